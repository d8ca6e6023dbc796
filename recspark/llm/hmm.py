"""Language-model scoring with a hidden Markov model, beside a unigram base score.

The frequent words are symbols of their own; every other word belongs to a class by its ending and is drawn inside the class by
its smoothed count, so each text has an exact likelihood. Baum-Welch runs in rounds, each over another part of the
training documents, and adds its expected counts to those of the parts before (incremental EM), so that the last model comes
from the counts of all of them: tasks run the scaled forward-backward recursion over their documents and add up expected counts, which
Spark sums. The scaled forward recursion then gives the likelihood of every text.

Every text is split into words once for the counts and once for its symbols, which are written as small integers; the first
guess, the rounds and the scores read those. Word counts cover all training documents. The counts of the `lookup` most frequent words go to every task; those of all
other words, which no hot key can be among, are joined. The first guess of the states comes from clusters of all training
documents, whose sums every task adds up.

Defined results: a null or empty text is the end token alone; repeated rows are scored, and learned from, as often as they
occur; a null answer to whether a row is learned from counts as no; without training documents every token has count 0; an
empty table gives no rows; ids may have any type, and columns besides `doc_id`, `text` and those that say what is learned from
are not looked at. Texts are read whole; of a very long one the forward values of `CELLS` steps are held at a time, and those
before are computed again from the borders between.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.langid import _clusters
from recspark.session import checkpointed

CELLS = 400_000  # tokens that are in work at once
SEEDS = 64  # distinct texts that the clusters of the first guess begin with
PASSES = 2  # passes of those clusters over all training documents
COUNTED = 500_000  # distinct words that a task holds before it hands them on


@dataclass
class Vocabulary:
    """What every task needs of the word counts; bounded by `lookup` words."""

    index: dict[bytes, int]  # rank of each of the most frequent words
    counts: np.ndarray  # their counts
    symbols: np.ndarray  # their symbols: the first `own` are symbols of their own
    own: int
    classes: int
    class_total: np.ndarray  # count of all words of a class + their number + 1
    unigram: np.ndarray  # share of every symbol
    tokens: int
    distinct: int
    ends: int

    @property
    def end(self) -> int:
        return self.own + self.classes

    @property
    def kind(self) -> np.dtype:
        """The integers that symbols are written as."""
        return np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def read(self, column: pa.Array) -> list[np.ndarray]:
        """Written symbol sequences."""
        return [np.frombuffer(b, dtype=self.kind) for b in column.to_pylist()]


def words(text: str | None) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return (text or "").encode().lower().split()


def ending(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(training: DataFrame, classes: int) -> DataFrame:
    """word, class, n over all training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(found)
            kinds = [ending(w, classes) for w in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(kinds, pa.int32()), pa.array(list(found.values()), pa.int64())],
                ["word", "class", "n"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words(text))
                if len(found) > COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    return training.select("text").mapInArrow(count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, documents: int, own: int, lookup: int, classes: int) -> Vocabulary:
    # The least count whose words, with all more frequent ones, are `lookup` at most; counts go by steps of an eighth octave.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = dict(counted.groupBy(step.alias("step")).agg(F.count("*")).collect())
    least, words_so_far = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        words_so_far += sizes[at]
        if words_so_far > lookup:
            break
        least = at
    top = counted.filter(step >= least).toPandas()
    top["word"] = top["word"].map(bytes)
    top = top.sort_values(["n", "word"], ascending=[False, True])
    ranked, times, kinds_of = top["word"].tolist(), top["n"].to_numpy(np.int64), top["class"].to_numpy(np.int64)
    own = min(own, len(ranked))
    symbols = np.where(np.arange(len(ranked)) < own, np.arange(len(ranked)), own + kinds_of)
    in_class, kinds = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
    for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_class[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    total, distinct = int(in_class.sum()), int(kinds.sum())
    np.subtract.at(in_class, kinds_of[:own], times[:own])
    np.subtract.at(kinds, kinds_of[:own], 1)
    share = np.concatenate([times[:own], in_class, [documents]]).astype(np.float64) + 1
    return Vocabulary(
        {w: i for i, w in enumerate(ranked)}, times, symbols, own, classes, in_class + kinds + 1, share / share.sum(),
        total + documents, distinct + (documents > 0), documents,
    )


def ranks_of(found: list[bytes], v: Vocabulary) -> np.ndarray:
    """Rank of every word, -1 for rare ones."""
    return np.fromiter(map(v.index.get, found, repeat(-1)), dtype=np.int64, count=len(found))


def symbols_of(found: list[bytes], v: Vocabulary, ranks: np.ndarray | None = None) -> np.ndarray:
    ranks = ranks_of(found, v) if ranks is None else ranks
    out = np.full(len(found) + 1, v.end, dtype=v.kind)
    common = ranks >= 0
    out[:-1][common] = v.symbols[ranks[common]]
    for i in np.flatnonzero(~common).tolist():
        out[i] = v.own + ending(found[i], v.classes)
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def batches_of(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of the sequences in groups of like length, so that padding stays small."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size = max(1, CELLS // len(texts[order[at]]))
        yield order[at : at + size]
        at += size


def _padded(texts: list[np.ndarray], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by step and sequence (the longest first), and how many sequences reach each step."""
    lengths = np.array([len(texts[i]) for i in group])
    grid = np.zeros((lengths[0], len(group)), dtype=texts[group[0]].dtype)
    for column, i in enumerate(group):
        grid[: len(texts[i]), column] = texts[i]
    alive = len(group) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    return grid, alive


def forward(
    grid: np.ndarray, alive: np.ndarray, model: Model, before: np.ndarray | None = None, keep: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural log likelihood of each sequence and the last scaled forward values; with `keep` also all of them and the scales.

    `before` are the forward values of the step before, if the grid goes on from there.
    """
    logs = np.zeros(grid.shape[1])
    alphas = np.zeros((*grid.shape, len(model.start))) if keep else None
    scales = np.ones(grid.shape) if keep else None
    alpha = np.broadcast_to(model.start, (grid.shape[1], len(model.start))) if before is None else before
    for t in range(len(grid)):
        n = alive[t]
        alpha = (alpha[:n] if before is None and not t else alpha[:n] @ model.move) * model.emit[grid[t, :n]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        logs[:n] += np.log(scale)
        if keep:
            alphas[t, :n], scales[t, :n] = alpha, scale
    return logs, alpha, alphas, scales


def expected(texts: list[np.ndarray], model: Model, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log likelihood.

    Forward values are kept for at most `cells` tokens; those of the parts before are computed again from the last ones of each.
    """
    start, move, emit, total = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit), 0.0
    for group in batches_of(texts):
        grid, alive = _padded(texts, group)
        steps = max(1, cells // len(group))
        parts = [slice(at, at + steps) for at in range(0, len(grid), steps)]
        befores = [None]
        for part in parts[:-1]:
            befores.append(forward(grid[part], alive[part], model, befores[-1])[1])
        beta = np.ones((alive[-1], len(model.start)))
        for part, before in zip(reversed(parts), reversed(befores)):
            here, left = grid[part], alive[part]
            logs, _, alphas, scales = forward(here, left, model, before, True)
            total += logs.sum()
            for t in range(len(here) - 1, -1, -1):
                n = left[t]
                if n > len(beta):  # sequences that end here
                    beta = np.concatenate([beta, np.ones((n - len(beta), beta.shape[1]))])
                onward = model.emit[here[t, :n]] * beta / scales[t, :n, None]
                alphas[t, :n] *= beta
                previous = alphas[t - 1] if t else before
                if previous is not None:
                    # What came before: sequences n.. ended before this step.
                    move += previous[:n].T @ onward
                    beta = onward @ model.move.T
            if before is None:
                start += alphas[0].sum(axis=0)
            inside = np.arange(here.shape[1])[None] < left[:, None]
            seen, weight = here[inside], alphas[inside]
            for s in range(emit.shape[1]):
                emit[:, s] += np.bincount(seen, weights=weight[:, s], minlength=len(emit))
    return start, move * model.move, emit, total


def _unit(counts: np.ndarray) -> np.ndarray:
    """Rows of symbol counts as vectors of length one, damped by the square root."""
    unit = np.sqrt(counts)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _guess(training: DataFrame, v: Vocabulary, states: int) -> np.ndarray:
    """Emissions of each state from clusters of all training documents (hash, symbols); every task adds up its own."""
    spark, size = training.sparkSession, v.end + 1
    # Distinct texts to begin with; where the clusters end is up to the passes over all documents.
    least = training.select("hash").distinct().orderBy("hash").limit(SEEDS)
    first = training.join(F.broadcast(least), "hash", "left_semi").groupBy("hash").agg(F.min("symbols").alias("symbols")).orderBy("hash").toArrow()
    out = np.zeros((states, size))
    if not first.num_rows:
        return out
    counts = [np.bincount(x, minlength=size) for x in v.read(first.column("symbols"))]
    centre, _ = _clusters(_unit(np.array(counts, dtype=np.float32)), states, 10, 0.0)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast((np.asarray(centre, dtype=np.float32), v))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, v = shared.value
            sums = np.zeros((2, len(centre), size))
            for batch in batches:
                for symbols in v.read(batch.column(0)):
                    some, n = np.unique(symbols, return_counts=True)
                    unit = np.sqrt(n)
                    unit /= np.linalg.norm(unit)
                    near = (centre[:, some] @ unit).argmax()
                    sums[0, near, some] += unit
                    sums[1, near, some] += n
            flat = sums.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "n"])

        found = training.select("symbols").mapInArrow(add_up, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(2 * len(centre) * size)
        flat[found["place"]] = found["n"]
        near, sums = flat.reshape(2, len(centre), size)
        length = np.linalg.norm(near, axis=1, keepdims=True)
        centre = np.where(length > 0, near / np.where(length > 0, length, 1), centre)  # an empty cluster stays where it was
        shared.unpersist()
    out[: len(sums)] = sums
    return out


def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, v: Vocabulary, pseudo: float) -> Model:
    """Probabilities from counts (emit: symbol x state); nothing gets probability 0."""
    emit = emit + pseudo * v.unigram[:, None]
    start, move = start + 1, move + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(training: DataFrame, v: Vocabulary, states: int, rounds: int, pseudo: float) -> Model:
    """The model of the training documents (doc_id, hash, symbols)."""
    spark = training.sparkSession
    size = v.end + 1
    guess = _guess(training, v, states)
    flat = np.ones(states)
    model = normalised(flat, np.eye(states) * 30 * states, guess.T, v, pseudo)
    totals = np.zeros(states + states * states + size * states)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model, v))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, v = shared.value
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            for batch in batches:
                held: list[np.ndarray] = []
                tokens = 0
                texts = v.read(batch.column(0))
                for i, text in enumerate(texts):
                    held.append(text)
                    tokens += len(held[-1])
                    if tokens > 10 * CELLS or i == len(texts) - 1:
                        a, b, c, _ = expected(held, model)
                        start, move, emit = start + a, move + b, emit + c
                        held, tokens = [], 0
            flat = np.concatenate([start, move.ravel(), emit.ravel()])
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "n"])

        part = training.filter(F.pmod(F.xxhash64("doc_id", "hash", F.lit("round")), F.lit(rounds)) == turn).select("symbols")
        found = part.mapInArrow(add_up, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        if len(found):
            # Counts of the parts before stay, so that the last model is of all parts.
            totals[found["place"]] += found["n"]
            start, move, emit = np.split(totals, [states, states + states * states])
            model = normalised(start, move.reshape(states, states), emit.reshape(size, states), v, pseudo)
        shared.unpersist()
    return model


def encoded(documents: DataFrame, v: Vocabulary) -> DataFrame:
    """The documents (doc_id, text, learns) as symbols, with what the base score needs.

    row (a number of its own), doc_id, learns, hash (of the text), n_tokens, known, logs, path (of the words inside their classes), rare
    and times (words beyond the lookup), symbols (written integers).
    """
    shared = documents.sparkSession.sparkContext.broadcast(v)
    names = ["row", "n_tokens", "known", "logs", "path", "rare", "times", "symbols"]
    whole, real, word = pa.int64(), pa.float64(), pa.binary()
    kinds = [whole, whole, whole, real, real, pa.list_(word), pa.list_(whole), word]

    def run(texts: list[str | None], first: int) -> list[pa.Array]:
        v = shared.value
        count_logs, class_logs = np.log10(v.counts + 1.0), np.log10(v.class_total)
        out = []
        for n, text in enumerate(texts):
            found = words(text)
            ranks = ranks_of(found, v)
            sequence = symbols_of(found, v, ranks)
            common = ranks[ranks >= 0]
            rare = Counter([found[i] for i in np.flatnonzero(ranks < 0).tolist()])
            logs = float(count_logs[common].sum() + np.log10(v.ends + 1.0))
            # Inside its class a word has (count + 1) / class_total; counts of the rare ones are added after the join.
            classed = sequence[:-1][sequence[:-1] >= v.own].astype(np.int64) - v.own
            inside = float(count_logs[common[common >= v.own]].sum() - class_logs[classed].sum())
            known = len(common) + (v.ends > 0)
            out.append((first + n, len(found) + 1, known, logs, inside, list(rare), list(rare.values()), sequence.tobytes()))
        return [pa.array(c, t) for c, t in zip(zip(*out), kinds)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                more = run(part.column("text").to_pylist(), row)
                same = [part.column(c) for c in ("doc_id", "learns", "hash")]
                yield pa.RecordBatch.from_arrays([*same, *more], ["doc_id", "learns", "hash", *names])
                row += part.num_rows

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, learns boolean, hash long, row long, n_tokens long, known long, logs double, path double, "
        "rare array<binary>, times array<long>, symbols binary"
    )
    return checkpointed(documents.select("doc_id", "learns", F.xxhash64("text").alias("hash"), "text").mapInArrow(scan, schema))


def score(
    documents: DataFrame, learns: Column, states: int = 8, rounds: int = 4, own: int = 8192, lookup: int = 150_000,
    classes: int = 1024, pseudo: float = 100.0,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; logarithms to base 10. `learns` says which rows train."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    training = rows.filter("learns")
    counted = checkpointed(count_words(training, classes))
    v = vocabulary(counted, training.count(), own, lookup, classes)
    coded = encoded(rows, v)
    model = train(coded.filter("learns").select("doc_id", "hash", "symbols"), v, states, rounds, pseudo)
    shared = spark.sparkContext.broadcast((model, v))
    names = ["doc_id", "row", "n_tokens", "known", "logs", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, v = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sequences, path = v.read(part.column("symbols")), np.array(part.column("path"))
                for group in batches_of(sequences):
                    path[group] += forward(*_padded(sequences, group), model)[0] / np.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], pa.array(path)], names)

    id_type = coded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row long, n_tokens long, known long, logs double, path double"
    scored = coded.select(*names, "symbols").mapInArrow(run, schema)
    asked = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), "w.times")
    rare = (
        asked.join(counted.select("word", "n"), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    more = F.coalesce("more_logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.distinct + 1)))).alias("base_score"),
        (F.col("path") + more).alias("score"),
    )
