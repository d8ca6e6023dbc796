"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has symbols of a fixed alphabet (`SYMBOLS`) and order 3. Its counts are summed over shards of the trusted text and joined
order by order: trigrams with their contexts, bigram continuations with theirs, then unigrams. Documents meet the counts the same
way: they are dealt to shards of bounded size, each shard lists its distinct trigrams once, the lists are joined to the counts of
every order, and the joined rows go back to their shard, where every document adds up its own. No count table passes through the driver, and
a frequent trigram has one row per shard. A document's cross-entropy is compared with quantiles of the trusted documents of its language: it is rejected above
median + margin * (upper quantile - median). Short texts say little, so `prior` symbols at the language's median are
added to every text.

Counts and quantiles cover all trusted documents. A caller may ask for a fit on about `fit_rows` of them, picked by a hash of
the id; by default there is no such bound.

Defined results: a null or empty text has one symbol (its end) and is kept; a null language is a language of its own; a
language without trusted documents takes the quantiles over all languages; without trusted documents all texts are kept;
documents with several labels are trusted if none of them speaks against it; repeated rows get equal results; columns with other
names are kept by `keep_good` and otherwise not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.llm.common import bounded, same_document
from recspark.session import checkpointed

BITS = 7
SYMBOLS = 1 << BITS
EDGE = SYMBOLS - 1
BINS = 1000  # quantiles are taken of thousandths of a bit
SHARD_BYTES = 16 * 1024 * 1024  # of text


def _alphabet() -> np.ndarray:
    """Symbol of each code point: printable ASCII as it is, one for control characters, 31 for all others by remainder."""
    points = np.arange(0x110000)
    symbol = 96 + points % 31
    symbol[:127] = np.where(points[:127] < 32, 95, points[:127] - 32)
    return symbol.astype(np.uint8)


ALPHABET = _alphabet()


def trigrams(text: str | None) -> np.ndarray:
    """Number of every trigram of a text, with two edges before and one behind."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = np.full(len(points) + 3, EDGE, dtype=np.int32)
    symbols[2:-1] = ALPHABET[points]
    return symbols[:-2] << 2 * BITS | symbols[1:-1] << BITS | symbols[2:]


def count_trigrams(documents: DataFrame) -> DataFrame:
    """a, b, c, n summed over all texts; every task adds up its own shard first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, *np.unique(trigrams(text), return_counts=True))
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], ["gram", "n"])

    summed = documents.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return _parted(summed).drop("gram")


def _parted(grams: DataFrame) -> DataFrame:
    """Adds the symbols a, b, c of every trigram `gram`."""
    gram = F.col("gram")
    return grams.withColumns(
        {"a": F.shiftright(gram, 2 * BITS), "b": F.shiftright(gram, BITS).bitwiseAND(EDGE), "c": gram.bitwiseAND(EDGE)}
    )


def _discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """The counts with `share` (what is left of each after its discount, over the context's sum), and per context `rest`.

    Modified Kneser-Ney: one discount each for counts of one, two, and three or more.
    """
    seen = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (max(seen.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    cuts = [min(max(k - (k + 1) * y * more / own, 0.1), k) for k, own, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    n = F.col("n")
    cut = F.when(n == 1, cuts[0]).when(n == 2, cuts[1]).otherwise(cuts[2])
    sums = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")) if context else counts.agg(
        F.sum("n").alias("total"), F.sum(cut).alias("cut")
    )
    rest = sums.withColumn("rest", F.col("cut") / F.col("total"))
    joined = counts.join(rest, context) if context else counts.crossJoin(F.broadcast(rest))  # one row
    return joined.withColumn("share", (n - cut) / F.col("total")).drop("total", "cut", "rest"), rest.drop("total", "cut")


@dataclass(frozen=True)
class Model:
    """Discounted counts of every order, as tables: `share` of the seen n-grams, `rest` of their contexts."""

    three: DataFrame  # a, b, c, share
    two: DataFrame  # b, c, share
    one: DataFrame  # c, share
    after_two: DataFrame  # a, b, rest
    after_one: DataFrame  # b, rest
    unseen: float  # probability of each symbol before anything is known

    def rated(self, grams: DataFrame) -> DataFrame:
        """Adds `bits` to rows with a trigram `gram`, by a join with the counts of every order."""
        rows = _parted(grams).hint("merge")  # the trigram counts may be many; the other tables have SYMBOLS**2 rows at most
        for counts, on, value in (
            (self.three, ["a", "b", "c"], "share3"), (self.after_two, ["a", "b"], "rest3"), (self.two, ["b", "c"], "share2"),
            (self.after_one, ["b"], "rest2"), (self.one, ["c"], "share1"),
        ):
            rows = rows.join(counts.select(*on, F.col(counts.columns[-1]).alias(value)), on, "left")
        seen = {n: F.coalesce(f"share{n}", F.lit(0.0)) for n in (1, 2, 3)}
        rest = {n: F.coalesce(f"rest{n}", F.lit(1.0)) for n in (2, 3)}
        p = seen[3] + rest[3] * (seen[2] + rest[2] * (seen[1] + F.lit(self.unseen)))
        return rows.select(*grams.columns, (-F.log2(p)).cast("float").alias("bits"))


def train(trusted: DataFrame) -> Model:
    """The model of all trusted texts; only single numbers come to the driver."""
    three = checkpointed(count_trigrams(trusted))
    two = checkpointed(three.groupBy("b", "c").agg(F.count("*").alias("n")))
    one = checkpointed(two.groupBy("c").agg(F.count("*").alias("n")))
    (share3, rest3), (share2, rest2), (share1, rest1) = _discounted(three, ["a", "b"]), _discounted(two, ["b"]), _discounted(one, [])
    left = rest1.first()["rest"]
    tables = (
        share3.select("a", "b", "c", "share"), share2.select("b", "c", "share"), share1.select("c", "share"),
        rest3.select("a", "b", "rest"), rest2.select("b", "rest"),
    )
    return Model(*map(checkpointed, tables), (1.0 if left is None else left) / SYMBOLS)


def fit(trusted: DataFrame) -> np.ndarray:
    """Bits of every trigram there can be, at place a, b, c; to look at a whole model, documents are scored without it."""
    rows = train(trusted).rated(trusted.sparkSession.range(SYMBOLS**3).withColumnRenamed("id", "gram")).toPandas()
    bits = np.empty(SYMBOLS**3, dtype=np.float32)
    bits[rows["gram"]] = rows["bits"]
    return bits.reshape((SYMBOLS,) * 3)


def _dealt(documents: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text_hash, lang, text and shard, in shards of about SHARD_BYTES of text, and the number of shards."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "text")
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int")).repartition(shards, "shard"), shards


def _listed(dealt: DataFrame) -> DataFrame:
    """shard, gram: the distinct trigrams of every shard, once each; no shard lies in two tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(shard, np.zeros(SYMBOLS**3, dtype=bool))[trigrams(text)] = True
        for shard, marks in seen.items():
            grams = np.flatnonzero(marks)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), shard, np.int32)), pa.array(grams)], ["shard", "gram"])

    return dealt.mapInArrow(run, "shard int, gram long")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, lang, n_symbols, bits of every document.

    The trigrams of a shard are joined to the counts of all orders, and its documents read what came of them.
    """
    dealt, shards = _dealt(documents)
    rated = model.rated(_listed(dealt)).repartition(shards, "shard")

    def add_up(texts: pa.Table, grams: pa.Table) -> pa.Table:
        table = np.full(SYMBOLS**3, np.nan, dtype=np.float32)
        table[np.asarray(grams.column("gram"))] = np.asarray(grams.column("bits"))
        n, total = [], []
        for chunk in texts.column("text").chunks:
            for text in chunk.to_pylist():
                own = trigrams(text)
                n.append(len(own))
                total.append(float(table[own].sum(dtype=np.float64)))
        kept = [texts.column(c) for c in ("doc_id", "text_hash", "lang")]
        return pa.table([*kept, pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "text_hash", "lang", "n_symbols", "bits"])

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").cogroup(rated.groupBy("shard")).applyInArrow(
        add_up, f"doc_id {kind}, text_hash long, lang string, n_symbols long, bits double"
    )


def _quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles of `value` in thousandths, rounded up, from counts per value; no group is held in one task."""
    bins = rows.groupBy(*by, F.ceil(F.col(value) * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("bin") if by else Window.partitionBy(F.lit(0)).orderBy("bin")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(whole)})
    return ranked.groupBy(*by).agg(
        *[F.min(F.when(F.col("upto") >= F.col("all") * s, F.col("bin") / BINS)).alias(name) for name, s in shares.items()]
    )


def judge(
    documents: DataFrame, labels: DataFrame, fit_rows: int | None = None, upper: float = 0.9, margin: float = 5.0, prior: int = 100
) -> DataFrame:
    """doc_id, text_hash, lang, n_symbols, perplexity (per symbol), entropy (with the prior, in bits), threshold, keep."""
    trusted = checkpointed(
        labels.groupBy(F.col("doc_id").alias("__id")).agg(
            F.coalesce(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)), F.lit(False)).alias("trusted")
        ).filter("trusted AND __id IS NOT NULL")
    )
    chosen = trusted.select("__id")
    if fit_rows is not None:
        rate = min(1.0, fit_rows / max(trusted.count(), 1))
        chosen = chosen.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < rate * (1 << 30))
    sample = documents.select("doc_id", "text").join(bounded(chosen), F.col("doc_id") == F.col("__id"), "left_semi")
    scored = checkpointed(score(documents, train(sample)))
    known = scored.join(trusted, F.col("doc_id") == F.col("__id"), "left")
    known = checkpointed(
        known.select(
            "doc_id", "text_hash", "lang", "n_symbols", "bits",
            F.struct(F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("name")).alias("__lang"),
            F.coalesce("trusted", F.lit(False)).alias("trusted"), (F.col("bits") / F.col("n_symbols")).alias("plain"),
        )
    )
    good = known.filter("trusted")
    middle = bounded(checkpointed(_quantiles(good, ["__lang"], "plain", {"middle": 0.5})))  # one row per language
    overall = _quantiles(good, [], "plain", {"any_middle": 0.5})

    def smoothed(rows: DataFrame) -> DataFrame:
        rows = rows.join(middle, "__lang", "left").crossJoin(F.broadcast(overall))  # one row
        centre = F.coalesce("middle", "any_middle", F.lit(0.0))
        return rows.withColumn("entropy", (F.col("bits") + prior * centre) / (F.col("n_symbols") + prior))

    shares = {"q50": 0.5, "upper": upper}
    own = bounded(checkpointed(_quantiles(smoothed(good), ["__lang"], "entropy", shares)))
    every = _quantiles(smoothed(good), [], "entropy", {f"any_{k}": v for k, v in shares.items()})
    q50, top = F.coalesce("q50", "any_q50"), F.coalesce("upper", "any_upper")
    return (
        smoothed(known)
        .join(own, "__lang", "left")
        .crossJoin(F.broadcast(every))  # one row
        .withColumn("threshold", q50 + margin * (top - q50))
        .select(
            "doc_id", "text_hash", "lang", "n_symbols", F.pow(F.lit(2.0), F.col("plain")).alias("perplexity"), "entropy",
            "threshold", F.coalesce(F.col("entropy") <= F.col("threshold"), F.lit(True)).alias("keep"),
        )
    )


def keep_good(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents without the rejected ones."""
    bad = judge(documents, labels, **settings).filter("NOT keep").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang")
    )
    bad = bounded(checkpointed(bad.distinct()))
    return documents.join(bad, same_document(bad) & F.col("lang").eqNullSafe(bad["__lang"]), "left_anti")
