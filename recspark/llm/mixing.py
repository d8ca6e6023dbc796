"""Mixing sources to target weights.

The words of each source are laid end to end and packed into blocks of fixed length. Every output shard draws how many
of its slots each source fills (multinomial, one generator per shard). The j-th slot of a source takes block
`permutation(j)` of that source, a keyed pseudorandom permutation per pass over the source, and slots meet the pieces of
documents by block number.

Defined results: null texts and texts without words have size 0 and are never taken; a null source is a source of its own,
last in order; repeated rows count as separate documents; an empty table gives an empty mix; columns besides `doc_id`,
`text` and `source` are not looked at. Very long texts only make more pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recspark.llm.common import SPACED_WORD, chunks_for, permuted, running_sum
from recspark.session import checkpointed

MAX_SOURCES = 10_000


@dataclass
class Source:
    """One source: bounded in number, so the plan of all of them fits the driver and every task."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int = 0
    last: int = 0  # words in the last block
    slots: int = 0  # slots that reach the target
    cut: int = 0  # words that the last of them leaves out


@dataclass
class Mixture:
    documents: DataFrame  # doc_id, source, size, text_hash, number, before: where a document starts in its source
    sources: list[Source]
    slots: DataFrame  # shard, slot, number, pass_no, block, words
    block_words: int


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of all sizes by weight; what lies above `most` times a size goes to the others by weight."""
    total, caps = sum(sizes), [most * s for s in sizes]
    capped = {i for i, s in enumerate(sizes) if s == 0}
    while True:
        left = total - sum(caps[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = {i: left * w / weight for i, w in enumerate(weights) if i not in capped}
        above = {i for i, t in share.items() if t > caps[i]}
        if not above:
            return [float(caps[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= above


def _permutation_key(seed: int, number: int, pass_no: int | np.ndarray) -> np.ndarray:
    return np.uint64(seed * 1_000_003 + number * 8191) + np.asarray(pass_no).astype(np.uint64)


def _fill(source: Source, block_words: int, seed: int) -> None:
    """Numbers the slots that a source needs, counting the pass in which its short last block comes."""
    if not source.size:
        return
    source.blocks = -(-source.size // block_words)
    source.last = source.size - (source.blocks - 1) * block_words
    wanted = round(source.target)
    passes = -(-wanted // source.size) + 1
    short = [
        p * source.blocks
        + int(permuted(np.array([source.blocks - 1]), source.blocks, _permutation_key(seed, source.number, p), True)[0])
        for p in range(passes)
    ]

    def words(slots: int) -> int:
        return slots * block_words - (block_words - source.last) * sum(s < slots for s in short)

    source.slots = wanted // block_words
    while words(source.slots) < wanted:
        source.slots += 1
    source.cut = words(source.slots) - wanted


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3,
    block_words: int = 256,
    shard_slots: int = 256,
    seed: int = 17,
) -> Mixture:
    """Plan the mix. `weights` go round over the sources in code point order; no source is taken more than `most` times."""
    spark = documents.sparkSession
    sized = checkpointed(
        documents.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("text_hash"),
        )
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    sources = [Source(i, r["source"], r["size"], t) for i, (r, t) in enumerate(zip(found, aims))]
    for source in sources:
        _fill(source, block_words, seed)

    schema = "source string, number int"
    numbers = F.broadcast(spark.createDataFrame([(s.name, s.number) for s in sources], schema))
    count = chunks_for(sized.count())
    placed = running_sum(
        sized.join(numbers.withColumnRenamed("source", "__name"), F.col("source").eqNullSafe(F.col("__name")))
        .drop("__name")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(count))),
        "number", "chunk", ["doc_id", "text_hash"], "size", "before",
    ).drop("chunk")
    return Mixture(placed, sources, _slots(documents, sources, block_words, shard_slots, seed), block_words)


def _slots(documents: DataFrame, sources: list[Source], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    spark = documents.sparkSession
    quotas = np.array([s.slots for s in sources], dtype=np.int64)
    wanted = int(quotas.sum())
    shards = -(-wanted // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = int(min(shard_slots, wanted - shard * shard_slots))
                drawn = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(slots, quotas / wanted)
                hit = np.flatnonzero(drawn)
                first = np.cumsum(drawn) - drawn
                yield pd.DataFrame({"shard": shard, "number": hit.astype(np.int32), "drawn": drawn[hit], "first": first[hit]})

    drawn = checkpointed(
        spark.range(shards).mapInPandas(draw, "shard long, number int, drawn long, first long")
    )
    totals = np.zeros(len(sources), dtype=np.int64)
    for r in drawn.groupBy("number").agg(F.sum("drawn").alias("n")).collect():
        totals[r["number"]] = r["n"]
    # The draws only come near the quotas: sources drawn too often hand the surplus, picked pseudorandomly, to the others.
    surplus, lack = np.maximum(totals - quotas, 0), np.maximum(quotas - totals, 0)
    surplus_from, lack_to = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = batch["drawn"].to_numpy()
            starts = np.repeat(np.cumsum(counts) - counts, counts)
            nth = np.arange(counts.sum()) - starts
            number = np.repeat(batch["number"].to_numpy(), counts).astype(np.int64)
            index = np.repeat(batch["before"].to_numpy(), counts) + nth
            shard = np.repeat(batch["shard"].to_numpy(), counts)
            place = np.repeat(batch["first"].to_numpy(), counts) + nth
            for n in np.unique(number):
                if surplus[n]:
                    mine = np.flatnonzero(number == n)
                    index[mine] = permuted(index[mine], int(totals[n]), seed + 7919 * int(n))
            over = np.flatnonzero(index >= quotas[number])
            nth_over = surplus_from[number[over]] + index[over] - quotas[number[over]]
            number[over] = np.searchsorted(lack_to, nth_over, side="right")
            index[over] = totals[number[over]] + nth_over - (lack_to - lack)[number[over]]
            pass_no, block, words = np.zeros_like(index), np.zeros_like(index), np.zeros_like(index)
            for n in np.unique(number):
                source, mine = sources[n], np.flatnonzero(number == n)
                pass_no[mine] = index[mine] // source.blocks
                keys = _permutation_key(seed, int(n), pass_no[mine])
                block[mine] = permuted(index[mine] % source.blocks, source.blocks, keys)
                words[mine] = np.where(block[mine] == source.blocks - 1, source.last, block_words)
                words[mine] -= np.where(index[mine] == source.slots - 1, source.cut, 0)
            # Sources take turns within a shard.
            slot = np.empty_like(place)
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                full = int(min(shard_slots, wanted - s * shard_slots))
                slot[mine] = permuted(place[mine], full, seed + 104_729 * int(s))
            yield pd.DataFrame(
                {"shard": shard, "slot": slot, "number": number.astype(np.int32), "pass_no": pass_no, "block": block, "words": words}
            )

    placed = running_sum(
        drawn.withColumn("chunk", F.floor(F.col("shard") / 4096)), "number", "chunk", ["shard"], "drawn", "before"
    )
    return placed.select("shard", "number", "drawn", "first", "before").mapInPandas(
        fill, "shard long, slot long, number int, pass_no long, block long, words long"
    )


def _pieces(mixture: Mixture) -> DataFrame:
    """One row per document and block it lies in: where the piece starts in the document and in the block."""
    size, before, length = F.col("size"), F.col("before"), mixture.block_words
    rows = mixture.documents.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"before div {length}"), F.expr(f"(before + size - 1) div {length}")))
    )
    start = F.greatest(F.col("block") * length, before)
    end = F.least((F.col("block") + 1) * length, before + size)
    return rows.withColumns(
        {"first_word": start - before, "at": start - F.col("block") * length, "n_words": end - start}
    )


def spans(mixture: Mixture) -> DataFrame:
    """The mix as spans of documents: shard, slot, at (place in the block), doc_id, before, first_word, n_words."""
    pieces = _pieces(mixture).select("number", "block", "doc_id", "before", "first_word", "at", "n_words")
    return (
        mixture.slots.join(pieces, ["number", "block"])
        .withColumn("n_words", F.least("n_words", F.col("words") - F.col("at")))
        .filter("n_words > 0")
        .drop("words")
    )


def taken(mixture: Mixture) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target and the words that the mix takes, repeats counted."""
    spark = mixture.documents.sparkSession
    sources = F.broadcast(
        spark.createDataFrame(
            [(s.number, s.size, s.target) for s in mixture.sources], "number int, source_size long, target double"
        )
    )
    # A source and a starting word name a document that has words.
    words = spans(mixture).groupBy("number", F.col("before").alias("__at")).agg(F.sum("n_words").alias("taken"))
    documents = mixture.documents.withColumn("__at", F.expr("if(size > 0, before, null)"))
    return (
        documents.join(words, ["number", "__at"], "left")
        .join(sources, "number")
        .select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def texts(mixture: Mixture, documents: DataFrame) -> DataFrame:
    """The mixed texts: one row per span with its words joined by single spaces; extra columns: doc_id and source."""
    length = mixture.block_words
    places = mixture.documents.filter("size > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "number", "before"
    )
    found = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(["doc_id", "text_hash"])
    # A row per place of a document, so that one that is repeated very often is no large row.
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    rows = found.join(places, same).select("doc_id", "text", "number", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text, number, before in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                for block in range(before // length, (before + len(words) - 1) // length + 1):
                    start, end = max(block * length, before), min((block + 1) * length, before + len(words))
                    piece = b" ".join(words[start - before : end - before])
                    out.append((doc_id, number, block, start - block * length, end - start, start - before, piece.decode()))
                    held += len(piece)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names = ["doc_id", "number", "block", "at", "n_words", "first_word", "piece"]
    id_type = rows.schema["doc_id"].dataType
    kinds = [to_arrow_type(id_type), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    pieces = rows.mapInArrow(
        cut, f"doc_id {id_type.simpleString()}, number int, block long, at long, n_words long, first_word long, piece string"
    )
    names_of = F.broadcast(
        documents.sparkSession.createDataFrame([(s.number, s.name) for s in mixture.sources], "number int, source string")
    )
    keep = F.col("words") - F.col("at")
    text = F.when(F.col("n_words") <= keep, F.col("piece")).otherwise(
        F.array_join(F.slice(F.split("piece", " "), 1, F.greatest(keep, F.lit(0)).cast("int")), " ")
    )
    return (
        mixture.slots.join(pieces, ["number", "block"])
        .filter(keep > 0)
        .join(names_of, "number")
        .select(
            "shard", "slot", "at", "doc_id", "source", "pass_no", "first_word",
            F.least("n_words", keep).alias("n_words"), text.alias("text"),
        )
    )
