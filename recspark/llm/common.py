"""What several operators of the subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recspark.session import checkpointed

SPACED_WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000
ROWS_PER_PART = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front of them until none is one of the columns (upper and lower case count as equal)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def bounded(rows: DataFrame) -> DataFrame:
    """A written table of few columns, broadcast if its row count is within BROADCAST_ROWS; else Spark joins by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def same_document(rows: DataFrame) -> Column:
    """Whether a document is the one that the columns __id and __hash (of the text) name."""
    return F.col("doc_id").eqNullSafe(rows["__id"]) & (F.xxhash64("text") == rows["__hash"])


def chunks_for(rows: int, per_chunk: int = 20_000) -> int:
    return max(1, -(-rows // per_chunk))


def running_sum(rows: DataFrame, group: str, chunk: str, order: list[str], value: str, before: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each one in its group, ordered by chunk, then by `order`.

    No task holds a group: sums per chunk are added up first (one row per chunk), then rows within a chunk. Rows that
    tie in everything may change places among themselves.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    ahead = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__g", "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__g": F.struct(F.col(group).isNull(), key), "__c": F.col(chunk)})
    sums = rows.groupBy("__g", "__c").agg(F.sum(value).alias("__s"))
    starts = sums.select("__g", "__c", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__start"))
    return (
        rows.join(starts, ["__g", "__c"])
        .withColumn(before, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__g", "__c", "__start")
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `place` (from 0 in its tree, in `order`, which must tell all rows of a tree apart) and `n` (leaves of the tree)."""
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, nth long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nths = []
            for now in batch.column("tree").to_pylist():
                tree, nth = now, nth + 1 if now == tree else 0
                nths.append(nth)
            more = [pa.array([part] * len(nths), pa.int32()), pa.array(nths, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "part", "nth"])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_PART + 1)
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = checkpointed(dealt.mapInArrow(number, schema))
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    # One row per part and tree, never one per leaf.
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(
        counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(tree).alias("n"))
    )
    return dealt.join(bounded(starts), ["tree", "part"]).select(*names, (F.col("start") + F.col("nth")).alias("place"), "n")


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _rounds(values: np.ndarray, keys: np.ndarray, half: int, numbers: range) -> np.ndarray:
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = values >> shift, values & mask
    for n in numbers:
        with np.errstate(over="ignore"):
            if numbers.step > 0:
                left, right = right, left ^ (mixed(right ^ mixed(keys + np.uint64(n))) & mask)
            else:
                left, right = right ^ (mixed(left ^ mixed(keys + np.uint64(n))) & mask), left
    return (left << shift) | right


def permuted(index: np.ndarray, size: int, key: int | np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1: a four-round Feistel network that walks on until it is inside."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    numbers = range(3, -1, -1) if inverse else range(4)
    keys = np.broadcast_to(np.asarray(key, dtype=np.uint64), np.shape(index)).copy()
    out = _rounds(np.asarray(index).astype(np.uint64), keys, half, numbers)
    outside = np.flatnonzero(out >= np.uint64(size))
    while len(outside):
        out[outside] = _rounds(out[outside], keys[outside], half, numbers)
        outside = outside[out[outside] >= np.uint64(size)]
    return out.astype(np.int64)
