"""Hard negatives: exact integer scores of anchor-by-row tiles by Strassen's recursion, and bounded heaps that are merged.

Anchors and rows are dealt to blocks by a hash of their ids; a block of anchors meets a block of rows in one task. The tile of
scores is the product of two int64 matrices, zero-padded to what the recursion can halve: seven products of halves in place of
eight, with exact integer additions. (Integers wrap alike in all steps, so sums inside the recursion cannot spoil a score that
fits a long.) A first pass keeps a heap of the best rows of the anchor's label per anchor and tile; heaps of up to `FAN_IN`
blocks are merged at a time until one is left. The positives of an anchor fix a window of scores each, and a second pass keeps
a heap of the best rows of other labels inside each window, merged the same way. No task holds more than two blocks and a tile,
and no merge more than `FAN_IN` heaps, however many rows a label or an anchor has.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part, nor do
vectors of a length (after scaling) of 2^28 or more, whose scores need not fit a long; vectors of unequal length are filled up with zeros, and an empty
one scores 0 everywhere; of repeated ids the row with the least label, then vector, counts; equal scores go by the smaller id;
anchors without positives, or windows without rows, give no rows; an empty table gives none; columns besides `vec_id`,
`embedding` and `label` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.session import checkpointed

ROWS = 8192  # rows of a block
ANCHORS = 512  # anchors of a block
FAN_IN = 64  # heaps that one merge takes
LEAF = 32  # sides that are multiplied without a further split
LONGEST = 2.0**28
HEAP = "array<struct<loss: long, vec_id: long>>"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices of any shapes that fit."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    levels, side = 0, max(1, min(rows, inner, columns))
    while side > leaf:
        levels, side = levels + 1, (side + 1) // 2
    unit = 1 << levels

    def padded(m: np.ndarray) -> np.ndarray:
        return np.pad(m, [(0, -n % unit) for n in m.shape])

    def product(x: np.ndarray, y: np.ndarray, levels: int) -> np.ndarray:
        if not levels:
            return x @ y
        r, k, c = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
        x11, x12, x21, x22 = x[:r, :k], x[:r, k:], x[r:, :k], x[r:, k:]
        y11, y12, y21, y22 = y[:k, :c], y[:k, c:], y[k:, :c], y[k:, c:]
        m1 = product(x11 + x22, y11 + y22, levels - 1)
        m2 = product(x21 + x22, y11, levels - 1)
        m3 = product(x11, y12 - y22, levels - 1)
        m4 = product(x22, y21 - y11, levels - 1)
        m5 = product(x11 + x12, y22, levels - 1)
        m6 = product(x21 - x11, y11 + y12, levels - 1)
        m7 = product(x12 - x22, y21 + y22, levels - 1)
        out = np.empty((2 * r, 2 * c), dtype=np.int64)
        out[:r, :c] = m1 + m4 - m5 + m7
        out[:r, c:] = m3 + m5
        out[r:, :c] = m2 + m4
        out[r:, c:] = m1 - m2 + m3 + m6
        return out

    if not inner:
        return np.zeros((rows, columns), dtype=np.int64)
    return product(padded(a), padded(b), levels)[:rows, :columns]


def usable(embeddings: DataFrame, relabel: int = 7, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (longs) of the rows that take part. Every `relabel`-th id gets the next of ten labels."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(~bad)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v * float(scale * scale)))
    rows = rows.filter(norm < LONGEST)
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("x", lambda v: F.floor(v * float(scale)).cast("long"))
    least = rows.groupBy("vec_id").agg(F.min(F.struct(label.alias("label"), vector.alias("vector"))).alias("r"))
    return checkpointed(least.select("vec_id", "r.label", "r.vector"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    column = column.combine_chunks()
    flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    width = int(ends.max(initial=0))
    if (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), dtype=np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _scores(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    a, b = _matrix(anchors.column("anchor")), _matrix(rows.column("vector"))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, [(0, 0), (0, width - m.shape[1])]) for m in (a, b))
    return strassen(a, np.ascontiguousarray(b.T))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest scores, negated, with their ids; ties by the smaller id."""
    if len(scores) > k:
        inside = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[inside], ids[inside]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip((-scores[order]).tolist(), ids[order].tolist()))


def _tiles(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, kernel, extra: list[str]) -> DataFrame:
    """Runs the kernel on every tile: anchor_id, nth, block, heap."""

    def other(own: str, count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(own)

    def of(count: int, own: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(own)

    # The two sides stem from one table, so no column keeps a common name.
    left = anchors.select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("anchor"), *extra,
        of(groups, "group"), other("with_block", blocks),
    )
    right = rows.select("vec_id", "label", "vector", of(blocks, "block"), other("with_group", groups))
    schema = f"anchor_id long, nth int, block int, heap {HEAP}"

    def run(asked: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and items.num_rows:
            block = items.column("block")[0].as_py()
            out = [(anchor, nth, block, heap) for anchor, nth, heap in kernel(asked, items) if heap]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("loss", pa.int64()), ("vec_id", pa.int64())]))]
        columns = list(zip(*out)) if out else [[]] * 4
        heaps = [[{"loss": loss, "vec_id": i} for loss, i in heap] for heap in columns[3]]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip([*columns[:3], heaps], kinds)], names=["anchor_id", "nth", "block", "heap"]
        )

    return left.groupBy("group", "with_block").cogroup(right.groupBy("with_group", "block")).applyInArrow(run, schema)


def merged(heaps: DataFrame, keys: list[str], blocks: int, k: int) -> DataFrame:
    """One heap per key: the k least of all its blocks. A merge takes at most FAN_IN heaps of k entries."""
    while True:
        blocks = -(-blocks // FAN_IN)
        heaps = (
            heaps.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))
            .groupBy(*keys, "block")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, k).alias("heap"))
        )
        if blocks <= 1:
            return heaps.drop("block")


def mine(
    embeddings: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between `low` and `high` hundredths of the positive's.
    """
    rows = usable(embeddings)
    is_anchor = F.col("vec_id") % anchor_every == 0
    anchors = rows.filter(is_anchor)
    blocks, groups = max(1, -(-rows.count() // rows_per_block)), max(1, -(-anchors.count() // anchors_per_block))

    def nearest(asked: pa.Table, items: pa.Table):
        scores = _scores(asked, items)
        ids, labels = np.asarray(items.column("vec_id")), np.asarray(items.column("label"))
        for i, (anchor, label) in enumerate(zip(asked.column("anchor_id").to_pylist(), asked.column("anchor_label").to_pylist())):
            same = np.flatnonzero((labels == label) & (ids != anchor))
            yield anchor, 0, _best(scores[i, same], ids[same], positives)

    heaps = merged(_tiles(anchors, rows, blocks, groups, nearest, []), ["anchor_id", "nth"], blocks, positives)
    heaps = checkpointed(heaps.select(F.col("anchor_id").alias("vec_id"), F.col("heap").alias("near")))

    def windows(asked: pa.Table, items: pa.Table):
        scores = _scores(asked, items)
        ids, labels = np.asarray(items.column("vec_id")), np.asarray(items.column("label"))
        columns = [asked.column(c).to_pylist() for c in ("anchor_id", "anchor_label", "near")]
        for i, (anchor, label, near) in enumerate(zip(*columns)):
            other = np.flatnonzero(labels != label)
            row, others = scores[i, other] * 100, ids[other]
            for nth, positive in enumerate(near):
                score = -positive["loss"]
                inside = np.flatnonzero((row >= low * score) & (row <= high * score))
                best = _best(row[inside], others[inside], negatives)
                yield anchor, nth, [(loss // 100, i) for loss, i in best]

    with_heaps = anchors.join(heaps, "vec_id")
    found = merged(_tiles(with_heaps, rows, blocks, groups, windows, ["near"]), ["anchor_id", "nth"], blocks, negatives)
    pairs = heaps.select(F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("nth", "positive"))
    return (
        found.select("anchor_id", "nth", F.posexplode("heap").alias("place", "negative"))
        .join(pairs, ["anchor_id", "nth"])
        .select(
            "anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("place") + 1).alias("rank"),
            F.col("negative.vec_id").alias("negative_id"), (-F.col("positive.loss")).alias("positive_score"),
            (-F.col("negative.loss")).alias("negative_score"),
        )
    )
