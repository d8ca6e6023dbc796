"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most `radius` bits are linked. Of `pieces` pieces of a fingerprint, `pieces - radius` are
equal for every such pair, so all pairs meet in a bucket of some choice of pieces; nothing is lost. Rows of a bucket lie
next to each other in a task, which stores bit plane k of all of them as one row of machine words. Shifting the planes by d
and XOR-ing gives bit k of the differences of 64 pairs at a time; carry-save counters add them up, and words in which every
pair has exceeded the radius are abandoned. A bucket gives a spanning forest of its links, never all pairs.

Defined results: null texts and texts without words have fingerprint zero and are linked like any other; fewer words than a
shingle are one shingle; repeated rows stay and share a component; null ids take no part in the smallest id (null if there
is no other); an empty table gives no rows; columns besides `doc_id` and `text` are not looked at. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import bounded, same_document
from recspark.llm.components import components
from recspark.session import checkpointed

BATCH = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of the text, A-Z lower-cased; bytes.split() splits on ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: bytes | None, width: int) -> int:
    """Bit k is set if it is set in over half the hashes."""
    hashes = shingle_hashes(text or b"", width)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash, fingerprint (64 bits as a long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                ["doc_id", "text_hash", "fingerprint"],
            )

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, text_hash long, fingerprint long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit plane k of all values as row k of 64-bit words, with spare words at the end for shifts."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(values) // 64) + 2
    padded = np.zeros((64, words * 8), dtype=np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def near_pairs(planes: np.ndarray, shift: int, candidates: np.ndarray, radius: int) -> np.ndarray:
    """Of the rows i in `candidates` those whose value differs from that of row i + shift in at most `radius` bits."""
    words = np.unique(candidates >> 6)
    alive = np.zeros(len(words), dtype=np.uint64)
    np.bitwise_or.at(alive, np.searchsorted(words, candidates >> 6), np.uint64(1) << (candidates & 63).astype(np.uint64))
    jump, rest = shift >> 6, np.uint64(shift & 63)
    # Counters start so that the carry out of the last one means "over the radius".
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    counters = [np.full(len(words), ONES if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    last = planes.shape[1] - 1
    for k in range(64):
        plane = planes[k]
        other = plane[np.minimum(words + jump, last)] >> rest
        if rest:
            other = other | (plane[np.minimum(words + jump + 1, last)] << (np.uint64(64) - rest))
        carry = plane[words] ^ other
        for c in range(depth):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        alive &= ~carry
        if k % 8 == 7:
            kept = np.flatnonzero(alive)
            if not len(kept):
                return kept
            if len(kept) < len(words):  # the other blocks are abandoned
                words, alive, counters = words[kept], alive[kept], [c[kept] for c in counters]
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def forest(values: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Root row of every row: rows that a chain of links inside their bucket connects share the least of them.

    `values` holds the buckets one after the other, the largest first; `sizes` are their numbers of rows.
    """
    root, planes = np.arange(len(values)), planes_of(values)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    reach = np.cumsum(sizes)
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        rows = reach[np.searchsorted(-sizes, -shift, side="left") - 1]  # rows in buckets of more than `shift` rows
        left, right = slice(0, rows - shift), slice(shift, rows)
        candidates = np.flatnonzero((bucket[left] == bucket[right]) & (root[left] != root[right]))
        if not len(candidates):
            continue
        first = near_pairs(planes, shift, candidates, radius)
        first = first[np.isin(first, candidates, assume_unique=True)]
        while len(first):
            a, b = root[first], root[first + shift]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            first = first[root[first] != root[first + shift]]
    return root


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows that are sorted by bucket; a bucket may go on in the next batch."""
    held: list[list[np.ndarray]] = []
    count = 0

    def flush(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        if not held:
            return
        key, block, values = (np.concatenate(c) for c in zip(*held))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        stop = len(key) if end else int(edge[-1]) if len(edge) else 0
        held = [[key[stop:], block[stop:], values[stop:]]] if stop < len(key) else []
        count = len(key) - stop
        starts = np.concatenate([[0], edge[edge < stop]]).astype(np.int64)
        sizes = np.diff(np.append(starts, stop))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 1]
        if not len(order):
            return
        starts, sizes = starts[order], sizes[order]
        rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        mine = values[rows].view(np.uint64)
        root = forest(mine, sizes, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine[moved].view(np.int64)), pa.array(mine[root[moved]].view(np.int64))], ["a", "b"]
            )

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        count += batch.num_rows
        if count >= BATCH:
            yield from flush(False)
    yield from flush(True)


def links(prints: DataFrame, radius: int = 4, pieces: int = 6, most: int = 20_000) -> DataFrame:
    """a, b: links between distinct fingerprints that connect whatever is within the radius.

    Buckets of over `most` rows are cut into blocks, and every two blocks of such a bucket meet in a group of their own.
    """
    if not radius < pieces <= 64:
        raise ValueError("the pieces must be more than the radius")
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    masks = [sum(((1 << cuts[p + 1]) - (1 << cuts[p])) for p in chosen) for chosen in combinations(range(pieces), pieces - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    value = F.col("fingerprint")
    # A bucket is named by a hash of its choice and bits; buckets that happen to share a name only compare more.
    rows = prints.select(
        "fingerprint",
        F.explode(F.array(*[F.xxhash64(F.lit(n), value.bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])).alias("key"),
    )
    half = most // 2
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = checkpointed(hot.select("key", F.ceil(F.col("n") / half).cast("int").alias("blocks")))
    if hot.isEmpty():
        dealt = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
        dealt = (
            rows.join(hot, "key", "left")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
            .withColumn("own", F.coalesce(own, F.lit(0)))
            .withColumn("block", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other"))
        )
    sorted_rows = (
        dealt.select("key", "block", "fingerprint").repartition("key", "block").sortWithinPartitions("key", "block", "fingerprint")
    )
    return sorted_rows.mapInArrow(lambda batches: _linked(batches, radius), "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 4, radius: int = 4, pieces: int = 6) -> DataFrame:
    """doc_id, text_hash, fingerprint, component (its least fingerprint) and component_id (its smallest doc_id)."""
    prints = checkpointed(fingerprints(documents, width))
    distinct = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, radius, pieces), "a", "b")
    placed = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("component")
    )
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(ids, "component").select(F.col("fingerprint").alias("__print"), "component", "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("__print")).drop("__print")


def keep_one(documents: DataFrame, width: int = 4, radius: int = 4, pieces: int = 6) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id stays."""
    return least_stays(documents, near_duplicates(documents, width, radius, pieces))


def least_stays(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of which `found` (doc_id, text_hash, component, component_id) says that they have the smallest id."""
    keys = found.groupBy("doc_id", "text_hash", "component").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    keys = checkpointed(keys)
    kept = (
        keys.filter(F.col("doc_id").eqNullSafe(F.col("least")))
        .groupBy("component")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
        .select("component", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    )
    judged = keys.join(kept.withColumnRenamed("component", "__c"), F.col("component") == F.col("__c")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
        (F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("stays"), "n",
    )
    judged = checkpointed(judged.filter("NOT stays OR n > 1"))
    gone = bounded(judged.select("__id", "__hash"))
    rest = documents.join(gone, same_document(gone), "left_anti")
    # Of rows that are equal in id and text, one stays.
    repeated = bounded(judged.filter("stays").select("__id", "__hash"))
    copies = documents.join(repeated, same_document(repeated), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    firsts = copies.groupBy(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")).agg(F.first(row).alias("r"))
    return rest.unionByName(firsts.select("r.*"))
