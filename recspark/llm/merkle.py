"""A Merkle manifest of a data set, kept as a log of nodes in postorder.

The leaves of a source stand in the order of their ids. Each run of `FAN` nodes of a level gets a parent, the last run of a
level as well, until one node remains, the subroot; the subroots of all sources, in order, are the leaves of the top tree.
A tree is cut into aligned pieces of `PIECE` leaves. A builder takes one piece and appends its nodes in the order of their
completion, so that the nodes of a piece are neighbours in the log of the source; the roots of the pieces are the leaves of
the next tier of builders. The place of a node in the log follows from the sizes of the full subtrees before it alone
(`position`), so a proof reads the siblings on its path at computed places, without a search or a stored link.

No task holds more than a piece: leaves are numbered by a range partition over (source, id, digest, row), whose parts are
counted and added up, so a source or an id with a third of all rows is dealt out like any other.

Defined results: null columns are written as `-`; a null source is a source of its own, before all others; null ids stand
first and are never tampered with; rows with equal source and id stand in the order of their leaves, and equal rows get one
leaf digest but places, and so proofs, of their own; a lone leaf is its own subroot and has the proof of no siblings; an
empty table gives no rows; columns besides the five of a leaf are not looked at. Texts are read whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import numbered
from recspark.session import checkpointed

FAN = 16
LEVELS = 3  # levels of a full piece
PIECE = FAN**LEVELS
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before: binary, after: binary>>"


def digest_of(nodes: list[bytes]) -> bytes:
    """The parent of a run: the hash of its digests, written one after the other as hexadecimal text."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place in the log of node `index` of `level`, in a tree of `leaves` leaves and `top` levels above them.

    Before it, and with it, all nodes up to its level that cover its leaves and those before are complete; of a higher level
    are only the nodes that end before its first leaf.
    """
    end = min((index + 1) * FAN**level, leaves)
    below = sum(-(-end // FAN**i) for i in range(level + 1))
    return below + sum(index // FAN ** (i - level) for i in range(level + 1, top + 1)) - 1


def appended(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes over the leaves in the order of their completion; the root is the last one."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: bytes) -> None:
        log.append(node)
        runs[level].append(node)
        if level < levels and len(runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        put(level + 1, digest_of(run))

    for leaf in leaves:
        put(0, leaf)
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def siblings(log: list[bytes], leaves: int, levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For every leaf of a piece the siblings before and after its ancestor (or itself) on each level, read from the log."""
    around: list[list[tuple[bytes, bytes]]] = []
    for level in range(levels):
        count = -(-leaves // FAN**level)
        nodes = [log[position(level, i, leaves, levels)] for i in range(count)]
        runs = [nodes[i : i + FAN] for i in range(0, count, FAN)]
        around.append([(b"".join(run[:i]), b"".join(run[i + 1 :])) for run in runs for i in range(len(run))])
    for leaf in range(leaves):
        yield [around[level][leaf // FAN**level] for level in range(levels)]


def levels_of(n: int) -> int:
    """Levels of a piece in a tier of n leaves: a lone piece ends at its root, others at the level of full pieces."""
    return height(n) if n <= PIECE else LEVELS


def _field(column: str | Column) -> Column:
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    fields = [_field(text if name == "text" else name) for name in COLUMNS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def leaf_rows(documents: DataFrame) -> DataFrame:
    """row, tree, doc_id, digest, altered (the digest after tampering, null where nothing is tampered with)."""
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)) & F.col("text").isNotNull()
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return checkpointed(
        documents.select(
            F.monotonically_increasing_id().alias("row"), tree.alias("tree"), "doc_id", _leaf(F.col("text")).alias("digest"),
            F.when(hit, _leaf(small)).alias("altered"),
        )
    )


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """The log in pieces: tree, piece, n (leaves of the tree in this tier), nodes in postorder; a table per tier."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n = rows.column("n")[0].as_py()
        log = appended(rows.column("digest").to_pylist(), levels_of(n))
        columns = [[key[0].as_py()], [key[1].as_py()], [n], pa.array([log], pa.list_(pa.binary()))]
        return pa.table(columns, names=["tree", "piece", "n", "nodes"])

    out = []
    rows = leaves.select("tree", "place", "n", "digest")
    while True:
        pieces = rows.withColumn("piece", F.floor(F.col("place") / PIECE)).groupBy("tree", "piece")
        out.append(checkpointed(pieces.applyInArrow(build, "tree string, piece long, n long, nodes array<binary>")))
        open_pieces = out[-1].filter(F.col("n") > PIECE)
        if open_pieces.isEmpty():
            return out
        rows = open_pieces.select(
            "tree", F.col("piece").alias("place"), F.ceil(F.col("n") / PIECE).alias("n"), F.element_at("nodes", -1).alias("digest")
        )


def roots(log: list[DataFrame]) -> DataFrame:
    """tree, digest of every finished tree."""
    done = [t.filter(F.col("n") <= PIECE).select("tree", F.element_at("nodes", -1).alias("digest")) for t in log]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def paths(log: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, piece, path, subroot of the pieces of the lowest tier. `above`: tree, path (over the root of the tree), subroot."""

    def descend(key: tuple, rows: pa.Table) -> pa.Table:
        tree, piece, n, nodes, path, subroot = (rows.column(c)[0].as_py() for c in ["tree", "piece", "n", "nodes", "path", "subroot"])
        leaves = min(PIECE, n - piece * PIECE)
        own = [[{"before": b, "after": a} for b, a in p] + path for p in siblings(nodes, leaves, levels_of(n))]
        columns = [[tree] * leaves, range(piece * PIECE, piece * PIECE + leaves), own, [subroot] * leaves]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _path_types())], names=["tree", "piece", "path", "subroot"])

    known = None
    for tier in reversed(log):
        done = tier.filter(F.col("n") <= PIECE).select("tree", "piece").join(above, "tree")
        known = done if known is None else known.unionByName(done)
        if tier is not log[0]:
            pieces = tier.join(known, ["tree", "piece"]).groupBy("tree", "piece")
            known = checkpointed(pieces.applyInArrow(descend, f"tree string, piece long, path {PATH}, subroot binary"))
    return known


def _path_types() -> list[pa.DataType]:
    step = pa.struct([("before", pa.binary()), ("after", pa.binary())])
    return [pa.string(), pa.int64(), pa.list_(step), pa.binary()]


@dataclass
class Manifest:
    leaves: DataFrame  # row, tree, doc_id, digest, altered, place, n
    log: list[DataFrame]  # of the sources, by tier
    top: list[DataFrame]  # of the tree over the subroots
    root: bytes | None


def manifest(documents: DataFrame) -> Manifest:
    """Leaves and logs of all sources, and of the tree over their subroots."""
    leaves = checkpointed(numbered(leaf_rows(documents), ["doc_id", "digest", "row"]))
    log = tiers(leaves)
    # The order of the trees is that of the sources: null first, then by the bytes of their names.
    subroots = roots(log).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = tiers(numbered(subroots, ["name"]))
    root = roots(top).first()
    return Manifest(leaves, log, top, bytes(root["digest"]) if root else None)


def nodes(m: Manifest) -> DataFrame:
    """source, position (in the log of the source), level, index, digest (hexadecimal): the logs of the sources, node by node."""

    def unfold(key: tuple, rows: pa.Table) -> pa.Table:
        tree, piece, n, total, log, low = (rows.column(c)[0].as_py() for c in ["tree", "piece", "n", "total", "nodes", "low"])
        leaves, levels, top = min(PIECE, n - piece * PIECE), levels_of(n), height(total)
        out = []
        # The leaves of a higher tier are the roots of the tier below it, which wrote them.
        for level in range(1 if low else 0, levels + 1):
            first = piece * PIECE // FAN**level
            for i in range(-(-leaves // FAN**level)):
                place = position(low + level, first + i, total, top)
                out.append((tree, place, low + level, first + i, log[position(level, i, leaves, levels)].hex()))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds],
            names=["tree", "position", "level", "index", "digest"],
        )

    sizes = m.log[0].filter("piece = 0").select("tree", F.col("n").alias("total"))
    found = None
    for i, tier in enumerate(m.log):
        pieces = tier.join(sizes, "tree").withColumn("low", F.lit(i * LEVELS)).groupBy("tree", "piece")
        rows = pieces.applyInArrow(unfold, "tree string, position long, level int, index long, digest string")
        found = rows if found is None else found.unionByName(rows)
    source = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)"))
    return found.select(source.alias("source"), "position", "level", "index", "digest")


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    spark = m.leaves.sparkSession
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    id_type = m.leaves.schema["doc_id"].dataType.simpleString()
    schema = schema.replace("doc_id long", f"doc_id {id_type}")
    if m.root is None:
        return spark.createDataFrame([], schema)
    # The top tree: a path for each source from its subroot to the root.
    start = spark.createDataFrame([("", [], b"")], f"tree string, path {PATH}, subroot binary")
    named = numbered(roots(m.log).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    over = _leaf_paths(named.select("tree", "place", "name", "digest"), m.top, paths(m.top, start))
    above = checkpointed(over.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")))
    pieces = m.log[0].join(paths(m.log, above), ["tree", "piece"])
    root = m.root

    def prove(rows: pa.Table, piece: pa.Table) -> pa.Table:
        names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
        rows = rows.sort_by("place")
        n, at, log, path, subroot = (piece.column(c)[0].as_py() for c in ["n", "piece", "nodes", "path", "subroot"])
        leaves = min(PIECE, n - at * PIECE)
        upper = [(step["before"], step["after"]) for step in path]
        upper_text = "".join((b + a).hex() for b, a in upper)
        leaf, digests, folded = [], [], []
        originals, altered = rows.column("digest").to_pylist(), rows.column("altered").to_pylist()
        for i, own in enumerate(siblings(log, leaves, levels_of(n))):
            text = "".join((b + a).hex() for b, a in own) + upper_text
            node = originals[i] if altered[i] is None else altered[i]
            for before, after in own + upper:
                node = digest_of([before, node, after])
            leaf.append(originals[i].hex())
            digests.append(sha256(text.encode()).hexdigest())
            folded.append(node.hex())
        return pa.table([rows.column("doc_id"), leaf, [subroot.hex()] * leaves, digests, folded], names=names)

    rows = m.leaves.withColumn("piece", F.floor(F.col("place") / PIECE)).select("tree", "piece", "place", "doc_id", "digest", "altered")
    found = (
        rows.groupBy("tree", "piece")
        .cogroup(pieces.groupBy("tree", "piece"))
        .applyInArrow(prove, f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string")
    )
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root.hex()).alias("verified"),
    )


def _leaf_paths(leaves: DataFrame, log: list[DataFrame], over: DataFrame) -> DataFrame:
    """name, digest, path of the leaves (tree, place, name, digest) of a tree whose pieces have the paths `over`."""

    def walk(rows: pa.Table, piece: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n, at, nodes, path = (piece.column(c)[0].as_py() for c in ["n", "piece", "nodes", "path"])
        own = siblings(nodes, min(PIECE, n - at * PIECE), levels_of(n))
        steps = [[{"before": b, "after": a} for b, a in p] + path for p in own]
        return pa.table([rows.column("name"), rows.column("digest"), pa.array(steps, _path_types()[2])], names=["name", "digest", "path"])

    rows = leaves.withColumn("piece", F.floor(F.col("place") / PIECE)).groupBy("tree", "piece")
    pieces = log[0].join(over, ["tree", "piece"]).groupBy("tree", "piece")
    return rows.cogroup(pieces).applyInArrow(walk, f"name string, digest binary, path {PATH}")
