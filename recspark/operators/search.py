"""Inner-product search for many queries at once.

Queries are cut into blocks of bounded size by a hash of their id, items into strips. A task takes one block and one strip: it holds the
queries, reads the items batch by batch in the order of their ids, and keeps one running list of the k best per query. However many items a strip
has, a query leaves it with at most k rows; the lists of several strips or cells are merged in levels, so that no merge reads
more than `FAN_IN` lists of a query. A large cell, shard or table only means longer strips or more of them, never a larger
task. No vector passes through the driver and nothing is broadcast but the per-cell counts.

Every block of queries gets its own copy of the items, and a probed cell its own list. Where these would come to more than `WAVE_BYTES` of
shuffle files, the queries are searched in waves; each leaves its lists and its shuffle files go, so the disk does not grow with queries times items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.functions.numbers import SCORE_DIGITS
from recspark.operators.ranking import best_first, exclude_items, top_per_group
from recspark.session import checkpointed, scratch, work_path, written_parts

BLOCK_BYTES = 16 * 1024 * 1024
LIST_ROWS = 2_000_000
SCORES = 1_000_000
PAIR_STEP = 32_768
SORT_UNITS = 2**21
PAIRS_PER_TASK = 4_000_000
TASKS = 65_536
MAX_CELLS = 65_536
FAN_IN = 8
PACK = 64  # items that travel to the blocks as one row
PACKS_AT_ONCE = 128
WAVE_BYTES = 2 * 1024 * 1024 * 1024  # of the copies of items and the unmerged lists that lie on disk at a time
LIST_BYTES = 24  # about what a row of a list takes in a shuffle file
FLAT_LIMIT = 50_000


def choose_index(n_items: int) -> str:
    """Exact search for small catalogues, cells for the others."""
    return "flat" if n_items < FLAT_LIMIT else "ivf"


def vector_dim(vectors: DataFrame, column: str = "embedding") -> int:
    row = vectors.select(F.size(column).alias("dim")).first()
    if row is None:
        raise ValueError("no vectors to search")
    return row["dim"]


def _block_counts(n_items: int, n_queries: int, dim: int, tasks_wanted: int, k: int = 100) -> tuple[int, int]:
    """How many strips of items and blocks of queries one cell gets.

    A block's vectors and lists are bounded. More than that, there are as many tasks as the work is worth, at most `tasks_wanted`; strips are cut only where there are
    too few queries for that many blocks, because every block reads all strips.
    """
    rows = max(64, min(BLOCK_BYTES // (8 * dim), LIST_ROWS // max(1, k)))
    wanted = min(tasks_wanted, -(-n_items * n_queries // PAIRS_PER_TASK))
    query_blocks = max(1, -(-n_queries // rows), min(wanted, -(-n_queries // 64)))
    strips = max(1, min(-(-wanted // query_blocks), -(-n_items // 1024)))
    return strips, query_blocks


def _item_bytes(items: DataFrame, dim: int) -> int:
    """About what a copy of an item takes in a shuffle file."""
    return dim * int(_number_kind(items)[-1]) + LIST_BYTES


def _true_places(mask):
    """`flatnonzero` of a matrix that is nearly all false: eight places are looked at together."""
    import numpy as np

    flat = mask.ravel()
    end = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:end].view(np.uint64))
    within = np.flatnonzero(flat[:end].reshape(-1, 8)[words])
    return np.concatenate([words[within >> 3] * 8 + (within & 7), end + np.flatnonzero(flat[end:])])


class _Chunk:
    """Running lists of some queries of a block, and the scores found since they were last cut."""

    def __init__(self, first: int, vectors, depths, unit: float, least: float | None = None):
        import numpy as np

        self.np, self.first, self.vectors, self.depths, self.unit = np, first, vectors, depths, unit
        with np.errstate(over="ignore"):
            self.small, self.lengths = vectors.astype(np.float32), np.sqrt((vectors * vectors).sum(axis=1))
        self.deepest, self.total = int(depths.max(initial=0)), max(64, int(np.maximum(depths, 0).sum()))
        self.rows, self.places, self.values = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        # A score must be above the border; a least score itself is allowed.
        self.border = np.where(depths > 0, -np.inf if least is None else np.nextafter(least, -np.inf), np.inf)
        self.waiting, self.held = [], 0

    def rounded(self, raw):
        np = self.np
        return np.copysign(np.floor(np.abs(raw) * self.unit + 0.5) / self.unit, raw) + 0.0

    def _likely(self, small, longest: float):
        """(rows, columns) whose single-precision product may reach the border; None if they are many or the range is too large."""
        np = self.np
        # The error of a product in single precision, twice its bound, and half a unit of the last digit.
        slack = 0.6 / self.unit + (small.shape[1] + 8) * 2.0**-22 * self.lengths * longest
        if not (np.isfinite(slack).all() and self.lengths.max(initial=0) * longest < 1e30 and max(self.lengths.max(initial=0), longest) < 1e30):
            return None
        scores, n, border = self.small @ small.T, len(small), self.border
        if self.deepest < n and np.isneginf(border).any():
            # Of one batch only the deepest list's worth can stay.
            own = np.partition(scores, n - self.deepest, axis=1)[:, n - self.deepest].astype(np.float64) - slack
            border = np.where(np.isneginf(border), own, border)
        limit = np.nextafter((border - slack).astype(np.float32), np.float32(-np.inf))
        found = _true_places(scores >= limit[:, None])
        return None if len(found) * 16 > scores.size and len(found) > 4 * self.total else np.divmod(found, n)

    def add(self, items, small, longest: float, seen: int) -> None:
        np, n = self.np, len(items)
        if not self.deepest:
            return
        likely = self._likely(small, longest)
        if likely is None:
            scores = self.rounded(self.vectors @ items.T)
            better = scores > self.border[:, None]
            if self.deepest < n:
                better &= scores >= np.partition(scores, n - self.deepest, axis=1)[:, n - self.deepest, None]
            rows, columns = np.nonzero(better)
            values = scores[rows, columns]
        else:
            rows, columns = likely
            values = np.empty(len(rows))
            for at in range(0, len(rows), PAIR_STEP):
                part = slice(at, at + PAIR_STEP)
                values[part] = np.einsum("ij,ij->i", self.vectors[rows[part]], items[columns[part]])
            values = self.rounded(values)
            better = values > self.border[rows]
            rows, columns, values = rows[better], columns[better], values[better]
        if len(rows):
            self.waiting.append((rows.astype(np.int32), (columns + seen).astype(np.int32), values))
            self.held += len(rows)
            if self.held * 2 > self.total:
                self.cut()

    def _in_order(self, rows, places, values):
        """Sorted by row, the highest value first, of equal values the earlier place."""
        np = self.np
        units = np.rint(values * self.unit)
        if np.abs(units).max(initial=0.0) < SORT_UNITS:
            # Row (10 bits), value and place in one whole number, which sorts much faster than three columns.
            packed = (rows.astype(np.int64) << 53) | ((SORT_UNITS - units.astype(np.int64)) << 31) | places
            packed.sort()
            whole = (packed >> 31) & (2 * SORT_UNITS - 1)
            return (packed >> 53).astype(np.int32), (packed & (2**31 - 1)).astype(np.int32), (SORT_UNITS - whole) / self.unit
        # Of equal scores the earlier items come first already; few rows of a chunk, so 16 bits hold them.
        order = np.argsort(-values, kind="stable")
        order = order[np.argsort(rows[order].astype(np.int16), kind="stable")]
        return rows[order], places[order], values[order]

    def cut(self) -> None:
        if not self.held:
            return
        np = self.np
        rows, places, values = (np.concatenate(p) for p in zip((self.rows, self.places, self.values), *self.waiting))
        rows, places, values = self._in_order(rows, places, values)
        rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.depths)))[rows]
        keep = rank < self.depths[rows]
        self.rows, self.places, self.values = rows[keep], places[keep], values[keep]
        last = rank == self.depths[rows] - 1
        self.border[rows[last]] = values[last]
        self.waiting, self.held = [], 0


class _RunningLists:
    """The best items of each query of a block, kept while items come in batch by batch in the order of their ids.

    Earlier items win ties, so only the place in this order is kept, beside the ids that some list still names. Products are taken in
    single precision first; those that may reach a list, by the bound of their error, are computed in double precision. Queries
    and items are taken in chunks of about `SCORES` pairs, so what a task holds besides the lists does not grow with the block.
    """

    def __init__(self, query_ids, vectors, depths, digits: int, least: float | None = None):
        import numpy as np

        self.np, self.query_ids = np, query_ids
        size = max(1, min(1024, 2 * SCORES // max(1, int(depths.max(initial=1)))))
        self.chunks = [
            _Chunk(at, vectors[at : at + size], depths[at : at + size], 10.0**digits, least) for at in range(0, len(vectors), size)
        ]
        self.step = max(64, SCORES // min(size, max(1, len(vectors))))
        self.ids, self.seen = [], 0

    def add(self, ids, items) -> None:
        np = self.np
        with np.errstate(over="ignore"):
            small, longest = items.astype(np.float32), np.sqrt((items * items).sum(axis=1))
        for start in range(0, len(items), self.step):
            part = slice(start, start + self.step)
            most = float(longest[part].max())
            for chunk in self.chunks:
                chunk.add(items[part], small[part], most, self.seen + start)
        self.ids.append(ids)
        self.seen += len(items)
        if self.seen > 1_000_000 + 4 * sum(len(c.rows) for c in self.chunks):
            self._forget()

    def _cut(self) -> None:
        for chunk in self.chunks:
            chunk.cut()

    def _forget(self) -> None:
        """Drops the ids that no list names any more."""
        import pyarrow as pa

        np = self.np
        self._cut()
        used = np.zeros(self.seen, dtype=bool)
        for chunk in self.chunks:
            used[chunk.places] = True
        kept = np.flatnonzero(used)
        self.ids = [pa.chunked_array(self.ids).take(pa.array(kept)).combine_chunks()]
        for chunk in self.chunks:
            chunk.places = np.searchsorted(kept, chunk.places).astype(np.int32)
        self.seen = len(kept)

    def tables(self, key: tuple):
        """The lists of every chunk of queries."""
        import pyarrow as pa

        np = self.np
        self._cut()
        ids = pa.chunked_array(self.ids).combine_chunks()
        mark = (int(key[0]) * 7919 + int(key[2])) % (1 << 31)
        for chunk in self.chunks:
            if len(chunk.rows):
                rank = np.arange(len(chunk.rows)) - np.searchsorted(chunk.rows, chunk.rows) + 1
                yield pa.RecordBatch.from_arrays(
                    [self.query_ids.take(pa.array(chunk.rows + chunk.first)), ids.take(pa.array(chunk.places)), pa.array(chunk.values),
                     pa.array(rank.astype(np.int32)), pa.array(np.full(len(rank), mark, dtype=np.int32))],
                    names=["query_id", "asin", "score", "rank", "list"],
                )

    def table(self, key: tuple):
        import pyarrow as pa

        return pa.Table.from_batches(list(self.tables(key)))


def _number_kind(items: DataFrame) -> str:
    """How the numbers of the vectors travel: as small as they are given."""
    kinds = {T.ByteType(): "<i1", T.FloatType(): "<f4"}
    return kinds.get(items.schema["embedding"].dataType.elementType, "<f8")


def _packed(items: DataFrame) -> DataFrame:
    """`items(cell, strip, blocks, asin, embedding)` -> rows of up to PACK items of one cell and strip, in the order of their ids.

    A row has the first id as `asin`, all ids and the vectors one after the other as bytes. Every block of queries reads all
    items of its strips, and copying, sorting and handing over a row costs much more than the numbers in it.
    """
    kind = _number_kind(items)
    fields = [items.schema[c] for c in ("cell", "strip", "blocks", "asin")]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(fields[-1].dataType)), T.StructField("vectors", T.BinaryType())])

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            vectors = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1).astype(kind)
            keys = np.stack([np.asarray(batch.column(c)) for c in ("cell", "strip")])
            runs = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(axis=0)))
            starts = np.concatenate([np.arange(a, b, PACK) for a, b in zip(runs, np.append(runs[1:], batch.num_rows))])
            ends = np.append(starts, batch.num_rows)
            first = [batch.column(c).take(pa.array(starts)) for c in ("cell", "strip", "blocks", "asin")]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), batch.column("asin"))
            rows = pa.array([vectors[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*first, ids, rows], names=schema.names)

    ordered = items.select("cell", "strip", "blocks", "asin", "embedding").repartitionByRange("cell", "strip", "asin")
    return ordered.sortWithinPartitions("cell", "strip", "asin").mapInArrow(pack, schema)


def _search_kernel(digits: int, least: float | None = None, kind: str = "<f8"):
    """The task body: rows in the order of (cell, block, strip), first the queries of each, then its packs of items by id."""

    def vectors(batch, name):
        import numpy as np

        column = batch.column(name)
        return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        key, asked, lists = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in ("cell", "block", "strip", "side")])
            starts = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(axis=0)))
            for start, stop in zip(starts, np.append(starts[1:], batch.num_rows)):
                part, now, side = batch.slice(start, stop - start), tuple(keys[:3, start]), keys[3, start]
                if now != key:
                    if lists is not None:
                        yield from lists.tables(key)
                    key, asked, lists = now, [], None
                if not side:
                    asked.append((part.column("query_id"), vectors(part, "query_vector"), np.asarray(part.column("depth"))))
                elif asked or lists is not None:
                    if lists is None:
                        ids, rows, depths = zip(*asked)
                        ids = pa.chunked_array(ids).combine_chunks()
                        lists, asked = _RunningLists(ids, np.concatenate(rows), np.concatenate(depths), digits, least), []
                    for at in range(0, part.num_rows, PACKS_AT_ONCE):
                        packs = part.slice(at, PACKS_AT_ONCE)
                        ids = packs.column("ids").flatten()
                        items = np.frombuffer(b"".join(packs.column("vectors").to_pylist()), dtype=kind).astype(np.float64)
                        lists.add(ids, items.reshape(len(ids), -1))
        if lists is not None:
            yield from lists.tables(key)

    return kernel


def _score_blocks(queries: DataFrame, packed: DataFrame, kind: str, n_tasks: int, digits: int, least: float | None = None) -> DataFrame:
    """`(query_id, asin, score, rank, list)`: the best items of every query in each strip of each of its cells.

    `queries` has the columns cell, block and strip, `packed` (see `_packed`) cell, strip and blocks (the number of blocks that read the item);
    together they are dealt out and sorted by cell, block and strip.
    """
    query_id, item_id = queries.schema["query_id"], packed.schema["asin"]
    schema = T.StructType(
        [
            query_id,
            item_id,
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("list", T.IntegerType()),
        ]
    )
    keys = ["cell", "block", "strip"]
    def none(table: DataFrame, column: str) -> Column:
        return F.lit(None).cast(table.schema[column].dataType)

    packs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = queries.select(
        *keys, F.lit(0).alias("side"), "query_id", none(packs, "asin").alias("asin"), F.col("embedding").alias("query_vector"),
        none(packs, "ids").alias("ids"), none(packs, "vectors").alias("vectors"), "depth",
    )
    right = packs.select(
        *keys, F.lit(1).alias("side"), none(queries, "query_id").alias("query_id"), "asin", none(queries, "embedding").alias("query_vector"),
        "ids", "vectors", F.lit(0).alias("depth"),
    )
    rows = left.unionByName(right)
    dealt = rows.repartition(max(1, min(n_tasks, TASKS)), *keys).sortWithinPartitions(*keys, "side", "asin")
    return dealt.mapInArrow(_search_kernel(digits, least, kind), schema)


def _in_waves(
    queries: DataFrame, items: DataFrame, k: int, n_tasks: int, most: int, n_waves: int, digits: int, least: float | None = None
) -> DataFrame:
    """`(query_id, asin, score, rank)`: the lists of `_score_blocks`, at most `most` of a query, merged. `n_tasks` is that of one wave.

    The items are packed and the queries placed once. A wave is a share of the queries; it writes its lists and its shuffle files go
    before the next one begins.
    """
    kind = _number_kind(items)

    def found(asked: DataFrame, packed: DataFrame) -> DataFrame:
        lists = _score_blocks(asked, packed, kind, n_tasks, digits, least)
        return lists.drop("list") if most == 1 else merge_lists(lists, k, most)

    if n_waves == 1:
        return found(queries, _packed(items))
    spark = queries.sparkSession
    path = work_path(spark, "lists")
    with scratch(spark):
        packed = checkpointed(_packed(items))
        # Another hash than that of the blocks; in the order of the waves, so that each reads little more than its own queries.
        wave = F.pmod(F.xxhash64("query_id", F.lit("wave")), F.lit(n_waves)).cast("int")
        placed = checkpointed(queries.withColumn("wave", wave).sortWithinPartitions("wave"))
        return written_parts((found(placed.filter(F.col("wave") == i).drop("wave"), packed) for i in range(n_waves)), path)


def _n_waves(copies: int, most_blocks: int, lists: int) -> int:
    """How many waves keep the bytes of the copies and of the lists in bounds; with one block of queries a wave, no more help the copies."""
    return max(1, min(most_blocks, -(-copies // WAVE_BYTES)), -(-lists // WAVE_BYTES))


def merge_lists(lists: DataFrame, k: int, most: int) -> DataFrame:
    """`(query_id, asin, score, rank)`: the k best of all lists of a query, of which there are at most `most`.

    While a query may have more than FAN_IN lists, groups of them are merged first; each group leaves one list.
    """
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        lists = lists.drop("rank").withColumn("list", F.pmod("list", F.lit(most)))
        lists = top_per_group(lists, ["query_id", "list"], best_first(), k)
    return top_per_group(lists.drop("rank", "list"), ["query_id"], best_first(), k)


def exact_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 100,
    *,
    n_queries: int | None = None,
    n_items: int | None = None,
    digits: int = SCORE_DIGITS,
    least: float | None = None,
) -> DataFrame:
    """The k items of highest inner product for every query.

    `queries(query_id, embedding)`, `items(asin, embedding)` with one row per id ->
    `(query_id, asin, score, rank)`. Scores are rounded to `digits`, ties are broken by `asin`.
    The sizes are counted unless the caller knows them. With `least`, items of a lower score are left out from the start.
    """
    n_items = items.count() if n_items is None else n_items
    n_queries = queries.count() if n_queries is None else n_queries
    strips = query_blocks = n_waves = 1
    if n_items and n_queries:
        cores, dim = queries.sparkSession.sparkContext.defaultParallelism, vector_dim(items)
        strips, query_blocks = _block_counts(n_items, n_queries, dim, 4 * cores, k)
        lists = n_queries * strips * k * LIST_BYTES if strips > 1 else 0
        n_waves = _n_waves(n_items * query_blocks * _item_bytes(items, dim), query_blocks, lists)
        if n_waves > 1:
            # Fewer blocks a wave, and as many more strips as keep all cores at work, while their lists have room.
            tasks, query_blocks = min(strips * query_blocks, 4 * cores), -(-query_blocks // n_waves)
            room = WAVE_BYTES // (-(-n_queries // n_waves) * k * LIST_BYTES)
            strips = max(strips, min(-(-tasks // query_blocks), room, -(-n_items // 1024)))
    asked = _in_blocks(queries.withColumn("depth", F.lit(k)), "query_id", "block", query_blocks, "strip", strips)
    placed = _own_block(items, "asin", "strip", strips).withColumns({"cell": F.lit(0), "blocks": F.lit(query_blocks)})
    return _in_waves(asked.withColumn("cell", F.lit(0)), placed, k, strips * query_blocks, strips, n_waves, digits, least)


def _in_blocks(df: DataFrame, id_column: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
    """The row's own block by a hash of its id, and one copy of the row for each block of the other side."""
    return _own_block(df, id_column, own, own_n).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))


def _own_block(df: DataFrame, id_column: str, own: str, own_n: int) -> DataFrame:
    return df.withColumn(own, F.pmod(F.xxhash64(id_column), F.lit(own_n)).cast("int"))


def _placed_in_cells(queries: DataFrame, items: DataFrame, k: int, probes: int | None) -> tuple[DataFrame, DataFrame, int, int, int, int]:
    """Queries and items with their strips and blocks, the tasks of a wave, the most strips of a cell, the number of cells and that of waves.

    Without `probes` there is one wave, whatever the lists take.
    """
    spark = queries.sparkSession
    counts = (
        items.groupBy("cell").agg(F.count("*").alias("n_items"))
        .join(queries.groupBy("cell").agg(F.count("*").alias("n_queries")), "cell")
        .limit(MAX_CELLS + 1)
        .collect()
    )
    if len(counts) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; use fewer, larger cells: big cells are split into strips")
    cores = spark.sparkContext.defaultParallelism
    dim = vector_dim(items) if counts else 1
    tasks_per_cell = max(1, 4 * cores // max(1, len(counts)))

    plan_rows, n_tasks, most, copies, lists, n_waves = [], 0, 1, 0, 0, 1
    for row in counts:
        strips, query_blocks = _block_counts(row["n_items"], row["n_queries"], dim, tasks_per_cell, k)
        plan_rows.append((row["cell"], strips, query_blocks))
        n_tasks, most = n_tasks + strips * query_blocks, max(most, strips)
        copies, lists = copies + row["n_items"] * query_blocks, lists + row["n_queries"] * strips * min(k, row["n_items"])
    if probes is not None and plan_rows:
        # A second level of merges writes the lists again.
        levels = 1 if most * min(probes, len(counts)) <= FAN_IN else 2
        n_waves = _n_waves(copies * _item_bytes(items, dim), max(blocks for *_, blocks in plan_rows), lists * LIST_BYTES * levels)
        plan_rows = [(cell, strips, -(-query_blocks // n_waves)) for cell, strips, query_blocks in plan_rows]
        n_tasks = sum(strips * query_blocks for _, strips, query_blocks in plan_rows)
    # One row per cell, at most MAX_CELLS: safe to broadcast.
    plan = F.broadcast(spark.createDataFrame(plan_rows, "cell int, strips int, blocks int"))
    placed_items = items.join(plan, "cell").withColumn("strip", F.pmod(F.xxhash64("asin"), F.col("strips")).cast("int"))
    placed_queries = (
        queries.withColumn("depth", F.lit(k))
        .join(plan, "cell")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        .withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    )
    return placed_queries, placed_items, n_tasks, most, len(plan_rows), n_waves


def cell_candidates(
    queries: DataFrame, items: DataFrame, k: int = 100, *, digits: int = SCORE_DIGITS
) -> tuple[DataFrame, int, int]:
    """The k best items per query and strip of the cells that it probes, the most strips of a cell, and the number of cells.

    `queries(query_id, embedding, cell)` has one row per probed cell, `items(asin, embedding, cell)`
    one row per item. The caller merges the rows of a query.
    """
    asked, placed, n_tasks, most, n_cells, _ = _placed_in_cells(queries, items, k, None)
    return _score_blocks(asked, _packed(placed), _number_kind(items), n_tasks, digits), most, n_cells


def topk_in_cells(
    queries: DataFrame, items: DataFrame, k: int = 100, *, digits: int = SCORE_DIGITS, probes: int = MAX_CELLS
) -> DataFrame:
    """The k best items of the probed cells; no query probes more than `probes`."""
    asked, placed, n_tasks, most, n_cells, n_waves = _placed_in_cells(queries, items, k, probes)
    # At least two, as an id that is asked twice in a cell has two lists.
    return _in_waves(asked, placed, k, n_tasks, max(2, most * min(probes, n_cells)), n_waves, digits)


def sharded_topk(queries: DataFrame, items: DataFrame, k: int = 100, *, shard: str, n_shards: int = 16) -> DataFrame:
    """Search every shard on its own, then merge the shards' lists.

    Shard values (categories, regions) are folded into `n_shards` groups by hash.
    """
    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    return topk_in_cells(
        queries.withColumn("cell", F.explode(shards)),
        items.withColumn("cell", F.pmod(F.xxhash64(shard), F.lit(n_shards)).cast("int")),
        k,
        probes=n_shards,
    )


def dual_index_topk(queries: DataFrame, main: DataFrame, delta: DataFrame, k: int = 100) -> DataFrame:
    """Search main and delta vectors together; the highest `version` of an asin wins."""
    return exact_topk(queries, newest_vectors(main, delta), k)


def newest_vectors(main: DataFrame, delta: DataFrame) -> DataFrame:
    """`(asin, embedding, version)` twice -> the newest vector per asin, in one partial aggregation."""
    columns = ["asin", "embedding", "version"]
    return (
        main.select(*columns).unionByName(delta.select(*columns))
        .groupBy("asin")
        .agg(F.max_by("embedding", "version").alias("embedding"))
    )


def search(
    queries: DataFrame,
    items: DataFrame,
    k: int = 100,
    *,
    excluded: DataFrame | None = None,
    exclude_first: bool = False,
    n_queries: int | None = None,
    n_items: int | None = None,
    ranked: bool = True,
) -> DataFrame:
    """Candidates per query, then the exclusion.

    Without `ranked` the column `rank` is left out, for callers that rank anew. By default the ids in `excluded(query_id, asin)` are dropped after the cut at k, so fewer than
    k may remain. With `exclude_first` k allowed items remain whenever they exist; see `excluded_first`.
    """
    if excluded is None:
        found = exact_topk(queries, items, k, n_queries=n_queries, n_items=n_items)
        return found if ranked else found.drop("rank")
    if exclude_first:
        counted = items.count() if n_items is None else n_items
        return excluded_first(lambda asked, depth: exact_topk(asked, items, depth, n_items=counted), queries, excluded, k)
    keys = ["query_id", "asin"]
    kept = exclude_items(exact_topk(queries, items, k, n_queries=n_queries, n_items=n_items), excluded, keys).drop("rank")
    return top_per_group(kept, ["query_id"], best_first(), k) if ranked else kept


def excluded_first(
    find: Callable[[DataFrame, int], DataFrame], queries: DataFrame, excluded: DataFrame, k: int
) -> DataFrame:
    """The k best rows of every query that `excluded(query_id, asin)` allows; `find(queries, depth)` searches.

    Lists are twice as deep as k at first. Only queries that are still short of k, and whose list was full, are searched again, four times
    as deep; so the many exclusions of one query cost the others nothing.
    """
    keys = ["query_id", "asin"]
    ids = checkpointed(excluded.select(*keys).distinct())
    asked, depth, done = checkpointed(queries), 2 * k, []
    while True:
        found = checkpointed(find(asked, depth).select("query_id", "asin", "score"))
        kept = checkpointed(exclude_items(found, ids, keys))
        done.append(kept)
        full = found.groupBy("query_id").agg(F.count("*").alias("found")).filter(F.col("found") >= depth).select("query_id")
        enough = kept.groupBy("query_id").agg(F.count("*").alias("kept")).filter(F.col("kept") >= k).select("query_id")
        short = checkpointed(full.join(enough, "query_id", "left_anti"))
        if short.isEmpty():
            break
        # What a deeper list finds for these queries takes the place of what there is.
        done[-1] = kept.join(short, "query_id", "left_anti")
        asked, depth = checkpointed(asked.join(short, "query_id", "left_semi")), depth * 4
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return top_per_group(rows, ["query_id"], best_first(), k)
