"""Vector cells in a tree of two levels.

A few branches, each with leaves of its own; the leaves are the cells. Training, assignment and probing compare a vector with all branches and then with
the leaves of its nearest ones, so the work per vector grows with the root of the number of cells. All leaves are trained at once: every pass adds up
the vectors of each leaf in the tasks, and Spark the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.vectors import norm
from recspark.operators.cells import MAX_CENTROID_BYTES, first_columns
from recspark.operators.ranking import top_per_group
from recspark.operators.search import MAX_CELLS, topk_in_cells
from recspark.session import checkpointed


@dataclass
class Tree:
    """Numbers and centroids of the branches, and of their leaves (the cells)."""

    branches: np.ndarray
    leaf_ids: list[np.ndarray]
    leaves: list[np.ndarray]

    def nearest_branches(self, points: np.ndarray, n: int) -> np.ndarray:
        return first_columns(points @ self.branches.T, min(n, len(self.branches)))

    def nearest_leaves(self, points: np.ndarray, n_branches: int, n: int) -> list[list[int]]:
        """The n nearest cells among the leaves of each point's nearest branches; ties go by the number of the cell."""
        if n == n_branches == 1:
            out = np.zeros(len(points), dtype=np.int64)
            near = self.nearest_branches(points, 1)[:, 0]
            for branch in np.unique(near):
                rows = np.flatnonzero(near == branch)
                out[rows] = self.leaf_ids[branch][(points[rows] @ self.leaves[branch].T).argmax(axis=1)]
            return out[:, None].tolist()
        out = []
        for point, chosen in zip(points, self.nearest_branches(points, n_branches)):
            ids = np.concatenate([self.leaf_ids[b] for b in chosen])
            scores = np.concatenate([self.leaves[b] @ point for b in chosen])
            out.append(ids[np.lexsort((ids, -scores))[:n]].tolist())
        return out


def tree_rows(tree: Tree, spark) -> DataFrame:
    """The tree as a table (branch, cell, centroid); a branch's own row has no cell."""
    rows = [(b, None, [float(x) for x in c]) for b, c in enumerate(tree.branches)]
    rows += [(b, int(i), [float(x) for x in c]) for b, (ids, cs) in enumerate(zip(tree.leaf_ids, tree.leaves)) for i, c in zip(ids, cs)]
    return spark.createDataFrame(rows, "branch int, cell int, centroid array<double>")


def read_tree(rows: DataFrame) -> Tree:
    """The tree of a table (branch, cell, centroid): at most MAX_CELLS rows, whose size is checked, and no branch without a cell."""
    found = rows.orderBy("branch", "cell").limit(2 * MAX_CELLS + 1).collect()
    if len(found) > 2 * MAX_CELLS or sum(len(r["centroid"]) for r in found) * 8 > MAX_CENTROID_BYTES:
        raise ValueError("too many centroids; train fewer cells, large cells are split into strips anyway")
    numbers = [r["branch"] for r in found if r["cell"] is None]
    leaves = {b: [(r["cell"], r["centroid"]) for r in found if r["branch"] == b and r["cell"] is not None] for b in numbers}
    return Tree(
        np.array([r["centroid"] for r in found if r["cell"] is None]),
        [np.array([i for i, _ in leaves[b]], dtype=np.int64) for b in numbers],
        [np.array([c for _, c in leaves[b]]) for b in numbers],
    )


def _unit_rows(batch) -> np.ndarray:
    rows = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _means(points: DataFrame, number, size: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit mean direction of the points that `number` (a function of unit rows) gives each number, and which numbers have any."""

    def add_up(batches):
        import pyarrow as pa

        sums, counts = np.zeros((size, dim)), np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _unit_rows(batch)
                mine = number(rows)
                order = np.argsort(mine, kind="stable")
                starts = np.flatnonzero(np.diff(mine[order], prepend=-1))
                sums[mine[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
                counts += np.bincount(mine, minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen].tolist(), pa.list_(pa.float64()))], ["number", "sums"])

    partial = points.select("embedding").mapInArrow(add_up, "number long, sums array<double>")
    total = partial.groupBy("number").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    means, has = np.zeros((size, dim)), np.zeros(size, dtype=bool)
    for row in total.collect():  # at most `size` rows, which the caller bounds
        means[row["number"]], has[row["number"]] = row["sums"], True
    length = np.linalg.norm(means, axis=1, keepdims=True)
    return means / np.where(length > 0, length, 1), has


def train_tree(items: DataFrame, n_branches: int = 32, per_branch: int = 32, *, max_iter: int = 8, seed: int = 42) -> Tree:
    """Branches, then leaves inside each, by k-means on directions over all items.

    They start from the items with the least hashes, of the whole table and of each branch. A centre that loses all its items stays
    where it was; a branch with few items has as few leaves.
    """
    points = items.select("asin", "embedding").filter(norm(F.col("embedding")) > 0)
    dim = len(items.select("embedding").first()["embedding"])
    if (n_branches + 1) * per_branch > MAX_CELLS or n_branches * (per_branch + 1) * dim * 8 > MAX_CENTROID_BYTES:
        raise ValueError("too many centroids; train fewer cells, large cells are split into strips anyway")
    order = [F.xxhash64("asin", F.lit(seed)), F.col("asin")]
    start = points.orderBy(*order).limit(n_branches).collect()
    if not start:
        return Tree(np.zeros((1, dim)), [np.array([0])], [np.zeros((1, dim))])
    branches = np.array([r["embedding"] for r in start], dtype=np.float64)
    branches /= np.linalg.norm(branches, axis=1, keepdims=True)
    for _ in range(max_iter):
        means, has = _means(points, lambda rows, now=branches: (rows @ now.T).argmax(axis=1), len(branches), dim)
        branches = np.where(has[:, None], means, branches)

    @F.arrow_udf("int")
    def branch_of(vectors):
        import pyarrow as pa

        rows = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
        return pa.array((rows @ branches.T).argmax(axis=1).astype(np.int32))

    placed = points.withColumn("branch", branch_of("embedding"))
    first = top_per_group(placed, ["branch"], order, per_branch).select("branch", "rank", "embedding")
    chosen: dict[int, list] = {b: [] for b in range(len(branches))}
    for row in first.orderBy("branch", "rank").collect():  # at most n_branches * per_branch rows
        chosen[row["branch"]].append(row["embedding"])
    filled = [b for b in chosen if chosen[b]]
    leaves = [np.array(chosen[b], dtype=np.float64) for b in filled]
    ends = np.cumsum([0, *map(len, leaves)])
    tree = Tree(
        branches[filled],
        [np.arange(a, b) for a, b in zip(ends, ends[1:])],
        [rows / np.linalg.norm(rows, axis=1, keepdims=True) for rows in leaves],
    )
    for _ in range(max_iter):
        means, has = _means(points, lambda rows, now=tree: np.array(now.nearest_leaves(rows, 1, 1))[:, 0], ends[-1], dim)
        now = np.where(has[:, None], means, np.concatenate(tree.leaves))
        tree = Tree(tree.branches, tree.leaf_ids, np.split(now, ends[1:-1]))
    return tree


def nearest_leaves(tree: Tree, n_branches: int, n: int):
    """A column function: the n nearest cells of a vector, found in its `n_branches` nearest branches."""

    @F.arrow_udf("array<int>")
    def nearest(vectors):
        import pyarrow as pa

        rows = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
        return pa.array(tree.nearest_leaves(rows, n_branches, n), pa.list_(pa.int32()))

    return nearest


def assign_leaves(items: DataFrame, tree: Tree) -> DataFrame:
    return items.withColumn("cell", F.get(nearest_leaves(tree, 1, 1)("embedding"), 0))


def tree_topk(queries: DataFrame, cells: DataFrame, tree: Tree, k: int = 100, *, n_branches: int = 2, n_probe: int = 4) -> DataFrame:
    """Top-k by inner product within the `n_probe` nearest leaves of each query's `n_branches` nearest branches."""
    probed = checkpointed(queries.withColumn("_cells", nearest_leaves(tree, n_branches, n_probe)("embedding")))
    return topk_in_cells(probed.withColumn("cell", F.explode("_cells")).drop("_cells"), cells, k, probes=n_probe)
