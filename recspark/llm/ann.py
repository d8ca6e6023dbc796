"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Vectors lie in blocks; a block posts each vector, with its
pivot's rank, in the inverted files of these pivots. A query walks the files of its own nearest pivots, which adds up how far
the footrule distance (sum of rank differences, a missing pivot counting as last) falls below its maximum. The nearest share
of each block by footrule, ties included, is ranked again by the inner product of the original vectors in double precision.

The pivots come from a bounded sample (`SAMPLE` vectors at most); every vector is indexed.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take no part, nor do those with a null
id or with another length than most; of repeated ids the least vector counts; an empty table gives no rows; columns besides
`vec_id` and `embedding` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.session import checkpointed

SAMPLE = 4096
BLOCK = 8192
QUERIES = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    return checkpointed(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def pivots_of(vectors: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors of a bounded sample, those with the least hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, pivots * 2)).select("embedding").collect()
    matrix = np.unique(np.array([r["embedding"] for r in rows], dtype=np.float64), axis=0)
    return matrix[np.random.default_rng(7).permutation(len(matrix))[:pivots]]


def orders(matrix: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of every row by inner product, nearest first."""
    length = min(length, len(pivots))
    near = matrix @ pivots.T
    top = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def search_block(
    ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray,
    length: int, k: int, share: float,
) -> pd.DataFrame:
    """The best k of a block for every query."""
    order = orders(matrix, pivots, length)
    length = order.shape[1]
    # Inverted files: for each pivot the rows that have it among their nearest, and its rank there.
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    posted, rank = by_pivot // length, by_pivot % length
    ends = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
    wanted = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
    out = []
    for query, vector, own in zip(query_ids, queries, orders(queries, pivots, length)):
        gain = np.zeros(len(ids), dtype=np.int32)
        for place, pivot in enumerate(own):
            file = slice(ends[pivot], ends[pivot + 1])
            gain[posted[file]] += length - np.maximum(place, rank[file])
        if wanted < len(ids):
            bound = np.partition(gain, len(ids) - wanted)[len(ids) - wanted]
            near = np.flatnonzero(gain >= bound)
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != query]
        score = (matrix[near] * vector).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, length: int = 48, share: float = 0.3
) -> DataFrame:
    """query_id, rank, vec_id, score. `vectors` and `queries` come from `usable`; a query's own row is no candidate."""
    sizes = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    vectors, queries = (t.filter(F.size("embedding") == usual["n"]) for t in (vectors, queries))
    chosen = pivots_of(vectors, pivots)
    blocks, groups = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))

    def dealt(rows: DataFrame, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_count - 1)))
        )

    def find(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_block(
            items["vec_id"].to_numpy(), _matrix(items["embedding"]), asked["vec_id"].to_numpy(), _matrix(asked["embedding"]),
            chosen, length, k, share,
        )

    left = dealt(vectors, "block", blocks, "part", groups).groupBy("block", "part")
    right = dealt(queries, "part", groups, "block", blocks).groupBy("block", "part")
    found = left.cogroup(right).applyInPandas(find, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
