"""Ranking inside groups: top-k, exclusion, re-ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this k Catalyst cuts each group to k rows before the shuffle (WindowGroupLimit).
GROUP_LIMIT_THRESHOLD = 1000
SALT_BUCKETS = 64


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group in `order`, numbered from 1 in column `rank`.

    A group may hold most of the table. For k below the planner's threshold every
    map task keeps only k rows per group before the shuffle. For larger k the same cut is
    made here in two steps, over salted parts of the group first.
    """
    if k >= GROUP_LIMIT_THRESHOLD:
        salt = "_salt"
        part = Window.partitionBy(*keys, salt).orderBy(*order)
        df = (
            df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(SALT_BUCKETS)))
            .withColumn("_part_rank", F.row_number().over(part))
            .filter(F.col("_part_rank") <= k)
            .drop(salt, "_part_rank")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_overall(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of the whole table (k is small), numbered from 1."""
    # The window sees only the k rows that the limit left.
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def best_first(item: str = "asin", score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col(item).asc()]


def exclude_items(ranked: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the rows whose keys occur in `excluded`; ranks are left as they are.

    `excluded` is reduced to its distinct keys first: before the shuffle, and in the join's partitioning.
    """
    return ranked.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def keep_items(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the rows whose keys occur in `wanted`."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
