"""Quality of recommendation lists against held-out items."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.functions.numbers import rounded
from recspark.functions.vectors import as_doubles, unit

MIN_PURCHASES = 5


def holdout_split(reviews: DataFrame, min_purchases: int = MIN_PURCHASES) -> tuple[DataFrame, DataFrame]:
    """`(train, test)`: the newest review of every user with enough reviews is held out.

    Users are counted with one partial aggregation; rows are then split by their unique id, so a user
    with very many reviews is no hot key.
    """
    latest = F.max_by(
        F.struct("review_id", "asin", "unixReviewTime"), F.struct("unixReviewTime", "review_id")
    ).alias("held")
    users = reviews.groupBy("reviewerID").agg(F.count("*").alias("n"), latest).filter(F.col("n") >= min_purchases)
    test = users.select("reviewerID", "held.review_id", "held.asin", "held.unixReviewTime")
    train = reviews.join(users.select("reviewerID"), "reviewerID", "left_semi").join(
        test.select("review_id"), "review_id", "left_anti"
    )
    return train, test


def _hits(recommended: DataFrame, relevant: DataFrame, k: int, key: str) -> DataFrame:
    """Per key of `relevant`: number of relevant ids, and the array of ranks at which they were found."""
    distinct = relevant.select(key, "asin").distinct()
    listed = recommended.filter(F.col("rank") <= k).select(key, "asin", "rank")
    return (
        distinct.join(listed, [key, "asin"], "left")
        .groupBy(key)
        .agg(
            F.count("*").alias("n_relevant"),
            F.count("rank").alias("n_hits"),
            F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("gain"),
            F.min("rank").alias("first_hit"),
        )
    )


def _ideal(n_relevant: Column, k: int) -> Column:
    positions = F.sequence(F.lit(1), F.least(n_relevant, F.lit(k)).cast("int"))
    return F.aggregate(positions, F.lit(0.0), lambda t, i: t + F.lit(1.0) / F.log2(i + 1))


def ndcg_at_k(recommended: DataFrame, relevant: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """`(key, ndcg)` with binary relevance, one row per key with a relevant id."""
    hits = _hits(recommended, relevant, k, key)
    return hits.select(key, rounded(F.coalesce("gain", F.lit(0.0)) / _ideal(F.col("n_relevant"), k)).alias("ndcg"))


def recall_at_k(recommended: DataFrame, relevant: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    hits = _hits(recommended, relevant, k, key)
    return hits.select(key, rounded(F.col("n_hits") / F.col("n_relevant")).alias("recall"))


def _first_hits(recommended: DataFrame, relevant: DataFrame, k: int, key: str) -> DataFrame:
    value = F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))
    return _hits(recommended, relevant, k, key).select(key, value.alias("reciprocal_rank"))


def reciprocal_rank(recommended: DataFrame, relevant: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    found = _first_hits(recommended, relevant, k, key)
    return found.withColumn("reciprocal_rank", rounded(F.col("reciprocal_rank")))


def mean_reciprocal_rank(recommended: DataFrame, relevant: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """One row: the mean over all keys with a relevant id."""
    return _first_hits(recommended, relevant, k, key).agg(
        rounded(F.avg("reciprocal_rank")).alias("mrr"), F.count("*").alias("n_users")
    )


def diversity_at_k(recommended: DataFrame, vectors: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """`(key, diversity)`: the mean of 1 - cosine over the item pairs of a list.

    The squared length of the sum of unit vectors holds all pair cosines, so no pairs are built.
    """
    listed = recommended.filter(F.col("rank") <= k).select(key, "asin").join(
        vectors.select("asin", unit(F.col("embedding")).alias("u")), "asin"
    )
    sums = listed.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"),
        F.sum(F.aggregate(as_doubles(F.col("u")), F.lit(0.0), lambda t, x: t + x * x)).alias("own"),
        F.count("*").alias("n"),
    )
    squared = F.aggregate("total", F.lit(0.0), lambda t, x: t + x * x)
    mean_cosine = (squared - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return sums.filter(F.col("n") > 1).select(key, rounded(1 - mean_cosine).alias("diversity"))
