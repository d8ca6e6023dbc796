"""Profile vectors of users and their blend with a text query."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.vectors import NORM_EPSILON, as_doubles, mixed, norm, zeros
from recspark.sources.versions import VersionedTable

AGGREGATIONS = ("mean", "max", "weighted_mean")


def profile_vectors(
    history: DataFrame,
    vectors: DataFrame,
    how: str = "mean",
    *,
    user: str = "reviewerID",
    weight: str | None = None,
    empty_dim: int | None = None,
) -> DataFrame:
    """One vector per user: element-wise mean or maximum over the vectors of the history.

    A repeated item counts each time. `weighted_mean` uses uniform weights unless `weight` names a
    column. The aggregation is partial, so a user with very many rows is no hot task. Users
    without any known item get no row, or the zero vector when `empty_dim` is given.
    """
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {how}")
    known = history.join(vectors.select("asin", "embedding"), "asin")
    vector = array_to_vector(as_doubles(F.col("embedding")))
    if how == "max":
        combined = Summarizer.max(vector)
    elif how == "weighted_mean" and weight is not None:
        combined = Summarizer.mean(vector, F.col(weight))
    else:
        combined = Summarizer.mean(vector)
    profiles = known.groupBy(user).agg(vector_to_array(combined).alias("embedding"))
    if empty_dim is None:
        return profiles
    return (
        history.select(user).distinct().join(profiles, user, "left")
        .withColumn("embedding", F.coalesce("embedding", zeros(empty_dim)))
    )


def profile_sums(history: DataFrame, vectors: DataFrame, *, user: str = "reviewerID") -> DataFrame:
    """`(user, sums, n)`: the sum of the vectors of a user's known items, and their number. Sums of several parts add up."""
    known = history.select(user, "asin").join(vectors.select("asin", "embedding"), "asin")
    sums = vector_to_array(Summarizer.sum(array_to_vector(as_doubles(F.col("embedding")))))
    return known.groupBy(user).agg(sums.alias("sums"), F.count("*").alias("n"))


def update_profiles(
    store: VersionedTable, batch: DataFrame, vectors: DataFrame, name: str, *, user: str = "reviewerID"
) -> None:
    """Adds a batch of new history rows to the stored sums; rows of earlier batches are not read again.

    A batch of this `name` that is in the store already adds nothing, so a run that is tried again counts once. The vectors must
    be those of the batches before; when they change, the store is built anew.
    """
    old = store.state()
    if name in old.batches:
        return
    fresh = profile_sums(batch, vectors, user=user)
    if old.version:
        before = store.read(old).select(user, F.col("sums").alias("_sums"), F.col("n").alias("_n"))
        added = F.zip_with("_sums", "sums", lambda a, b: a + b)
        fresh = before.join(fresh, user, "full").select(
            user, F.when(F.col("sums").isNull(), F.col("_sums")).when(F.col("_sums").isNull(), F.col("sums")).otherwise(added).alias("sums"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
        )
    store.replace(fresh, name, old)


def stored_profiles(store: VersionedTable) -> DataFrame:
    """`(user, embedding)`: the mean vectors of all batches."""
    return _means(store.read())


def changed_profiles(store: VersionedTable, *, user: str = "reviewerID") -> DataFrame:
    """The mean vectors of the users whom the last version changed, found by comparison with the one before."""
    state = store.state()
    now = store.read(state)
    if not state.before:
        return _means(now)
    was = store.spark.read.schema(state.schema).parquet(*[f"{store.path}/{f}" for f in state.before])
    return _means(now.join(was.select(user, "n"), [user, "n"], "left_anti"))


def _means(sums: DataFrame) -> DataFrame:
    return sums.withColumn("embedding", F.transform("sums", lambda x: x / F.col("n"))).drop("sums", "n")


def blend_query_vectors(profiles: DataFrame, texts: DataFrame, key: str = "query_id") -> DataFrame:
    """History vector and query vector combined and normalised; history alone stays as it is."""
    both = profiles.select(key, F.col("embedding").alias("_history")).join(
        texts.select(key, F.col("embedding").alias("_query")), key, "left"
    )
    blended = both.withColumn("_mixed", mixed(F.col("_history"), F.col("_query"))).withColumn(
        "_length", norm(F.col("_mixed")) + F.lit(NORM_EPSILON)
    )
    scaled = F.transform("_mixed", lambda x: x / F.col("_length"))
    return blended.select(
        key, F.when(F.col("_query").isNull(), as_doubles(F.col("_history"))).otherwise(scaled).alias("embedding")
    )
