"""Popularity baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.functions.numbers import fixed
from recspark.functions.popularity import popularity_score
from recspark.operators.ranking import best_first, exclude_items, top_overall, top_per_group
from recspark.session import checkpointed

POPULAR_POOL = 1000  # what the ranking of the most popular products shows
BROADCAST_ROWS = 100_000


def display_columns(products: DataFrame) -> list[Column]:
    """The product columns of a result row; a missing column becomes its default."""
    have = products.columns
    return [
        F.col("title") if "title" in have else F.lit("Unknown").alias("title"),
        F.col("category") if "category" in have else F.lit("").alias("category"),
        F.col("price") if "price" in have else F.lit(0.0).alias("price"),
        F.col("image_url") if "image_url" in have else F.lit(None).cast("string").alias("image_url"),
    ]


def popularity_topk(products: DataFrame, n: int = POPULAR_POOL) -> DataFrame:
    """The n products of highest `avg_rating * ln(1 + num_reviews)`."""
    scored = products.withColumn("score", popularity_score(F.col("avg_rating"), F.col("num_reviews")))
    return top_overall(scored, best_first(), n)


def recommend_popular(products: DataFrame, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """The k most popular products besides `excluded(asin)`; the exclusion comes first, so k remain if there are k."""
    pool = products.withColumn("score", popularity_score(F.col("avg_rating"), F.col("num_reviews")))
    if excluded is not None:
        pool = exclude_items(pool, excluded, ["asin"])
    note = F.concat(
        F.lit("Popular product: "), F.col("num_reviews").cast("string"), F.lit(" reviews, "),
        fixed(F.col("avg_rating"), 1), F.lit("★"),
    )
    return top_overall(pool, best_first(), k).select(
        "rank", "asin", "score", note.alias("explanation"), *display_columns(pool)
    )


def recommend_popular_for_users(
    products: DataFrame, users: DataFrame, excluded: DataFrame, k: int = 10, *, first: int = 64
) -> DataFrame:
    """The k most popular products for each of `users(query_id)`, without that user's `excluded(query_id, asin)`.

    The ranking is read in blocks, each twice as long as the one before; a user goes on to the next block only while short of k. So one
    user's many exclusions cost the others nothing.
    """
    ids = checkpointed(excluded.select("query_id", "asin").distinct())
    scored = products.withColumn("score", popularity_score(F.col("avg_rating"), F.col("num_reviews"))).select("asin", "score")
    ranked = checkpointed(scored)
    n_products = ranked.count()
    short = checkpointed(users.select("query_id").distinct().withColumn("have", F.lit(0)))
    found, begin, size, above = [], 0, max(first, k), None
    while begin < n_products and not short.isEmpty():
        # What comes after the last product of the block before; a limit, so no task sorts the whole ranking.
        rest = ranked if above is None else ranked.filter(
            (F.col("score") < above["score"]) | ((F.col("score") == above["score"]) & (F.col("asin") > above["asin"]))
        )
        block = checkpointed(rest.orderBy(*best_first()).limit(size))
        above = block.orderBy(F.col("score").asc(), F.col("asin").desc()).first()
        if above is None:
            break
        # At most `size` rows; beyond BROADCAST_ROWS Spark decides.
        given = short.crossJoin(F.broadcast(block) if size <= BROADCAST_ROWS else block)
        left = exclude_items(given, ids, ["query_id", "asin"])
        best = top_per_group(left, ["query_id"], best_first(), k).filter(F.col("rank") <= k - F.col("have"))
        found.append(checkpointed(best.select("query_id", "asin", "score", (F.col("rank") + F.col("have")).cast("int").alias("rank"))))
        more = found[-1].groupBy("query_id").agg(F.max("rank").alias("now"))
        short = short.join(more, "query_id", "left").select("query_id", F.coalesce("now", "have").alias("have")).filter(F.col("have") < k)
        short = checkpointed(short)
        begin, size = begin + size, size * 2
    if not found:
        kinds = f"query_id {dict(users.dtypes)['query_id']}, asin {dict(products.dtypes)['asin']}, score double, rank int"
        return users.sparkSession.createDataFrame([], kinds)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def popular_fallback(products: DataFrame, k: int = 10) -> DataFrame:
    """The k most reviewed products, scored by mean rating: what a user without any input gets."""
    order = [F.col("num_reviews").desc(), F.col("asin").asc()]
    note = F.concat(F.lit("Popular product with "), F.col("num_reviews").cast("string"), F.lit(" reviews"))
    return top_overall(products, order, k).select(
        "rank", "asin", F.col("avg_rating").alias("score"), note.alias("explanation"), *display_columns(products)
    )
