"""User histories and the texts made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators.ranking import top_per_group

PRODUCT_COLUMNS = ["title", "description", "category", "image_url", "price"]

# Phrases of the summaries.
NO_HISTORY = "No purchase history available."
NO_HISTORY_DISPLAY = "No purchase history"
DEFAULT_QUERY_TEXT = "recommend popular products"
TASTE_PHRASE = "products that I would like based on my purchase history"
SUMMARY_LINES = 10
TEXT_TITLES = 3
TEXT_CATEGORIES = 3


def recent_best(reviews: DataFrame, k: int = 10) -> DataFrame:
    """Of the 2k most recent reviews of every user the k best rated; ties keep the newest first."""
    recent = top_per_group(
        reviews, ["reviewerID"], [F.col("unixReviewTime").desc(), F.col("review_id").asc()], 2 * k, "recency"
    )
    best = [F.col("rating").desc_nulls_last(), F.col("recency").asc()]
    return top_per_group(recent, ["reviewerID"], best, k, "history_rank").drop("recency")


def with_products(history: DataFrame, products: DataFrame) -> DataFrame:
    """Add the product columns that the catalogue has; unknown products keep nulls."""
    present = [c for c in PRODUCT_COLUMNS if c in products.columns]
    return history.join(products.select("asin", *present), "asin", "left")


def user_history(reviews: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    return with_products(recent_best(reviews, k), products)


def _rating_text(history: DataFrame):
    if "rating" not in history.columns:
        return F.lit("N/A")
    return F.coalesce(F.col("rating").cast("string"), F.lit("N/A"))


def _lines(history: DataFrame, bullet: str, missing: str):
    line = F.concat(
        F.lit(bullet), F.coalesce("title", F.lit(missing)), F.lit(" (Rating: "), _rating_text(history), F.lit("/5)")
    )
    return F.when(F.col("history_rank") <= SUMMARY_LINES, line)


def _joined_lines(history: DataFrame, bullet: str, missing: str, end: str) -> DataFrame:
    lined = history.select("reviewerID", "history_rank", _lines(history, bullet, missing).alias("line"))
    # listagg skips the nulls, so at most SUMMARY_LINES lines are held per user.
    return lined.groupBy("reviewerID").agg(
        F.count("*").alias("n_items"),
        F.expr(f"listagg(line, '{end}') WITHIN GROUP (ORDER BY history_rank)").alias("lines"),
    )


def history_summary(history: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """`(reviewerID, summary)`: the count and the first ten titles; a fixed text for users without history."""
    texts = _joined_lines(history, "- ", "Unknown", "\\n").select(
        "reviewerID",
        F.concat(
            F.lit("User has purchased "), F.col("n_items").cast("string"), F.lit(" products:\n"), "lines", F.lit("\n")
        ).alias("summary"),
    )
    return _for_users(texts, users, "summary", NO_HISTORY)


def history_display(history: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """`(reviewerID, display)`: the bullet list shown to people."""
    texts = _joined_lines(history, "• ", "Unknown Product", "\\n").select("reviewerID", F.col("lines").alias("display"))
    return _for_users(texts, users, "display", NO_HISTORY_DISPLAY)


def _for_users(texts: DataFrame, users: DataFrame | None, column: str, default: str) -> DataFrame:
    if users is None:
        return texts
    return (
        users.select("reviewerID").distinct().join(texts, "reviewerID", "left")
        .withColumn(column, F.coalesce(column, F.lit(default)))
    )


def rich_query_text(
    history: DataFrame, queries: DataFrame | None = None, users: DataFrame | None = None
) -> DataFrame:
    """`(reviewerID, query_text)` from the first distinct titles and categories of the history.

    `queries(reviewerID, text)` adds the user's own words. Users listed in `users` or `queries`
    without any history get their words alone, or the default text.
    """
    pairs = history.select(
        "reviewerID",
        "history_rank",
        F.explode(
            F.array(
                F.struct(F.lit("title").alias("kind"), F.col("title").alias("value")),
                F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                F.struct(F.lit("any").alias("kind"), F.lit("").alias("value")),
            )
        ).alias("p"),
    ).select("reviewerID", "history_rank", "p.kind", "p.value")
    first_seen = (
        pairs.filter(F.col("value").isNotNull())
        .groupBy("reviewerID", "kind", "value")
        .agg(F.min("history_rank").alias("seen"))
    )
    kept = top_per_group(first_seen, ["reviewerID", "kind"], [F.col("seen"), F.col("value")], max(TEXT_TITLES, TEXT_CATEGORIES))

    def joined(kind: str) -> str:
        return f"listagg(CASE WHEN kind = '{kind}' THEN value END, ', ') WITHIN GROUP (ORDER BY seen, value)"

    parts = kept.groupBy("reviewerID").agg(
        F.expr(joined("title")).alias("titles"), F.expr(joined("category")).alias("categories")
    )
    known = parts.withColumn("phrase", F.lit(TASTE_PHRASE))
    people = users.select("reviewerID") if users is not None else history.select("reviewerID")
    if queries is not None:
        people = people.unionByName(queries.select("reviewerID"))
    full = people.distinct().join(known, "reviewerID", "left")
    if queries is not None:
        full = full.join(queries.select("reviewerID", F.col("text").alias("words")), "reviewerID", "left")
    else:
        full = full.withColumn("words", F.lit(None).cast("string"))
    text = F.concat_ws(
        ". ",
        F.concat(F.lit("Products similar to: "), "titles"),
        F.concat(F.lit("in categories: "), "categories"),
        "phrase",
        F.when(F.col("words") != "", F.col("words")),
    )
    return full.select(
        "reviewerID",
        F.when(text == "", F.lit(DEFAULT_QUERY_TEXT)).otherwise(F.concat(text, F.lit("."))).alias("query_text"),
    )


def first_titles(history: DataFrame, n: int = 5) -> DataFrame:
    """`(reviewerID, titles)`: the titles of the first n history items, in order."""
    first = history.filter((F.col("history_rank") <= n) & F.col("title").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("history_rank", "title")))
    return first.groupBy("reviewerID").agg(F.transform(listed, lambda h: h["title"]).alias("titles"))


def all_users(reviews: DataFrame, limit: int | None = None) -> DataFrame:
    users = reviews.select("reviewerID").distinct()
    return users if limit is None else users.orderBy("reviewerID").limit(limit)
