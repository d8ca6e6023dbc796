"""Reviews and metadata to one row per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.numbers import rounded
from recspark.functions.text import product_text
from recspark.session import checkpointed

# Fixed values.
DIGEST_REVIEWS = 10
DIGEST_SEPARATOR = " | "
MINIMAL_REVIEWS = 5
MINIMAL_SEPARATOR = " "
UNTITLED = "Untitled Product"
DEFAULT_CATEGORY = "Electronics"
REVIEW_ORDER = ["unixReviewTime", "review_id"]
CHUNK = 100_000


def product_stats(reviews: DataFrame, min_reviews: int = 0, min_rating: float | None = None) -> DataFrame:
    """Mean and count of the ratings of every product; null ratings do not count."""
    stats = reviews.groupBy("asin").agg(F.avg("rating").alias("mean"), F.count("rating").alias("num_reviews"))
    if min_reviews:
        stats = stats.filter(F.col("num_reviews") >= min_reviews)
    if min_rating is not None:
        stats = stats.filter(F.col("mean") >= min_rating)
    return stats.select("asin", rounded(F.col("mean")).alias("avg_rating"), "num_reviews")


def _combined(rows, n: int):
    """Rows (asin, total, num_reviews, first) in the order of `asin` -> one row per run of an `asin`, with its n first texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    codes = np.asarray(rows.column("asin").dictionary_encode().combine_chunks().indices)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    run = np.cumsum(np.diff(codes, prepend=-1) != 0) - 1
    total = np.add.reduceat(np.asarray(rows.column("total")), starts)
    count = np.add.reduceat(np.asarray(rows.column("num_reviews")), starts)
    lists = rows.column("first").combine_chunks()
    texts, of = lists.flatten(), run[np.asarray(pc.list_parent_indices(lists))]
    fields = [texts.field(i) for i in range(texts.type.num_fields)]
    table = pa.table([pa.array(of), *fields], names=["run", *REVIEW_ORDER, "text"])
    order = pc.sort_indices(table, [(c, "ascending") for c in ("run", *REVIEW_ORDER)], null_placement="at_start")
    of = of[np.asarray(order)]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < n
    kept = texts.take(order.filter(pa.array(keep)))
    ends = np.searchsorted(of[keep], np.arange(len(starts) + 1)).astype(np.int32)
    first = pa.ListArray.from_arrays(pa.array(ends), kept)
    return pa.table([rows.column("asin").take(pa.array(starts)), total, count, first], names=["asin", "total", "num_reviews", "first"])


def review_summary(reviews: DataFrame, n: int = DIGEST_REVIEWS) -> DataFrame:
    """`(asin, total, num_reviews, first)`: sum and count of the ratings of every product and its n first reviews with a text.

    One scan and one shuffle: tasks add up `CHUNK` reviews at a time and hand on at most n texts per product, and the sorted parts
    of a product are merged as they are read, so that a product with most reviews is no larger a task than others.
    """
    columns = ["asin", "rating", *REVIEW_ORDER, "reviewText"]
    kinds = dict(reviews.dtypes)
    order = ", ".join(f"{c}: {kinds[c]}" for c in REVIEW_ORDER)
    schema = f"asin {kinds['asin']}, total double, num_reviews bigint, first array<struct<{order}, text: string>>"

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def chunk(held):
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows, [("asin", "ascending")]))
            rated, text = pc.is_valid(rows.column("rating")), rows.column("reviewText")
            has = np.asarray(pc.is_valid(text))
            ends = np.append(0, np.cumsum(has)).astype(np.int32)
            fields = [rows.column(c).filter(pa.array(has)).combine_chunks() for c in (*REVIEW_ORDER, "reviewText")]
            first = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, [*REVIEW_ORDER, "text"]))
            total = pc.fill_null(rows.column("rating"), 0.0)
            raw = pa.table([rows.column("asin"), total, rated.cast(pa.int64()), first], names=["asin", "total", "num_reviews", "first"])
            return _combined(raw, n).to_batches()

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK:
                yield from chunk(held)
                held, size = [], 0
        if held:
            yield from chunk(held)

    def merged(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
                rows = _combined(rows, n)
                # The last product may go on in the next batch.
                yield from rows.slice(0, rows.num_rows - 1).to_batches()
                last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield from last.to_batches()

    rows = reviews.filter(F.col("asin").isNotNull()).select("asin", F.col("rating").cast("double").alias("rating"), *columns[2:])
    return rows.mapInArrow(partial, schema).repartition("asin").sortWithinPartitions("asin").mapInArrow(merged, schema)


def joined_texts(first: str = "first", separator: str = DIGEST_SEPARATOR):
    return F.array_join(F.transform(first, lambda r: r["text"]), separator)


def review_digest(reviews: DataFrame, n: int = DIGEST_REVIEWS, separator: str = DIGEST_SEPARATOR) -> DataFrame:
    """`(asin, all_reviews)`: the first n review texts of every product, joined."""
    found = review_summary(reviews, n).filter(F.size("first") > 0)
    return found.select("asin", joined_texts(separator=separator).alias("all_reviews"))


def _kept(summary: DataFrame, min_reviews: int = 0, min_rating: float | None = None) -> DataFrame:
    """`(asin, avg_rating, num_reviews, first)` of the products with enough and good enough reviews."""
    rows = summary.withColumn("mean", F.when(F.col("num_reviews") > 0, F.col("total") / F.col("num_reviews")))
    rows = rows.filter(F.col("num_reviews") >= min_reviews)
    if min_rating is not None:
        rows = rows.filter(F.col("mean") >= min_rating)
    return rows.select("asin", rounded(F.col("mean")).alias("avg_rating"), "num_reviews", "first")


def minimal_metadata(reviews: DataFrame, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """Metadata for products nobody described: the first reviews serve as the description."""
    return _kept(review_summary(reviews, MINIMAL_REVIEWS)).select(
        "asin",
        "avg_rating",
        "num_reviews",
        joined_texts(separator=MINIMAL_SEPARATOR).alias("description"),
        F.concat(F.lit("Product "), "asin").alias("title"),
        F.lit(0.0).alias("price"),
        F.lit(category).alias("category"),
    )


def build_catalogue(
    reviews: DataFrame,
    metadata: DataFrame,
    min_reviews: int = 2,
    min_rating: float = 3.0,
    *,
    category: str = DEFAULT_CATEGORY,
    dedupe: bool = False,
    description_limit: int | None = None,
    reviews_limit: int | None = None,
) -> DataFrame:
    """Products with enough and good enough reviews, joined with their metadata and described as text.

    Repeated metadata rows of a product stay repeated unless `dedupe` is set. The limits cut the text; none by default. What the reviews
    give is written once, so that their shuffle files are gone when the texts of the metadata are shuffled.
    """
    known = _kept(review_summary(reviews), min_reviews, min_rating)
    known = checkpointed(known.select("asin", "avg_rating", "num_reviews", joined_texts().alias("all_reviews")))
    described = metadata.drop("avg_rating", "num_reviews")
    if dedupe:
        described = one_per_product(described)
    for column in ("brand", "imageURL"):
        if column not in described.columns:
            kind = "string" if column == "brand" else "array<string>"
            described = described.withColumn(column, F.lit(None).cast(kind))
    joined = known.join(described, "asin", "inner")
    filled = (
        joined.withColumn("title", F.coalesce("title", F.lit(UNTITLED)))
        .withColumn("description", F.coalesce("description", "all_reviews", F.lit("")))
        .withColumn("category", F.coalesce("category", F.lit(category)))
    )
    text = product_text(*(F.col(c) for c in ("title", "brand", "category", "description", "all_reviews")), description_limit, reviews_limit)
    return filled.withColumn("text_for_embedding", text).withColumn("image_url", first_image())


def first_image(column: str = "imageURL"):
    return F.get(F.col(column), 0)


def one_per_product(metadata: DataFrame) -> DataFrame:
    """One metadata row per product: the greatest of its rows, so the choice does not vary."""
    others = [c for c in metadata.columns if c != "asin"]
    row = F.struct(*others)
    return metadata.groupBy("asin").agg(F.max(row).alias("row")).select("asin", "row.*")


def build_catalogue_relaxed(reviews: DataFrame, metadata: DataFrame, min_reviews: int = 1, **options) -> DataFrame:
    """As `build_catalogue`; if nothing passes the filter, every reviewed product is kept. No plan calls this by itself."""
    products = build_catalogue(reviews, metadata, min_reviews, **options)
    if products.isEmpty():
        return build_catalogue(reviews, metadata, 1, 0.0, **options)
    return products
