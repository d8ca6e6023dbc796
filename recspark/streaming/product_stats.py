"""Product statistics kept current from a stream of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.functions.numbers import rounded
from recspark.sources.versions import VersionedTable


def windowed_stats(reviews: DataFrame, *, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rating sum and count per product and window; repeats of a review and late rows are dropped.

    Tasks drop the repeats they see before the shuffle to the state, so many copies of one review do not meet in one task.
    """
    columns = reviews.select("review_id", "asin", "rating", "unixReviewTime")

    def first_of_each_id(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = np.asarray(batch.column("review_id").dictionary_encode().indices.fill_null(-1))
            yield batch.take(pa.array(np.sort(np.unique(ids, return_index=True)[1])))

    timed = columns.mapInArrow(first_of_each_id, columns.schema).withColumn("event_time", F.timestamp_seconds("unixReviewTime")).withWatermark("event_time", delay)
    return (
        timed.dropDuplicatesWithinWatermark(["review_id"])
        .groupBy(F.window("event_time", window), "asin")
        .agg(F.sum("rating").alias("rating_sum"), F.count("rating").alias("num_reviews"))
        .select(F.col("window.start").alias("window_start"), "asin", "rating_sum", "num_reviews")
    )


def run_stats_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    *,
    max_files: int | None = None,
    most: int = 32,
    **windows,
) -> None:
    """Process what is in the Parquet folder `source` and stop; a later call goes on from there.

    Each micro-batch adds the present totals of the windows it changed, open ones too, to a versioned table; a batch that is run
    again adds nothing. From `most` batches on the table is cut to the totals written last.
    """
    table = VersionedTable(spark, target)

    def write(changed: DataFrame, batch_id: int) -> None:
        rows = changed.withColumn("batch", F.lit(batch_id).cast("bigint"))
        state = table.append(rows, str(batch_id), most=1 << 30)
        if len(state.folders) >= most:
            table.replace(latest_totals(table.read(state)), old=state)

    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        windowed_stats(reader.parquet(source), **windows)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_totals(written: DataFrame) -> DataFrame:
    """Of each window and product the totals that the last batch wrote."""
    last = written.groupBy("window_start", "asin").agg(F.max_by(F.struct("rating_sum", "num_reviews", "batch"), "batch").alias("t"))
    return last.select("window_start", "asin", "t.*")


def current_stats(spark: SparkSession, target: str) -> DataFrame:
    """`(asin, avg_rating, num_reviews)` over all windows, open or closed; of a window the totals written last count."""
    table = VersionedTable(spark, target)
    columns = "window_start timestamp, asin string, rating_sum double, num_reviews bigint, batch bigint"
    written = table.read() if table.exists() else spark.createDataFrame([], columns)
    return latest_totals(written).groupBy("asin").agg(
        rounded(F.sum("rating_sum") / F.sum("num_reviews")).alias("avg_rating"),
        F.sum("num_reviews").alias("num_reviews"),
    )
