"""Vectors of new products, appended to the delta table as the products arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.operators.embed import embed_texts
from recspark.sources.versions import VersionedTable


def run_delta_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    *,
    text: str = "text_for_embedding",
    most: int = 32,
    **embedding,
) -> None:
    """Embed the products of the Parquet folder `source` that have not been seen yet, then stop.

    Each micro-batch is added to a versioned table once: a batch that is tried again after a failure leaves no second copy. The
    batch number is the version. From `most` batches on only the newest vector of each product stays.
    """
    table = VersionedTable(spark, target)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = embed_texts(batch.select("asin", text), text, **embedding).drop(text)
        state = table.append(rows.withColumn("version", F.lit(batch_id + 1).cast("bigint")), str(batch_id), most=1 << 30)
        if len(state.folders) >= most:
            newest = table.read(state).groupBy("asin").agg(F.max_by(F.struct("embedding", "version"), "version").alias("v"))
            table.replace(newest.select("asin", "v.*"), old=state)

    query = (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def delta_vectors(spark: SparkSession, target: str) -> DataFrame:
    """The delta table `(asin, embedding, version)`; main vectors count as version 0."""
    return VersionedTable(spark, target).read().select("asin", "embedding", "version")
