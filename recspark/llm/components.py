"""Connected components of a link table by joins and minima: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.session import checkpointed


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.sum(F.pmod(F.xxhash64("high", "low"), F.lit(1 << 30)))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link to another node; root is the least node that it reaches.

    A round hangs every node's larger neighbours, then its smaller ones, on the least of them. Rounds end when the links
    no longer change. Each round is written to the shared folder; nothing is collected but a count and two sums.
    """
    links = checkpointed(
        links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct()
    )
    before = _signature(links)
    while True:
        ends = links.select(F.col("low").alias("node"), F.col("high").alias("other")).unionAll(
            links.select(F.col("high").alias("node"), F.col("low").alias("other"))
        )
        least = ends.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
        large = (
            links.join(least, F.col("low") == F.col("node")).select(F.col("root").alias("low"), "high").distinct()
        )
        roots = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(roots, "high").filter("low > root").select(F.col("root").alias("low"), F.col("low").alias("high"))
        links = checkpointed(small.unionAll(roots.select(F.col("root").alias("low"), "high")).distinct())
        now = _signature(links)
        if now == before:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = now
