from recspark.operators.search import exact_topk, newest_vectors
from recspark.sources.files import path_exists
from recspark.sources.versions import VersionedTable
from recspark.session import checkpointed, scratch, shared_dir, spread, work_path
from recspark.streaming.delta_vectors import delta_vectors, run_delta_stream
from recspark.streaming.product_stats import current_stats, run_stats_stream

DAY = 86400
SCHEMA = "review_id string, asin string, rating double, unixReviewTime bigint"


def test_statistics_stream_drops_repeats_and_late_rows(spark):
    source, target, state = (work_path(spark, n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        run_stats_stream(spark, source, SCHEMA, target, state)
        return {r["asin"]: (r["avg_rating"], r["num_reviews"]) for r in current_stats(spark, target).collect()}

    first = arrive(
        ("1", "a", 4.0, 10), ("1", "a", 4.0, 10), ("2", "a", 2.0, 20), ("3", "b", None, 30), ("4", "a", 5.0, DAY), ("5", "z", 1.0, 4 * DAY)
    )
    assert first == {"a": (3.666667, 3), "b": (None, 0), "z": (1.0, 1)}
    # Day 0 is closed: its late row is dropped. Rows of open days count at once.
    second = arrive(("6", "a", 1.0, 40), ("7", "b", 3.0, 3 * DAY), ("8", "z", 1.0, 9 * DAY))
    assert second["a"] == (3.666667, 3) and second["b"] == (3.0, 1) and second["z"] == (1.0, 2)
    third = arrive(("5", "z", 1.0, 4 * DAY), ("9", "z", 4.0, 9 * DAY + 1))
    assert third["z"] == (2.0, 3) and {k: v for k, v in third.items() if k != "z"} == {k: v for k, v in second.items() if k != "z"}
    assert current_stats(spark, work_path(spark, "none")).count() == 0


def test_batches_are_compacted(spark):
    """Many micro-batches, one file each: the tables hold few folders, and the numbers are those of all batches."""
    source, target, state = (work_path(spark, n) for n in ("in", "out", "state"))
    for n in range(7):
        spark.createDataFrame([(str(n), "a", float(n), 10 + n), (f"x{n}", f"p{n}", 1.0, 20)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run_stats_stream(spark, source, SCHEMA, target, state, max_files=1, most=3)
    table = VersionedTable(spark, target)
    assert len(table.state().folders) < 3 and len(table.state().batches) >= 7
    got = {r["asin"]: (r["avg_rating"], r["num_reviews"]) for r in current_stats(spark, target).collect()}
    assert got == {"a": (3.0, 7)} | {f"p{n}": (1.0, 1) for n in range(7)}
    assert table.vacuum() > 0 and current_stats(spark, target).count() == 8


def test_delta_stream_serves_the_newest_vectors(spark):
    source, target, state = (work_path(spark, n) for n in ("in", "delta", "state"))
    schema = "asin string, text_for_embedding string"
    for text in ("red chair", "blue table"):
        spark.createDataFrame([("a", text), (text[:1], text)], schema).write.mode("append").parquet(source)
        run_delta_stream(spark, source, schema, target, state)
    rows = delta_vectors(spark, target)
    assert sorted((r["asin"], r["version"]) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 2), ("r", 1)]
    main = rows.limit(0)
    served = newest_vectors(main, rows)
    query = rows.filter("asin = 'b'").selectExpr("'q' AS query_id", "embedding")
    assert [r["asin"] for r in exact_topk(query, served, 2).orderBy("rank").collect()] == ["a", "b"]


def test_shared_folder_and_lineage_cut(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    df = checkpointed(spark.range(5))
    assert df.count() == 5 and len(df.inputFiles()) > 0
    assert work_path(spark, "x") != work_path(spark, "x")


def test_intermediate_tables_are_removed(spark, tmp_path):
    with scratch(spark) as folder:
        df = checkpointed(spark.range(7))
        assert df.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file:"))
        df.write.parquet(f"{tmp_path}/kept")
    assert not path_exists(spark, folder) and spark.read.parquet(f"{tmp_path}/kept").count() == 7
    assert not work_path(spark, "x").startswith(folder)


def test_spread_leaves_derived_and_tiny_tables_alone(spark):
    tiny = checkpointed(spark.range(5))
    assert spread(tiny).rdd.getNumPartitions() == tiny.rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    assert spread(tiny, "id", above=0).rdd.getNumPartitions() in (cores, tiny.rdd.getNumPartitions())
    grouped = spark.range(5).groupBy("id").count()
    assert spread(grouped, above=0) is grouped
