"""Versioned tables, incremental profiles, the one-scan summary, filtering by lists, the SVD's error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.operators import catalogue, filtering, profiles
from recspark.sources.versions import Conflict, VersionedTable
from test_recommend import expected_factors, ratings


def ids(table):
    return sorted(r["id"] for r in table.read().collect())


def test_versions_replace_append_compact(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(spark.range(3), "a")
    table.append(spark.range(3, 5), "b")
    table.append(spark.range(3, 5), "b")  # once only
    assert ids(table) == [0, 1, 2, 3, 4] and len(table.state().folders) == 2 and table.has("b") and not table.has("c")
    # A table may be made from itself, and a reader of the version before goes on.
    before = table.read()
    table.replace(table.read().filter("id > 1"), "c")
    assert ids(table) == [2, 3, 4] and before.count() == 5
    table.append(spark.range(9, 10))
    table.compact()
    assert ids(table) == [2, 3, 4, 9] and len(table.state().folders) == 1
    for n in range(5):
        table.append(spark.range(20 + n, 21 + n), most=4)
    assert len(table.state().folders) < 4 and len(ids(table)) == 9
    removed = table.vacuum()
    assert removed and len(ids(table)) == 9 and table.vacuum() == 0


def test_a_write_that_ends_half_way_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.replace(spark.range(4))

    def broken(batches):
        for n, batch in enumerate(batches):
            yield batch
            raise RuntimeError("the writer is gone")

    with pytest.raises(Exception, match="the writer is gone"):
        table.replace(spark.range(100).mapInArrow(broken, "id long"))
    assert ids(table) == [0, 1, 2, 3] and table.state().version == 1
    # So is one that wrote its rows and was lost before it could say so.
    folder = table._write(spark.range(50), 2)
    assert ids(table) == [0, 1, 2, 3]
    old = table.state()
    table.append(spark.range(7, 8))
    with pytest.raises(Conflict):
        table.replace(spark.range(1), old=old)
    assert ids(table) == [0, 1, 2, 3, 7] and table.vacuum() >= 2
    assert folder not in table.state().folders and ids(table) == [0, 1, 2, 3, 7]


def test_profiles_are_updated_without_the_old_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"p{i}", rng.normal(size=4).tolist()) for i in range(20)], "asin string, embedding array<double>")
    rows = [(f"u{rng.integers(6)}", f"p{rng.integers(22)}") for _ in range(90)]
    first = spark.createDataFrame(rows[:60], "reviewerID string, asin string")
    second = spark.createDataFrame([r for r in rows[60:] if r[0] != "u3"] + [("new", "p1")], "reviewerID string, asin string")
    store = VersionedTable(spark, f"{tmp_path}/profiles")
    profiles.update_profiles(store, first, vectors, "day 1")
    assert profiles.changed_profiles(store).count() == profiles.stored_profiles(store).count()
    profiles.update_profiles(store, second, vectors, "day 2")
    profiles.update_profiles(store, second, vectors, "day 2")
    got = dict(profiles.stored_profiles(store).collect())
    want = dict(profiles.profile_vectors(first.union(second), vectors).collect())
    assert got.keys() == want.keys() and all(np.allclose(got[u], want[u]) for u in want)
    changed = {r["reviewerID"] for r in profiles.changed_profiles(store).collect()}
    known = {f"p{i}" for i in range(20)}
    assert changed == {r["reviewerID"] for r in second.collect() if r["asin"] in known} and "u3" not in changed


def test_summary_takes_first_texts_in_one_scan(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "CHUNK", 50)
    rng = np.random.default_rng(2)
    rows = [(None if rng.random() < 0.02 else f"p{min(int(rng.integers(12)), 5)}", None if rng.random() < 0.1 else float(rng.integers(1, 6)),
             None if rng.random() < 0.05 else int(rng.integers(40)), f"r{i:04}", None if rng.random() < 0.2 else f"text {i}") for i in range(700)]
    rows += [("mute", 2.0, 1, "m1", None), ("unrated", None, 1, "m2", "said")]
    reviews = spark.createDataFrame(rows, "asin string, rating double, unixReviewTime bigint, review_id string, reviewText string").repartition(7)
    got = {r["asin"]: r for r in catalogue.review_summary(reviews, 4).collect()}
    for asin in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == asin]
        rated = [r[1] for r in mine if r[1] is not None]
        texts = [r[4] for r in sorted((r for r in mine if r[4]), key=lambda r: (r[2] is not None, r[2] or 0, r[3]))]
        assert got[asin]["num_reviews"] == len(rated) and got[asin]["total"] == sum(rated)
        assert [t["text"] for t in got[asin]["first"]] == texts[:4]
    assert None not in got and catalogue.review_summary(reviews.limit(0)).count() == 0
    assert catalogue.review_digest(reviews, 4).filter("asin = 'mute'").count() == 0
    stats = {r["asin"]: r["avg_rating"] for r in catalogue.minimal_metadata(reviews).collect()}
    assert stats["unrated"] is None and stats["mute"] == 2.0


def test_catalogue_reads_the_reviews_once(spark, tmp_path):
    reviews = spark.range(30).select(
        (F.col("id") % 3).cast("string").alias("asin"), F.lit(4.0).alias("rating"), F.col("id").alias("unixReviewTime"),
        F.col("id").cast("string").alias("review_id"), F.lit("t").alias("reviewText"),
    )
    reviews.write.parquet(f"{tmp_path}/reviews")
    metadata = spark.createDataFrame([(str(i), f"t{i}", "c", 1.0, "d") for i in range(3)], "asin string, title string, category string, price double, description string")
    built = catalogue.build_catalogue(spark.read.parquet(f"{tmp_path}/reviews"), metadata)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert built.count() == 3 and plan.count("FileScan parquet") == 1


def plain_scores(rows, near, k):
    out = {}
    for user in {u for u, _, r in rows if r > 0}:
        have = {i for u, i, r in rows if u == user and r > 0}
        found = {}
        for i in have:
            for other, corr in near.get(i, []):
                if other not in have:
                    found.setdefault(other, []).append(round(corr * 10**6))
        best = sorted((-np.floor(sum(c) / len(c) + 0.5) / 10**6, i) for i, c in found.items())[:k]
        if best:
            out[user] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("entries", [1, 40, 500_000])
def test_scores_of_neighbours_by_lists(spark, entries):
    """With one item that everybody bought and that is in every list, one user who bought nearly all, and small task buffers."""
    rng = np.random.default_rng(5)
    items = [f"i{n:02}" for n in range(40)]
    rows = [(f"u{u:02}", items[i], float(rng.integers(0, 6))) for u in range(30) for i in {0, *rng.integers(1, 40, 6)}]
    rows += [("bot", i, 3.0) for i in items[:37]]
    near = {i: [(o, float(np.round(rng.random(), 4))) for o in {"i00", *rng.choice(items, 9)} if o != i] for i in items if i != "i39"}
    pairs = spark.createDataFrame([(i, o, c) for i in near for o, c in near[i]], "asin string, neighbor string, corr double")
    matrix = spark.createDataFrame(rows, "user string, item string, rating double").repartition(5)
    got = {}
    for r in sorted(filtering.recommend_neighbors(matrix, pairs, 4, entries=entries).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["user"], []).append((r["asin"], r["score"]))
    assert got == plain_scores(rows, near, 4)
    assert filtering.recommend_neighbors(matrix.limit(0), pairs, 4).count() == 0


def test_a_block_of_users_gets_a_list_once(spark, monkeypatch):
    """Lists do not travel with every rating; users with more ratings than a block are summed up by Spark, with the same rows."""
    rng = np.random.default_rng(6)
    items = [f"i{n:02}" for n in range(30)]
    rows = [(f"u{u:02}", items[i], 1.0) for u in range(200) for i in {*rng.integers(0, 25, 8)}] + [("bot", i, 2.0) for i in items[:20]]
    rows += [(None, i, 2.0) for i in items[3:9]] + [("u00", None, 1.0)]
    near = {i: [(o, float(np.round(rng.random() - 0.3, 4))) for o in rng.permutation(items)[:9] if o != i] for i in items[:28]}
    pairs = spark.createDataFrame([(i, o, c) for i in near for o, c in near[i]], "asin string, neighbor string, corr double")
    matrix = spark.createDataFrame(rows, "user string, item string, rating double")
    lists = filtering._needed_lists(matrix.withColumn("block", F.crc32(F.coalesce("user", F.lit(""))) % 3), pairs).collect()
    assert len(lists) == len({(r["list_block"], r["list_item"]) for r in lists}) <= 75 and {r["list_item"] for r in lists} <= set(items[:25])
    for most in (20_000, 10):
        monkeypatch.setattr(filtering, "BLOCK_RATINGS", most)
        got = {}
        for r in sorted(filtering.recommend_neighbors(matrix, pairs, 4).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["user"], []).append((r["asin"], r["score"]))
        assert got == plain_scores(rows, near, 4)


def test_svd_knows_its_error(spark):
    """400 x 300: ten strong directions above a floor of noise, then a second matrix of noise alone."""
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(400, 300))
    strong = noise * 0.2 + (rng.normal(size=(400, 10)) * np.arange(10, 0, -1)) @ rng.normal(size=(10, 300)) / 10
    for dense, rounds in ((strong, 3), (noise, 12)):
        rows = [(f"u{u:03}", f"i{i:03}", float(x)) for u, line in enumerate(dense) for i, x in enumerate(line)]
        matrix = spark.createDataFrame(rows, "user string, item string, rating double")
        svd = filtering.truncated_svd(matrix, 10, tolerance=1e-3)
        _, s, _ = np.linalg.svd(dense, full_matrices=False)
        best = (s[:10] ** 2).sum()
        assert svd.total == pytest.approx((dense**2).sum()) and svd.settled and svd.rounds <= rounds
        assert svd.captured <= best * (1 + 1e-9) and best - svd.captured <= 0.02 * best
        assert svd.residual == pytest.approx((dense**2).sum() - svd.captured)
        got = {r["asin"]: r["factors"] for r in svd.factors.collect()}
        rows = np.array([got[f"i{i:03}"] for i in range(300)])
        assert (rows**2).sum() == pytest.approx(svd.captured)
    assert filtering.truncated_svd(matrix.limit(0), 3).rounds == 0
    dense, matrix = ratings(spark)
    exact = filtering.truncated_svd(matrix, 5, tolerance=1e-7, max_rounds=15)
    got = {r["asin"]: r["factors"] for r in exact.factors.collect()}
    assert np.allclose([got[f"i{i:02}"] for i in range(24)], expected_factors(dense, 5), atol=0.05)


def test_the_svd_sums_in_waves_and_leaves_two_tables(spark, monkeypatch):
    """Waves of the keys give the same sums; of the tables of the rounds only the ratings and the last factors stay."""
    import os
    from urllib.parse import urlparse

    from recspark.session import shared_dir

    rng = np.random.default_rng(5)
    cells = [(f"u{u}", f"i{i}", float(rng.integers(1, 6))) for u in range(60) for i in range(25) if rng.random() < 0.4]
    matrix = spark.createDataFrame(cells, "user string, item string, rating double").repartition(4)
    want = {r["asin"]: r["factors"] for r in filtering.truncated_svd(matrix, 3).factors.collect()}
    sizes, real = [], filtering._weighted_sums

    def counting(entries, *args):
        sizes.append(entries.count())
        return real(entries, *args)

    monkeypatch.setattr(filtering, "_weighted_sums", counting)
    monkeypatch.setattr(filtering, "WAVE_BYTES", len(cells) * 6 * 8 // 4, raising=False)
    folder = urlparse(shared_dir(spark)).path
    before = set(os.listdir(folder))
    svd = filtering.truncated_svd(matrix, 3)
    assert len([n for n in set(os.listdir(folder)) - before if n.startswith("recspark-")]) == 2
    got = {r["asin"]: r["factors"] for r in svd.factors.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[a], want[a], atol=1e-6) for a in want)
    assert len(sizes) >= 4 * (2 + svd.rounds) and max(sizes) < len(cells) * 0.6


def test_a_catalogue_no_longer_reads_the_reviews(spark, tmp_path):
    """What the reviews give is written before the texts are joined, so that the shuffle files of both are not there together."""
    spark.range(30).select(
        (F.col("id") % 3).cast("string").alias("asin"), F.lit(4.0).alias("rating"), F.col("id").alias("unixReviewTime"),
        F.col("id").cast("string").alias("review_id"), F.lit("t").alias("reviewText"),
    ).write.parquet(f"{tmp_path}/reviews")
    metadata = spark.createDataFrame([(str(i), f"t{i}", "c", 1.0, "d") for i in range(3)], "asin string, title string, category string, price double, description string")
    built = catalogue.build_catalogue(spark.read.parquet(f"{tmp_path}/reviews"), metadata)
    assert built.inputFiles() and not [f for f in built.inputFiles() if "/reviews/" in f]
    assert built.count() == 3 and {r["num_reviews"] for r in built.collect()} == {10}
