import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recspark import session
from recspark.operators import cells, search
from recspark.operators.embed import embed_texts, embed_with_store, missing_texts
from recspark.operators.profiles import blend_query_vectors, profile_vectors
from recspark.operators.ranking import best_first, top_per_group

VECTOR = "asin string, embedding array<float>"


def random_vectors(n, dim=8, seed=0, prefix="p"):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    return [(f"{prefix}{i:04}", row.tolist()) for i, row in enumerate(rows)]


def brute(queries, items, k, digits=6):
    out = {}
    for q, v in queries:
        scored = [(round(float(np.dot(np.float64(v), np.float64(w))), digits) + 0.0, a) for a, w in items]
        out[q] = [(a, s) for s, a in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["asin"], round(r["score"], 6)))
    return out


def frames(spark, queries, items):
    return (
        spark.createDataFrame(queries, "query_id string, embedding array<float>"),
        spark.createDataFrame(items, VECTOR),
    )


def test_exact_search_in_one_block_and_in_many(spark, monkeypatch):
    queries, items = random_vectors(37, seed=1, prefix="q"), random_vectors(1500, seed=2)
    q, i = frames(spark, queries, items)
    expected = brute(queries, items, 7)
    assert collected(search.exact_topk(q, i, 7)) == expected
    monkeypatch.setattr(search, "_block_counts", lambda *_: (5, 3))
    assert collected(search.exact_topk(q, i, 7)) == expected


def test_lists_do_not_grow_with_the_strips(spark, monkeypatch):
    queries, items = random_vectors(9, seed=11, prefix="q"), random_vectors(3000, seed=12)
    q, i = frames(spark, queries, items)
    expected = brute(queries, items, 6)
    merged, last = [], search.top_per_group

    def counting(df, keys, order, k, rank="rank"):
        if keys == ["query_id"]:
            merged.append(df.count() / len(queries))
        return last(df, keys, order, k, rank)

    monkeypatch.setattr(search, "top_per_group", counting)
    for strips in (1, 64, 600):
        monkeypatch.setattr(search, "_block_counts", lambda *_, n=strips: (n, 2))
        assert collected(search.exact_topk(q, i, 6)) == expected
    # One strip needs no merge; the last merge of many reads FAN_IN lists at most.
    assert len(merged) == 2 and max(merged) <= search.FAN_IN * 6


def test_running_lists_forget_ids_and_keep_ties():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (5, 3)).astype(float)
    items = rng.integers(-2, 3, (4000, 3)).astype(float)
    ids = [f"{i:05}" for i in range(4000)]
    lists = search._RunningLists(pa.array(["a", "b", "c", "d", "e"]), vectors, np.array([7, 0, 1, 4000, 50]), 6)
    for start in range(0, 4000, 130):
        lists.add(pa.array(ids[start : start + 130]), items[start : start + 130])
        lists._forget()
    got = lists.table((0, 0, 3)).to_pydict()
    for q, depth in zip(range(5), (7, 0, 1, 4000, 50)):
        best = sorted(range(4000), key=lambda i: (-(items[i] @ vectors[q]), i))[:depth]
        assert [a for a, name in zip(got["asin"], got["query_id"]) if name == "abcde"[q]] == [ids[i] for i in best]


def test_running_lists_hold_little_besides_the_lists():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors, items = rng.normal(size=(6000, 8)), rng.normal(size=(9000, 8))
    depths = np.full(6000, 50)
    tracemalloc.start()
    lists = search._RunningLists(pa.array([f"q{i:04}" for i in range(6000)]), vectors, depths, 6)
    for start in range(0, 9000, 3000):
        lists.add(pa.array([f"{i:04}" for i in range(start, start + 3000)]), items[start : start + 3000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    got = lists.table((0, 0, 0)).to_pydict()
    for q in (0, 1023, 1024, 5999):
        scores = np.floor(np.abs(items @ vectors[q]) * 1e6 + 0.5) * np.sign(items @ vectors[q])
        best = sorted(range(9000), key=lambda i: (-scores[i], i))[:50]
        assert [a for a, name in zip(got["asin"], got["query_id"]) if name == f"q{q:04}"] == [f"{i:04}" for i in best]


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e20, 1e200])
def test_running_lists_are_exact_for_copies_and_any_scale(scale):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (70, 4)).astype(float) * scale
    items = np.concatenate([np.repeat(rng.integers(-3, 4, (2, 4)), 700, axis=0), rng.integers(-3, 4, (3000, 4))]).astype(float)
    depths = rng.integers(0, 40, 70)
    lists = search._RunningLists(pa.array([f"{i:02}" for i in range(70)]), vectors, depths, 6)
    for start in range(0, len(items), 900):
        lists.add(pa.array([f"{i:05}" for i in range(start, min(start + 900, len(items)))]), items[start : start + 900])
    got = lists.table((0, 0, 0)).to_pydict()
    raw = vectors @ items.T
    scores = np.copysign(np.floor(np.abs(raw) * 1e6 + 0.5) / 1e6, raw) + 0.0
    for q in range(70):
        best = sorted(range(len(items)), key=lambda i: (-scores[q, i], i))[: depths[q]]
        assert [a for a, name in zip(got["asin"], got["query_id"]) if name == f"{q:02}"] == [f"{i:05}" for i in best]


def test_equal_scores_go_by_id(spark):
    items = [(f"p{i}", [1.0, 0.0]) for i in (3, 1, 2, 0)] + [("z", [0.0, 0.0])]
    q, i = frames(spark, [("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], items)
    assert collected(search.exact_topk(q, i, 3)) == {
        "q": [("p0", 1.0), ("p1", 1.0), ("p2", 1.0)],
        "zero": [("p0", 0.0), ("p1", 0.0), ("p2", 0.0)],
    }


def test_exclusion_after_and_before_the_cut(spark):
    queries, items = random_vectors(5, seed=3, prefix="q"), random_vectors(60, seed=4)
    q, i = frames(spark, queries, items)
    full = brute(queries, items, 60)
    gone = [(name, a) for name, rows in full.items() for a, _ in rows[: 2 + int(name[1:])]]
    excluded = spark.createDataFrame(gone + gone, "query_id string, asin string")
    dropped = set(gone)
    after = {n: [r for r in rows[:4] if (n, r[0]) not in dropped] for n, rows in full.items()}
    before = {n: [r for r in rows if (n, r[0]) not in dropped][:4] for n, rows in full.items()}
    assert collected(search.search(q, i, 4, excluded=excluded)) == {n: r for n, r in after.items() if r}
    assert collected(search.search(q, i, 4, excluded=excluded, exclude_first=True)) == before


def test_probing_all_cells_is_exact_and_few_cells_recall_most(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 8)) * 3
    items = [(f"p{i:04}", (centres[i % 10] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    queries = [(f"q{i}", (centres[i % 10] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(30)]
    q, i = frames(spark, queries, items)
    expected = brute(queries, items, 10)
    centroids = cells.train_centroids(i, 10)
    placed = cells.assign_cells(i, centroids)
    assert collected(cells.ivf_topk(q, placed, centroids, 10, n_probe=10)) == expected
    assert collected(cells.two_stage_topk(q, placed, centroids, 10, coarse_k=600, n_probe=10)) == expected
    few = collected(cells.ivf_topk(q, placed, centroids, 10, n_probe=3))
    hits = sum(len({a for a, _ in expected[n]} & {a for a, _ in few[n]}) for n in expected)
    assert hits >= 0.8 * 300


def test_few_vectors_form_one_cell(spark):
    queries, items = random_vectors(3, seed=8, prefix="q"), random_vectors(12, seed=9)
    q, i = frames(spark, queries, items)
    centroids = cells.train_centroids(i)
    assert centroids.count() == 1
    assert collected(cells.ivf_topk(q, cells.assign_cells(i, centroids), centroids, 4)) == brute(queries, items, 4)


def test_one_cell_with_most_items_is_split(spark, monkeypatch):
    queries, items = random_vectors(20, seed=6, prefix="q"), random_vectors(900, seed=7)
    q, i = frames(spark, queries, items)
    number = F.substring("asin", 2, 4).cast("int")
    skewed = i.withColumn("cell", F.when(number < 600, 0).otherwise(number % 5))
    probing = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(4))))
    monkeypatch.setattr(search, "_block_counts", lambda n_items, *_: (max(1, n_items // 100), 2))
    assert collected(search.topk_in_cells(probing, skewed, 9)) == brute(queries, items, 9)
    sharded = search.sharded_topk(q, i.withColumn("shop", F.lit("one")), 9, shard="shop", n_shards=3)
    assert collected(sharded) == brute(queries, items, 9)


def test_delta_vectors_win(spark):
    main = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.5, 0.0], 0)], VECTOR + ", version int")
    delta = spark.createDataFrame([("a", [0.1, 0.0], 2), ("a", [0.2, 0.0], 1), ("c", [0.3, 0.0], 1)], VECTOR + ", version int")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert collected(search.dual_index_topk(q, main, delta, 3)) == {"q": [("b", 0.5), ("c", 0.3), ("a", 0.1)]}


def test_index_choice():
    assert [search.choose_index(n) for n in (10, 49_999, 50_000, 10**7)] == ["flat", "flat", "ivf", "ivf"]
    assert [cells.cell_count(n) for n in (5, 500, 10**6)] == [1, 50, 100]


def test_block_counts_stay_bounded():
    # Items are streamed; what a task holds are its queries and their lists.
    strips, blocks = search._block_counts(10**9, 10**6, 64, 4000)
    assert 10**6 / blocks * 512 <= search.BLOCK_BYTES and 10**6 / blocks * 100 <= search.LIST_ROWS and strips * blocks >= 4000
    strips, blocks = search._block_counts(10**9, 100, 64, 4000)
    assert strips >= 2000 and search._block_counts(10, 10, 64, 32) == (1, 1)


def test_large_k_is_cut_in_salted_parts_first(spark):
    df = spark.range(6000).select(F.lit("hot").alias("query_id"), F.col("id").cast("string").alias("asin"), (F.col("id") % 977).cast("double").alias("score"))
    got = top_per_group(df, ["query_id"], best_first(), 1500)
    want = sorted(((-(i % 977), str(i)) for i in range(6000)))[:1500]
    assert [(r["score"], r["asin"]) for r in got.orderBy("rank").collect()] == [(-s, a) for s, a in want]


def test_profiles(spark):
    vectors = spark.createDataFrame([("a", [1.0, -2.0]), ("b", [3.0, -4.0])], VECTOR)
    history = spark.createDataFrame([("u", "a", 1.0), ("u", "a", 1.0), ("u", "b", 2.0), ("w", "zz", 1.0)], "reviewerID string, asin string, w double")
    mean = dict(profile_vectors(history, vectors).collect())
    assert set(mean) == {"u"} and mean["u"] == pytest.approx([5 / 3, -8 / 3])
    assert dict(profile_vectors(history, vectors, "max").collect())["u"] == [3.0, -2.0]
    assert dict(profile_vectors(history, vectors, "weighted_mean").collect())["u"] == pytest.approx([5 / 3, -8 / 3])
    assert dict(profile_vectors(history, vectors, "weighted_mean", weight="w").collect())["u"] == pytest.approx([2.0, -3.0])
    assert dict(profile_vectors(history, vectors, empty_dim=2).collect())["w"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        profile_vectors(history, vectors, "median")


def test_blend(spark):
    profiles = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [2.0, 2.0])], "query_id string, embedding array<double>")
    texts = spark.createDataFrame([("u", [0.0, 1.0])], "query_id string, embedding array<float>")
    got = dict(blend_query_vectors(profiles, texts).collect())
    length = np.sqrt(0.7**2 + 0.3**2) + 1e-8
    assert got["u"] == pytest.approx([0.7 / length, 0.3 / length]) and got["v"] == [2.0, 2.0]


def test_text_vectors_and_the_store(spark):
    texts = spark.createDataFrame([("1", "Red red BLUE"), ("2", ""), ("3", None), ("4", "Red red BLUE"), ("5", "é!")], "id string, text string")
    rows = {r["id"]: r["embedding"] for r in embed_texts(texts, "text").collect()}
    assert rows["1"] == rows["4"] and np.linalg.norm(rows["1"]) == pytest.approx(1, abs=1e-6)
    assert sorted(x for x in rows["1"] if x) == pytest.approx(sorted([2 / 5**0.5, 1 / 5**0.5]))
    assert not any(rows["2"]) and not any(rows["3"]) and np.linalg.norm(rows["5"]) == pytest.approx(1, abs=1e-6)
    store = embed_texts(texts.filter("id = '1'"), "text").select(F.md5("text").alias("text_key"), "embedding")
    assert {r["text"] for r in missing_texts(texts, "text", store).collect()} == {"", "é!"}
    joined, fresh = embed_with_store(texts, "text", store)
    assert fresh.count() == 2 and joined.filter("embedding is not null").count() == 4


def test_own_model(spark):
    def model(words):
        assert len(words) <= 2
        return [[float(len(w)), 0.0, 1.0] for w in words]

    texts = spark.createDataFrame([("abc",), ("a",), ("",)], "text string").coalesce(1)
    rows = {r["text"]: r["embedding"] for r in embed_texts(texts, "text", embedder=model, batch_size=2).collect()}
    assert rows["abc"] == pytest.approx([3 / 10**0.5, 0.0, 1 / 10**0.5]) and rows[""] == [0.0, 0.0, 1.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.integers(1, 30), st.integers(0, 1000))
def test_exact_search_matches_brute_force(spark, n, k, seed):
    queries, items = random_vectors(3, 4, seed, "q"), random_vectors(n, 4, seed + 1)
    assert collected(search.exact_topk(*frames(spark, queries, items), k)) == brute(queries, items, k)


def test_texts_are_tokenised_a_few_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    from recspark.operators import embed

    texts = [None, "", " ".join(f"w{i % 97}" for i in range(600_000))] + [" ".join(f"w{(i + n) % 97}" for i in range(500)) for n in range(4000)]
    histogram = embed._token_histogram(8).func
    given = pa.array(texts[3:] + texts[:2])
    tracemalloc.start()
    many = histogram(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    many = many.to_pylist()
    assert many[::500] == [histogram(pa.array([t], pa.string())).to_pylist()[0] for t in (texts[3:] + texts[:2])[::500]]
    assert many[-2:] == [[0.0] * 8] * 2 and histogram(pa.array([], pa.string())).to_pylist() == []
    assert len(histogram(pa.array(texts[2:3] * 3)).to_pylist()) == 3


def test_lists_are_sorted_as_whole_numbers_where_values_allow_it():
    rng = np.random.default_rng(3)
    chunk = search._Chunk(0, np.ones((1024, 4)), np.full(1024, 5), 1e6)
    rows, places = rng.integers(0, 1024, 5000).astype(np.int32), np.arange(5000, dtype=np.int32)
    for scale in (1, 2.09, 1e3, 1e20):
        values = np.rint(rng.choice([-1, -0.5, 0.25, 0, 1], 5000) * scale * 1e6) / 1e6 + 0.0
        order = np.lexsort((places, -values, rows))
        got = chunk._in_order(rows, places, values)
        assert all(np.array_equal(a, b[order]) for a, b in zip(got, (rows, places, values)))
    for shape in ((3, 5), (8, 16), (1, 7), (0, 4)):
        mask = rng.random(shape) < 0.3
        assert np.array_equal(search._true_places(mask), np.flatnonzero(mask))


def test_a_least_score_leaves_the_same_rows_above_it(spark):
    queries, items = random_vectors(30, seed=8, prefix="q"), random_vectors(300, seed=9)
    q, i = frames(spark, queries, items)
    every = brute(queries, items, 20)
    least = sorted(s for rows in every.values() for _, s in rows)[250]
    want = {a: [(b, s) for b, s in rows if s >= least] for a, rows in every.items()}
    assert collected(search.exact_topk(q, i, 20, least=least)) == {a: rows for a, rows in want.items() if rows}


def test_items_travel_to_the_blocks_in_packs(spark, monkeypatch):
    """A block gets a row per pack, not per item; packs keep to a cell and strip and the order of the ids, and lists are those of all items."""
    monkeypatch.setattr(search, "PACK", 7)
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, (300, 6)).astype(float)
    items = spark.createDataFrame([(f"i{n:03}", v.tolist()) for n, v in enumerate(vectors)], "asin string, embedding array<double>")
    placed = items.selectExpr("cast(crc32(asin) % 2 as int) AS cell", "cast(crc32(asin) % 3 as int) AS strip", "2 AS blocks", "asin", "embedding")
    packs = search._packed(placed).collect()
    keys = {r["asin"]: (r["cell"], r["strip"]) for r in placed.collect()}
    assert sorted(i for p in packs for i in p["ids"]) == sorted(keys) and len(packs) < 100
    for p in packs:
        assert len(p["ids"]) <= 7 and p["ids"] == sorted(p["ids"]) and p["asin"] == p["ids"][0]
        assert {keys[i] for i in p["ids"]} == {(p["cell"], p["strip"])}
        rows = np.frombuffer(p["vectors"]).reshape(len(p["ids"]), -1)
        assert (rows == vectors[[int(i[1:]) for i in p["ids"]]]).all()
    single = items.selectExpr("asin", "cast(embedding AS array<float>) AS embedding")
    for table in (items, single):
        found = search.exact_topk(table.withColumnRenamed("asin", "query_id"), table, 9).collect()
        got = {(r["query_id"], r["rank"]): (r["asin"], r["score"]) for r in found}
        scores = vectors @ vectors.T
        for q in range(300):
            best = sorted(range(300), key=lambda i: (-scores[q, i], i))[:9]
            assert [got[f"i{q:03}", r + 1] for r in range(9)] == [(f"i{i:03}", scores[q, i]) for i in best]


def shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.length()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    """A checkpoint removes what it shuffled; the result that reads it is still whole, also a second time."""
    import time

    rows = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 70).alias("key")).agg(F.count("*").alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    kept = session.checkpointed(rows)
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting
    assert kept.agg(F.sum("n")).first()[0] == 5000 and sorted(rows.collect()) == sorted(kept.collect())


def test_many_blocks_are_searched_in_waves(spark, monkeypatch):
    """However many copies of the items and lists the whole search needs, a wave has its share of them, and the rows are the same."""
    queries, items = random_vectors(60, seed=21, prefix="q"), random_vectors(900, seed=22)
    q, i = frames(spark, queries, items)
    expected, real, blocks, lists = brute(queries, items, 7), search._score_blocks, [], []

    def counting(asked, packed, *args):
        blocks.append(packed.agg(F.sum(F.size("ids") * F.col("blocks"))).first()[0])
        found = real(asked, packed, *args)
        lists.append(found.count())
        return found

    monkeypatch.setattr(search, "_score_blocks", counting)
    rows = [search._block_counts, lambda n_items, n_queries, *_: (1, max(1, n_queries // 10))]
    monkeypatch.setattr(search, "_block_counts", rows[1])
    monkeypatch.setattr(search, "WAVE_BYTES", 2 * 900 * (4 * 8 + 24), raising=False)
    assert collected(search.exact_topk(q, i, 7)) == expected
    assert len(blocks) >= 3 and max(blocks) <= 2 * 900
    monkeypatch.setattr(search, "_block_counts", rows[0])
    blocks.clear(), lists.clear()
    placed = i.withColumn("cell", (F.crc32("asin") % 5).cast("int"))
    asked = q.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in range(5)])))
    monkeypatch.setattr(search, "WAVE_BYTES", 60 * 5 * 7 * 24 // 4, raising=False)
    assert collected(search.topk_in_cells(asked, placed, 7, probes=5)) == expected
    assert len(lists) >= 4 and max(lists) <= 60 * 5 * 7 // 2 and sum(lists) == 60 * 5 * 7


def test_quantised_vectors_travel_as_bytes(spark):
    items = spark.createDataFrame([(f"i{n}", [n - 60, 127 - n, -128]) for n in range(100)], "asin string, embedding array<tinyint>")
    placed = items.withColumns({"cell": F.lit(0), "strip": F.lit(0), "blocks": F.lit(1)})
    packs = search._packed(placed).collect()
    assert sum(len(p["vectors"]) for p in packs) == 300
    got = {i: tuple(v) for p in packs for i, v in zip(p["ids"], np.frombuffer(p["vectors"], "<i1").reshape(-1, 3).tolist())}
    assert got == {f"i{n}": (n - 60, 127 - n, -128) for n in range(100)}
    best = search.exact_topk(items.limit(1).select(F.lit("q").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("embedding")), items, 3)
    assert [(r["asin"], r["score"]) for r in best.orderBy("rank").collect()] == [("i99", 39.0), ("i98", 38.0), ("i97", 37.0)]


def test_coarse_pairs_are_scored_in_waves(spark, monkeypatch):
    """Every item is a coarse candidate of every query, so that the rows are those of exact search."""
    queries, items = random_vectors(40, seed=31, prefix="q"), random_vectors(50, seed=32)
    q, i = frames(spark, queries, items)
    centroids = cells.train_centroids(i, 3)
    placed = cells.assign_cells(i, centroids)
    pairs, real = [], cells.top_per_group

    def counting(df, *args):
        pairs.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(cells, "top_per_group", counting)
    monkeypatch.setattr(cells, "WAVE_BYTES", 40 * 50 * 8 * 8 // 4, raising=False)
    found = cells.two_stage_topk(q, placed, centroids, 6, coarse_k=50, n_probe=3)
    assert collected(found) == brute(queries, items, 6)
    assert len(pairs) == 4 and sum(pairs) == 40 * 50 and max(pairs) < 40 * 50 // 2


def test_raw_lines_are_compressed_and_read_the_same(spark, tmp_path):
    import os

    from checks import fixtures

    lines = spark.range(300).select(F.concat(F.lit('{"asin": "a line that is written often", "n": '), "id", F.lit("}")).alias("value"))
    fixtures.write_lines(lines.coalesce(1), f"{tmp_path}/lines.jsonl")
    size = sum(os.path.getsize(f"{tmp_path}/lines.jsonl/{f}") for f in os.listdir(f"{tmp_path}/lines.jsonl") if f.startswith("part-"))
    assert size < 300 * 50 // 4
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines.jsonl").collect()) == sorted(r.value for r in lines.collect())
