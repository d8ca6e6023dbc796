import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recspark.operators import compare, durable, evaluate, filtering, history, popularity, rerank
from recspark.plans import recommend

REVIEWS = "reviewerID string, asin string, rating double, unixReviewTime bigint, review_id string"
PRODUCTS = "asin string, title string, category string, description string, price double, avg_rating double, num_reviews bigint"


def product_rows(n):
    return [(f"p{i}", f"t{i}", f"c{i % 2}", f"d{i}", float(i), 3.0 + i % 2, 100 - i) for i in range(n)]


def test_history_takes_recent_then_best(spark):
    rows = [("u", f"p{i}", float(i % 3), i, f"r{i}") for i in range(10)] + [("v", "p1", None, 5, "x"), ("v", "p1", 1.0, 5, "w")]
    got = history.recent_best(spark.createDataFrame(rows, REVIEWS), 3).orderBy("reviewerID", "history_rank").collect()
    assert [r["asin"] for r in got if r["reviewerID"] == "u"] == ["p8", "p5", "p7"]
    assert [r["review_id"] for r in got if r["reviewerID"] == "v"] == ["w", "x"]
    assert history.all_users(spark.createDataFrame(rows, REVIEWS), 1).collect()[0][0] == "u"


def test_history_texts(spark):
    products = spark.createDataFrame(product_rows(12), PRODUCTS)
    rows = spark.createDataFrame([("u", f"p{i}", 4.0, i, f"r{i}") for i in range(15)] + [("w", "none", None, 1, "r")], REVIEWS)
    people = spark.createDataFrame([("u",), ("w",), ("z",)], "reviewerID string")
    full = history.user_history(rows, products, 15)
    said = dict(history.history_summary(full, people).collect())
    assert said["u"].startswith("User has purchased 15 products:\n- Unknown (Rating: 4.0/5)\n") and said["u"].count("\n") == 11
    assert said["w"] == "User has purchased 1 products:\n- Unknown (Rating: N/A/5)\n"
    assert said["z"] == "No purchase history available."
    assert dict(history.history_display(full, people).collect())["z"] == "No purchase history"
    words = spark.createDataFrame([("u", "red"), ("y", "blue")], "reviewerID string, text string")
    asked = dict(history.rich_query_text(full, words, people).collect())
    assert asked["u"] == (
        "Products similar to: t11, t10, t9. in categories: c1, c0. "
        "products that I would like based on my purchase history. red."
    )
    assert asked["w"] == "products that I would like based on my purchase history."
    assert asked["y"] == "blue." and asked["z"] == "recommend popular products"


def test_popularity(spark):
    products = spark.createDataFrame(product_rows(12), PRODUCTS)
    best = popularity.popularity_topk(products, 3).orderBy("rank").collect()
    assert [r["asin"] for r in best] == ["p1", "p3", "p5"]
    assert best[0]["score"] == pytest.approx(4.0 * math.log1p(99), abs=1e-6)
    gone = spark.createDataFrame([("p1",), ("p1",)], "asin string")
    got = popularity.recommend_popular(products, 2, gone).orderBy("rank").collect()
    assert [(r["rank"], r["asin"]) for r in got] == [(1, "p3"), (2, "p5")]
    assert got[0]["explanation"] == "Popular product: 97 reviews, 4.0★" and got[0]["image_url"] is None
    assert [r["asin"] for r in popularity.popular_fallback(products, 2).orderBy("rank").collect()] == ["p0", "p1"]


def test_recommendation_plans(spark):
    rng = np.random.default_rng(1)
    vectors = [(f"p{i}", (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(30, 6)))]
    v = spark.createDataFrame(vectors, "asin string, embedding array<float>")
    products = spark.createDataFrame(product_rows(25), PRODUCTS)
    reviews = spark.createDataFrame([("u", f"p{i}", 5.0, i, f"r{i}") for i in range(4)], REVIEWS)
    profile = np.mean([vectors[i][1] for i in range(4)], axis=0)
    order = sorted(range(30), key=lambda i: (-round(float(np.dot(profile, vectors[i][1])), 6), f"p{i}"))
    known = [f"p{i}" for i in order if 4 <= i < 25]
    got = recommend.recommend_history(reviews, products, recommend.retrieve_exact(v, 30), v, 5)
    assert [r["asin"] for r in got.orderBy("rank").collect()] == known[:5]
    lists = spark.createDataFrame([("q", ["p0", "p1", "p2", "p3", "nope"]), ("none", ["nope"])], "query_id string, asins array<string>")
    same = recommend.recommend_item_lists(lists, products, recommend.retrieve_exact(v, 30), v, 5)
    assert [(r["query_id"], r["asin"]) for r in same.orderBy("rank").collect()] == [("q", a) for a in known[:5]]
    popular = popularity.popular_fallback(products, 5)
    both = recommend.recommend_item_lists(lists, products, recommend.retrieve_exact(v, 30), v, 5, fallback=popular)
    assert [(r["query_id"], r["asin"]) for r in both.orderBy("query_id", "rank").collect()] == [
        ("none", f"p{i}") for i in range(5)
    ] + [("q", a) for a in known[:5]]
    requests = spark.createDataFrame(
        [("1", "u", ["p9"], None), ("2", None, ["p0", "p1", "p2", "p3"], ""), ("3", None, None, "red chair"), ("4", None, None, None),
         ("5", "stranger", ["p0"], None), ("6", "", ["nope"], "red chair"), ("7", "u", None, "red chair")],
        "query_id string, reviewerID string, asins array<string>, text string",
    )
    got_all = recommend.recommend_requests(
        requests, reviews, products, recommend.retrieve_exact(v, 30), v, popular, 5, dim=6
    ).orderBy("rank").collect()
    by_id = {str(q): [r["asin"] for r in got_all if r["query_id"] == str(q)] for q in range(1, 8)}
    assert by_id["1"] == by_id["2"] == known[:5] and by_id["3"] == by_id["6"] and len(by_id["3"]) == len(by_id["7"]) == 5
    assert by_id["4"] == by_id["5"] == [f"p{i}" for i in range(5)] and not {"p0", "p1", "p2", "p3"} & set(by_id["7"])
    people = spark.createDataFrame([("u",), ("new",)], "reviewerID string")
    cold = recommend.cold_start(people, reviews, products, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["asin"]) for r in cold] == [("new", "p0"), ("new", "p1"), ("new", "p2")]
    scored = recommend.with_sustainability(got, products).collect()
    assert len(scored) == 5 and all(r["sustainability_score"] == 5.0 for r in scored)


def test_merge_of_replies(spark):
    products = spark.createDataFrame(product_rows(9), PRODUCTS)
    candidates = spark.createDataFrame(
        [("q", f"p{i}", 1.0 - i / 10, i + 1) for i in range(6)] + [("r", "p1", 0.5, 1)], "query_id string, asin string, score double, rank int"
    )
    listed = ", ".join(f'{{"asin": "{a}", "explanation": "{n}"}}' for n, a in enumerate(["p3", "p3", "zz", "p8", "p1", "p2"]))
    replies = spark.createDataFrame([("q", f'{{"recommendations": [{listed}]}}'), ("gone", GOOD_REPLY)], "query_id string, reply string")
    got = rerank.merge_replies(candidates, replies, products, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["asin"], r["score"]) for r in got] == [
        ("q", "p3", 0.7), ("q", "p8", 0.0), ("q", "p1", 0.9), ("q", "p0", 1.0), ("q", "p2", 0.8), ("r", "p1", 0.5),
    ]
    assert got[0]["explanation"] == "0" and got[3]["explanation"] == "High similarity to your preferences (score: 1.000)"
    strict = rerank.merge_replies(candidates, replies, products, 5, only_candidates=True).filter("query_id = 'q'")
    assert [r["asin"] for r in strict.orderBy("rank").collect()] == ["p3", "p1", "p0", "p2", "p4"]
    assert {(r["query_id"], r["asin"]) for r in got if r["query_id"] == "q"} == {("q", a) for a in ("p3", "p8", "p1", "p0", "p2")}


GOOD_REPLY = '{"recommendations": [{"asin": "p1"}]}'


def test_prompts_model_calls_and_reply_keys(spark):
    candidates = spark.createDataFrame(
        [("q", "b", 0.5, 2, "B", None, "x" * 300), ("q", "a", 0.75, 1, "A", "cat", None)],
        "query_id string, asin string, score double, rank int, title string, category string, description string",
    )
    summaries = spark.createDataFrame([("q", "S")], "query_id string, summary string")
    asks = spark.createDataFrame([("q", "red", ["c1", "c2"])], "query_id string, query string, criteria array<string>")
    whole = rerank.rerank_prompts(candidates, summaries, asks).first()["prompt"]
    assert "\n2. ASIN: b\n   Title: B\n   Category: N/A\n   Description: " + "x" * 300 + "\n" in whole
    prompts = rerank.rerank_prompts(candidates, summaries, asks, description_limit=rerank.PROMPT_DESCRIPTION)
    text = prompts.first()["prompt"]
    assert "User's Purchase History:\nS\n\nUser Query: red\n\n\nPrecise" in text and "- c1\n- c2\n" in text
    assert "\n1. ASIN: a\n   Title: A\n   Category: cat\n   Description: \n   Retrieval Score: 0.7500\n" in text
    assert "\n2. ASIN: b\n   Title: B\n   Category: N/A\n   Description: " + "x" * 200 + "\n" in text
    assert "sustainable, eco-friendly" not in text
    replies = rerank.ask_model(prompts, lambda texts: [t[:7] for t in texts])
    assert [tuple(r) for r in replies.collect()] == [("q", "You are")]
    keys = rerank.reply_keys(candidates, asks)
    stored = keys.withColumn("reply", F.lit("{}"))
    assert rerank.missing_replies(candidates, asks, stored).count() == 0
    assert rerank.missing_replies(candidates, asks.withColumn("query", F.lit("blue")), stored).count() == 1


def test_replies_outlive_a_task_that_fails(spark, tmp_path):
    """A model that is lost after 5 calls: the second run asks only for what had no reply yet."""
    log, folder = f"{tmp_path}/asked", f"file:{tmp_path}/replies"
    open(log, "w").close()
    prompts = spark.createDataFrame([(f"q{i}", f"prompt {i // 2}") for i in range(60)] + [("none", None)], "query_id string, prompt string").coalesce(1)

    def model(limit):
        def generate(asked):
            with open(log, "a") as file:
                file.write("".join(f"{p}\n" for p in asked))
            if len(open(log).readlines()) > limit:
                raise RuntimeError("the model is gone")
            return [f"reply to {p}" for p in asked]

        return generate

    with pytest.raises(Exception, match="the model is gone"):
        durable.ask_durably(prompts, model(5), folder, at_once=1).collect()
    assert durable.stored_replies(spark, folder).count() >= 1
    got = {r["query_id"]: r["reply"] for r in durable.ask_durably(prompts, model(10**6), folder, at_once=3).collect()}
    assert got == {f"q{i}": f"reply to prompt {i // 2}" for i in range(60)} | {"none": "reply to "}
    asked = open(log).read().split("\n")[:-1]
    lost = {p for p in asked if asked.count(p) > 1}
    assert set(asked) == {f"prompt {i}" for i in range(30)} | {""} and all(asked.count(p) <= 2 for p in asked) and len(lost) <= spark.sparkContext.defaultParallelism
    durable.ask_durably(prompts, model(0), folder).collect()
    assert durable.stored_replies(spark, folder).count() == 31
    assert durable.stored_replies(spark, f"{folder}/nowhere").count() == 0


def ratings(spark, seed=0, users=60, items=24):
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((users, items)) < 0.4, rng.integers(1, 6, (users, items)), 0).astype(float)
    rows = [(f"u{u}", f"i{i:02}", float(dense[u, i])) for u in range(users) for i in range(items) if dense[u, i]]
    return dense, spark.createDataFrame(rows, "user string, item string, rating double")


def expected_factors(dense, k):
    _, s, vt = np.linalg.svd(dense, full_matrices=False)
    v = vt[:k].T * s[:k]
    return v * np.where(v.max(axis=0) >= -v.min(axis=0), 1, -1)


def test_factors_match_numpy(spark):
    dense, matrix = ratings(spark)
    got = {r["asin"]: r["factors"] for r in filtering.item_factors(matrix, 12).collect()}
    want = expected_factors(dense, 12)
    assert np.allclose([got[f"i{i:02}"] for i in range(24)], want, atol=1e-6)


def test_neighbors_and_recommendations_match_numpy(spark):
    dense, matrix = ratings(spark, 3)
    factors = expected_factors(dense, 8)
    frame = spark.createDataFrame([(f"i{i:02}", row.tolist()) for i, row in enumerate(factors)] + [("flat", [1.0] * 8)], "asin string, factors array<double>")
    corr = np.corrcoef(factors)
    neighbors = filtering.item_neighbors(frame, 5, 0.1)
    got = {(r["asin"], r["neighbor"]): r["corr"] for r in neighbors.collect()}
    want = {}
    for i in range(24):
        for j in sorted((j for j in range(24) if j != i), key=lambda j: (-round(corr[i, j], 6), j))[:5]:
            if corr[i, j] >= 0.1:
                want[f"i{i:02}", f"i{j:02}"] = corr[i, j]
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-6)
    found = filtering.recommend_neighbors(matrix, neighbors, 3).collect()
    for u in range(60):
        have = {f"i{i:02}" for i in range(24) if dense[u, i] > 0}
        scores = {}
        for (a, b), c in got.items():
            if a in have and b not in have:
                scores.setdefault(b, []).append(c)
        best = sorted(((-round(sum(c) / len(c), 5), a) for a, c in scores.items()))[:3]
        assert [-s for s, _ in best] == pytest.approx(
            [round(r["score"], 5) for r in sorted(found, key=lambda r: r["rank"]) if r["user"] == f"u{u}"], abs=2e-5
        )


def test_filtering_input(spark):
    reviews = spark.createDataFrame([("u", f"p{i}", 1.0, 10 - i, f"r{i}") for i in range(10)], REVIEWS)
    assert [r["asin"] for r in filtering.limit_reviews(reviews, 2).collect()] == ["p9", "p8"]
    twice = spark.createDataFrame([("u", "p", 1.0, 1, "a"), ("u", "p", 4.0, 2, "b"), ("u", "q", None, 2, "c")], REVIEWS)
    assert [tuple(r) for r in filtering.utility_matrix(twice).collect()] == [("u", "p", 2.5)]


def lists_frame(spark, lists):
    rows = [(q, a, i + 1) for q, items in lists.items() for i, a in enumerate(items)]
    return spark.createDataFrame(rows, "query_id string, asin string, rank int")


def test_comparison(spark):
    a = lists_frame(spark, {"q": ["x", "y", "z"], "only_a": ["x"]})
    b = lists_frame(spark, {"q": ["z", "w"], "only_b": ["x"]})
    got = {r["query_id"]: tuple(r)[1:] for r in compare.compare_lists(a, b).collect()}
    assert got == {"q": (1, 0.333333, 2, 1), "only_a": (0, 0.0, 1, 0), "only_b": (0, 0.0, 0, 1)}
    rows = {(r["query_id"], r["method"]): r["overlap"] for r in compare.compare_baselines(a, {"m": b, "n": a}, 3).collect()}
    assert rows == {("q", "m"): 1, ("q", "n"): 3, ("only_a", "m"): 0, ("only_a", "n"): 1}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(["s1", "s2", "s3"]))
def test_fusion_ignores_the_order_of_lists(spark, order):
    lists = {"s1": ["a", "b", "c"], "s2": ["b", "a"], "s3": ["c"]}
    rows = [("q", s, a, i + 1) for s in order for i, a in enumerate(lists[s])]
    fused = compare.rank_fusion(spark.createDataFrame(rows, "query_id string, source string, asin string, rank int"), k=3)
    got = {r["asin"]: r["score"] for r in fused.collect()}
    assert got == {"a": round(1 / 60 + 1 / 61, 6), "b": round(1 / 61 + 1 / 60, 6), "c": round(1 / 62 + 1 / 60, 6)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdefghijkl"), unique=True, max_size=12), st.lists(st.sampled_from("abcdefghijkl"), unique=True, min_size=1))
def test_ranking_metrics(spark, found, wanted):
    recommended = lists_frame(spark, {"q": found}) if found else lists_frame(spark, {"other": ["a"]})
    relevant = spark.createDataFrame([("q", a) for a in wanted], "query_id string, asin string")
    k = 5
    gain = sum(1 / math.log2(i + 2) for i, a in enumerate(found[:k]) if a in wanted)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(wanted))))
    assert evaluate.ndcg_at_k(recommended, relevant, k).first()["ndcg"] == pytest.approx(gain / ideal, abs=1e-6)
    hits = [i for i, a in enumerate(found[:k]) if a in wanted]
    assert evaluate.recall_at_k(recommended, relevant, k).first()["recall"] == pytest.approx(len(hits) / len(wanted), abs=1e-6)
    assert evaluate.reciprocal_rank(recommended, relevant, k).first()["reciprocal_rank"] == pytest.approx(
        1 / (hits[0] + 1) if hits else 0, abs=1e-6
    )


def test_diversity_and_split(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 3.0])], "asin string, embedding array<float>")
    got = evaluate.diversity_at_k(lists_frame(spark, {"q": ["a", "b", "c"], "one": ["a"]}), vectors).collect()
    cosine = (0 + 2 * 0.5**0.5) / 3
    assert [(r["query_id"], r["diversity"]) for r in got] == [("q", pytest.approx(1 - cosine, abs=1e-6))]
    rows = [("u", f"p{i}", 1.0, i // 2, f"r{i}") for i in range(6)] + [("v", "p", 1.0, 1, "s")]
    train, test = evaluate.holdout_split(spark.createDataFrame(rows, REVIEWS))
    assert [r["review_id"] for r in test.collect()] == ["r5"]
    assert sorted(r["review_id"] for r in train.collect()) == ["r0", "r1", "r2", "r3", "r4"]


def test_equal_item_lists_are_searched_once_and_never_broadcast_when_many(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(f"p{i}", rng.normal(size=4).tolist()) for i in range(30)], "asin string, embedding array<double>")
    products = spark.createDataFrame(product_rows(30), PRODUCTS)
    rows = [("a", ["p1", "p2"]), ("b", ["p2", "p1"]), ("c", ["p1"]), ("c", ["p2"]), ("d", ["p3", None]), ("e", None), ("f", ["p1", "p1", "p2"])]
    lists = spark.createDataFrame(rows, "query_id string, asins array<string>")
    exact, asked = recommend.retrieve_exact(v, 20), []

    def spy(queries, excluded, n):
        asked.append((queries.count(), n, "Broadcast" in excluded.join(queries, "query_id")._jdf.queryExecution().executedPlan().toString()))
        return exact(queries, excluded, n)

    monkeypatch.setattr(recommend, "BROADCAST_ROWS", 0)
    got = recommend.recommend_item_lists(lists, products, spy, v, 4)
    assert asked == [(3, 3, False)]
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["asin"], r["score"]))
    assert set(found) == set("abcdf") and found["a"] == found["b"] == found["c"] != found["f"]
    assert {"p1", "p2"}.isdisjoint(a for a, _ in found["a"]) and len(found["a"]) == 4


def test_prompts_by_block_send_a_text_once(spark, monkeypatch):
    texts = [(f"p{i}", f"t{i}" if i % 3 else None, "c", "long " * 200 + str(i)) for i in range(20)]
    texts.append(texts[3])
    products = spark.createDataFrame(texts, "asin string, title string, category string, description string")
    rows = [(f"q{q:02}", f"p{(q + r) % 22}", 1.0 / r, r) for q in range(40) for r in range(1, 11)] + [(None, "p1", 1.0, 1)]
    candidates = spark.createDataFrame(rows, "query_id string, asin string, score double, rank int")
    summaries = spark.createDataFrame([(f"q{q:02}", f"s{q}") for q in range(1, 42)] + [(None, "s"), ("q02", "second"), ("q03", None)], "query_id string, summary string")
    asks = spark.createDataFrame([("q01", "red", ["a", "b"]), ("q02", "", [])], "query_id string, query string, criteria array<string>")
    options = {"most": 7, "sustainability_mode": True}
    joined = candidates.join(products, "asin")
    wanted = sorted(map(repr, rerank.rerank_prompts(joined, summaries, asks, **options).collect()))
    sent = []

    def counting(tail):
        run = written(tail)

        def counted(batches):
            rows, total = [], 0
            for batch in batches:
                total += sum(len(t or "") for t in batch.column("text").to_pylist())
                rows.append(batch)
            assert total < 60_000  # 378 candidates have 380,000 characters
            yield from run(rows)

        sent.append(1)
        return counted

    written = rerank._written_prompts
    monkeypatch.setattr(rerank, "_written_prompts", counting)
    assert sorted(map(repr, rerank.rerank_prompts(candidates, summaries, asks, products=products, **options).collect())) == wanted and sent
    monkeypatch.setattr(rerank, "_written_prompts", written)
    monkeypatch.setattr(rerank, "PROMPT_ROWS", 30)
    monkeypatch.setattr(rerank, "PROMPT_BATCH", 5_000)
    assert sorted(map(repr, rerank.rerank_prompts(candidates, summaries, asks, products=products, **options).collect())) == wanted


def test_lists_are_taken_in_parts_of_bounded_size():
    import pyarrow as pa

    lists = [list(range(n)) for n in (5, 0, 30, 1, 1, 7, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.int64()))], ["user", "asin"])
    parts = list(filtering._parts(batch, "asin", 10))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 2
    assert all(p.num_rows == 1 or sum(len(x or []) + 1 for x in p.column(1).to_pylist()[:-1]) <= 10 for p in parts)
    assert not list(filtering._parts(batch.slice(0, 0), "asin", 10))


def test_prompts_are_asked_in_waves_and_histories_hold_no_descriptions(spark, monkeypatch):
    products = spark.createDataFrame(product_rows(30), PRODUCTS)
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"p{i}", rng.normal(size=6).tolist()) for i in range(30)], "asin string, embedding array<double>")
    rows = [(f"u{u}", f"p{(u * 7 + i) % 30}", 4.0, i, f"r{u}-{i}") for u in range(12) for i in range(5)]
    reviews = spark.createDataFrame(rows, REVIEWS)

    def generate(asked):
        import json
        import re

        return [json.dumps({"recommendations": [{"asin": re.findall(r"ASIN: (\S+)", p)[2], "explanation": "third"}]}) for p in asked]

    def answers():
        final, fresh = recommend.recommend_reranked(reviews, products, recommend.retrieve_exact(vectors, 8), vectors, generate=generate, k=4)
        return sorted(map(repr, final.collect())), sorted(map(repr, fresh.collect()))

    want, asked, prompts, joined = answers(), [], recommend.rerank_prompts, recommend.with_products

    def counting(candidates, *args, **options):
        asked.append(candidates.count())
        return prompts(candidates, *args, **options)

    def plain(history, described):
        assert "description" not in described.columns
        return joined(history, described)

    monkeypatch.setattr(recommend, "rerank_prompts", counting)
    monkeypatch.setattr(recommend, "with_products", plain)
    monkeypatch.setattr(recommend, "PROMPT_WAVE", 20, raising=False)
    assert answers() == want and len(want[1]) == 12
    assert len(asked) >= 3 and max(asked) < sum(asked)
