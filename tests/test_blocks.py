"""Search that skips blocks, the centroid tree, exclusion in waves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.operators import cones, popularity, search, tree
from recspark.operators.cells import assign_cells, first_columns, train_centroids
from recspark.plans import recommend
from test_search import brute, collected, frames, random_vectors


def clustered(n, centres, spread, seed, prefix="p"):
    rng = np.random.default_rng(seed)
    return [(f"{prefix}{i:04}", (centres[i % len(centres)] + spread * rng.normal(size=centres.shape[1])).astype(np.float32).tolist()) for i in range(n)]


def test_skipping_search_is_exact_and_skips_most_blocks(spark):
    centres = np.random.default_rng(1).normal(size=(20, 8)) * 4
    items = clustered(1000, centres, 0.1, 2) + [("zero", [0.0] * 8)]
    queries = clustered(40, centres, 0.1, 3, "q") + [("q_zero", [0.0] * 8), ("q_none", (-centres[0]).astype(np.float32).tolist())]
    q, i = frames(spark, queries, items)
    index = cones.build_cones(i, train_centroids(i, 20), 25)
    assert index.cones.count() >= 40 and index.items.groupBy("cell").count().agg(F.max("count")).first()[0] <= 50
    found, visits = cones.skipping_topk(q, index, 5)
    assert collected(found) == brute(queries, items, 5)
    visited = dict(visits.collect())
    assert len(visited) == len(queries) and np.mean([visited[n] for n, _ in queries[:40]]) < 0.25 * index.cones.count()
    assert cones.skipping_topk(q.limit(0), index, 5)[0].count() == 0


def test_skipping_search_on_vectors_without_structure(spark):
    queries, items = random_vectors(9, seed=4, prefix="q"), random_vectors(200, seed=5)
    q, i = frames(spark, queries, items)
    index = cones.build_cones(i, train_centroids(i, 4), 30)
    assert collected(cones.skipping_topk(q, index, 7)[0]) == brute(queries, items, 7)
    # With more wanted than there are items, every block is read.
    found, visits = cones.skipping_topk(q.limit(3), index, 300)
    assert found.count() == 3 * len(items) and {r["visited"] for r in visits.collect()} == {index.cones.count()}


def test_waves_stay_bounded_where_bounds_say_little(spark, monkeypatch):
    queries, items = random_vectors(40, seed=14, prefix="q"), random_vectors(300, seed=15)
    q, i = frames(spark, queries, items)
    index = cones.build_cones(i, train_centroids(i, 10), 5)
    pairs, real = [], cones.cell_candidates

    def counting(asked, *args, **options):
        pairs.append(asked.count())
        return real(asked, *args, **options)

    monkeypatch.setattr(cones, "cell_candidates", counting)
    monkeypatch.setattr(cones, "WAVE_ROWS", 100, raising=False)
    monkeypatch.setattr(cones, "WAVE_SHARE", 1, raising=False)
    found, visits = cones.skipping_topk(q, index, 7)
    assert collected(found) == brute(queries, items, 7) and max(pairs) <= 300
    assert sorted(r["query_id"] for r in visits.collect()) == [n for n, _ in queries]
    assert visits.agg(F.max("visited")).first()[0] == index.cones.count()


def test_first_columns():
    scores = np.array([[1.0, 3.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0]])
    assert first_columns(scores, 2).tolist() == [[1, 2], [0, 1]] and first_columns(scores, 3).tolist() == [[1, 2, 3], [0, 1, 2]]
    assert first_columns(scores, 1).tolist() == [[1], [0]] and first_columns(scores, 9).tolist()[0] == [1, 2, 3, 0]


def test_tree_of_centroids(spark):
    centres = np.random.default_rng(6).normal(size=(30, 8)) * 3
    items, queries = clustered(3000, centres, 0.4, 7), clustered(60, centres, 0.4, 8, "q")
    q, i = frames(spark, queries, items)
    grown = tree.train_tree(i, 6, 8, max_iter=4)
    assert len(grown.branches) == 6 and sum(map(len, grown.leaf_ids)) == 48
    again = tree.read_tree(tree.tree_rows(grown, spark))
    assert np.allclose(again.branches, grown.branches) and [x.tolist() for x in again.leaf_ids] == [x.tolist() for x in grown.leaf_ids]
    placed = tree.assign_leaves(i, grown).persist()
    # The nearest leaf of the nearest branch, one vector at a time.
    for row in placed.limit(50).collect():
        v = np.array(row["embedding"], dtype=np.float64)
        b = int((grown.branches @ v).argmax())
        assert row["cell"] == grown.leaf_ids[b][int((grown.leaves[b] @ v).argmax())]
    expected = brute(queries, items, 10)
    every = collected(tree.tree_topk(q, placed, grown, 10, n_branches=6, n_probe=48))
    assert every == expected
    few = collected(tree.tree_topk(q, placed, grown, 10, n_branches=2, n_probe=6))
    recall = sum(len({a for a, _ in expected[n]} & {a for a, _ in few.get(n, [])}) for n in expected) / 600
    assert recall >= 0.9
    placed.unpersist()
    one = tree.train_tree(i.limit(0).union(spark.createDataFrame([("a", [0.0] * 8)], i.schema)), 4, 4)
    assert [r["cell"] for r in tree.assign_leaves(i.limit(3), one).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        tree.train_tree(i, 5000, 5000)


def test_exclusion_comes_first_in_waves(spark):
    queries, items = random_vectors(6, seed=9, prefix="q"), random_vectors(300, seed=10)
    q, i = frames(spark, queries, items)
    full = brute(queries, items, 300)
    gone = [("q0000", a) for a, _ in full["q0000"][:250]] + [("q0001", a) for a, _ in full["q0001"]] + [("q0002", a) for a, _ in full["q0002"][1:9]]
    excluded = spark.createDataFrame(gone, "query_id string, asin string")
    want = {n: [r for r in rows if (n, r[0]) not in set(gone)][:4] for n, rows in full.items()}
    want = {n: r for n, r in want.items() if r}
    asked = []

    def find(some, depth):
        asked.append((some.count(), depth))
        return search.exact_topk(some, i, depth)

    assert collected(search.excluded_first(find, q, excluded, 4)) == want
    assert asked[0] == (6, 8) and asked[1][0] <= 3 and all(n <= 2 for n, _ in asked[2:])
    assert collected(search.search(q, i, 4, excluded=excluded, exclude_first=True)) == want
    centroids = train_centroids(i, 5)
    cells = assign_cells(i, centroids)
    found = recommend.retrieve_cells(cells, centroids, 4, n_probe=5, exclude_first=True)(q, excluded)
    got = {n: sorted((r["asin"], round(r["score"], 6)) for r in found.filter(F.col("query_id") == n).collect()) for n in want}
    assert got == {n: sorted(r) for n, r in want.items()}


def test_popular_products_are_read_in_blocks(spark):
    products = spark.range(3000).select(
        F.col("id").cast("string").alias("asin"), F.lit(4.0).alias("avg_rating"), (F.lit(9000) - F.floor(F.col("id") / 3)).alias("num_reviews")
    )
    order = [r["asin"] for r in popularity.popularity_topk(products, 3000).orderBy("rank").collect()]
    users = spark.createDataFrame([("none",), ("some",), ("most",), ("all",)], "query_id string")
    gone = [("some", a) for a in order[:3]] + [("most", a) for a in order[:2500]] + [("all", a) for a in order] + [("stranger", "1")]
    got = popularity.recommend_popular_for_users(products, users, spark.createDataFrame(gone, "query_id string, asin string"), 5, first=8)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["asin"]))
    assert rows == {u: [(i + 1, a) for i, a in enumerate(order[n : n + 5])] for u, n in (("none", 0), ("some", 3), ("most", 2500))}
