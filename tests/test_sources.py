import json

import pytest

from recspark.operators.catalogue import (
    build_catalogue,
    build_catalogue_relaxed,
    minimal_metadata,
    one_per_product,
    review_digest,
)
from recspark.plans import batch as batch_plan
from recspark.plans.batch import load_or_build_catalogue, run_batch
from recspark.sources import jsonl, tables


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_reviews_defaults_and_broken_lines(spark, tmp_path):
    path = write(
        tmp_path / "reviews.json",
        [
            {"reviewerID": "u", "asin": "a", "overall": 4, "reviewText": "fine", "unixReviewTime": 7},
            "{broken",
            "",
            "[1, 2]",
            {"asin": "b", "rating": 2.5},
            {"asin": "c", "overall": None, "reviewText": None},
            {"asin": "d", "overall": "good"},
            {"asin": "e", "overall": "3.5"},
        ],
    )
    rows = {r["asin"]: r for r in jsonl.load_reviews(spark, path).collect()}
    assert sorted(rows) == ["a", "b", "c", "d", "e"]
    assert rows["a"]["rating"] == 4.0 and rows["a"]["unixReviewTime"] == 7 and rows["a"]["summary"] == ""
    assert rows["b"]["rating"] == 2.5 and rows["b"]["reviewerID"] == "" and rows["b"]["unixReviewTime"] == 0
    assert rows["c"]["rating"] is None and rows["c"]["reviewText"] is None
    assert rows["d"]["rating"] is None and rows["e"]["rating"] == 3.5


def test_metadata_shapes(spark, tmp_path):
    path = write(
        tmp_path / "meta.json",
        [
            {"asin": "a", "description": ["x", "y"], "category": [["A", "B", "C", "D"], ["E"]], "price": 3,
             "imageURL": ["low"], "imageURLHighRes": ["high", "more"]},
            {"asin": "b", "description": "z", "category": ["A", "B"], "price": "$12.99", "imageURL": [], "imageURLHighRes": ["h"]},
            {"asin": "c", "category": [], "imageURL": ["low"]},
            {"asin": "d", "category": "text", "title": "T", "also_bought": ["a"], "imageURL": "one"},
        ],
    )
    rows = {r["asin"]: r for r in jsonl.load_metadata(spark, path, "Books").collect()}
    assert rows["a"]["description"] == "x y" and rows["a"]["category"] == "A > B > C" and rows["a"]["price"] == 3.0
    assert rows["a"]["imageURL"] == ["high", "more"]
    assert rows["b"]["category"] == "A > B" and rows["b"]["price"] is None and rows["b"]["imageURL"] is None
    assert rows["c"]["category"] == "Books" and rows["c"]["imageURL"] == ["low"] and rows["c"]["description"] == ""
    assert rows["d"]["category"] == "Books" and rows["d"]["also_bought"] == ["a"] and rows["d"]["also_viewed"] == []


def test_file_lookup_takes_the_first_name(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jsonl.find_reviews(spark, str(tmp_path))
    assert jsonl.find_metadata(spark, str(tmp_path)) is None
    write(tmp_path / "reviews.jsonl", ["{}"])
    write(tmp_path / "Electronics.json", ["{}"])
    assert jsonl.find_reviews(spark, str(tmp_path)).endswith("/reviews.jsonl")
    write(tmp_path / "reviews_Electronics.jsonl", ["{}"])
    assert jsonl.find_reviews(spark, str(tmp_path)).endswith("/reviews_Electronics.jsonl")
    write(tmp_path / "meta.json", ["{}"])
    assert jsonl.find_metadata(spark, str(tmp_path)).endswith("/meta.json")


REVIEWS = "reviewerID string, asin string, rating double, reviewText string, unixReviewTime bigint, review_id string"


def test_digest_order_limit_and_nulls(spark):
    rows = [("u", "a", 1.0, f"t{i:02}", 100 - i, f"r{i:02}") for i in range(12)]
    rows += [("u", "a", 1.0, None, 0, "r99"), ("u", "b", 1.0, "y", 5, "r2"), ("u", "b", 1.0, "x", 5, "r1")]
    got = dict(review_digest(spark.createDataFrame(rows, REVIEWS)).collect())
    assert got["a"] == " | ".join(f"t{i:02}" for i in range(11, 1, -1))
    assert got["b"] == "x | y"


def catalogue_inputs(spark):
    reviews = spark.createDataFrame(
        [("u", "a", 4.0, "good", 1, "1"), ("v", "a", 2.0, "bad", 2, "2"), ("u", "b", 2.0, "meh", 1, "3"), ("v", "x", 5.0, "lost", 1, "4")],
        REVIEWS,
    )
    metadata = spark.createDataFrame(
        [("a", None, None, None, "d" * 600), ("b", "B", "Br", "Cat", None)],
        "asin string, title string, brand string, category string, description string",
    )
    return reviews, metadata


def test_catalogue_fills_and_filters(spark):
    reviews, metadata = catalogue_inputs(spark)
    rows = {r["asin"]: r for r in build_catalogue(reviews, metadata, 1, 0.0, description_limit=500, reviews_limit=300).collect()}
    assert sorted(rows) == ["a", "b"]
    assert rows["a"]["title"] == "Untitled Product" and rows["a"]["category"] == "Electronics"
    assert rows["a"]["text_for_embedding"] == (
        "Title: Untitled Product | Category: Electronics | Description: " + "d" * 500 + "... | Reviews: good | bad"
    )
    assert rows["b"]["description"] == "meh" and rows["a"]["image_url"] is None
    assert [r["asin"] for r in build_catalogue(reviews, metadata, 2, 3.0).collect()] == ["a"]


def test_catalogue_relaxes_when_empty(spark):
    reviews, metadata = catalogue_inputs(spark)
    low = reviews.withColumn("rating", reviews["rating"] * 0.1)
    assert build_catalogue(low, metadata, 1).count() == 0
    assert build_catalogue_relaxed(low, metadata).count() == 2


def test_catalogue_duplicates_and_minimal_metadata(spark):
    reviews, metadata = catalogue_inputs(spark)
    doubled = metadata.union(metadata)
    assert build_catalogue(reviews, doubled, 1, 0.0).count() == 4
    assert build_catalogue(reviews, doubled, 1, 0.0, dedupe=True).count() == 2
    assert one_per_product(doubled).count() == 2
    minimal = minimal_metadata(reviews)
    row = minimal.filter("asin = 'a'").first()
    assert row["title"] == "Product a" and row["description"] == "good bad" and row["price"] == 0.0
    assert build_catalogue(reviews, minimal, 1, 0.0).filter("asin = 'x'").first()["num_reviews"] == 1


def test_catalogue_roundtrip_parquet_and_csv(spark, tmp_path):
    reviews, metadata = catalogue_inputs(spark)
    products = build_catalogue(reviews, metadata, 1, 0.0)
    tables.save_catalogue(products.drop("image_url", "imageURL"), str(tmp_path / "p.parquet"))
    loaded = tables.load_catalogue(spark, str(tmp_path / "p.parquet"))
    assert "image_url" in loaded.columns and loaded.count() == 2
    flat = products.drop("imageURL").select("asin", "title", "avg_rating", "num_reviews")
    flat.toPandas().to_csv(tmp_path / "p.csv", index=False)
    from_csv = tables.load_catalogue(spark, str(tmp_path / "p.csv"), "asin string, title string, avg_rating double, num_reviews bigint")
    assert {r["asin"]: r["avg_rating"] for r in from_csv.collect()} == {"a": 3.0, "b": 2.0}
    tables.save_catalogue(products.drop("image_url"), str(tmp_path / "whole.csv"))
    whole = tables.load_catalogue(spark, str(tmp_path / "whole.csv"))
    assert dict(whole.dtypes) == dict(products.dtypes)
    assert sorted(whole.select(*products.columns).collect(), key=str) == sorted(products.collect(), key=str)


def test_batch_from_raw_files_and_from_the_stored_catalogue(spark, tmp_path):
    people = [f"u{i}" for i in range(60)]
    lines = [
        {"reviewerID": u, "asin": f"p{(7 * i + j) % 40}", "overall": 1 + (i + j) % 5, "reviewText": f"text {i % 5} {j}", "unixReviewTime": i * 100 + j}
        for i, u in enumerate(people) for j in range(20)
    ]
    write(tmp_path / "reviews.json", lines)
    write(tmp_path / "metadata.json", [{"asin": f"p{i}", "title": f"thing {i % 7}", "category": ["c", str(i % 3)]} for i in range(40)])
    target = str(tmp_path / "out" / "catalogue.parquet")
    index = str(tmp_path / "out" / "index")
    batch = run_batch(spark, str(tmp_path), target, index, k=5, n_components=10, n_clusters=4)
    assert batch.products.count() > 0 and batch.vectors.count() == batch.products.count()
    per_user = {r["query_id"]: r["n"] for r in batch.recommendations.groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
    assert set(per_user) <= set(people) and max(per_user.values()) <= 5
    methods = {r["method"] for r in batch.comparison.select("method").distinct().collect()}
    assert methods == {"popularity", "filtering"}
    products, reviews = load_or_build_catalogue(spark, str(tmp_path), target)
    assert products.count() == batch.products.count() and reviews.count() == len(lines)


def test_a_second_batch_gives_the_same_rows(spark, tmp_path):
    lines = [
        {"reviewerID": f"u{i}", "asin": f"p{(37 * i + 11 * j) % 600}", "overall": 3 + (i + j) % 3, "reviewText": f"word{i} thing{j}", "unixReviewTime": i * 100 + j}
        for i in range(80) for j in range(20)
    ]
    write(tmp_path / "reviews.json", lines)
    write(tmp_path / "metadata.json", [{"asin": f"p{i}", "title": f"thing{i % 97} of kind{i % 31}", "category": ["c", str(i % 7)]} for i in range(600)])
    target, index = str(tmp_path / "out" / "catalogue.parquet"), str(tmp_path / "out" / "index")
    runs = []
    for how in ("exact", "exact", "cells", "cells"):
        batch = run_batch(spark, str(tmp_path), target, index, index=how, k=5, n_components=10)
        runs.append(sorted(tuple(r) for r in batch.recommendations.select("query_id", "rank", "asin", "score").collect()))
    assert batch.products.count() > 500
    assert runs[0] == runs[1] and runs[2] == runs[3] and runs[0]


def test_a_batch_makes_only_the_baselines_that_are_compared(spark, tmp_path, monkeypatch):
    lines = [{"reviewerID": f"u{i}", "asin": f"p{(7 * i + j) % 9}", "overall": 3 + (i + j) % 3, "reviewText": f"text {j}", "unixReviewTime": i} for i in range(6) for j in range(4)]
    write(tmp_path / "reviews.json", lines)
    write(tmp_path / "metadata.json", [{"asin": f"p{i}", "title": f"thing {i}"} for i in range(9)])
    made = []
    fit = batch_plan.item_factors
    monkeypatch.setattr(batch_plan, "item_factors", lambda *a: made.append(1) or fit(*a))
    batch = run_batch(spark, str(tmp_path), str(tmp_path / "c.parquet"), k=3, n_components=2)
    popular = {tuple(r) for r in batch.compared("popularity").collect()}
    assert popular and not made
    assert popular == {tuple(r) for r in batch.comparison.filter("method = 'popularity'").collect()} and made


@pytest.mark.parametrize("name", ["c.parquet", "c.csv"])
def test_a_stored_catalogue_is_much_smaller_than_its_texts(spark, tmp_path, name):
    words = " ".join(f"word{i * i % 997}" for i in range(4000))
    products = spark.range(200).selectExpr("cast(id AS string) asin", f"concat(id, ' ', '{words}') description").selectExpr(
        "*", "concat('Title | ', description) text_for_embedding", "CAST(NULL AS string) image_url"
    )
    tables.save_catalogue(products, str(tmp_path / name))
    stored = sum(f.stat().st_size for f in (tmp_path / name).iterdir())
    assert stored < 200 * 2 * len(words) / 10
    back = tables.load_catalogue(spark, str(tmp_path / name)).select("asin", "description", "text_for_embedding")
    assert sorted(back.collect()) == sorted(products.drop("image_url").collect())
