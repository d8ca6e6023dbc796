"""The registered queries: each runs an operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from recspark.functions import prompts, replies, rules, text
from recspark.functions.replies import with_replied_criteria, with_replied_eco_score
from recspark.functions.rules import with_eco_score, with_search_criteria
from recspark.operators import catalogue, cells, compare, cones, embed, evaluate, filtering, history, popularity, rerank, search, tree
from recspark.operators import profiles
from recspark.operators.profiles import blend_query_vectors, profile_vectors
from recspark.plans import recommend
from recspark.plans.batch import run_batch
from recspark.session import checkpointed, work_path
from recspark.sources import jsonl, tables, versions
from recspark.streaming import delta_vectors
from recspark.streaming import product_stats as stats_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def shown(vector: str = "embedding") -> Column:
    """A vector as text in millionths, so that both engines print it alike."""
    doubles = F.col(vector).cast("array<double>")
    return F.array_join(F.transform(doubles, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.build_catalogue(fx.reviews(spark, sf_dir), fx.metadata(spark, sf_dir))


def feed_products(spark: SparkSession, sf_dir: str, described: bool = False) -> DataFrame:
    """The products of the feed; the descriptions only where a query needs them."""
    rows = fx.metadata(spark, sf_dir) if described else fx.parts(spark, sf_dir)
    return rows.withColumn("image_url", catalogue.first_image())


def product_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = products(spark, sf_dir).select("asin", "text_for_embedding")
    return checkpointed(embed.embed_texts(texts, "text_for_embedding").drop("text_for_embedding"))


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("asin").alias("query_id"), "embedding")


CATALOGUE_COLUMNS = [
    "asin", "avg_rating", "num_reviews", "all_reviews", "title", "brand", "category", "price", "description",
    "image_url", "text_for_embedding",
]


# Sources and catalogue


@query
def ingest_reviews(spark, sf_dir):
    return jsonl.load_reviews(spark, fx.write_text(fx.raw_reviews(spark, sf_dir), "reviews.jsonl"))


@query
def ingest_metadata(spark, sf_dir):
    loaded = jsonl.load_metadata(spark, fx.write_text(fx.raw_metadata(spark, sf_dir), "meta.jsonl"))
    return loaded.select(
        "asin", "title", "description", "price", "category", "brand",
        catalogue.first_image().alias("image_url"),
        F.array_join("also_bought", "|").alias("also_bought"),
        F.size("also_viewed").alias("n_also_viewed"),
    )


@query
def minimal_metadata(spark, sf_dir):
    return catalogue.minimal_metadata(fx.reviews(spark, sf_dir))


@query
def product_stats(spark, sf_dir):
    return catalogue.product_stats(fx.reviews(spark, sf_dir))



@query
def review_digest(spark, sf_dir):
    return catalogue.review_digest(fx.reviews(spark, sf_dir))


@query
def product_catalogue(spark, sf_dir):
    return products(spark, sf_dir).select(*CATALOGUE_COLUMNS)


@query
def catalogue_roundtrip(spark, sf_dir):
    path = work_path(spark, "catalogue.parquet")
    tables.save_catalogue(products(spark, sf_dir).drop("image_url"), path)
    return tables.load_catalogue(spark, path).select(*CATALOGUE_COLUMNS)


@query
def catalogue_csv(spark, sf_dir):
    path = work_path(spark, "catalogue.csv")
    tables.save_catalogue(products(spark, sf_dir).drop("image_url"), path)
    return tables.load_catalogue(spark, path).select(*CATALOGUE_COLUMNS)


@query
def all_users(spark, sf_dir):
    return history.all_users(fx.reviews(spark, sf_dir))


# Histories


@query
def user_history(spark, sf_dir):
    return history.user_history(fx.reviews(spark, sf_dir), products(spark, sf_dir), 10).select(
        "reviewerID", "asin", "rating", "unixReviewTime", "history_rank", "title", "category", "price", "image_url"
    )


@query
def history_summary(spark, sf_dir):
    rows = history.user_history(fx.reviews(spark, sf_dir), products(spark, sf_dir), 20)
    return history.history_summary(rows, fx.customers(spark, sf_dir))


@query
def history_display(spark, sf_dir):
    rows = history.user_history(fx.reviews(spark, sf_dir), products(spark, sf_dir), 10)
    return history.history_display(rows, fx.customers(spark, sf_dir))


@query
def rich_query_text(spark, sf_dir):
    rows = history.user_history(fx.reviews(spark, sf_dir), products(spark, sf_dir), 20)
    texts = fx.user_texts(spark, sf_dir).withColumnRenamed("query_id", "reviewerID")
    return history.rich_query_text(rows, texts, fx.customers(spark, sf_dir))


# Popularity


@query
def popularity_topk(spark, sf_dir):
    return popularity.popularity_topk(products(spark, sf_dir)).select("rank", "asin", "score", "title")


@query
def popularity_excluding(spark, sf_dir):
    bought = fx.feed(spark, sf_dir).select("asin")
    return popularity.recommend_popular(products(spark, sf_dir), 10, bought)


@query
def popularity_per_user(spark, sf_dir):
    """For every user of the feed, without the five items rated last."""
    recent = history.recent_best(fx.feed(spark, sf_dir), 5).select(F.col("reviewerID").alias("query_id"), "asin")
    users = history.all_users(fx.feed(spark, sf_dir)).withColumnRenamed("reviewerID", "query_id")
    return popularity.recommend_popular_for_users(products(spark, sf_dir), users, checkpointed(recent), 10)


@query
def popular_fallback(spark, sf_dir):
    return popularity.popular_fallback(products(spark, sf_dir), 10)


# Vectors


@query
def embed_products(spark, sf_dir):
    texts = products(spark, sf_dir).select("asin", "text_for_embedding")
    return embed.embed_texts(texts, "text_for_embedding").select("asin", shown().alias("embedding"))


@query
def embedding_cache(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    english = documents.filter(F.col("lang") == "en")
    known = embed.embed_texts(english.select(F.md5("text").alias("text_key"), "text"), "text")
    store = checkpointed(known.drop("text").dropDuplicates(["text_key"]))
    joined, fresh = embed.embed_with_store(documents, "text", store)
    new_keys = fresh.select("text_key", F.lit(True).alias("computed"))
    return joined.join(new_keys, "text_key", "left").select(
        "doc_id", "text_key", F.coalesce("computed", F.lit(False)).alias("computed"), shown().alias("embedding")
    )


def feed_profiles(spark, sf_dir, how="mean") -> DataFrame:
    rows = history.recent_best(fx.feed(spark, sf_dir), 20)
    return profile_vectors(rows, fx.vectors(spark, sf_dir), how)


@query
def user_profile_mean(spark, sf_dir):
    return feed_profiles(spark, sf_dir).select("reviewerID", shown().alias("embedding"))


@query
def user_profile_max(spark, sf_dir):
    return feed_profiles(spark, sf_dir, "max").select("reviewerID", shown().alias("embedding"))


@query
def user_profile_weighted(spark, sf_dir):
    rows = history.recent_best(fx.feed(spark, sf_dir), 20)
    weighted = profile_vectors(rows, fx.vectors(spark, sf_dir), "weighted_mean", weight="rating")
    return weighted.select("reviewerID", shown().alias("embedding"))


@query
def user_profile_updated(spark, sf_dir):
    """Stored sums of the even events, then the odd ones added: the profiles over all events."""
    feed, vectors = fx.feed(spark, sf_dir), fx.vectors(spark, sf_dir)
    store = versions.VersionedTable(spark, work_path(spark, "profiles"))
    odd = F.col("review_id").cast("bigint") % 2 == 1
    profiles.update_profiles(store, feed.filter(~odd), vectors, "first")
    for _ in range(2):  # the second time adds nothing
        profiles.update_profiles(store, feed.filter(odd), vectors, "second")
    return profiles.stored_profiles(store).select("reviewerID", shown().alias("embedding"))


def user_text_vectors(spark, sf_dir) -> DataFrame:
    return embed.embed_texts(fx.user_texts(spark, sf_dir), "text").select("query_id", "embedding")


@query
def blend_query_vector(spark, sf_dir):
    known = feed_profiles(spark, sf_dir).withColumnRenamed("reviewerID", "query_id")
    blended = blend_query_vectors(known, user_text_vectors(spark, sf_dir))
    return blended.select("query_id", shown().alias("embedding"))


@query
def exact_topk(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    return search.exact_topk(as_queries(vectors), vectors, 100)



def stored_cells(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    vectors = fx.vectors(spark, sf_dir).select("asin", "embedding")
    centroids = cells.train_centroids(vectors, 16)
    path = work_path(spark, "index")
    tables.save_cells(cells.assign_cells(vectors, centroids), centroids, path)
    return *tables.load_cells(spark, path), 16


@query
def ivf_topk(spark, sf_dir):
    """Probes every cell, so that the result must equal exact search."""
    placed, centroids, n_cells = stored_cells(spark, sf_dir)
    return cells.ivf_topk(as_queries(fx.vectors(spark, sf_dir)), placed, centroids, 100, n_probe=n_cells)


@query
def ivf_topk_probed(spark, sf_dir):
    """Probes two cells of each query; the mean vector of every label is a centroid, so that SQL can do the same."""
    vectors = fx.vectors(spark, sf_dir).select("asin", "embedding", F.col("label").cast("int").alias("cell"))
    labelled = vectors.select("asin", "cell").filter(F.col("cell").isNotNull())
    means = profile_vectors(labelled, vectors, user="cell").withColumnRenamed("embedding", "centroid")
    centroids = checkpointed(means)
    items = vectors.drop("cell")
    placed = checkpointed(cells.assign_cells(items, centroids))
    return cells.ivf_topk(as_queries(items), placed, centroids, 100, n_probe=2)


@query
def skipping_topk(spark, sf_dir):
    """Blocks by direction, skipped by their bounds: the rows of exact search."""
    vectors = fx.vectors(spark, sf_dir).select("asin", "embedding")
    index = cones.build_cones(vectors, cells.train_centroids(vectors, 64), 64)
    return cones.skipping_topk(as_queries(vectors), index, 100)[0]


@query
def tree_topk_probed(spark, sf_dir):
    """Labels as branches, three leaves each by the number of the vector, two of them probed in the two nearest branches."""
    vectors = fx.vectors(spark, sf_dir).select("asin", "embedding", F.col("label").cast("int").alias("branch"))
    placed = vectors.withColumn("cell", (F.col("branch") * 3 + F.col("asin").cast("bigint") % 3).cast("int")).filter("branch IS NOT NULL")
    items = vectors.drop("branch")
    branches = profile_vectors(placed.select("asin", "branch"), items, user="branch")
    leaves = profile_vectors(placed.select("asin", "cell"), items, user="cell")
    rows = branches.select("branch", F.lit(None).cast("int").alias("cell"), F.col("embedding").alias("centroid")).unionByName(
        leaves.select(F.floor(F.col("cell") / 3).cast("int").alias("branch"), "cell", F.col("embedding").alias("centroid"))
    )
    known = tree.read_tree(rows)
    placed = checkpointed(tree.assign_leaves(items, known))
    return tree.tree_topk(as_queries(items), placed, known, 100, n_branches=2, n_probe=2)


@query
def two_stage_topk(spark, sf_dir):
    placed, centroids, n_cells = stored_cells(spark, sf_dir)
    return cells.two_stage_topk(as_queries(fx.vectors(spark, sf_dir)), placed, centroids, 50, coarse_k=200, n_probe=n_cells)


@query
def sharded_topk(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    return search.sharded_topk(as_queries(vectors), vectors, 100, shard="label")



@query
def dual_index_topk(spark, sf_dir):
    """Delta rows replace the vectors of label 3 and add a new product for each vector of label 4."""
    vectors = fx.vectors(spark, sf_dir)
    main = vectors.select("asin", "embedding", F.lit(0).alias("version"))
    changed = vectors.filter(F.col("label").isin(3, 4)).select(
        F.when(F.col("label") == 4, F.concat(F.lit("n"), "asin")).otherwise(F.col("asin")).alias("asin"),
        F.reverse("embedding").alias("embedding"),
        F.lit(1).alias("version"),
    )
    return search.dual_index_topk(as_queries(vectors), main, changed, 100)



@query
def zero_shot_topk(spark, sf_dir):
    items = product_vectors(spark, sf_dir)
    return recommend.zero_shot(
        fx.text_queries(spark, sf_dir), products(spark, sf_dir), recommend.retrieve_exact(items), all_known=True
    ).select("query_id", "rank", "asin", "score", "title", "explanation", "category", "price", "image_url")


@query
def multi_query_topk(spark, sf_dir):
    return recommend.multi_query(fx.text_queries(spark, sf_dir), product_vectors(spark, sf_dir))


def feed_candidates(spark, sf_dir, how="mean", k=100) -> DataFrame:
    asked = checkpointed(feed_profiles(spark, sf_dir, how).withColumnRenamed("reviewerID", "query_id"))
    return search.exact_topk(asked, fx.vectors(spark, sf_dir), k)


@query
def rank_fusion(spark, sf_dir):
    both = feed_candidates(spark, sf_dir, "mean").withColumn("source", F.lit("mean")).unionByName(
        feed_candidates(spark, sf_dir, "max").withColumn("source", F.lit("max"))
    )
    return compare.rank_fusion(both)


# Text rules


@query
def clean_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))



@query
def eco_keywords(spark, sf_dir):
    words = F.concat_ws(" ", "title", "description")
    return fx.metadata(spark, sf_dir).select("asin", F.array_join(rules.eco_keywords(words), ",").alias("keywords"))



@query
def eco_score(spark, sf_dir):
    return with_eco_score(fx.metadata(spark, sf_dir)).select("asin", "sustainability_score", "short_reason")


@query
def eco_score_replies(spark, sf_dir):
    slot = F.col("asin").cast("bigint") % 6
    reply = (
        F.when(slot == 0, F.lit('{"sustainability_score": 8.7, "short_reason": "cuir de pomme"}'))
        .when(slot == 1, F.lit('Voici :\n```json\n{"sustainability_score": 12.5, "short_reason": "trop"}\n```'))
        .when(slot == 2, F.lit('{"sustainability_score": , "short_reason": "cassé"}'))
        .when(slot == 3, F.lit('{"sustainability_score": "7.5"} et {"autre": 1}'))
        .when(slot == 4, F.lit("pas de note"))
    )
    scored = with_eco_score(fx.metadata(spark, sf_dir)).withColumn("reply", reply)
    return with_replied_eco_score(scored).select("asin", "sustainability_score", "short_reason")


def criteria_asks(spark, sf_dir) -> DataFrame:
    """Whole documents as queries; those numbered as a user of the feed come with a history."""
    users = fx.feed(spark, sf_dir).select(F.col("reviewerID").alias("query_id"), F.lit(True).alias("known")).distinct()
    return (
        fx.table(spark, sf_dir, "documents")
        .select(fx.text_of("doc_id").alias("query_id"), F.col("text").alias("query"))
        .join(users, "query_id", "left")
    )


@query
def search_criteria(spark, sf_dir):
    asks = criteria_asks(spark, sf_dir)
    plain = with_search_criteria(asks, has_history=F.col("known")).withColumn("mode", F.lit(False))
    green = with_search_criteria(asks, has_history=F.col("known"), sustainability_mode=True).withColumn("mode", F.lit(True))
    return plain.unionByName(green).select("query_id", "mode", F.array_join("criteria", "|").alias("criteria"))


@query
def search_criteria_replies(spark, sf_dir):
    number = F.col("query_id").cast("bigint")
    listed = F.transform(F.sequence(F.lit(1), (number % 15 + 1).cast("int")), lambda i: F.concat(F.lit("critère "), i))
    reply = F.when(number % 4 != 0, F.to_json(F.struct(listed.alias("expanded_criteria"))))
    broken = F.when(number % 4 == 1, F.concat(F.lit("Voici "), reply, F.lit(" fin"))).when(
        number % 4 == 2, F.replace(reply, F.lit("]"), F.lit(""))
    ).otherwise(reply)
    asks = with_search_criteria(criteria_asks(spark, sf_dir), has_history=F.col("known")).withColumn("reply", broken)
    return with_replied_criteria(asks).select("query_id", F.array_join("criteria", "|").alias("criteria"))


@query
def eco_prompt(spark, sf_dir):
    columns = {c: F.col(c) for c in ("title", "description", "brand")}
    found = rules.eco_keywords(F.concat_ws(" ", "title", "description"))
    prompt = prompts.eco_prompt(**columns, features=F.col("category"), keywords=found)
    return fx.metadata(spark, sf_dir).select("asin", prompt.alias("prompt"))


@query
def criteria_prompt(spark, sf_dir):
    rows = history.user_history(fx.feed(spark, sf_dir), feed_products(spark, sf_dir), 20)
    titles = history.first_titles(rows).withColumnRenamed("reviewerID", "query_id")
    both = fx.user_texts(spark, sf_dir).join(titles, "query_id", "full")
    return both.select("query_id", prompts.criteria_prompt(F.col("text"), F.col("titles")).alias("prompt"))


# Recommendations

RESULT = ["query_id", "rank", "asin", "title", "score", "explanation", "category", "price", "image_url"]


def feed_recommendations(spark, sf_dir, **options) -> DataFrame:
    vectors = fx.vectors(spark, sf_dir)
    return recommend.recommend_history(
        options.pop("reviews", None) or fx.feed(spark, sf_dir),
        feed_products(spark, sf_dir),
        recommend.retrieve_exact(vectors, exclude_first=options.pop("exclude_first", False)),
        vectors,
        **options,
    )


@query
def recommend_history(spark, sf_dir):
    return feed_recommendations(spark, sf_dir).select(*RESULT)


@query
def recommend_unseen(spark, sf_dir):
    """All purchases are excluded, before the cut."""
    return feed_recommendations(spark, sf_dir, exclude_first=True, exclude_all_purchases=True).select(*RESULT)


@query
def recommend_blend(spark, sf_dir):
    return feed_recommendations(spark, sf_dir, texts=user_text_vectors(spark, sf_dir)).select(*RESULT)


@query
def recommend_eco(spark, sf_dir):
    return recommend.with_sustainability(
        feed_recommendations(spark, sf_dir), feed_products(spark, sf_dir, described=True)
    ).select(
        "query_id", "rank", "asin", "score", "sustainability_score", "short_reason"
    )


@query
def recommend_eco_resorted(spark, sf_dir):
    return recommend.with_sustainability(
        feed_recommendations(spark, sf_dir), feed_products(spark, sf_dir, described=True), resort=True
    ).select(
        "query_id", "rank", "asin", "score", "sustainability_score", "short_reason"
    )


@query
def history_by_item_list(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    return recommend.recommend_item_lists(
        fx.item_lists(spark, sf_dir), feed_products(spark, sf_dir), recommend.retrieve_exact(vectors), vectors,
        fallback=popularity.popular_fallback(products(spark, sf_dir)),
    ).select(*RESULT)


@query
def recommend_requests(spark, sf_dir):
    """Users, item lists, texts, several of them or nothing: one answer each."""
    vectors = fx.vectors(spark, sf_dir)
    return recommend.recommend_requests(
        fx.requests(spark, sf_dir), fx.feed(spark, sf_dir), feed_products(spark, sf_dir),
        recommend.retrieve_exact(vectors), vectors, popularity.popular_fallback(products(spark, sf_dir)),
    ).select(*RESULT)


@query
def recommend_cold_start(spark, sf_dir):
    return recommend.cold_start(
        fx.customers(spark, sf_dir), fx.feed(spark, sf_dir), products(spark, sf_dir)
    ).select(*RESULT)


# Re-ranking


def candidate_rows(spark, sf_dir) -> DataFrame:
    """Retrieved candidates of the feed's users, history items excluded."""
    vectors = fx.vectors(spark, sf_dir)
    owned = recommend.history_items(fx.feed(spark, sf_dir))
    return checkpointed(search.search(profile_vectors(owned, vectors, user="query_id"), vectors, 100, excluded=owned))


def prompts_of(spark, sf_dir, **options) -> DataFrame:
    items = feed_products(spark, sf_dir, described=True)
    candidates = candidate_rows(spark, sf_dir)
    rows = checkpointed(history.user_history(fx.feed(spark, sf_dir), items.drop("description"), 20))
    summaries = history.history_summary(rows).withColumnRenamed("reviewerID", "query_id")
    texts = history.rich_query_text(rows).select(F.col("reviewerID").alias("query_id"), F.col("query_text").alias("query"))
    asks = with_search_criteria(texts, has_history=F.lit(True), sustainability_mode=True)
    return rerank.rerank_prompts(candidates, summaries, asks, sustainability_mode=True, products=items, **options)


@query
def rerank_prompt(spark, sf_dir):
    """With whole descriptions."""
    return prompts_of(spark, sf_dir)


@query
def rerank_prompt_compact(spark, sf_dir):
    """With the fixed number of characters of each description."""
    return prompts_of(spark, sf_dir, description_limit=rerank.PROMPT_DESCRIPTION)


REPLIED_RANKS = [5, 3, 3, 1, 0, -1, 7, 9, 11, 13, 2, 4]  # 0: an unknown product, -1: product "0" of the catalogue


def model_replies(candidates: DataFrame) -> DataFrame:
    """Replies naming candidates by rank: plain, fenced, broken and empty ones; every fifth user has none."""
    wanted = [r for r in REPLIED_RANKS if r > 0]
    picked = candidates.filter(F.col("rank").isin(wanted)).groupBy("query_id").agg(
        *[F.max(F.when(F.col("rank") == r, F.col("asin"))).alias(f"r{r}") for r in sorted(set(wanted))]
    )

    def entry(place: int, rank: int) -> Column:
        asin = F.lit("zzz") if rank == 0 else F.lit("0") if rank == -1 else F.coalesce(F.col(f"r{rank}"), F.lit("none"))
        said = F.concat(F.lit(f"choice {place} of "), "query_id") if place % 4 else F.lit(None).cast("string")
        return F.struct(F.lit(place).alias("rank"), asin.alias("asin"), said.alias("explanation"))

    entries = F.array(*[entry(i, r) for i, r in enumerate(REPLIED_RANKS, 1)])
    body = F.to_json(F.struct(entries.alias("recommendations")))
    slot = F.col("query_id").cast("bigint") % 5
    reply = (
        F.when(slot == 0, body)
        .when(slot == 1, F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nEnjoy {them}!")))
        .when(slot == 2, F.concat(F.lit("Sure. "), F.replace(body, F.lit("]"), F.lit(""))))
        .when(slot == 3, F.lit(""))
    )
    return picked.select("query_id", reply.alias("reply")).filter(F.col("reply").isNotNull())


@query
def parse_replies(spark, sf_dir):
    return replies.parse_replies(model_replies(candidate_rows(spark, sf_dir)))



@query
def rerank_fill(spark, sf_dir):
    candidates = candidate_rows(spark, sf_dir)
    return rerank.merge_replies(
        candidates, checkpointed(model_replies(candidates)), feed_products(spark, sf_dir)
    ).select(*RESULT)


@query
def recommend_reranked(spark, sf_dir):
    """A first model answers every user; its replies to even-numbered users are stored, a second model answers the others."""

    def naming(places, said):
        def generate(asked):
            import json
            import re

            found = [re.findall(r"ASIN: (\S+)", prompt) for prompt in asked]
            chosen = [[asins[p - 1] for p in places if p <= len(asins)] for asins in found]
            return [json.dumps({"recommendations": [{"asin": a, "explanation": said} for a in c]}) for c in chosen]

        return generate

    vectors = fx.vectors(spark, sf_dir)
    inputs = fx.feed(spark, sf_dir), feed_products(spark, sf_dir, described=True), recommend.retrieve_exact(vectors), vectors
    options = {"sustainability_mode": True}
    folder = work_path(spark, "replies")
    _, fresh = recommend.recommend_reranked(*inputs, generate=naming([3, 1], "model one"), reply_folder=folder, **options)
    stored = checkpointed(fresh.filter(F.substring_index("reply_key", ":", 1).cast("bigint") % 2 == 0))
    final, _ = recommend.recommend_reranked(*inputs, stored, naming([2], "model two"), **options)
    return final.select("query_id", "rank", "asin", "title", "score", "explanation", "sustainability_score", "short_reason")


@query
def reply_cache_misses(spark, sf_dir):
    """Replies are stored for the first half of the users in id order; those of the others are missing."""
    candidates = candidate_rows(spark, sf_dir)
    asks = fx.user_texts(spark, sf_dir).withColumnRenamed("text", "query")
    keys = rerank.reply_keys(candidates, asks)
    half = candidates.select(F.max(F.col("query_id").cast("bigint"))).first()[0] // 2
    store = keys.filter(F.col("query_id").cast("bigint") <= half).withColumn("reply", F.lit("{}"))
    return rerank.missing_replies(candidates, asks, checkpointed(store))


# Filtering


@query
def utility_matrix(spark, sf_dir):
    return filtering.utility_matrix(fx.feed(spark, sf_dir))


@query
def svd_item_energy(spark, sf_dir):
    """With as many components as items, the factors of an item are as long as its ratings."""
    matrix = checkpointed(filtering.utility_matrix(fx.feed(spark, sf_dir)))
    factors = filtering.item_factors(matrix, matrix.select("item").distinct().count())
    squared = F.aggregate("factors", F.lit(0.0), lambda total, x: total + x * x)
    # First what floats add, so that a tie at the third digit is one in both engines.
    return factors.select("asin", (F.round(F.round(squared, 9), 3) + F.lit(0.0)).alias("energy"))


@query
def svd_truncated_energy(spark, sf_dir):
    """All energy of the ratings, and what one component and its residual hold of it."""
    matrix = checkpointed(filtering.utility_matrix(fx.feed(spark, sf_dir)))
    svd = filtering.truncated_svd(matrix, 1, tolerance=1e-13, max_rounds=60)
    held = svd.factors.agg(F.sum(F.aggregate("factors", F.lit(0.0), lambda total, x: total + x * x)).alias("held"))
    return held.select(
        F.round(F.round(F.lit(svd.total), 9), 2).alias("total"), F.round("held", 2).alias("captured"), F.lit(round(svd.residual, 2)).alias("residual")
    )


@query
def item_neighbors(spark, sf_dir):
    return filtering.item_neighbors(fx.vectors(spark, sf_dir), min_correlation=0.2, column="embedding")


@query
def cf_recommend(spark, sf_dir):
    """With the factors of the distributed SVD."""
    matrix = checkpointed(filtering.utility_matrix(fx.feed(spark, sf_dir)))
    neighbors = filtering.item_neighbors(filtering.item_factors(matrix))
    path = work_path(spark, "neighbors")
    tables.save_neighbors(neighbors, path)
    return filtering.recommend_neighbors(matrix, tables.load_neighbors(spark, path), 10, feed_products(spark, sf_dir))


def factor_recommendations(spark, sf_dir) -> DataFrame:
    matrix = checkpointed(filtering.utility_matrix(fx.feed(spark, sf_dir)))
    neighbors = checkpointed(filtering.item_neighbors(fx.vectors(spark, sf_dir), min_correlation=0.2, column="embedding"))
    return filtering.recommend_neighbors(matrix, neighbors, 10, feed_products(spark, sf_dir))


@query
def cf_recommend_factors(spark, sf_dir):
    """With the given vectors as item factors, so that every step after the SVD can be checked."""
    return factor_recommendations(spark, sf_dir)


# Comparison and evaluation


@query
def compare_lists(spark, sf_dir):
    return compare.compare_lists(feed_recommendations(spark, sf_dir), feed_recommendations(spark, sf_dir, how="max"))


@query
def compare_baselines(spark, sf_dir):
    main = checkpointed(feed_recommendations(spark, sf_dir))
    ranks = main.select("query_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(10))))
    # Ten rows: safe to broadcast.
    popular = F.broadcast(popularity.recommend_popular(products(spark, sf_dir)).select("rank", "asin"))
    return compare.compare_baselines(
        main,
        {
            "popularity": ranks.join(popular, "rank"),
            "filtering": factor_recommendations(spark, sf_dir).withColumnRenamed("user", "query_id"),
        },
    )


@query
def holdout_split(spark, sf_dir):
    train, test = evaluate.holdout_split(fx.feed(spark, sf_dir))
    return train.select("reviewerID", "review_id", "asin", F.lit("train").alias("part")).unionByName(
        test.select("reviewerID", "review_id", "asin", F.lit("test").alias("part"))
    )


def evaluated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    train, test = evaluate.holdout_split(fx.feed(spark, sf_dir))
    found = checkpointed(feed_recommendations(spark, sf_dir, reviews=checkpointed(train)))
    return found, test.select(F.col("reviewerID").alias("query_id"), "asin")


@query
def ndcg_at_k(spark, sf_dir):
    return evaluate.ndcg_at_k(*evaluated(spark, sf_dir))


@query
def recall_at_k(spark, sf_dir):
    return evaluate.recall_at_k(*evaluated(spark, sf_dir))


@query
def mrr(spark, sf_dir):
    return evaluate.mean_reciprocal_rank(*evaluated(spark, sf_dir))


@query
def diversity_at_k(spark, sf_dir):
    return evaluate.diversity_at_k(feed_recommendations(spark, sf_dir), fx.vectors(spark, sf_dir))


# Streams and the whole batch


@query
def stream_product_stats(spark, sf_dir):
    rows = fx.feed(spark, sf_dir)
    source, target, state = (work_path(spark, n) for n in ("feed", "windows", "state"))
    rows.write.parquet(source)
    stats_stream.run_stats_stream(spark, source, rows.schema, target, state)
    return stats_stream.current_stats(spark, target)


@query
def stream_delta_index(spark, sf_dir):
    rows = products(spark, sf_dir).select("asin", "text_for_embedding")
    source, target, state = (work_path(spark, n) for n in ("products", "delta", "state"))
    rows.write.parquet(source)
    delta_vectors.run_delta_stream(spark, source, rows.schema, target, state)
    return delta_vectors.delta_vectors(spark, target).select("asin", shown().alias("embedding"), "version")


def whole_batch(spark, sf_dir, runs=1, **options):
    folder = work_path(spark, "raw")
    fx.write_lines(fx.raw_reviews(spark, sf_dir), f"{folder}/reviews.jsonl")
    fx.write_lines(fx.raw_metadata(spark, sf_dir), f"{folder}/metadata.jsonl")
    if runs > 1:
        options["store_path"] = f"{folder}/store"
    for _ in range(runs):
        batch = run_batch(spark, folder, f"{folder}/catalogue.parquet", **options)
    return batch


@query
def end_to_end_batch(spark, sf_dir):
    return whole_batch(spark, sf_dir).comparison


@query
def batch_popularity(spark, sf_dir):
    """How many of each user's recommendations are among the most popular products, from the comparison of the batch."""
    return whole_batch(spark, sf_dir).compared("popularity")


@query
def batch_recommendations(spark, sf_dir):
    """From raw files to the recommendations of every user."""
    return whole_batch(spark, sf_dir).recommendations.select(*RESULT)


@query
def batch_recommendations_again(spark, sf_dir):
    """The second run of the batch, from the catalogue, the vectors, the factors and the neighbours that the first one stored."""
    return whole_batch(spark, sf_dir, runs=2).recommendations.select(*RESULT)
