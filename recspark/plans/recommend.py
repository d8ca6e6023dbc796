"""Recommendation plans: for all users or all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.numbers import fixed
from recspark.functions.rules import with_eco_score, with_search_criteria
from recspark.functions.vectors import as_doubles
from recspark.operators.cells import ivf_topk
from recspark.operators.durable import ask_durably
from recspark.operators.embed import embed_texts
from recspark.operators.history import history_summary, recent_best, rich_query_text, with_products
from recspark.operators.popularity import BROADCAST_ROWS, display_columns, popular_fallback
from recspark.operators.profiles import blend_query_vectors, profile_vectors
from recspark.operators.ranking import best_first, exclude_items, keep_items, top_per_group
from recspark.operators.compare import pooled_candidates
from recspark.operators.rerank import PROMPT_CANDIDATES, ask_model, merge_replies, missing_replies, reply_keys, rerank_prompts
from recspark.operators.search import exact_topk, excluded_first, search
from recspark.session import checkpointed, checkpointed_alone

HISTORY_ITEMS = 20
RETRIEVAL = 100
TOP = 10
PROMPT_WAVE = 500_000  # candidates whose prompts are made at a time

# Prefixes of the extra phrasings of a query.
PHRASINGS = ["", "sustainable ", "high-quality "]

# (queries, excluded ids or None, number of queries if known, whether to exclude before the cut) -> (query_id, asin, score)
Retrieval = Callable[..., DataFrame]


def retrieve_exact(
    vectors: DataFrame, k: int = RETRIEVAL, *, exclude_first: bool = False, n_items: int | None = None
) -> Retrieval:
    """Retrieval by exact search; the exclusion comes after the cut unless `exclude_first`, here or at the call."""

    def run(queries: DataFrame, excluded: DataFrame | None = None, n_queries: int | None = None, first: bool = False) -> DataFrame:
        return search(
            queries, vectors, k, excluded=excluded, exclude_first=exclude_first or first,
            n_queries=n_queries, n_items=n_items, ranked=False,
        ).drop("rank")

    return run


def retrieve_cells(
    cells: DataFrame, centroids: DataFrame, k: int = RETRIEVAL, *, n_probe: int = 8, exclude_first: bool = False
) -> Retrieval:
    """Retrieval by probing vector cells; the exclusion comes after the cut unless `exclude_first`, here or at the call."""

    def run(queries: DataFrame, excluded: DataFrame | None = None, n_queries: int | None = None, first: bool = False) -> DataFrame:
        if excluded is not None and (exclude_first or first):
            return excluded_first(lambda q, depth: ivf_topk(q, cells, centroids, depth, n_probe=n_probe), queries, excluded, k).drop("rank")
        found = ivf_topk(queries, cells, centroids, k, n_probe=n_probe).drop("rank")
        return found if excluded is None else exclude_items(found, excluded, ["query_id", "asin"])

    return run


def present(candidates: DataFrame, products: DataFrame, k: int = TOP, *, all_known: bool = False) -> DataFrame:
    """Known products among the candidates, the best k per query, with the display columns.

    The product columns are joined to the k rows that stay, not to all candidates. `all_known` says that every
    vector belongs to a product, which saves the look-up of all candidates.
    """
    known = candidates if all_known else keep_items(candidates, products, ["asin"])
    best = top_per_group(known, ["query_id"], best_first(), k)
    # Products are as many as the catalogue has, whatever size their compressed file has; they are not broadcast.
    return best.hint("merge").join(products.select("asin", *display_columns(products)), "asin").withColumn(
        "explanation", F.concat(F.lit("Similarity score: "), fixed(F.col("score"), 3))
    )


def _each(queries: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """The rows of `fallback`, ranked from 1 to k, for every query."""
    ranked = queries.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    # k rows: safe to broadcast.
    return ranked.join(F.broadcast(fallback), "rank")


def answered(recommended: DataFrame, asked: DataFrame, fallback: DataFrame, k: int = TOP) -> DataFrame:
    """`recommended`, and the first k rows of `fallback` (see `popular_fallback`) for every query of `asked` without a row.

    The recommendations are written once: they are read for their rows and for the ids that they answer.
    """
    found = checkpointed(recommended)
    silent = asked.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(_each(silent, fallback.filter(F.col("rank") <= k), k))


def history_items(reviews: DataFrame, history_k: int = HISTORY_ITEMS) -> DataFrame:
    """`(query_id, asin)`: the history items of every user.

    They are written once: the profiles and the exclusion both read these few rows, not the reviews.
    """
    columns = ["reviewerID", "asin", "rating", "unixReviewTime", "review_id"]
    history = recent_best(reviews.select(*columns), history_k)
    return checkpointed(history.select(F.col("reviewerID").alias("query_id"), "asin"))


def recommend_history(
    reviews: DataFrame,
    products: DataFrame,
    retrieval: Retrieval,
    vectors: DataFrame,
    k: int = TOP,
    *,
    history_k: int = HISTORY_ITEMS,
    how: str = "mean",
    texts: DataFrame | None = None,
    exclude_all_purchases: bool = False,
    all_known: bool = False,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """Products near the profile of every user, without the items the profile was made of.

    `texts(query_id, embedding)` blends a text query into the profiles of the users it names. Users without any known
    item get the rows of `fallback`, or none without it.
    """
    owned = history_items(reviews, history_k)
    queries = profile_vectors(owned, vectors, how, user="query_id")
    if texts is not None:
        queries = blend_query_vectors(queries, texts)
    excluded = owned
    if exclude_all_purchases:
        excluded = reviews.select(F.col("reviewerID").alias("query_id"), "asin")
    n_users = owned.select("query_id").distinct().count()
    # All purchases of a user may be more than the retrieved rows.
    found = retrieval(queries, excluded, n_users, first=True) if exclude_all_purchases else retrieval(queries, excluded, n_users)
    shown = present(found, products, k, all_known=all_known)
    if fallback is None:
        return shown
    users = reviews.select(F.col("reviewerID").alias("query_id")).filter(F.col("query_id").isNotNull())
    return answered(shown, users, fallback, k)


def recommend_reranked(
    reviews: DataFrame,
    products: DataFrame,
    retrieval: Retrieval,
    vectors: DataFrame,
    stored: DataFrame | None = None,
    generate: Callable[[list[str]], list[str]] | None = None,
    k: int = TOP,
    *,
    history_k: int = HISTORY_ITEMS,
    most: int = PROMPT_CANDIDATES,
    description_limit: int | None = None,
    sustainability_mode: bool = False,
    reply_folder: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Retrieved candidates of every user, put in the order that a model replies; and the new replies, to be stored.

    `stored(reply_key, reply)` answers where it can, `generate` (prompts to replies) the other users, and whoever has no
    usable reply keeps the order of retrieval. With `sustainability_mode` the model is told so and every result carries its
    product's rule score. With `reply_folder` each reply is written as it comes, and none of those is asked for twice, also if
    an executor is lost on the way. The new replies are `(reply_key, reply)`, null without `generate`.
    """
    columns = ["reviewerID", "asin", "rating", "unixReviewTime", "review_id"]
    recent = checkpointed(recent_best(reviews.select(*columns), history_k))
    owned = recent.select(F.col("reviewerID").alias("query_id"), "asin")
    queries = profile_vectors(owned, vectors, user="query_id")
    found = retrieval(queries, owned, owned.select("query_id").distinct().count())
    ranked = top_per_group(keep_items(found, products, ["asin"]), ["query_id"], best_first(), most)
    candidates = checkpointed(ranked.select("query_id", "asin", "score", "rank"))
    # The history is told by titles and categories; a description beside each of its rows would be many times larger.
    shown = checkpointed(with_products(recent, products.drop("description")))
    texts = rich_query_text(shown).select(F.col("reviewerID").alias("query_id"), F.col("query_text").alias("query"))
    asks = checkpointed(with_search_criteria(texts, has_history=F.lit(True), sustainability_mode=sustainability_mode))
    if stored is None:
        stored = reviews.sparkSession.createDataFrame([], "reply_key string, reply string")
    stored = stored.select("reply_key", "reply").dropDuplicates(["reply_key"])
    replies = reply_keys(candidates, asks).join(stored, "reply_key").select("query_id", "reply")
    fresh = None
    if generate is not None:
        missing = checkpointed(missing_replies(candidates, asks, stored))
        summaries = history_summary(shown).withColumnRenamed("reviewerID", "query_id")

        def replied(wanted: DataFrame) -> DataFrame:
            prompts = rerank_prompts(
                keep_items(candidates, wanted, ["query_id"]), keep_items(summaries, wanted, ["query_id"]), asks,
                sustainability_mode=sustainability_mode, most=most, description_limit=description_limit, products=products,
            )
            return ask_model(prompts, generate) if reply_folder is None else ask_durably(prompts, generate, reply_folder)

        # A wave of users at a time: only their replies stay, not the texts that their prompts are made of.
        n_waves, wave = max(1, -(-candidates.count() // PROMPT_WAVE)), F.xxhash64("query_id", F.lit("wave"))
        waves = [missing.filter(F.pmod(wave, F.lit(n_waves)) == i) for i in range(n_waves)]
        asked = reduce(DataFrame.unionByName, [checkpointed_alone(reviews.sparkSession, lambda w=w: replied(w)) for w in waves])
        fresh = missing.join(asked, "query_id").select("reply_key", "reply")
        replies = replies.unionByName(asked)
    final = merge_replies(candidates, checkpointed(replies), products, k)
    return (with_sustainability(final, products) if sustainability_mode else final), fresh


def recommend_item_lists(
    lists: DataFrame,
    products: DataFrame,
    retrieval: Retrieval,
    vectors: DataFrame,
    k: int = TOP,
    *,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """As `recommend_history`, for histories given as `lists(query_id, asins)`; a repeated id counts each time.

    Lists with the same items have the same answer, which is looked for once. Rows of ids compress well, so the size of
    their file says little: beyond `BROADCAST_ROWS` rows they are never broadcast.
    """
    pooled = lists.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("asins"))).alias("asins"))
    # Without an id nothing is excluded.
    none = F.col("query_id").isNull()
    asked = checkpointed(pooled.select("query_id", F.sha2(F.to_json(F.struct(none, "asins")), 256).alias("key"), none.alias("none"), "asins"))
    kinds = asked.groupBy("key").agg(F.first("asins").alias("asins"), F.first("none").alias("none"))
    named = checkpointed(kinds.select(F.col("key").alias("query_id"), "none", F.explode("asins").alias("asin")))
    n_named = named.count()
    known = named.hint("merge") if n_named > BROADCAST_ROWS else named
    queries = profile_vectors(known.select("query_id", "asin"), vectors, user="query_id")
    excluded = known.filter(~F.col("none")).select("query_id", "asin")
    n_kinds = named.select("query_id").distinct().count()
    shown = present(retrieval(queries, excluded, n_kinds), products, k).withColumnRenamed("query_id", "key")
    shown = asked.select("key", "query_id").hint("merge").join(shown, "key").select("query_id", *[c for c in shown.columns if c != "key"])
    return shown if fallback is None else answered(shown, lists, fallback, k)


def recommend_requests(
    requests: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    retrieval: Retrieval,
    vectors: DataFrame,
    fallback: DataFrame,
    k: int = TOP,
    *,
    history_k: int = HISTORY_ITEMS,
    **embedding,
) -> DataFrame:
    """One answer for each of `requests(query_id, reviewerID, asins, text)`, whatever it names; ids are distinct.

    A request that names a user takes that user's history, else the history is its own list. History and text are blended
    where both are there, else the one there is asks alone; with neither, or with unknown items and no text, the answer is
    `fallback`. Null and empty fields count as not given.
    """
    asked = checkpointed(requests.select("query_id", "reviewerID", "asins", "text"))
    named = F.length("reviewerID") > 0
    users = asked.filter(named).select("query_id", "reviewerID")
    recent = recent_best(
        keep_items(reviews.select("reviewerID", "asin", "rating", "unixReviewTime", "review_id"), users, ["reviewerID"]),
        history_k,
    )
    of_users = users.join(recent.select("reviewerID", "asin"), "reviewerID").select("query_id", "asin")
    of_lists = asked.filter(~F.coalesce(named, F.lit(False))).select("query_id", F.explode("asins").alias("asin"))
    owned = checkpointed(of_users.unionByName(of_lists))
    profiles = checkpointed(profile_vectors(owned, vectors, user="query_id"))
    spoken = asked.filter(F.length("text") > 0).select("query_id", "text")
    texts = checkpointed(embed_texts(spoken, "text", **embedding).drop("text"))
    alone = texts.join(profiles, "query_id", "left_anti").withColumn("embedding", as_doubles(F.col("embedding")))
    queries = blend_query_vectors(profiles, texts).unionByName(alone)
    return answered(present(retrieval(queries, owned, asked.count()), products, k), asked, fallback, k)


def zero_shot(
    queries: DataFrame, products: DataFrame, retrieval: Retrieval, k: int = TOP, *, all_known: bool = False, **embedding
) -> DataFrame:
    """Products near the text of `queries(query_id, text)`, without any history."""
    embedded = embed_texts(queries.select("query_id", "text"), "text", **embedding).drop("text")
    return present(retrieval(embedded, None, queries.count()), products, k, all_known=all_known)


def multi_query(queries: DataFrame, vectors: DataFrame, k: int = RETRIEVAL, per_phrasing: int = 50, **embedding) -> DataFrame:
    """Every query in several phrasings; their candidates are pooled with the best score per item."""
    phrased = queries.select(
        "query_id",
        F.posexplode(F.array(*[F.lit(p) for p in PHRASINGS])).alias("phrasing", "prefix"),
        "text",
    ).select("query_id", "phrasing", F.concat("prefix", "text").alias("text"))
    embedded = embed_texts(phrased, "text", **embedding).drop("text")
    keyed = embedded.withColumn("query_id", F.struct("query_id", "phrasing"))
    found = exact_topk(keyed, vectors, per_phrasing, n_queries=len(PHRASINGS) * queries.count()).withColumn(
        "query_id", F.col("query_id.query_id")
    )
    return pooled_candidates(found, k)


def cold_start(users: DataFrame, reviews: DataFrame, products: DataFrame, k: int = TOP) -> DataFrame:
    """The most reviewed products for every user without a review: one row per user and rank."""
    newcomers = users.select(F.col("reviewerID").alias("query_id")).distinct().join(
        reviews.select(F.col("reviewerID").alias("query_id")).distinct(), "query_id", "left_anti"
    )
    return _each(newcomers, popular_fallback(products, k), k)


def with_sustainability(recommended: DataFrame, products: DataFrame, *, resort: bool = False) -> DataFrame:
    """Annotate every result with its product's rule score; with `resort` the score decides the rank.

    Each recommended product is scored once, however many users it is recommended to.
    """
    wanted = keep_items(products, recommended, ["asin"])
    scores = with_eco_score(wanted).select("asin", "sustainability_score", "short_reason")
    scored = recommended.join(scores, "asin")
    if not resort:
        return scored
    order = Window.partitionBy("query_id").orderBy(F.col("sustainability_score").desc(), *best_first())
    return scored.withColumn("rank", F.row_number().over(order))
