"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Named building blocks; each may use the ones before it.
BLOCKS: dict[str, str] = {
    "reviews": """
        SELECT CAST(o_custkey AS VARCHAR) AS reviewerID, CAST(l_partkey AS VARCHAR) AS asin,
          CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) AS rating,
          concat('review of part ', l_partkey, ' line ', l_linenumber) AS reviewText,
          l_returnflag AS summary, CAST(epoch(o_orderdate) AS BIGINT) AS unixReviewTime,
          concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS INT), '-',
            CAST(l_shipdate AS DATE)) AS review_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "meta": """
        SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand AS brand, p_type AS category,
          p_retailprice AS price,
          concat(d.text, ' ', CASE p_partkey % 12
            WHEN 0 THEN 'organic cotton, GOTS' WHEN 1 THEN 'recycled bottle' WHEN 2 THEN 'cork sole, vegan'
            WHEN 3 THEN 'green label' WHEN 4 THEN 'B-Corp, fair trade' WHEN 5 THEN 'repairable, 2 year warranty'
            WHEN 6 THEN 'made in France' WHEN 7 THEN 'eco-friendly certified' WHEN 8 THEN 'long-lasting, robust'
            WHEN 9 THEN 'upcycled, biodegradable' ELSE 'plain' END) AS description,
          CASE WHEN p_size % 3 = 0 THEN concat('https://img.example/', p_partkey, '.jpg') END AS image_url
        FROM part JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents)""",
    "vectors": "SELECT CAST(vec_id AS VARCHAR) AS asin, embedding, label FROM embeddings",
    "feed": """
        SELECT CAST(event_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS reviewerID, props->>'$.k' AS asin,
          CAST(1 + event_id % 5 AS DOUBLE) AS rating, CAST(floor(epoch(ts)) AS BIGINT) AS unixReviewTime
        FROM events""",
    "customers": "SELECT CAST(c_custkey AS VARCHAR) AS reviewerID FROM customer",
    "text_queries": "SELECT concat(conv_id, '-', turn) AS query_id, text FROM conversations",
    "user_texts": """
        SELECT CAST(conv_id AS VARCHAR) AS query_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1""",
    # catalogue
    "digest": """
        SELECT asin, string_agg(reviewText, ' | ' ORDER BY rn) AS all_reviews FROM (
          SELECT *, row_number() OVER (PARTITION BY asin ORDER BY unixReviewTime, review_id) AS rn FROM reviews
        ) WHERE rn <= 10 GROUP BY asin""",
    "products": """
        SELECT s.asin, round(s.m, 6) + 0.0 AS avg_rating, s.n AS num_reviews, all_reviews, title, brand, category, price,
          description, image_url,
          concat('Title: ', title, ' | Brand: ', brand, ' | Category: ', category, ' | Description: ',
            description,
            ' | Reviews: ', all_reviews) AS text_for_embedding
        FROM (SELECT asin, avg(rating) AS m, count(rating) AS n FROM reviews GROUP BY asin
              HAVING count(rating) >= 2 AND avg(rating) >= 3.0) s
        JOIN digest USING (asin) JOIN meta USING (asin)""",
    "popular": """
        SELECT *, row_number() OVER (ORDER BY score DESC, asin) AS rank FROM (
          SELECT *, round(avg_rating * ln(1 + num_reviews), 6) AS score FROM products)
        QUALIFY rank <= 1000""",
    "most_reviewed": """
        SELECT *, row_number() OVER (ORDER BY num_reviews DESC, asin) AS rank FROM products QUALIFY rank <= 10""",
}


def history_of(source: str, k: int) -> str:
    return f"""
        SELECT * EXCLUDE (recency), row_number() OVER (PARTITION BY reviewerID ORDER BY rating DESC NULLS LAST, recency)
            AS history_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY reviewerID ORDER BY unixReviewTime DESC, review_id) AS recency
              FROM {source} QUALIFY recency <= {2 * k})
        QUALIFY history_rank <= {k}"""


def embedded(source: str, key: str, text: str) -> str:
    """Unit vectors of hashed token counts, as float lists of length 64."""
    return rf"""
        SELECT {key}, list(CAST(CASE WHEN length2 > 0 THEN n / sqrt(length2) ELSE 0 END AS FLOAT) ORDER BY d) AS embedding
        FROM (
          SELECT g.{key}, g.d, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0) * coalesce(c.n, 0)) OVER (PARTITION BY g.{key}) AS length2
          FROM (SELECT {key}, unnest(range(64)) AS d FROM {source}) g
          LEFT JOIN (
            SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS d, CAST(count(*) AS DOUBLE) AS n
            FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS tok FROM {source})
            WHERE tok <> '' GROUP BY 1, 2) c ON c.{key} = g.{key} AND c.d = g.d)
        GROUP BY {key}"""


def aggregated(source: str, how: str, key: str = "query_id", items: str = "vectors") -> str:
    """Element-wise mean or max of the vectors of `source`'s items."""
    return f"""
        SELECT {key}, list(x ORDER BY i) AS embedding FROM (
          SELECT {key}, i, {how}(x) AS x FROM (
            SELECT {key}, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
            FROM {source} JOIN {items} USING (asin))
          GROUP BY 1, 2)
        GROUP BY {key}"""


def nearest(queries: str, items: str, k: int) -> str:
    return f"""
        SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
        FROM (SELECT q.query_id, v.asin,
                round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 AS score
              FROM {queries} q, {items} v)
        QUALIFY rank <= {k}"""


def without(ranked: str, excluded: str) -> str:
    return f"""
        SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
        FROM {ranked} r WHERE NOT EXISTS (SELECT 1 FROM {excluded} e WHERE e.query_id = r.query_id AND e.asin = r.asin)"""


def presented(candidates: str, products: str, k: int = 10) -> str:
    return f"""
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank, asin, title,
          score, concat('Similarity score: ', printf('%.3f', score)) AS explanation, category, price, image_url,
          description, brand
        FROM (SELECT * EXCLUDE (rank) FROM {candidates}) JOIN {products} USING (asin) QUALIFY rank <= {k}"""


def blended_with(profiles: str, texts: str) -> str:
    """Profiles mixed with the text of the same query and scaled; a profile without a text stays as it is."""
    return f"""
        SELECT query_id, list_transform(mixed, lambda x: x / (sqrt(list_inner_product(mixed, mixed)) + 1e-8)) AS embedding
        FROM (SELECT query_id, list_transform(list_zip(p.embedding, CAST(t.embedding AS DOUBLE[])),
                lambda z: z[1] * 0.7 + z[2] * 0.3) AS mixed
              FROM {profiles} p JOIN {texts} t USING (query_id))
        UNION ALL
        SELECT query_id, embedding FROM {profiles} WHERE query_id NOT IN (SELECT query_id FROM {texts})"""


BLOCKS |= {
    "shop_history10": history_of("reviews", 10),
    "shop_history20": history_of("reviews", 20),
    "feed_history": history_of("feed", 20),
    "owned": "SELECT reviewerID AS query_id, asin FROM feed_history",
    "mean_profiles": aggregated("owned", "avg"),
    "max_profiles": aggregated("owned", "max"),
    "product_vectors": embedded("products", "asin", "text_for_embedding"),
    "text_vectors": embedded("text_queries", "query_id", "text"),
    "user_text_vectors": embedded("user_texts", "query_id", "text"),
    "blended": blended_with("mean_profiles", "user_text_vectors"),
    "mean_found": nearest("mean_profiles", "vectors", 100),
    "max_found": nearest("max_profiles", "vectors", 100),
    "candidates": without("mean_found", "owned"),
    "recommended": presented("candidates", "meta"),
}


def sql(final: str, **extra: str) -> str:
    """`final` with all building blocks it needs, in order."""
    blocks = BLOCKS | extra
    needed: set[str] = set()

    def add(text: str) -> None:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
        for name, body in blocks.items():
            if name in words and name not in needed:
                needed.add(name)
                add(body)

    add(final)
    parts = ",\n".join(f"{name} AS ({body})" for name, body in blocks.items() if name in needed)
    return f"WITH {parts}\n{final}" if parts else final


SHOWN = "array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS embedding"
CATALOGUE = (
    "asin, avg_rating, num_reviews, all_reviews, title, brand, category, price, description, image_url, text_for_embedding"
)
RESULT = "query_id, rank, asin, title, score, explanation, category, price, image_url"

# Sources and catalogue

ORACLES["ingest_reviews"] = sql("""
    SELECT reviewerID, asin, CASE CAST(asin AS BIGINT) % 7 WHEN 1 THEN 0.0 WHEN 3 THEN NULL ELSE rating END AS rating,
      reviewText, summary, unixReviewTime, review_id FROM reviews""")
PARSED_METADATA = """
    SELECT asin, title,
      CASE n % 4 WHEN 0 THEN description WHEN 1 THEN concat(title, ' ', description) WHEN 2 THEN '' END AS description,
      CASE n % 3 WHEN 0 THEN price WHEN 2 THEN 0.0 END AS price,
      CASE n % 5 WHEN 0 THEN concat(category, ' > A > B') WHEN 1 THEN concat(category, ' > x') ELSE 'Electronics' END AS category,
      brand, CASE n % 4 WHEN 0 THEN concat('high-', asin) WHEN 2 THEN concat('low-', asin) END AS image_url,
      CASE n % 3 WHEN 0 THEN concat(asin, '|0') ELSE '' END AS also_bought, CAST(0 AS INT) AS n_also_viewed
    FROM (SELECT *, CAST(asin AS BIGINT) AS n FROM meta)"""
ORACLES["ingest_metadata"] = sql(PARSED_METADATA)
ORACLES["minimal_metadata"] = sql("""
    SELECT asin, avg_rating, num_reviews, description, concat('Product ', asin) AS title, CAST(0 AS DOUBLE) AS price,
      'Electronics' AS category
    FROM (SELECT asin, round(avg(rating), 6) AS avg_rating, count(rating) AS num_reviews FROM reviews GROUP BY asin)
    JOIN (SELECT asin, string_agg(reviewText, ' ' ORDER BY rn) AS description FROM (
            SELECT *, row_number() OVER (PARTITION BY asin ORDER BY unixReviewTime, review_id) AS rn FROM reviews)
          WHERE rn <= 5 GROUP BY asin) USING (asin)""")
ORACLES["product_stats"] = sql(
    "SELECT asin, round(avg(rating), 6) AS avg_rating, count(rating) AS num_reviews FROM reviews GROUP BY asin")
ORACLES["review_digest"] = sql("SELECT asin, all_reviews FROM digest")
ORACLES["product_catalogue"] = sql(f"SELECT {CATALOGUE} FROM products")
ORACLES["catalogue_roundtrip"] = ORACLES["product_catalogue"]
ORACLES["catalogue_csv"] = ORACLES["product_catalogue"]
ORACLES["all_users"] = sql("SELECT DISTINCT reviewerID FROM reviews")

# Histories

ORACLES["user_history"] = sql("""
    SELECT reviewerID, h.asin, rating, unixReviewTime, CAST(history_rank AS INT) AS history_rank, title, category, price, image_url
    FROM shop_history10 h LEFT JOIN products p ON p.asin = h.asin""")


def lines(history: str, bullet: str, missing: str) -> str:
    return f"""
        SELECT reviewerID, count(*) AS n, string_agg(CASE WHEN history_rank <= 10 THEN concat('{bullet}', coalesce(title, '{missing}'),
            ' (Rating: ', rating, '/5)') END, chr(10) ORDER BY history_rank) AS listed
        FROM {history} h LEFT JOIN products p ON p.asin = h.asin GROUP BY reviewerID"""


ORACLES["history_summary"] = sql(
    """SELECT reviewerID, CASE WHEN n IS NULL THEN 'No purchase history available.'
         ELSE concat('User has purchased ', n, ' products:', chr(10), listed, chr(10)) END AS summary
       FROM customers LEFT JOIN listing USING (reviewerID)""",
    listing=lines("shop_history20", "- ", "Unknown"))
ORACLES["history_display"] = sql(
    """SELECT reviewerID, coalesce(listed, 'No purchase history') AS display
       FROM customers LEFT JOIN listing USING (reviewerID)""",
    listing=lines("shop_history10", "• ", "Unknown Product"))


def firsts(history: str, products: str, column: str) -> str:
    return f"""
        SELECT reviewerID, string_agg(v, ', ' ORDER BY seen, v) AS listed FROM (
          SELECT reviewerID, {column} AS v, min(history_rank) AS seen FROM {history} h JOIN {products} p ON p.asin = h.asin
          WHERE {column} IS NOT NULL GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY reviewerID ORDER BY min(history_rank), {column}) <= 3)
        GROUP BY reviewerID"""


ORACLES["rich_query_text"] = sql(
    """SELECT reviewerID, CASE WHEN words = '' THEN 'recommend popular products' ELSE concat(words, '.') END AS query_text
       FROM (SELECT p.reviewerID, concat_ws('. ', 'Products similar to: ' || t.listed, 'in categories: ' || c.listed,
               CASE WHEN h.reviewerID IS NOT NULL THEN 'products that I would like based on my purchase history' END,
               nullif(u.text, '')) AS words
             FROM people p LEFT JOIN titles t USING (reviewerID) LEFT JOIN categories c USING (reviewerID)
             LEFT JOIN (SELECT DISTINCT reviewerID FROM shop_history20) h USING (reviewerID)
             LEFT JOIN user_texts u ON u.query_id = p.reviewerID)""",
    titles=firsts("shop_history20", "products", "title"),
    categories=firsts("shop_history20", "products", "category"),
    people="SELECT reviewerID FROM customers UNION SELECT query_id FROM user_texts")

# Popularity

ORACLES["popularity_topk"] = sql("SELECT CAST(rank AS INT) AS rank, asin, score, title FROM popular")
ORACLES["popularity_excluding"] = sql("""
    SELECT CAST(row_number() OVER (ORDER BY score DESC, asin) AS INT) AS rank, asin, score,
      concat('Popular product: ', num_reviews, ' reviews, ', printf('%.1f', avg_rating), '★') AS explanation,
      title, category, price, image_url
    FROM popular WHERE asin NOT IN (SELECT asin FROM feed)
    QUALIFY row_number() OVER (ORDER BY score DESC, asin) <= 10""")
ORACLES["popularity_per_user"] = sql(
    """SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
       FROM (SELECT DISTINCT reviewerID AS query_id FROM feed) u, (SELECT asin, score FROM popular) p
       WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.reviewerID = u.query_id AND r.asin = p.asin)
       QUALIFY rank <= 10""",
    recent=history_of("feed", 5))
ORACLES["popular_fallback"] = sql("""
    SELECT CAST(rank AS INT) AS rank, asin, avg_rating AS score,
      concat('Popular product with ', num_reviews, ' reviews') AS explanation, title, category, price, image_url
    FROM most_reviewed""")

# Vectors

ORACLES["embed_products"] = sql(f"SELECT asin, {SHOWN} FROM product_vectors")
ORACLES["embedding_cache"] = sql(
    f"""SELECT d.doc_id, md5(d.text) AS text_key,
          md5(d.text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') AS computed, {SHOWN}
        FROM documents d JOIN doc_vectors USING (doc_id)""",
    doc_vectors=embedded("documents", "doc_id", "text"))
ORACLES["user_profile_mean"] = sql(f"SELECT query_id AS reviewerID, {SHOWN} FROM mean_profiles")
ORACLES["user_profile_updated"] = sql(
    f"SELECT reviewerID, {SHOWN} FROM whole", whole=aggregated("feed", "avg", "reviewerID", "(SELECT asin, embedding FROM vectors)"))
ORACLES["user_profile_max"] = sql(f"SELECT query_id AS reviewerID, {SHOWN} FROM max_profiles")
ORACLES["user_profile_weighted"] = sql(
    f"SELECT reviewerID, {SHOWN} FROM weighted",
    weighted="""
        SELECT reviewerID, list(x ORDER BY i) AS embedding FROM (
          SELECT reviewerID, i, sum(x * rating) / sum(rating) AS x FROM (
            SELECT reviewerID, rating, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
            FROM feed_history JOIN vectors USING (asin))
          GROUP BY 1, 2)
        GROUP BY reviewerID""")
ORACLES["blend_query_vector"] = sql(f"SELECT query_id, {SHOWN} FROM blended")

SELF = "SELECT asin AS query_id, embedding FROM vectors"
ORACLES["exact_topk"] = sql("SELECT * FROM found", asked=SELF, found=nearest("asked", "vectors", 100))
ORACLES["ivf_topk"] = ORACLES["exact_topk"]
ORACLES["sharded_topk"] = ORACLES["exact_topk"]
ORACLES["ivf_topk_probed"] = sql(
    "SELECT * FROM found",
    labelled="SELECT asin, label FROM vectors WHERE label IS NOT NULL",
    centroids=aggregated("labelled", "avg", "label", "(SELECT asin, embedding FROM vectors)"),
    near="""
        SELECT asin, cell, row_number() OVER (PARTITION BY asin ORDER BY score DESC, cell) AS place
        FROM (SELECT v.asin, c.label AS cell, list_inner_product(CAST(v.embedding AS DOUBLE[]), c.embedding) AS score
              FROM vectors v, centroids c)
        QUALIFY place <= 2""",
    found="""
        SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
        FROM (SELECT q.asin AS query_id, v.asin,
                round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 AS score
              FROM near p JOIN vectors q ON q.asin = p.asin JOIN near n ON n.cell = p.cell AND n.place = 1
              JOIN vectors v ON v.asin = n.asin)
        QUALIFY rank <= 100""")
ORACLES["skipping_topk"] = ORACLES["exact_topk"]
ORACLES["tree_topk_probed"] = sql(
    "SELECT * FROM found",
    labelled="SELECT asin, CAST(label AS INT) AS branch, CAST(label * 3 + CAST(asin AS BIGINT) % 3 AS INT) AS cell FROM vectors WHERE label IS NOT NULL",
    branches=aggregated("labelled", "avg", "branch", "(SELECT asin, embedding FROM vectors)"),
    leaves=aggregated("labelled", "avg", "cell", "(SELECT asin, embedding FROM vectors)"),
    near="""
        SELECT asin, branch, row_number() OVER (PARTITION BY asin ORDER BY score DESC, branch) AS place
        FROM (SELECT v.asin, b.branch, list_inner_product(CAST(v.embedding AS DOUBLE[]), b.embedding) AS score FROM vectors v, branches b)
        QUALIFY place <= 2""",
    scored="""
        SELECT n.asin, n.place, l.cell, list_inner_product(CAST(v.embedding AS DOUBLE[]), l.embedding) AS score
        FROM near n JOIN vectors v USING (asin) JOIN leaves l ON l.cell // 3 = n.branch""",
    own="SELECT asin, cell FROM scored WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY asin ORDER BY score DESC, cell) = 1",
    probed="SELECT asin, cell FROM scored QUALIFY row_number() OVER (PARTITION BY asin ORDER BY score DESC, cell) <= 2",
    found="""
        SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
        FROM (SELECT q.asin AS query_id, v.asin,
                round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 AS score
              FROM probed p JOIN vectors q ON q.asin = p.asin JOIN own o ON o.cell = p.cell JOIN vectors v ON v.asin = o.asin)
        QUALIFY rank <= 100""")
ORACLES["two_stage_topk"] = sql(
    "SELECT * FROM exact",
    asked=SELF,
    small="SELECT asin, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 127)) AS embedding FROM vectors",
    coarse=nearest("asked", "small", 200),
    exact="""
        SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
        FROM (SELECT c.query_id, c.asin,
                round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 AS score
              FROM coarse c JOIN asked q USING (query_id) JOIN vectors v ON v.asin = c.asin)
        QUALIFY rank <= 50""")
ORACLES["dual_index_topk"] = sql(
    "SELECT * FROM found",
    asked=SELF,
    pooled="""
        SELECT asin, embedding FROM vectors WHERE label <> 3
        UNION ALL SELECT asin, list_reverse(embedding) FROM vectors WHERE label = 3
        UNION ALL SELECT 'n' || asin, list_reverse(embedding) FROM vectors WHERE label = 4""",
    found=nearest("asked", "pooled", 100))
ORACLES["zero_shot_topk"] = sql(
    f"SELECT {RESULT} FROM shown",
    found=nearest("text_vectors", "product_vectors", 100), shown=presented("found", "products"))
ORACLES["multi_query_topk"] = sql(
    """SELECT query_id, asin, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS INT) AS rank
       FROM (SELECT split_part(query_id, '/', 1) AS query_id, asin, max(score) AS score FROM found GROUP BY 1, 2)
       QUALIFY rank <= 100""",
    phrased="""
        SELECT concat(query_id, '/', i) AS query_id, concat(prefix, text) AS text FROM text_queries,
          (VALUES (0, ''), (1, 'sustainable '), (2, 'high-quality ')) p(i, prefix)""",
    phrased_vectors=embedded("phrased", "query_id", "text"),
    found=nearest("phrased_vectors", "product_vectors", 50))
ORACLES["rank_fusion"] = sql("""
    SELECT query_id, asin, round(sum(1.0::DOUBLE / (rank - 1 + 60)), 6) AS score
    FROM (SELECT * FROM mean_found UNION ALL SELECT * FROM max_found) GROUP BY 1, 2""")

# Text rules

WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLES["clean_text"] = (
    f"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '{WHITESPACE}', ' ', 'g'), '<[^>]+>', '', 'g')) AS cleaned"
    " FROM pages")
KEYWORD_LIST = (
    "['organic', 'recycled', 'sustainable', 'eco-friendly', 'vegan', 'biodegradable', 'compostable', 'carbon neutral',"
    " 'fair trade', 'green', 'environmentally friendly', 'renewable', 'ethical']")
ORACLES["eco_keywords"] = sql(f"""
    SELECT asin, array_to_string(list_filter({KEYWORD_LIST}, lambda k: contains(lower(concat(title, ' ', description)), k)), ',')
      AS keywords FROM meta""")

HIT = "regexp_matches(words, '{}')"
RULES = [
    (2.0, "gots|oeko-tex|bluesign|cradle to cradle", "certification matériaux"),
    (1.5, "recycled|recyclé|upcycled|récupéré", "matériaux recyclés"),
    (1.0, "bio|organic|biologique|biosourcé|cork|liège", "matériaux biosourcés"),
    (1.5, "b-corp|b corp|1% for the planet|fair trade|commerce équitable", "marque certifiée éthique"),
    (0.5, "réparable|repairable|réparation|garantie|warranty", "réparable"),
    (0.5, "made in france|fabriqué en france|made in europe|fabriqué en europe|local", "production locale"),
    (0.5, "vegan|végan|cruelty-free|sans cruauté", "végan"),
    (0.5, "durable|durability|long-lasting|résistant|robust", "durable"),
]


def eco(source: str) -> str:
    points = " + ".join(f"CASE WHEN {HIT.format(p)} THEN {v} ELSE 0 END" for v, p, _ in RULES)
    reasons = ", ".join(f"CASE WHEN {HIT.format(p)} THEN '{r}' END" for _, p, r in RULES)
    return f"""
        SELECT * EXCLUDE (words, fired), coalesce(nullif(array_to_string(fired[1:3], ', '), ''), 'Évaluation standard') AS short_reason
        FROM (SELECT *, CAST(greatest(0, least(10, 5 + {points}
                - CASE WHEN {HIT.format('green|eco|éco')} AND NOT {HIT.format('certified|certifié|recycled|recyclé')} THEN 0.5 ELSE 0 END
              )) AS DOUBLE) AS sustainability_score,
              list_filter([{reasons}], lambda r: r IS NOT NULL) AS fired
            FROM (SELECT *, lower(concat(title, ' ', description, ' ', category, ' ', brand)) AS words FROM {source}))"""


ORACLES["eco_score"] = sql("SELECT asin, sustainability_score, short_reason FROM scored", scored=eco("meta"))
ORACLES["eco_score_replies"] = sql(
    """SELECT asin,
         CASE n WHEN 0 THEN 8.7::DOUBLE WHEN 1 THEN 10.0 WHEN 3 THEN 7.5 ELSE sustainability_score END AS sustainability_score,
         CASE n WHEN 0 THEN 'cuir de pomme' WHEN 1 THEN 'trop' WHEN 3 THEN '' ELSE short_reason END AS short_reason
       FROM (SELECT *, CAST(asin AS BIGINT) % 6 AS n FROM scored)""",
    scored=eco("meta"))

ORACLES["eco_prompt"] = sql(f"""
    SELECT asin, concat('Tu es un expert en durabilité et éco-responsabilité produit.

Évalue ce produit de 0 à 10 en termes de durabilité réelle (et pas juste greenwashing).

Critères pris en compte :

- Matériaux recyclés, biosourcés, certifiés (GOTS, OEKO-TEX, etc.)

- Empreinte carbone de fabrication et transport

- Durabilité et réparabilité

- Certifications officielles

- Politique de la marque (B-Corp, 1% for the Planet, etc.)

- Avis clients mentionnant la longévité ou l''éthique

Réponds EXACTEMENT avec ce format (rien d''autre) :

{{"sustainability_score": 8.7, "short_reason": "Cuir de pomme recyclé, marque B-Corp, fabriqué en Italie, réparable à vie"}}

Produit :

Titre : ', title, '

Description : ', description, '

Marque : ', brand, '

Caractéristiques : ', category, '

Mots-clés détectés : ', coalesce(nullif(array_to_string(list_filter({KEYWORD_LIST},
        lambda k: contains(lower(concat(title, ' ', description)), k)), ', '), ''), 'Aucun'), '
') AS prompt FROM meta""")
ORACLES["criteria_prompt"] = sql("""
    SELECT query_id, concat('Tu es un expert en shopping personnalisé ultra-précis.

À partir de cette requête utilisateur (ou historique d''achats), génère 8 à 12 critères de recherche très précis et variés que l''utilisateur recherche implicitement.

Réponds EXACTEMENT sous ce format JSON (rien d''autre, pas de ```json) :

{
  "expanded_criteria": [
    "critère 1",
    "critère 2",
    ...
  ]
}

Requête utilisateur : "', coalesce(nullif(text, ''), 'Aucune requête spécifique'), '"

Historique récent (si disponible) : ', coalesce(titles, 'Aucun historique disponible'), '
') AS prompt
    FROM user_texts FULL JOIN (
      SELECT reviewerID AS query_id, string_agg('- ' || title, chr(10) ORDER BY history_rank) AS titles
      FROM feed_history JOIN meta USING (asin) WHERE history_rank <= 5 GROUP BY 1) USING (query_id)""")

COLOURS = ["noir", "blanc", "rouge", "bleu", "vert", "marron", "beige", "gris"]
CRITERIA = [
    ("sous|moins de|inférieur|budget|prix", "prix raisonnable ou dans le budget"),
    ("végan|vegan", "cuir végan ou matériaux alternatifs"),
    ("recyclé|recycled", "matériaux recyclés"),
    ("cuir", "cuir authentique ou alternative végan"),
    ("durable|sustainable|éco|eco|bio|organic", "produit durable et éco-responsable"),
    ("durable|sustainable|éco|eco|bio|organic", "marque certifiée B-Corp ou Fair Trade"),
    ("colour", ""),
    ("léger|light", "poids réduit"),
    ("compact", "format compact"),
    ("qualité|premium|haut de gamme", "note moyenne ≥ 4.5 étoiles"),
    ("qualité|premium|haut de gamme", "qualité premium"),
    ("livraison", "livraison gratuite ou rapide"),
    ("france|europe|local|made in", "fabriqué en Europe ou localement"),
    ("garantie", "garantie minimum 2 ans"),
    ("sac", "sac bandoulière ou sac à dos"),
    ("résistant|waterproof", "résistant à l''eau"),
]
MODE = [
    "produit durable et éco-responsable", "marque certifiée B-Corp ou Fair Trade", "matériaux recyclés ou biologiques",
    "emballage minimal ou recyclable",
]
HISTORY = ["style cohérent avec les achats précédents", "qualité similaire aux produits précédemment achetés"]
DEFAULTS = ["note moyenne ≥ 4.0 étoiles", "avis clients positifs", "produit disponible en stock", "retour gratuit possible"]


def criteria_list(mode: str, known: str) -> str:
    """All criteria that apply to `words`, in order, repeats removed, 8 to 12 of them."""
    colour = "CASE " + " ".join(f"WHEN contains(words, '{c}') THEN 'couleur {c} ou similaire'" for c in COLOURS) + " END"
    found = [colour if p == "colour" else f"CASE WHEN {HIT.format(p)} THEN '{out}' END" for p, out in CRITERIA]
    found += [f"CASE WHEN {mode} THEN '{c}' END" for c in MODE]
    found += [f"CASE WHEN {known} THEN '{c}' END" for c in HISTORY]
    defaults = ", ".join(f"'{c}'" for c in DEFAULTS)
    listed = f"list_filter([{', '.join(found)}, {defaults}], lambda c: c IS NOT NULL)"
    once = f"list_filter({listed}, lambda c, i: list_position({listed}, c) = i)"
    return f"(CASE WHEN len({once}) >= 8 THEN {once} ELSE list_concat({once}, [{defaults}]) END)[1:12]"


ASKS = """
    SELECT CAST(doc_id AS VARCHAR) AS query_id, doc_id, lower(text) AS words,
      CAST(doc_id AS VARCHAR) IN (SELECT reviewerID FROM feed) AS known FROM documents"""
ORACLES["search_criteria"] = sql(
    f"""SELECT query_id, mode, array_to_string({criteria_list('mode', 'known')}, '|') AS criteria
        FROM asks, (VALUES (false), (true)) m(mode)""",
    asks=ASKS)
ORACLES["search_criteria_replies"] = sql(
    f"""SELECT query_id, array_to_string(CASE WHEN doc_id % 4 IN (1, 3) AND doc_id % 15 + 1 >= 8
          THEN list_transform(range(1, least(12, doc_id % 15 + 1) + 1), lambda i: 'critère ' || i)
          ELSE {criteria_list('false', 'known')} END, '|') AS criteria FROM asks""",
    asks=ASKS)

# Recommendations

ORACLES["recommend_history"] = sql(f"SELECT {RESULT} FROM recommended")
ORACLES["recommend_unseen"] = sql(
    f"SELECT {RESULT} FROM shown",
    bought="SELECT DISTINCT reviewerID AS query_id, asin FROM feed",
    unseen=without("(" + nearest("mean_profiles", "vectors", 1_000_000) + ")", "bought"),
    shown=presented("unseen", "meta"))
ORACLES["recommend_blend"] = sql(
    f"SELECT {RESULT} FROM shown",
    found=nearest("blended", "vectors", 100), left_over=without("found", "owned"), shown=presented("left_over", "meta"))
ORACLES["recommend_eco"] = sql(
    "SELECT query_id, rank, asin, score, sustainability_score, short_reason FROM scored", scored=eco("recommended"))
ORACLES["recommend_eco_resorted"] = sql(
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sustainability_score DESC, score DESC, asin) AS INT)
         AS rank, asin, score, sustainability_score, short_reason FROM scored""",
    scored=eco("recommended"))
LISTED = """
    SELECT CAST(c_custkey AS VARCHAR) AS query_id, CAST((c_custkey * 13 + i * 7) % 2500 AS VARCHAR) AS asin
    FROM customer, (VALUES (0), (1), (2), (3), (4), (0)) n(i)"""
# Every customer without a row among those shown gets the most reviewed products.
ANSWERED = f"""
    SELECT {RESULT} FROM shown
    UNION ALL
    SELECT c.reviewerID, CAST(rank AS INT), asin, title, avg_rating, concat('Popular product with ', num_reviews, ' reviews'),
      category, price, image_url
    FROM customers c, most_reviewed WHERE c.reviewerID NOT IN (SELECT query_id FROM shown)"""
ORACLES["history_by_item_list"] = sql(
    ANSWERED,
    named=LISTED,
    profiles=aggregated("named", "avg"),
    found=nearest("profiles", "vectors", 100), left_over=without("found", "named"), shown=presented("left_over", "meta"))
ORACLES["recommend_requests"] = sql(
    ANSWERED,
    listing=LISTED,
    requests="""
        SELECT reviewerID AS query_id, CAST(reviewerID AS BIGINT) % 4 IN (0, 3) AS by_user,
          CAST(reviewerID AS BIGINT) % 4 IN (1, 3) AS by_list, text
        FROM customers LEFT JOIN user_texts ON query_id = reviewerID""",
    named="""
        SELECT query_id, asin FROM requests JOIN feed_history ON reviewerID = query_id WHERE by_user
        UNION ALL
        SELECT query_id, asin FROM requests JOIN listing USING (query_id) WHERE by_list AND NOT by_user""",
    profiles=aggregated("named", "avg"),
    spoken="SELECT query_id, text FROM requests WHERE text <> ''",
    spoken_vectors=embedded("spoken", "query_id", "text"),
    asked=f"""
        {blended_with("profiles", "spoken_vectors")}
        UNION ALL
        SELECT query_id, CAST(embedding AS DOUBLE[]) FROM spoken_vectors WHERE query_id NOT IN (SELECT query_id FROM profiles)""",
    found=nearest("asked", "vectors", 100), left_over=without("found", "named"), shown=presented("left_over", "meta"))
ORACLES["recommend_cold_start"] = sql("""
    SELECT c.reviewerID AS query_id, CAST(rank AS INT) AS rank, asin, title, avg_rating AS score,
      concat('Popular product with ', num_reviews, ' reviews') AS explanation, category, price, image_url
    FROM customers c, most_reviewed WHERE c.reviewerID NOT IN (SELECT reviewerID FROM feed)""")

# Re-ranking

# The wording of the prompt.
PROMPT = """concat('You are an expert product recommendation assistant for an e-commerce platform.

User''s Purchase History:
', summary, '

User Query: ', query, '


Precise Search Criteria (implicit user requirements):
', array_to_string(list_transform(criteria, lambda c: '- ' || c), chr(10)), '

IMPORTANT: Prioritize products that match these criteria when ranking.


Candidate Products (retrieved from similarity search):
', blocks, '

Your task:
1. Analyze the user''s purchase history and preferences
2. From the candidate products above, select the TOP 10 most relevant products
3. Re-rank them in order of relevance (1 = most relevant)
4. For each product, provide a natural, convincing explanation (2-3 sentences) explaining why you recommend it


IMPORTANT: Prioritize products that are sustainable, eco-friendly, organic, recycled, or vegan.
Look for keywords like: organic, recycled, sustainable, eco-friendly, vegan, biodegradable, fair trade.


Output your recommendations in the following JSON format:
{
  "recommendations": [
    {
      "rank": 1,
      "asin": "B00XXXXX",
      "explanation": "Why this product is perfect for the user..."
    },
    ...
  ]
}

Be specific and reference the user''s past purchases when relevant. Make the explanations engaging and personalized.
')"""
ORACLES["rerank_prompt_compact"] = sql(
    f"SELECT query_id, {PROMPT} AS prompt FROM listed JOIN summaries USING (query_id) JOIN asks USING (query_id)",
    feed_lines=lines("feed_history", "- ", "Unknown").replace("products p", "meta p"),
    summaries="""
        SELECT reviewerID AS query_id, concat('User has purchased ', n, ' products:', chr(10), listed, chr(10)) AS summary
        FROM feed_lines""",
    titles=firsts("feed_history", "meta", "title"),
    categories=firsts("feed_history", "meta", "category"),
    texts="""
        SELECT t.reviewerID AS query_id, concat('Products similar to: ', t.listed, '. in categories: ', c.listed,
          '. products that I would like based on my purchase history.') AS query
        FROM titles t JOIN categories c USING (reviewerID)""",
    asks=f"""
        SELECT query_id, query, {criteria_list('true', 'true')} AS criteria
        FROM (SELECT *, lower(query) AS words FROM texts)""",
    listed="""
        SELECT query_id, string_agg(concat(chr(10), rank, '. ASIN: ', asin, chr(10), '   Title: ', title, chr(10),
            '   Category: ', category, chr(10), '   Description: ', left(description, 200), chr(10),
            '   Retrieval Score: ', printf('%.4f', score), chr(10)), '' ORDER BY rank) AS blocks
        FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
              FROM candidates JOIN meta USING (asin))
        WHERE rank <= 100 GROUP BY query_id""")

ORACLES["rerank_prompt"] = ORACLES["rerank_prompt_compact"].replace("left(description, 200)", "description")

REPLIED = """
    SELECT query_id, i AS position, asin,
      CASE WHEN i % 4 = 0 THEN 'No explanation provided.' ELSE concat('choice ', i, ' of ', query_id) END AS explanation
    FROM (SELECT u.query_id, w.i, CASE WHEN w.r = 0 THEN 'zzz' WHEN w.r = -1 THEN '0' ELSE coalesce(c.asin, 'none') END AS asin
          FROM (SELECT DISTINCT query_id FROM candidates) u
          CROSS JOIN (VALUES (1, 5), (2, 3), (3, 3), (4, 1), (5, 0), (6, -1), (7, 7), (8, 9), (9, 11), (10, 13), (11, 2), (12, 4)) w(i, r)
          LEFT JOIN candidates c ON c.query_id = u.query_id AND c.rank = w.r)
    WHERE CAST(query_id AS BIGINT) % 5 IN (0, 1)"""
ORACLES["parse_replies"] = sql(
    "SELECT query_id, CAST(position AS INT) AS position, asin, explanation FROM replied", replied=REPLIED)
ORACLES["rerank_fill"] = sql(
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source, place, asin) AS INT) AS rank, asin, title,
         score, explanation, category, price, image_url
       FROM merged JOIN meta USING (asin) QUALIFY rank <= 10""",
    replied=REPLIED,
    chosen="""
        SELECT query_id, asin, min(position) AS place, arg_min(explanation, position) AS explanation
        FROM replied WHERE position <= 10 GROUP BY 1, 2""",
    merged="""
        SELECT o.query_id, o.asin, coalesce(c.score, 0) AS score, 0 AS source, place, explanation
        FROM chosen o LEFT JOIN candidates c ON c.query_id = o.query_id AND c.asin = o.asin
        UNION ALL
        SELECT query_id, asin, score, 1, rank,
          concat('High similarity to your preferences (score: ', printf('%.3f', score), ')')
        FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM chosen o WHERE o.query_id = c.query_id AND o.asin = c.asin)""")
ORACLES["recommend_reranked"] = sql(
    """SELECT query_id, rank, asin, title, score, explanation, sustainability_score, short_reason FROM scored""",
    known="""
        SELECT query_id, asin, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asin) AS rank,
          CAST(query_id AS BIGINT) % 2 = 0 AS stored
        FROM (SELECT query_id, asin, score FROM candidates) JOIN meta USING (asin)""",
    ordered="""
        SELECT query_id, asin, score, CASE WHEN stored THEN 'model one' ELSE 'model two' END AS explanation,
          CASE WHEN stored AND rank = 3 THEN -2 WHEN stored THEN -1 ELSE 0 END AS place
        FROM known WHERE (stored AND rank IN (1, 3)) OR (NOT stored AND rank = 2)
        UNION ALL
        SELECT query_id, asin, score, concat('High similarity to your preferences (score: ', printf('%.3f', score), ')'), rank
        FROM known WHERE NOT ((stored AND rank IN (1, 3)) OR (NOT stored AND rank = 2))""",
    best="""
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank, asin, title, score,
          explanation, description, category, brand
        FROM ordered JOIN meta USING (asin) QUALIFY rank <= 10""",
    scored=eco("best"))
ORACLES["reply_cache_misses"] = sql("""
    SELECT query_id, concat(query_id, ':', md5(coalesce(any_value(text), '')), ':', md5(string_agg(asin, ',' ORDER BY asin))) AS reply_key
    FROM candidates LEFT JOIN user_texts USING (query_id)
    WHERE CAST(query_id AS BIGINT) > (SELECT max(CAST(query_id AS BIGINT)) // 2 FROM candidates)
    GROUP BY query_id""")

# Filtering

BLOCKS |= {
    "ratings": 'SELECT reviewerID AS "user", asin AS item, round(avg(rating), 6) AS rating FROM feed GROUP BY 1, 2',
    "centred": """
        SELECT asin, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS embedding
        FROM (SELECT asin, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS c
              FROM vectors)""",
    "neighbors": """
        SELECT asin, neighbor, corr, CAST(row_number() OVER (PARTITION BY asin ORDER BY corr DESC, neighbor) AS INT) AS rank
        FROM (SELECT a.asin, b.asin AS neighbor, round(list_inner_product(a.embedding, b.embedding), 6) + 0.0 AS corr
              FROM centred a JOIN centred b ON a.asin <> b.asin)
        QUALIFY rank <= 100""",
    "close": "SELECT * FROM neighbors WHERE corr >= 0.2",
    "filtered": """
        SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, asin) AS INT) AS rank, asin, score
        FROM (SELECT "user", neighbor AS asin, round(avg(round(corr * 1000000))) / 1000000 + 0.0 AS score
              FROM ratings JOIN close ON close.asin = ratings.item WHERE rating > 0 GROUP BY 1, 2) s
        WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = s."user" AND r.item = s.asin AND r.rating > 0)
        QUALIFY rank <= 10""",
}
ORACLES["utility_matrix"] = sql("SELECT * FROM ratings")
ORACLES["svd_item_energy"] = sql(
    "SELECT item AS asin, round(round(sum(rating * rating), 9), 3) + 0.0 AS energy FROM ratings WHERE rating <> 0 GROUP BY 1")
# The largest eigenvalue of the items by items product, by repeated multiplication.
ORACLES["svd_truncated_energy"] = sql(
    """SELECT round(round(total, 9), 2) AS total, round(captured, 2) AS captured, round(total - captured, 2) AS residual
       FROM (SELECT sum(rating * rating) AS total FROM ratings), (SELECT max(size) AS captured FROM power WHERE n = 200)""",
    power="""
        SELECT 0 AS n, item, CAST(1 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS size FROM (SELECT DISTINCT item FROM ratings)
        UNION ALL
        SELECT n + 1, item, y / z, z FROM (
          SELECT n, item, y, sqrt(sum(y * y) OVER ()) AS z FROM (
            SELECT t.n, r.item, sum(r.rating * t.t) AS y FROM ratings r JOIN (
              SELECT "user", any_value(n) AS n, sum(rating * x) AS t FROM ratings JOIN power USING (item) WHERE n < 200 GROUP BY 1
            ) t ON r."user" = t."user" GROUP BY t.n, r.item))""").replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["item_neighbors"] = sql("SELECT * FROM close")
ORACLES["cf_recommend_factors"] = sql("""
    SELECT "user", rank, asin, score,
      concat('High correlation (', printf('%.3f', score), ') with products you''ve purchased') AS explanation,
      coalesce(title, 'Unknown') AS title, coalesce(category, '') AS category, coalesce(price, 0) AS price, image_url
    FROM filtered LEFT JOIN meta USING (asin)""")

# Comparison and evaluation

ORACLES["compare_lists"] = sql(
    """SELECT coalesce(a.query_id, b.query_id) AS query_id, CAST(count(a.asin) FILTER (b.asin IS NOT NULL) AS BIGINT) AS overlap,
         CASE WHEN count(a.asin) > 0 THEN round(count(a.asin) FILTER (b.asin IS NOT NULL) / count(a.asin), 6) ELSE 0 END AS overlap_ratio,
         count(*) FILTER (b.asin IS NULL) AS first_unique, count(*) FILTER (a.asin IS NULL) AS second_unique
       FROM recommended a FULL JOIN other b ON a.query_id = b.query_id AND a.asin = b.asin GROUP BY 1""",
    other_found=without("max_found", "owned"), other=presented("other_found", "meta"))
ORACLES["compare_baselines"] = sql("""
    SELECT query_id, 'popularity' AS method, count(*) FILTER (asin IN (SELECT asin FROM popular WHERE rank <= 10)) AS overlap,
      CAST(10 AS INT) AS k FROM recommended GROUP BY 1
    UNION ALL
    SELECT r.query_id, 'filtering', count(f.asin), CAST(10 AS INT)
    FROM recommended r LEFT JOIN filtered f ON f."user" = r.query_id AND f.asin = r.asin GROUP BY 1""")

BLOCKS |= {
    "parts": """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY reviewerID ORDER BY unixReviewTime DESC, review_id DESC) = 1
            THEN 'test' ELSE 'train' END AS part
        FROM feed QUALIFY count(*) OVER (PARTITION BY reviewerID) >= 5""",
    "train": "SELECT * EXCLUDE (part) FROM parts WHERE part = 'train'",
    "train_history": history_of("train", 20),
    "train_owned": "SELECT reviewerID AS query_id, asin FROM train_history",
    "train_profiles": aggregated("train_owned", "avg"),
    "train_found": nearest("train_profiles", "vectors", 100),
    "train_left": without("train_found", "train_owned"),
    "train_lists": presented("train_left", "meta"),
    "judged": """
        SELECT p.reviewerID AS query_id, l.rank FROM parts p
        LEFT JOIN train_lists l ON l.query_id = p.reviewerID AND l.asin = p.asin WHERE part = 'test'""",
}
ORACLES["holdout_split"] = sql("SELECT reviewerID, review_id, asin, part FROM parts")
ORACLES["ndcg_at_k"] = sql(
    "SELECT query_id, coalesce(round(1 / log2(rank + 1), 6), 0) AS ndcg FROM judged")
ORACLES["recall_at_k"] = sql("SELECT query_id, CAST(rank IS NOT NULL AS DOUBLE) AS recall FROM judged")
ORACLES["mrr"] = sql(
    "SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count(*) AS n_users FROM judged")
ORACLES["diversity_at_k"] = sql("""
    SELECT query_id, round(avg(1 - list_cosine_similarity(CAST(va.embedding AS DOUBLE[]), CAST(vb.embedding AS DOUBLE[]))), 6) AS diversity
    FROM recommended a JOIN recommended b USING (query_id)
    JOIN vectors va ON va.asin = a.asin JOIN vectors vb ON vb.asin = b.asin
    WHERE a.asin < b.asin GROUP BY 1""")

# Streams

ORACLES["stream_product_stats"] = sql(
    "SELECT asin, round(avg(rating), 6) AS avg_rating, count(rating) AS num_reviews FROM feed GROUP BY asin")
ORACLES["stream_delta_index"] = sql(f"SELECT asin, {SHOWN}, CAST(1 AS BIGINT) AS version FROM product_vectors")

# The whole batch: parsed files, catalogue, vectors, profiles, lists

ORACLES["batch_recommendations"] = sql(
    f"""SELECT {RESULT} FROM listed
        UNION ALL
        SELECT u.reviewerID, CAST(f.rank AS INT), f.asin, f.title, f.avg_rating,
          concat('Popular product with ', f.num_reviews, ' reviews'), f.category, f.price, f.image_url
        FROM (SELECT DISTINCT reviewerID FROM parsed) u, fallback f
        WHERE u.reviewerID NOT IN (SELECT query_id FROM listed)""",
    parsed="""
        SELECT * REPLACE (CASE CAST(asin AS BIGINT) % 7 WHEN 1 THEN 0.0 WHEN 3 THEN NULL ELSE rating END AS rating)
        FROM reviews""",
    goods=PARSED_METADATA,
    parsed_digest="""
        SELECT asin, string_agg(reviewText, ' | ' ORDER BY rn) AS all_reviews FROM (
          SELECT *, row_number() OVER (PARTITION BY asin ORDER BY unixReviewTime, review_id) AS rn FROM parsed)
        WHERE rn <= 10 GROUP BY asin""",
    shelf="""
        SELECT s.asin, round(s.m, 6) + 0.0 AS avg_rating, s.n AS num_reviews, title, brand, category, price, image_url,
          coalesce(description, all_reviews) AS description,
          concat('Title: ', title, ' | Brand: ', brand, ' | Category: ', category, ' | Description: ',
            coalesce(description, all_reviews), ' | Reviews: ', all_reviews) AS text_for_embedding
        FROM (SELECT asin, avg(rating) AS m, count(rating) AS n FROM parsed GROUP BY asin
              HAVING count(rating) >= 1 AND avg(rating) >= 3.0) s
        JOIN parsed_digest USING (asin) JOIN goods USING (asin)""",
    shelf_vectors=embedded("shelf", "asin", "text_for_embedding"),
    parsed_history=history_of("parsed", 20),
    parsed_owned="SELECT reviewerID AS query_id, asin FROM parsed_history",
    parsed_profiles=aggregated("parsed_owned", "avg", items="shelf_vectors"),
    parsed_found=nearest("parsed_profiles", "shelf_vectors", 100),
    parsed_left=without("parsed_found", "parsed_owned"),
    listed=presented("parsed_left", "shelf"),
    fallback="SELECT *, row_number() OVER (ORDER BY num_reviews DESC, asin) AS rank FROM shelf QUALIFY rank <= 10")
ORACLES["batch_recommendations_again"] = ORACLES["batch_recommendations"]
_head, _tail = ORACLES["batch_recommendations"].split(f"\nSELECT {RESULT} FROM listed", 1)
ORACLES["batch_popularity"] = f"""{_head},
all_lists AS (SELECT {RESULT} FROM listed{_tail}),
best_known AS (SELECT asin FROM shelf ORDER BY round(avg_rating * ln(1 + num_reviews), 6) DESC, asin LIMIT 10)
SELECT query_id, 'popularity' AS method, count(*) FILTER (asin IN (SELECT asin FROM best_known)) AS overlap, CAST(10 AS INT) AS k
FROM all_lists GROUP BY 1"""
