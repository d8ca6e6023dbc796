"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.session import shuffles_removed, spread, work_path


ROW_KEYS = {
    "lineitem": ["l_orderkey", "l_partkey"],
    "orders": ["o_orderkey"],
    "documents": ["doc_id"],
    "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
    "pages": ["page_id"],
    "embeddings": ["vec_id"],
    "part": ["p_partkey"],
    "customer": ["c_custkey"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its one file is one task's work however many cores there are, so it is spread while it is small."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *ROW_KEYS.get(name, []))


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return (
        F.unix_date(moment.cast("date")).cast("bigint") * 86400
        + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    ).cast("bigint")


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews of parts by customers."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        text_of("o_custkey").alias("reviewerID"),
        text_of("l_partkey").alias("asin"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        F.concat(F.lit("review of part "), text_of("l_partkey"), F.lit(" line "), text_of("l_linenumber")).alias("reviewText"),
        F.col("l_returnflag").alias("summary"),
        epoch_seconds(F.col("o_orderdate")).alias("unixReviewTime"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
            F.col("l_shipdate").cast("date"),
        ).alias("review_id"),
    )


PHRASES = [
    "organic cotton, GOTS", "recycled bottle", "cork sole, vegan", "green label", "B-Corp, fair trade",
    "repairable, 2 year warranty", "made in France", "eco-friendly certified", "long-lasting, robust",
    "upcycled, biodegradable",
]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products, without a description."""
    picture = F.concat(F.lit("https://img.example/"), text_of("p_partkey"), F.lit(".jpg"))
    images = F.when(F.col("p_size") % 3 == 0, F.array(picture, F.lit("https://img.example/back.jpg"))).when(
        F.col("p_size") % 3 == 1, F.array().cast("array<string>")
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text_of("p_partkey").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        images.alias("imageURL"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; a whole document and a phrase describe each of them."""
    documents = table(spark, sf_dir, "documents")
    slot = F.col("p_partkey") % 12
    phrase = F.coalesce(F.get(F.array(*[F.lit(p) for p in PHRASES]), slot.cast("int")), F.lit("plain"))
    numbered = parts(spark, sf_dir).withColumn("doc_id", F.col("p_partkey") % F.lit(documents.count()))
    return (
        numbered.join(documents.select("doc_id", "text"), "doc_id")
        .withColumn("description", F.concat("text", F.lit(" "), phrase))
        .drop("doc_id", "text", "p_partkey")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(text_of("vec_id").alias("asin"), "embedding", "label")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ratings of 100 products that all have a vector."""
    return table(spark, sf_dir, "events").select(
        text_of("user_id").alias("reviewerID"),
        F.get_json_object("props", "$.k").alias("asin"),
        (1 + F.col("event_id") % 5).cast("double").alias("rating"),
        epoch_seconds(F.col("ts")).alias("unixReviewTime"),
        text_of("event_id").alias("review_id"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(text_of("c_custkey").alias("reviewerID"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a text query."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"
    )


def user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per user: all turns of the conversation of the same number, in order."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(text_of("conv_id").alias("query_id"))
        .agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY turn)").alias("text"))
    )


def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six product ids per customer; one is repeated, some are unknown."""
    ids = [((F.col("c_custkey") * 13 + i * 7) % 2500).cast("string") for i in (0, 1, 2, 3, 4, 0)]
    return table(spark, sf_dir, "customer").select(text_of("c_custkey").alias("query_id"), F.array(*ids).alias("asins"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer: a user, an item list, both or neither, and a text where there is a conversation."""
    slot = F.col("query_id").cast("bigint") % 4
    return item_lists(spark, sf_dir).join(user_texts(spark, sf_dir), "query_id", "left").select(
        "query_id",
        F.when(slot.isin(0, 3), F.col("query_id")).alias("reviewerID"),
        F.when(slot.isin(1, 3), F.col("asins")).alias("asins"),
        "text",
    )


def fragment(name: str, value: Column) -> Column:
    """`"name":value` of a JSON object; null when the value is null."""
    inner = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def json_lines(rows: DataFrame, fragments: list[Column], broken: Column) -> DataFrame:
    """One JSON object per row as text, and a broken line besides where `broken` holds."""
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fragments), F.lit("}"))
    return rows.select(
        F.explode(F.when(broken, F.array(F.lit('{"asin": "broken'), whole)).otherwise(F.array(whole))).alias("value")
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews as JSON lines whose rating field takes all the shapes that occur."""
    slot = F.col("asin").cast("bigint") % 7
    rating = F.col("rating")
    shaped = (
        F.when(slot == 0, fragment("rating", rating))
        .when(slot == 2, fragment("overall", rating.cast("string")))
        .when(slot == 3, F.lit('"overall":null'))
        .when(slot != 1, fragment("overall", rating))
    )
    names = ["reviewerID", "asin", "reviewText", "summary", "unixReviewTime", "review_id"]
    return json_lines(
        reviews(spark, sf_dir),
        [shaped, *[fragment(n, F.col(n)) for n in names]],
        F.col("asin").cast("bigint") % 11 == 0,
    )


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata as JSON lines with text and lists, absent and null fields."""
    number = F.col("asin").cast("bigint")
    by4, by5, by3 = number % 4, number % 5, number % 3
    description = (
        F.when(by4 == 0, fragment("description", F.col("description")))
        .when(by4 == 1, fragment("description", F.array("title", "description")))
        .when(by4 == 3, F.lit('"description":null'))
    )
    kind = F.col("category")
    category = (
        F.when(by5 == 0, fragment("category", F.array(F.array(kind, F.lit("A"), F.lit("B"), F.lit("C")))))
        .when(by5 == 1, fragment("category", F.array(kind, F.lit("x"))))
        .when(by5 == 2, F.lit('"category":[]'))
        .when(by5 == 3, fragment("category", kind))
    )
    price = F.when(by3 == 0, fragment("price", F.col("price"))).when(by3 == 1, F.lit('"price":"$12.99"'))
    plain = F.when(by4.isin(0, 2), fragment("imageURL", F.array(F.concat(F.lit("low-"), "asin")))).when(
        by4 == 1, F.lit('"imageURL":[]')
    )
    sharp = F.when(by4.isin(0, 1), fragment("imageURLHighRes", F.array(F.concat(F.lit("high-"), "asin"))))
    bought = F.when(by3 == 0, fragment("also_bought", F.array("asin", F.lit("0"))))
    return json_lines(
        metadata(spark, sf_dir),
        [fragment("asin", F.col("asin")), fragment("title", F.col("title")), fragment("brand", F.col("brand")),
         description, category, price, plain, sharp, bought],
        number % 11 == 0,
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Raw files are compressed, as such files come."""
    with shuffles_removed(lines.sparkSession):
        lines.write.text(path, compression="gzip")


def write_text(lines: DataFrame, name: str) -> str:
    path = work_path(lines.sparkSession, name)
    write_lines(lines, path)
    return path
