"""The registered queries of the subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import ann, chat, decontaminate, hmm, langid, merkle, mixing, negatives, pii, quality, secretscan, simhash, warc
from recspark.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    mixture = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(mixture).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from archives of all pages."""
    records = warc.archive(table(spark, sf_dir, "pages"), split_bytes=8 << 20)
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", warc.page_of("refers_to")).alias("refers_to"),
    )


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is held out from learning."""
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(documents.filter(~held_out))
    return langid.predict(documents, model, [F.col("doc_id"), held_out.alias("held_out")])


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data, and how many mentions were replaced."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "op4", count="n_mentions")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; a seventh of the documents is held out from learning."""
    documents = table(spark, sf_dir, "documents")
    found = hmm.score(documents, remainder("doc_id", 7) != 2)
    return found.withColumn("held_out", remainder("doc_id", 7) == 2)


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of every participant."""
    found = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return found.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(spans, ",").alias("spans"), "masked")


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed shapes, and tokens that look random and unlike ordinary text."""
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    fixed = F.filter("spans", lambda s: s["kind"] < secretscan.KINDS.index("random"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secretscan.SHAPES)]
    return found.select(
        "doc_id", *counts, F.sha2(secretscan.written(fixed), 256).alias("base_sha256"), secretscan.written(F.col("spans")).alias("spans")
    )


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document under one root."""
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)
