"""From raw documents to a mixed training corpus: five stages, each written as Parquet and read again by the next.

Quality, near-duplicates and contamination drop documents, personal data is replaced in place, and the last stage mixes the
sources. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import decontaminate, mixing, pii, quality, simhash
from recspark.llm.common import table
from recspark.session import work_path


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints of four-word shingles, four bits apart at most) the smallest id stays."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts."""
    return pii.pseudonymise(docs, "corpus").withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: spans of documents by shard and slot, with their text."""
    return mixing.texts(mixing.mix(docs), docs)


STAGES = [
    ("quality", good_text),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("pii", pseudonymous),
    ("mixing", mixed),
]

# The quality model, the components and the mix are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
