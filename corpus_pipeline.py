"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and its decisions take effect: quality rules and decontamination drop documents,
near-dedup keeps one document of each group, the secret scan masks what it
finds, and the last stage gives each document's ids.

Extra columns of ``docs`` pass through all stages but the last; documents with a
null id are never dropped for their id; rows that repeat an id are one document
from the near-dedup stage on; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, near_dedup, quality_rules, secret_scan, sentencepiece_codec
from quern.llm.common import ship, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence rules, by references learnt from these documents."""
    ship(spark)
    return quality_rules.keep_good(docs, quality_rules.learn_references(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    ship(spark)
    return near_dedup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    ship(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text where there is such a column."""
    columns = docs.columns
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of each document."""
    ship(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminated),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]

#: SQL cannot express the learnt references, the near-dedup graph or the codec: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
