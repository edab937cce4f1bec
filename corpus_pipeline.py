"""The documents pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between stages the rows are written
as Parquet to the shared folder of ``spark.checkpoint.dir`` and read again, so that a lost executor costs at most the
running stage. All stages but the last return the columns of documents. The tables between stages are removed at the end.

Defined results: a null text counts as no words, and goes in the first stage. Empty texts go with it. Rows that repeat, or
unlike texts under one doc_id, are judged each on its own, until the third stage keeps one row of each group of texts (the
smallest doc_id, null last). Very long texts are worked on whole. Extra columns stay, whatever their names, up to the last
stage, which returns pieces. Empty tables give no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import near_texts, packing, pii, quality_model, quality_rules
from inkstone.runtime import Scratch, table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that fail the measures or lose too much text."""
    return quality_rules.apply(docs)


def apply_quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that a model of the labelled originals (the rules have left hardly any bad ones here) rejects."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles are similar to 0.8 or more form groups; the smallest id of each stays."""
    return near_texts.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become marks of their kind."""
    return pii.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_model", apply_quality_model),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]

#: SQL has no tokenizer and no trained model; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    scratch.remove(docs)
    return docs
