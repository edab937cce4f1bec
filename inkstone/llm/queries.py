"""One registered query per operator, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import bpe, byte_contexts, chat, lm_score, ogg, packing, phrases, pii, quality_model, quality_rules, simhash, turn_repair, warc
from inkstone.runtime import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.as_tool_messages(table(spark, sf_dir, "conversations"))
    return chat.link(messages, chat.tool_schemas(spark))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm_score.score(documents, lm_score.fit(documents))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(ogg.load(ogg.store(table(spark, sf_dir, "documents"))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).drop("clean_text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.serialise(warc.derive(warc.responses(table(spark, sf_dir, "pages")))))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return byte_contexts.predict(documents, byte_contexts.fit(documents))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(damaged, damaged["copies"])


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_model": op2_quality_model,
        "op3_tool_calls": op3_tool_calls,
        "op4_lm_score": op4_lm_score,
        "op5_personal_data": op5_personal_data,
        "op6_ogg_media": op6_ogg_media,
        "op7_packing": op7_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash": op9_simhash,
        "op10_warc_derivatives": op10_warc_derivatives,
        "op11_language_id": op11_language_id,
        "op12_phrases": op12_phrases,
        "op13_turn_repair": op13_turn_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op3_tool_calls": chat.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op10_warc_derivatives": warc.ORACLE_SQL,
        "op12_phrases": phrases.ORACLE_SQL,
        "op13_turn_repair": turn_repair.ORACLE_SQL,
    }
