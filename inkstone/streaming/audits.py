"""Audits of text files as they arrive.

An audit looks at one document at a time, so the stream keeps no state: each file is audited once, in the micro-batch that
finds it, and a restarted query goes on from its checkpoint. Counts by rule over event time do keep state, bounded by the
watermark.

Defined results: bytes that are no UTF-8 end the query with an error, as they do in batch reading. Files without a byte
give no row. A file that is written again is a new file. A folder without files gives no batch. Texts of any length are
audited whole. Columns beside ``file, text, seen`` are kept as in a batch audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators.audit import audit, rule_results

BINARY = "path string, modificationTime timestamp, length long, content binary"


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``file, text, seen`` of new files below ``path``."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("file"), F.validate_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("seen"))


def audit_stream(texts: DataFrame, **options) -> DataFrame:
    """Rule results of a stream of ``file, text, seen``."""
    return rule_results(audit(texts, **options))


def rule_counts(results: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window, rule, violations`` over tumbling windows of ``seen``; rows later than the watermark are left out."""
    counted = results.where("count > 0").withWatermark("seen", late).groupBy(F.window("seen", window).alias("window"), "rule")
    return counted.agg(F.sum("count").alias("violations"))


def write_results(results: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append results to a parquet table, each file's exactly once."""
    out = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
