"""Text files in and out.

Defined results: Spark's file sources leave out files without a byte, so an empty file gives no row, neither in texts nor
in listings. Repeated texts are written and read as often as they stand; an empty table writes no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.StructType([T.StructField("file", T.StringType()), T.StructField("text", T.StringType())])


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, text`` of whole files with LF line ends; a path that does not exist and bytes that are no UTF-8 are errors."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("file"), F.regexp_replace(F.validate_utf8(F.col("content").cast("string")), r"\r\n?", "\n").alias("text"))


def read_tree(spark: SparkSession, path: str, pattern: str = "*", ordered: bool = False) -> DataFrame:
    """``file, sha256, length`` of all files below a folder; ``ordered`` sorts the listing by file, after hashing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = rows.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "length")
    return listed.orderBy("file") if ordered else listed


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """``runner, task, condition, generation, text`` of files ``<runner>/<task>-<condition>/draft-<generation>.md``."""
    part = lambda k: F.regexp_extract("file", r"([^/]+)/([^/]+)-(baseline|treatment)/draft-([0-9]+)\.md$", k)
    rows = read_texts(spark, f"{path}/*/*/draft-*.md")
    return rows.select(part(1).alias("runner"), part(2).alias("task"), part(3).alias("condition"), part(4).cast("int").alias("generation"), "text")


def normalised_source(text: Column) -> Column:
    """LF line ends and one at the end; a byte-order mark is an error."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(text.startswith("\ufeff"), F.raise_error(F.lit("source starts with a byte-order mark"))).otherwise(F.when(plain.endswith("\n"), plain).otherwise(F.concat(plain, F.lit("\n"))))


def lf_text(text: Column) -> Column:
    """Text as it is written: no CR, exactly one line end at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+\z", ""), F.lit("\n"))


def write_texts(rows: DataFrame, path: str, text_col: str = "text", by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """Texts with LF line ends, each ended by exactly one; files lie in a folder for each value of ``by`` and hold at most
    ``rows_per_file`` texts (0: as many as a task has). A null text is written as an empty line."""
    out = rows.select(*(by or []), F.regexp_replace(lf_text(F.col(text_col)), r"\n\z", "").alias("value")).write
    out = out.option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*by) if by else out).text(path)  # the writer adds the last line end
