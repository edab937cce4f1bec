"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is the empty text.

    Every other column stays behind, so extra columns cannot clash with the ones an operator adds.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds at most ``rows`` rows and, beyond one row, about ``chars`` bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > chars:
                n //= 2
            yield batch.slice(at, n)
            at += n
