"""Rewriting of version numbers in files: exact matches only, with a count for each file.

Defined results: null texts are empty and have no match. Files of other kinds, and those to pass over, are skipped as they
are. Repeated paths are rewritten each; of a path's required counts the greatest holds. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of files that name the version, and files that keep old ones.
KINDS = [".md", ".py", ".js", ".mdc", ".json", ".toml"]
KEPT = ["CHANGELOG.md"]


def forms(version: str, package: str) -> list[str]:
    """The ways in which files name a version, in the order in which they are replaced."""
    return [f"v{version}", f'"{version}"', f"{package}@{version}", f"// {version}"]


def _times(text: Column, form: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(form), F.lit("")))) / len(form)).cast("long")


def rewrite(files: DataFrame, old: str, new: str, package: str, required: DataFrame | None = None, check: bool = False) -> DataFrame:
    """``path, replaced, state, text`` of ``files`` (``path, text``): how many places name the old version, and the text
    with the new one; with ``check`` texts stay, and what would be written is told.

    States: 'skipped', 'unchanged', 'updated' ('stale' with ``check``), and 'short' for a file with fewer places than
    ``required`` (``path, least``) asks for, which stays as it is.
    """
    text = F.coalesce("text", F.lit(""))
    inside = F.lit(False)
    for kind in KINDS:
        inside = inside | F.col("path").endswith(kind)
    inside = F.coalesce(inside & ~F.col("path").isin(KEPT), F.lit(False))
    count, after = F.lit(0).cast("long"), text
    for a, b in zip(forms(old, package), forms(new, package), strict=True):
        count, after = count + _times(after, a), F.replace(after, F.lit(a), F.lit(b))
    rows = files.select("path", text.alias("before"), inside.alias("inside"), F.when(inside, count).otherwise(0).alias("replaced"), after.alias("after"))
    if required is None:
        rows = rows.withColumn("least", F.lit(None).cast("long"))
    else:
        rows = rows.join(required.groupBy("path").agg(F.max("least").alias("least")), "path", "left")
    short = F.coalesce(F.col("replaced") < F.col("least"), F.lit(False))
    state = F.when(~F.col("inside"), "skipped").when(short, "short").when(F.col("replaced") == 0, "unchanged").otherwise("stale" if check else "updated")
    return rows.select("path", "replaced", state.alias("state"), F.when((state == "updated"), F.col("after")).otherwise(F.col("before")).alias("text"))
