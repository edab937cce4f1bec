"""A corpus with Markdown in it, made from the given documents.

The given texts are plain prose, so most detectors would find nothing in them. Each document therefore gets a snippet in
front, chosen by its id; the same list gives the Spark expression and the SQL one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPETS = [
    "# A Guide to the Old harbour\n\nMoreover, it's a plan — a big one.",
    "```\nfoo — bar don't leverage\n``` \n~~~\nx — y isn't\n```\nAfter — fence.",
    "- one item here\n- second item here\n\nWe met. Overall, the day ended well. Thus, the end.",
    "1. alpha\n2. beta\n3. gamma delta\n\n* one two three four five six seven eight nine\n* b\n* c",
    "> Furthermore quoted text\n- Additionally, a listed thing\nIn addition, spaced text. In addition to that.",
    "Years 2022–2026 and a–b with `code — span` and 1—2 signs.",
    "We can't say isn't, don't or WE'LL; John's book isn't `it's` here.",
    "This is a novel approach to a novel framework, a deep dive at the end of the day. It paves the way.",
    "They leverage vast realms and a pivotal, pivotal nuance; Utilizes tools. Facilitating `delve` work.",
    "| cell — one | cell |\n## bad heading here\n### [link](u) And `code` Words ##\n#### Well-known State-of-Play",
    "The cat sat. A dog ran. The bird flew. The cat left.\n\nThese results represent progress.",
    "😀 — emoji first – then\nno mark\tat all\n\n\n-  a list of one",
    "    ```python\ninside — code\n\nstill inside don't",
    "Plain opening words without any mark.",
]


def dressed(docs: DataFrame) -> DataFrame:
    """``docs`` with dressed texts."""
    return docs.withColumn("text", dressed_text())


def dressed_text() -> Column:
    n = len(SNIPPETS)
    chosen = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % n + 1).cast("int"))
    return F.concat(chosen, F.lit("\n\n"), F.coalesce(F.col("text"), F.lit("")))


def sql_literal(text: str) -> str:
    """A SQL string with its line ends and tabs spelled out."""
    parts = [f"'{line.replace(chr(39), chr(39) * 2)}'" for line in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def dressed_sql() -> str:
    cases = " ".join(f"when {i} then {sql_literal(s)}" for i, s in enumerate(SNIPPETS))
    return f"(case doc_id % {len(SNIPPETS)} {cases} end || chr(10) || chr(10) || coalesce(text, ''))"
