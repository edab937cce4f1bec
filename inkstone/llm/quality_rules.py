"""Quality rules: line-first cleaning, in DataFrame functions only.

Measures of a whole text, over words ``[^\\x20\\x09-\\x0D]+``: their number and code points, symbol characters, lines that
repeat an earlier line, and words that lie in a three-word window found more than once in the text.

Cleaning drops each line that fails a rule:
    punctuation   at least ``bare_words`` words and none that ends a clause
    noise         a quarter of its words or more carry runs of symbols or of exclamation marks
    navigation    at least three separators, and at least one for every four words
    boilerplate   at most ``notice_words`` words and a stock phrase of sites and licences
A document is kept unless its measures fail (under 50 words, or more than half of the words repeat) or the lines that
stay hold less than half of its word characters.

Everything happens inside a row: no shuffle, no Python, memory in proportion to the longest text. Repeated windows are
looked for by sorting only in the texts where distinct windows are fewer than windows.

Defined results: a null text counts as no words and is not kept. Blank lines stay. Equal rows give equal results, and
rows with the same doc_id are judged on their own. Extra columns are carried by ``apply`` and left behind by
``measure``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SYMBOLS = "[#*$%&|<>]"
CLAUSE_END = r"""[.!?…:;,]["'”’»)\]]*(?:[ \t-\r]|$)"""
# Tried at the start of a word only, and up to its first mark, so that a word of a megabyte takes linear time.
NOISY_WORD = r"(?<![^ \t-\r])[^ \t-\r]*?(?:[#*$%&]{3}|!!)"
SEPARATOR = r"(?:^|[ \t-\r])[|»›•·>]+"
# Fixed phrases of site furniture and licence notices.
NOTICE = (
    r"(?i)(?:all rights reserved|cookie|javascript|privacy policy|terms of (?:use|service)|click here|subscribe|"
    r"sign up|log ?in|lorem ipsum|licensed under|general public license|read more|skip to content)"
)
MIN_WORDS = 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text has at least twice."""
    # The last two windows are shorter than three words and equal to no other window.
    windows = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(placed: Column) -> Column:
            same = lambda x, k: x["w"] == F.get(placed, k)["w"]
            twice = F.filter(placed, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def add(seen: Column, at: Column) -> Column:
            return F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(3), at - seen["last"])).alias("n"))

        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        total = F.aggregate(_let(placed, starts), zero, add, lambda seen: seen["n"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total)

    return _let(windows, covered).cast("long")


def line_stays(line: Column, bare_words: int = 12, notice_words: int = 40) -> Column:
    """Whether a line passes every rule."""
    n = F.regexp_count(line, F.lit(WORD))
    bare = (n >= bare_words) & ~line.rlike(CLAUSE_END)
    noisy = (n > 0) & (4 * F.regexp_count(line, F.lit(NOISY_WORD)) >= n)
    seps = F.regexp_count(line, F.lit(SEPARATOR))
    navigation = (seps >= 3) & (4 * seps >= n)
    notice = (n <= notice_words) & line.rlike(NOTICE)
    return ~(bare | noisy | navigation | notice)


def clean_lines(text: Column, **limits: int) -> Column:
    """The text without the lines that fail a rule."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line_stays(line, **limits)), "\n")


def word_characters(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def _base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``kept`` and ``clean_text`` of each row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = plain.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        clean_lines(F.col("text"), **limits).alias("clean_text"),
    )
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    stays = 2 * word_characters(F.col("clean_text")) >= F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & stays)


def apply(docs: DataFrame, text_col: str = "text", **limits: int) -> DataFrame:
    """The kept rows of ``docs`` with cleaned texts; every column stays, ``n_chars`` follows the text if there is one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = "__cleaned"
    while mark in docs.columns:
        mark += "_"

    def good(x: Column) -> Column:
        failed = _let(words_of(text), lambda w: _base_failed(F.size(w), repeated_window_words(w)))
        return ~failed & (2 * word_characters(x[mark]) >= word_characters(text))

    # A filter inside the row: a filter over rows would be pushed below the projection and clean every text twice. The
    # outer form because for the other one the optimizer adds a filter on the array's size, which would do the same.
    cleaned = docs.select("*", F.inline_outer(F.filter(F.array(F.struct(clean_lines(text, **limits).alias(mark))), good))).where(F.col(mark).isNotNull())
    out = {text_col: F.col(mark)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(mark).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


# The same rows in DuckDB's SQL.
def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_NOISY_WORD_SQL = r"[^ \t-\r]*(?:[#*$%&]{3}|!!)[^ \t-\r]*"
ORACLE_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), {_sql(SPACE + '+')}), lambda x: x <> '') as w
  from documents
), windows as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as tri
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, tri) as c from windows) where c > 1
), covered as (
  select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from twice) group by r
), lines as (
  select r, n, line, len(regexp_extract_all(line, {_sql(WORD)})) as nw,
         len(regexp_extract_all(line, {_sql(_NOISY_WORD_SQL)})) as noisy, len(regexp_extract_all(line, {_sql(SEPARATOR)})) as seps
  from (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from d)
), per_doc as (
  select r, count(*) filter (nw > 0) - count(distinct line) filter (nw > 0) as dups,
         coalesce(sum(length(regexp_replace(line, {_sql(SPACE)}, '', 'g'))) filter (not (
           (nw >= 12 and not regexp_matches(line, {_sql(CLAUSE_END)})) or (nw > 0 and 4 * noisy >= nw)
           or (seps >= 3 and 4 * seps >= nw) or (nw <= 40 and regexp_matches(line, {_sql(NOTICE)})))), 0) as stays
  from lines group by r
), m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, {_sql(SYMBOLS)}))::bigint as n_symbols, p.dups::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words, p.stays
  from d join per_doc p using (r) left join covered c using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and 2 * stays >= word_chars as kept
from m
"""
