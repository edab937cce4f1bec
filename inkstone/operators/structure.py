"""Lines, fences, paragraphs and lists of a Markdown text, all inside the row: no shuffle.

``lines`` is an array of ``line, n, hidden, fenced``: ``hidden`` is the mask of the line detectors (an opening fence and
what follows it, not the closing fence), ``fenced`` the mask of the paragraph detectors (both fences and what lies
between). The text is split at its fence lines; the parity of a piece's place tells whether it lies inside a fence, so
the masks cost one pass. A fence that is not closed runs to the end of the text.

Null and empty texts have no lines. ``with_structure`` adds ``lines``, ``paras`` and ``lists``; ``with_open_text`` adds
``open``, ``clear`` and ``coded``, for counting without lines. Columns of the caller's with those names give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.chars import LINE_END, WS, first_word, let, split_sentences, strip

# White space that ends no line.
IN_LINE = r"\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
FENCE = rf"(?m)^[{IN_LINE}]*(?:```|~~~)[^\n]*$"
FENCE_LINE = rf"^[{WS}]*(?:```|~~~)"
BULLET = rf"^[{WS}]*(?:[*+-]|\p{{Nd}}+\.)[{WS}]+(.*)$"
OTHER_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
BREAK = rf"^[{WS}]*(?:[|#>]|$)"


def lines_of(text: Column) -> Column:
    """Array of ``line, n, hidden, fenced`` of a text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_END, "\n")
    plain = F.regexp_replace(plain, r"\n\z", "")
    entry = lambda line, hidden, fenced: F.struct(line.alias("line"), hidden.alias("hidden"), fenced.alias("fenced"))

    def with_fences(fences: Column) -> Column:
        def piece(part: Column, j: Column) -> Column:
            # The piece's text begins after a fence line and ends before one: the line ends at its edges belong to those.
            body = F.when(j > 0, F.regexp_replace(part, r"\A\n", "")).otherwise(part)
            body = F.when(j < F.size(fences), F.regexp_replace(body, r"\n\z", "")).otherwise(body)
            missing = ((j > 0) & (j < F.size(fences)) & (F.length(part) < 2)) | (F.size(fences) > 0) & ((j == 0) | (j == F.size(fences))) & (part == "")
            rows = F.when(missing, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
            inside = j % 2 == 1
            own = F.transform(rows, lambda line: entry(line, inside, inside))
            fence = F.array(entry(F.get(fences, j - 1), inside, F.lit(True)))
            return F.concat(F.when(j > 0, fence).otherwise(F.slice(fence, 1, 0)), own)

        return F.flatten(F.transform(F.split(plain, FENCE, -1), piece))

    marked = let(F.regexp_extract_all(plain, F.lit(FENCE), F.lit(0)), with_fences)
    empty = F.coalesce(text, F.lit("")) == ""
    numbered = F.transform(marked, lambda x, i: F.struct(x["line"].alias("line"), (i + 1).alias("n"), x["hidden"].alias("hidden"), x["fenced"].alias("fenced")))
    return F.when(empty, F.slice(numbered, 1, 0)).otherwise(numbered)


def _runs(lines: Column, belongs) -> Column:
    """Array of ``low, high`` (1-based, inclusive) of maximal runs of lines that belong together."""

    def runs(flags: Column) -> Column:
        at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        places = F.transform(flags, lambda flag, i: F.when(flag, i))
        firsts = F.filter(places, lambda i: i.isNotNull() & ~at(i - 1))
        lasts = F.filter(places, lambda i: i.isNotNull() & ~at(i + 1))
        return F.zip_with(firsts, lasts, lambda low, high: F.struct((low + 1).alias("low"), (high + 1).alias("high")))

    return let(F.transform(lines, belongs), runs)


def paragraphs_of(lines: Column) -> Column:
    """Array of ``start, n_lines, sentences, firsts``: runs of lines that are no fence, blank, heading, table or quote."""
    prose = lambda x: ~x["fenced"] & ~x["line"].rlike(BREAK)

    def build(run: Column) -> Column:
        part = F.slice(lines, run["low"], run["high"] - run["low"] + 1)
        joined = F.array_join(F.transform(part, lambda x: strip(x["line"])), " ")
        sentences = F.filter(F.transform(split_sentences(joined), strip), lambda s: s != "")
        return let(
            sentences,
            lambda s: F.struct(run["low"].alias("start"), (run["high"] - run["low"] + 1).alias("n_lines"), s.alias("sentences"), F.transform(s, first_word).alias("firsts")),
        )

    return F.transform(_runs(lines, prose), build)


def lists_of(lines: Column) -> Column:
    """Array of ``start, items``: runs of neighbouring list lines outside fences, with the text of each item."""
    bullet = lambda x: ~x["fenced"] & x["line"].rlike(BULLET)

    def build(run: Column) -> Column:
        part = F.slice(lines, run["low"], run["high"] - run["low"] + 1)
        return F.struct(run["low"].alias("start"), F.transform(part, lambda x: strip(F.regexp_extract(x["line"], BULLET, 1))).alias("items"))

    return F.transform(_runs(lines, bullet), build)


def with_structure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lines``, ``paras`` and ``lists``."""
    lined = docs.withColumn("lines", lines_of(F.col(text_col)))
    return lined.withColumn("paras", paragraphs_of(F.col("lines"))).withColumn("lists", lists_of(F.col("lines")))


def open_text(text: Column) -> Column:
    """The lines that no fence hides, as one text with LF line ends. Only texts with marks of a fence are cut into lines."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.when(whole.rlike(OTHER_END), F.regexp_replace(whole, LINE_END, "\n")).otherwise(whole)
    seen = F.transform(F.filter(lines_of(text), lambda x: ~x["hidden"]), lambda x: x["line"])
    return F.when(whole.contains("```") | whole.contains("~~~"), F.array_join(seen, "\n")).otherwise(plain)


def with_open_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``open``, its lines without a backtick as one text (``clear``) and those with one (``coded``)."""
    marked, lines = F.col("open").contains("`"), F.split("open", "\n", -1)
    clear = F.when(marked, F.array_join(F.filter(lines, lambda x: ~x.contains("`")), "\n")).otherwise(F.col("open"))
    coded = F.when(marked, F.filter(lines, lambda x: x.contains("`"))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("open", open_text(F.col(text_col))).withColumns({"clear": clear, "coded": coded})
