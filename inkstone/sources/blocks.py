"""Headings of Markdown texts by block structure: what stands in fences, code and HTML is no heading, underlined paragraphs are.

One pattern takes a text apart into its blocks, each by the first kind that fits where the block before it ended: a fenced
block up to a fence of its own mark and at least its length, an HTML block up to its end mark or a blank line, a heading
line, a rule, a quote or list item with the lines that continue it, indented code, or a paragraph, which an underline
makes a heading. All loops are possessive, so a text is walked once and no block is recursed into.

Quotes and list items are passed over whole: headings inside of them are not told.

Defined results: a null or empty text has no blocks. Lines count from 1 and are those of LF, CRLF and CR. Repeated rows
give repeated headings. A block that is not closed goes to the end of the text. Columns beside the key and the text stay
behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.chars import any_of, let, running_sums

# Elements that open an HTML block wherever they begin a line, and those that hold raw text.
HTML_BLOCKS = """
address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option
p param search section summary table tbody td tfoot th thead title tr track ul
""".split()
RAW = ["pre", "script", "style", "textarea"]

_LINE = r"[^\n]*\n"
_BLANK = r"[ \t]*\n"
_IN = " {0,3}"
_ATX = rf"{_IN}#{{1,6}}(?:[ \t]{_LINE}|\n)"
_RULE = rf"{_IN}(?:(?:\*[ \t]*+){{3,}}+|(?:-[ \t]*+){{3,}}+|(?:_[ \t]*+){{3,}}+)\n"
_UNDERLINE = rf"{_IN}(?:=++|-++){_BLANK}"
_FENCE = rf"{_IN}(?:`{{3,}}+[^`\n]*\n|~~~)"
_QUOTE = rf"{_IN}>"
_BULLET, _NUMBER = r"[-+*]", r"[0-9]{1,9}[.)]"
_ITEM = rf"{_IN}(?:{_BULLET}|{_NUMBER})(?:[ \t]|\n)"
_ITEM_INSIDE = rf"{_IN}(?:{_BULLET}|1[.)])[ \t]++[^ \t\n]"  # what may end a paragraph
_TAG = r"(?:<[A-Za-z][A-Za-z0-9-]*+(?:[ \t]++[A-Za-z_:][A-Za-z0-9_.:-]*+(?:[ \t]*+=[ \t]*+(?:\"[^\"\n]*+\"|'[^'\n]*+'|[^ \t\n\"'=<>`]++))?+)*+[ \t]*+/?>|</[A-Za-z][A-Za-z0-9-]*+[ \t]*+>)"
_HTML = {
    rf"<(?i:{any_of(RAW)})(?:[ \t>]|\n)": rf"</(?i:{any_of(RAW)})>",
    "<!--": "-->",
    r"<\?": r"\?>",
    "<![A-Za-z]": ">",
    r"<!\[CDATA\[": r"\]\]>",
}
_HTML_NAMED = rf"{_IN}</?(?i:{any_of(HTML_BLOCKS)})(?:[ \t]|\n|/?>)"
_HTML_START = rf"(?:{'|'.join(_IN + start for start in _HTML)}|{_HTML_NAMED})"
_ENDS = rf"(?:{_BLANK}|{_FENCE}|{_ATX}|{_RULE}|{_QUOTE}|{_HTML_START}|{_ITEM_INSIDE})"


def _while_not(stop: str) -> str:
    return rf"(?:(?!{stop}){_LINE})*+"


def _fenced(mark: str, info: str, group: int) -> str:
    close = rf"{_IN}\{group}{mark}*+{_BLANK}"
    return rf"{_IN}({mark}{{3,}}+){info}\n{_while_not(close)}(?:{close})?+"


_KINDS = [
    _BLANK,
    rf"(?: {{4}}|{_IN}\t){_LINE}",
    _fenced("`", r"[^`\n]*", 1),
    _fenced("~", r"[^\n]*", 2),
    *[rf"(?={_IN}{start}){_while_not(rf'[^\n]*{end}')}(?:{_LINE})?+" for start, end in _HTML.items()],
    rf"(?={_HTML_NAMED}|{_IN}{_TAG}{_BLANK}){_while_not(_BLANK)}",
    _ATX,
    _RULE,
    rf"(?={_QUOTE}|{_ITEM}){_LINE}{_while_not(_ENDS)}",
    rf"{_LINE}(?:(?!{_UNDERLINE}|{_ENDS}){_LINE})*+({_UNDERLINE})?+",
]
BLOCK = rf"(?m)^(?:{'|'.join(_KINDS)})"
UNDERLINE_GROUP = 3


def _title(text: Column) -> Column:
    """The text of a heading line without its marks and blanks."""
    inner = F.btrim(F.ltrim(F.btrim(text, F.lit(" \t\n")), F.lit("#")), F.lit(" \t"))
    bare = lambda t: F.rtrim(t, F.lit("#"))
    return let(inner, lambda t: F.when(bare(t) == "", "").when(bare(t).rlike(r"[ \t]\z"), F.rtrim(bare(t), F.lit(" \t"))).otherwise(t))


def headings(packs: DataFrame, key: str = "file", text_col: str = "text") -> DataFrame:
    """``key, line, last, level, title`` of every heading; ``last`` is its last line, an underline included."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"\r\n?", "\n")
    plain = F.when(plain.endswith("\n") | (plain == ""), plain).otherwise(F.concat(plain, F.lit("\n")))
    rows = packs.select(F.col(f"`{key}`").alias("__key"), plain.alias("__text"))
    blocks = F.arrays_zip(F.regexp_extract_all("__text", F.lit(BLOCK), F.lit(0)).alias("block"), F.regexp_extract_all("__text", F.lit(BLOCK), F.lit(UNDERLINE_GROUP)).alias("under"))
    atx = lambda b: b["block"].rlike(rf"\A{_IN}#{{1,6}}[ \t\n]")
    is_heading = lambda b: (b["under"] != "") | atx(b)
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def told(found: Column) -> Column:
        starts = running_sums(F.transform(found, lambda b: lines(b["block"]).cast("long")))
        placed = F.zip_with(found, starts, lambda b, s: F.struct(b["block"].alias("block"), b["under"].alias("under"), s.alias("start")))
        return F.filter(placed, is_heading)

    flat = rows.select("__key", F.inline(let(blocks, told)))
    under = F.col("under") != ""
    level = F.when(under, F.when(F.col("under").contains("="), 1).otherwise(2)).otherwise(F.length(F.regexp_extract("block", r"\A *(#+)", 1)))
    text = F.btrim(F.substring(F.col("block"), F.lit(1), F.length("block") - F.length("under")), F.lit(" \t\n"))
    return flat.select(
        F.col("__key").alias(key), (F.col("start") + 1).cast("int").alias("line"), (F.col("start") + lines(F.col("block"))).cast("int").alias("last"), level.cast("int").alias("level"),
        F.when(under, text).otherwise(_title(F.col("block"))).alias("title"),
    )
