"""Character classes and text primitives as Column functions.

Patterns are written so that Java's and RE2's engines read them alike (``\\x{...}`` escapes, explicit classes), apart from
the look-arounds of the Spark side. Each takes time in proportion to a line's length, also on lines made to be slow: marks,
hyphens or blanks by the million.

Defined results: null texts give null, but no lines and no violations; empty texts have no lines. Texts and lines of any
length are worked on whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from unicodedata import category

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space (as a class and as characters), line ends and word characters as Unicode-aware text tools define them.
WS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"

# The word characters below U+0100 one by one: such a class is looked up in a table, where properties and ranges are tried
# in turn. Patterns over whole texts try it first.
LATIN_WORD = "".join(rf"\x{k:02x}" for k in range(256) if category(chr(k))[0] in "LN" or chr(k) == "_")

SENTENCE_GAP = rf"(?<=[.!?])[{WS}]+(?=[A-Z\"'(\[])"
# A run of word characters, hyphens and apostrophes counts if it holds a word character; only a run's start is tried.
COUNTED_WORD = rf"(?<![{WORD}'-])['-]*+[{WORD}]"
FIRST_WORD = "^[A-Za-z][A-Za-z'-]*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def split_lines(text: Column) -> Column:
    """Lines by any Unicode line end; a final line end opens no empty line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def excerpt(text: Column, start0: Column, lead: int, length: Column | None = None) -> Column:
    """Up to 120 characters from ``lead`` before a 0-based place, with dots where text was left out; ``length`` is the
    text's, if the caller has it."""
    length = F.length(text) if length is None else length
    start = F.greatest(F.lit(0), start0 - lead)
    cut = strip(F.substring(text, start + 1, F.lit(120)))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + 120 < length, "…").otherwise(""))


def running_sums(values: Column, block: int = 64) -> Column:
    """The sum of the values before each value of an array; blocks keep the work far below the square of its size."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    number = lambda i: F.floor(i / block).cast("int")

    def of(v: Column) -> Column:
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), number(F.size(v) - 1))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda b: total(F.slice(v, b * block + 1, block)))
        starts = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b))))
        place = lambda s, i: F.get(s, number(i)) + total(F.slice(v, number(i) * block + 1, i % block))
        return let(starts, lambda s: F.transform(v, lambda _, i: place(s, i)))

    return let(values, of)


def _places(gaps: Column, found: Column) -> Column:
    """Structs of 1-based column, match, and whether an odd number of backticks stands before it, from gaps and matches."""
    # Length and backticks of a piece in one number.
    size = lambda x: F.length(x).cast("long") + F.when(x.contains("`"), (F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit("")))).cast("long") * (1 << 32)).otherwise(0)
    widths = F.zip_with(F.transform(gaps, size), F.transform(found, size), lambda g, m: F.struct(g.alias("g"), F.coalesce(m, F.lit(0)).alias("m")))

    def placed(w: Column) -> Column:
        ends = running_sums(F.transform(w, lambda x: x["g"] + x["m"]))

        def one(m: Column, at: Column) -> Column:
            return F.struct((at % (1 << 32) + 1).cast("int").alias("column"), m.alias("match"), (F.floor(at / (1 << 32)) % 2 == 1).alias("coded"))

        starts = F.zip_with(ends, w, lambda e, x: e + x["g"])
        return let(starts, lambda s: F.transform(found, lambda m, i: one(m, F.get(s, i))))

    return let(widths, placed)


def find_all(text: Column, pattern: str) -> Column:
    """Matches with their 1-based code-point columns, and whether they lie in inline code (``coded``: an odd number of
    backticks before them)."""
    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _places(gaps, found)))


def find_overlapping(text: Column, pattern: str) -> Column:
    """The same for a pattern whose matches may overlap, of which one at the most begins at any place: the text is cut
    before each of them, so pieces and matches run side by side."""

    def placed(pieces: Column, found: Column) -> Column:
        width = lambda x: F.length(x).cast("long") + (F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit("")))).cast("long") * (1 << 32)
        first = F.size(pieces) - F.size(found)  # 1 where something stands before the first match

        def one(starts: Column) -> Column:
            def told(m: Column, i: Column) -> Column:
                at = F.get(starts, i + first)
                return F.struct((at % (1 << 32) + 1).cast("int").alias("column"), m.alias("match"), (F.floor(at / (1 << 32)) % 2 == 1).alias("coded"))

            return F.transform(found, told)

        return let(running_sums(F.transform(pieces, width)), one)

    found = F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))
    return let(F.split(text, f"(?={pattern})", -1), lambda pieces: let(found, lambda f: placed(pieces, f)))


def any_of(phrases: list[str], char: Callable[[str], str] = re.escape) -> str:
    """A pattern for any of some literal phrases, as a tree by common beginnings: one branch is tried for each next
    character in place of every phrase. ``char`` gives a character's pattern."""

    def tree(words: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for w in words:
            if w:
                by_first.setdefault(w[0], []).append(w[1:])
        branches = [char(c) + tree(rest) for c, rest in by_first.items()]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
        return f"{inner}?" if "" in words else inner

    return tree(sorted(set(phrases)))


# Characters beside its own two cases that a pattern without regard to case, of Unicode, takes for a letter.
_MORE_CASES = {"i": r"\x{130}\x{131}", "k": r"\x{212a}", "s": r"\x{17f}"}


def _cases(c: str) -> str:
    return f"{c.lower()}{c.upper()}{_MORE_CASES.get(c.lower(), '')}"


def any_case(c: str) -> str:
    """What ``(?iu)`` makes of an ASCII character, as a class: a class fails at once, where the flags look up cases."""
    return f"[{_cases(c)}]" if c.isalpha() else re.escape(c)


def any_word(words: list[str], group: int = 6) -> str:
    """``any_of`` of words of ASCII letters in any case, in groups by their first letters: a place where none begins costs
    one test for each group in place of one for each letter."""
    firsts = sorted({w[0] for w in words})
    groups = [firsts[k : k + group] for k in range(0, len(firsts), group)]
    return "|".join(f"(?=[{''.join(map(_cases, g))}])(?:{any_of([w for w in words if w[0] in g], any_case)})" for g in groups)


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP, -1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COUNTED_WORD))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def first_word(sentence: Column) -> Column:
    return F.lower(F.regexp_extract(lstrip(sentence), FIRST_WORD, 0))
