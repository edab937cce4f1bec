"""The ten detectors as Column functions: each gives an array of ``line, column, excerpt, detail``.

Line detectors take ``lines``, the others ``paras`` or ``lists`` (see ``structure``). Violations stand in the order of
lines and columns, except for clichés, where phrases come first. Each has a twin that counts without telling where: those
of line detectors search ``open``, all open lines as one text, or ``clear`` and ``coded``, its lines without and with a
backtick. No match reaches beyond its line, so a text is searched in one go, and only if it holds what every match has.

Defined results: null and empty texts have no lines, paragraphs or lists, and so no violations. Lines of any length are
searched whole, in time that is proportional to them. Repeated texts give repeated results.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.chars import (
    LATIN_WORD, WORD, WS, any_of, any_word, excerpt, find_all, find_overlapping, let, lstrip, rstrip, split_sentences, strip, token_count, word_count,
)
from inkstone.operators.structure import IN_LINE

VIOLATION = "array<struct<line:int,column:int,excerpt:string,detail:string>>"

# The phrases and words that the rules name.
CLICHES = [
    "ring the changes", "take up the cudgels", "toe the line", "ride roughshod over", "stand shoulder to shoulder with",
    "play into the hands of", "no axe to grind", "grist to the mill", "fishing in troubled waters", "at the end of the day",
    "think outside the box", "level playing field", "low-hanging fruit", "paradigm shift", "moving the needle", "push the envelope",
    "circle back", "deep dive", "cutting-edge", "state of the art", "state-of-the-art", "paves the way", "pave the way", "a novel",
    "novel approach", "novel framework", "novel method", "novel optimization", "advance the state of the art", "game-changer",
    "game changer", "significant step forward", "paradigm-shifting", "best-in-class", "world-class", "next-generation", "next generation",
]
JARGON = [
    "encompass", "burgeoning", "pivotal", "realm", "keen", "adept", "endeavor", "uphold", "imperative", "profound", "ponder", "cultivate",
    "hone", "delve", "embrace", "pave", "embark", "monumental", "scrutinize", "vast", "versatile", "paramount", "foster", "necessitates",
    "provenance", "multifaceted", "nuance", "obliterate", "articulate", "acquire", "underpin", "underscore", "harmonize", "garner",
    "undermine", "gauge", "facet", "bolster", "groundbreaking", "game-changing", "reimagine", "turnkey", "intricate", "trailblazing",
    "unprecedented", "leverages", "leveraging", "leverage", "utilize", "utilizes", "utilizing", "facilitate", "facilitates", "facilitating",
]
LOWER_IN_TITLES = [
    "a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "so", "the", "to", "up", "via", "vs", "yet", "with",
    "over", "per", "into", "from", "onto",
]
OPENERS = ["Additionally", "Furthermore", "Moreover", "In addition"]
CLOSERS = ["Overall,", "In summary,", "In conclusion,", "To summarize,", "All in all,", "In short,", "Ultimately,", "Thus,", "Therefore,"]
CONTRACTION_ENDS = ["s", "t", "re", "ll", "d", "ve", "m"]
SUMMARIES = [
    "these (?:changes|contributions|improvements|updates|results) (?:represent|demonstrate|reflect)",
    "a significant step (?:forward|change|improvement)",
    "represents? a (?:significant|major|substantial) (?:advance|step|improvement)",
]

DASH = r"—|(?<!\p{Nd})–|–(?!\p{Nd})"
CONTRACTION = rf"(?iu)(?<![{WORD}])[a-z]+'(?:{'|'.join(CONTRACTION_ENDS)})(?![{WORD}])"
JARGON_WORD = rf"(?iu)(?<![{WORD}])(?:{any_of(JARGON)})(?![{WORD}])"
ANY_CLICHE = any_of(CLICHES)
# A phrase whose end is a beginning of its own could overlap itself, and is searched for alone; no phrase begins another.
LOOPED = [p for p in CLICHES if any(p[k:] == p[: len(p) - k] for k in range(1, len(p)))]
CLICHE_SEARCHES = [(find_overlapping, any_of([p for p in CLICHES if p not in LOOPED])), *[(find_all, any_of([p])) for p in LOOPED]]
CLOSER = rf"(?iu)^(?:{'|'.join(CLOSERS)})"
SUMMARY = rf"(?iu)(?<![{WORD}])(?:{'|'.join(SUMMARIES)})(?![{WORD}])"
# Possessive, so that a line of very many marks is walked and not recursed into.
MARKUP = rf"^(?:>++[{WS}]*+|[*-][{WS}]++)++"
HEADING = rf"^[{WS}]*+#{{1,6}}+[{WS}]"
TITLE_TOKEN = "[A-Za-z][A-Za-z0-9'/-]*"

# For counting in whole texts, with a line end in front. JARGON_WORD behind the character before it: most places then fail
# at a class that is looked up in a table.
ANY_JARGON = rf"[^{LATIN_WORD}](?<![{WORD}])(?:{any_word(JARGON)})(?![{WORD}])"
# Every cliché has a blank or a hyphen: what follows the first of them, in any case, is a mark of the phrase.
CLICHE_ENDS = [re.split("[ -]", p, maxsplit=1)[1] for p in CLICHES]
CLICHE_MARK = f"[ -](?:{any_word(CLICHE_ENDS)})"
ANY_MARK = f"[^{LATIN_WORD}](?:{any_word(JARGON + CLICHE_ENDS)})"
OPENER_LINE = rf"(?md)^[{IN_LINE}]*+(?:>++[{IN_LINE}]*+|[*-][{IN_LINE}]++)*+(?i:(?:{'|'.join(OPENERS[:3])})(?![a-z-])|{OPENERS[3]})"
NO_PROSE = rf"(?md)^[{IN_LINE}]*+[#|][^\n]*+"
# A sentence's beginning, from the last character before it; what may stand between its words (anything but a line end or a
# gap); and a word with what is before it. A blank or a comma and a blank that a common letter follows is taken at once.
SENTENCE = rf"[\n.!?](?:(?<=\n)|[{IN_LINE}]++(?=[A-Z\"'(\[]))"
BETWEEN = rf"(?:[^{WORD}\n{IN_LINE}]++|(?<![.!?])[{IN_LINE}]++|(?<=[.!?])[{IN_LINE}]++(?![A-Z\"'(\[]))*+"
NEXT_WORD = rf"(?:[{LATIN_WORD}]|{BETWEEN}[{WORD}])(?:[{LATIN_WORD}'-]++|[{WORD}])*+(?:,? (?=[{LATIN_WORD}]))?+"


def _violation(line: Column, column: Column, text: Column, detail: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"), text.alias("excerpt"), detail.alias("detail"))


def _open(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: ~x["hidden"] & x["line"].rlike(pattern))


def _matches(lines: Column, pattern: str, detail) -> Column:
    def one(x: Column) -> Column:
        free = F.filter(find_all(x["line"], pattern), lambda m: ~m["coded"])
        told = lambda m, n: _violation(x["n"], m["column"], excerpt(x["line"], m["column"] - 1, 20, n), detail(m["match"]))
        return let(F.length(x["line"]), lambda n: F.transform(free, lambda m: told(m, n)))

    return F.flatten(F.transform(_open(lines, pattern), one))


def dashes(lines: Column) -> Column:
    """Em and en dashes used as punctuation; en dashes between digits are ranges."""
    return _matches(lines, DASH, lambda m: F.concat(F.when(m == "—", "em").otherwise("en"), F.lit("-dash as casual punctuation")))


def contractions(lines: Column) -> Column:
    return _matches(lines, CONTRACTION, lambda m: F.concat(F.lit("contraction '"), m, F.lit("'")))


def jargon(lines: Column) -> Column:
    return _matches(lines, JARGON_WORD, lambda m: F.concat(F.lit("jargon / AI-tell '"), m, F.lit("'")))


def openers(lines: Column) -> Column:
    """Transition words that open a line, after quote and list marks."""

    def one(x: Column) -> Column:
        after = F.regexp_replace(lstrip(x["line"]), MARKUP, "")
        word = F.lower(F.regexp_extract(after, "^[A-Za-z][A-Za-z-]*", 0))
        found = F.when((word == "in") & F.lower(after).startswith("in addition"), OPENERS[3])
        for opener in OPENERS[:3]:
            found = found.when(word == opener.lower(), opener)
        column = F.length(x["line"]) - F.length(after) + 1
        return F.when(found.isNotNull(), _violation(x["n"], column, excerpt(x["line"], column - 1, 20), F.concat(F.lit("transition opener '"), found, F.lit("'"))))

    return F.filter(F.transform(_open(lines, "(?i)additionally|furthermore|moreover|in addition"), one), lambda v: v.isNotNull())


def heading_text(line: Column) -> Column:
    """The text of a heading line: without the marks before it, and without marks behind it that blanks set apart."""
    inner = strip(F.ltrim(lstrip(line), F.lit("#")))

    def without_marks(t: Column) -> Column:
        return let(F.rtrim(t, F.lit("#")), lambda x: F.when(x != rstrip(x), rstrip(x)).otherwise(t))

    return let(inner, without_marks)


def _unlinked(text: Column) -> Column:
    """Links as their texts."""
    return F.when(text.contains("](") & text.contains(")"), F.regexp_replace(text, r"\[([^\]]*)\]\([^\)]*\)", "$1")).otherwise(text)


def heading_case(lines: Column) -> Column:
    """Headings whose words are not in title case; the detail lists them in order."""
    upper = lambda w: w.rlike("^[A-Z0-9]")

    def one(x: Column) -> Column:
        text = F.regexp_replace(heading_text(x["line"]), "`[^`]*`", "")
        tokens = F.regexp_extract_all(let(text, _unlinked), F.lit(TITLE_TOKEN), F.lit(0))

        def wrong(tokens: Column) -> Column:
            def bad(t: Column, i: Column) -> Column:
                parts = F.exists(F.split(t, "-", -1), lambda p: (p != "") & ~upper(p))
                edge = (i == 0) | (i == F.size(tokens) - 1)
                return F.when(t.contains("-"), parts).when(edge, ~upper(t)).when(F.lower(t).isin(LOWER_IN_TITLES), t != F.lower(t)).otherwise(~upper(t))

            return F.filter(tokens, bad)

        def told(found: Column) -> Column:
            detail = F.concat(F.lit("heading not in title case; violating tokens: "), F.array_join(found, ", "))
            return F.when(F.size(found) > 0, _violation(x["n"], F.lit(1), excerpt(x["line"], F.lit(0), 20), detail))

        return let(let(tokens, wrong), told)

    return F.filter(F.transform(_open(lines, HEADING), one), lambda v: v.isNotNull())


def long_sentences(lines: Column, most: int = 30) -> Column:
    """Sentences of a line with over ``most`` words; headings and table rows are passed over."""

    def one(x: Column) -> Column:
        counted = F.transform(split_sentences(strip(x["line"])), lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))
        over = F.filter(counted, lambda c: c["n"] > most)
        return F.transform(over, lambda c: _violation(x["n"], F.lit(1), excerpt(c["s"], F.lit(0), 20), F.format_string(f"sentence length %d words (>{most})", c["n"])))

    return F.flatten(F.transform(_prose(lines), one))


def _prose(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x["hidden"] & ~x["line"].rlike(rf"^[{WS}]*+(?:[#|]|$)"))


def cliches(lines: Column) -> Column:
    """Clichés anywhere in a line, phrase by phrase; phrases may overlap."""
    order = F.array(*[F.lit(p) for p in CLICHES])

    def one(x: Column) -> Column:
        found = F.concat(*[find(F.lower(x["line"]), pattern) for find, pattern in CLICHE_SEARCHES])
        free = F.filter(found, lambda m: ~m["coded"])
        told = lambda m: _violation(x["n"], m["column"], excerpt(x["line"], m["column"] - 1, 20), F.concat(F.lit("cliché phrase '"), m["match"], F.lit("'")))
        return F.transform(free, lambda m: F.struct(F.array_position(order, m["match"]).alias("p"), x["n"].alias("n"), m["column"].alias("c"), told(m).alias("v")))

    hits = F.flatten(F.transform(_cliched(lines), one))
    return F.transform(F.array_sort(hits), lambda x: x["v"])


def _cliched(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x["hidden"] & F.lower(x["line"]).rlike(ANY_CLICHE))


def list_overuse(lists: Column, lines: Column) -> Column:
    """Lists of one or two items, and lists whose items all have at most eight words."""

    def one(found: Column) -> Column:
        n = F.size(found["items"])
        short = F.forall(found["items"], lambda t: token_count(t) <= 8)
        detail = F.when(n <= 2, F.format_string("list has only %d item(s); consider prose", n)).when(short, F.format_string("list has %d items all ≤ 8 words; consider prose", n))
        first = F.element_at(lines, found["start"])["line"]
        return F.when(detail.isNotNull(), _violation(found["start"], F.lit(1), excerpt(first, F.lit(0), 10), detail))

    return F.filter(F.transform(lists, one), lambda v: v.isNotNull())


def same_starts(paras: Column) -> Column:
    """The first place in each paragraph where two of three neighbouring sentences start alike."""

    def one(p: Column) -> Column:
        f = lambda i: F.coalesce(F.get(p["firsts"], i), F.lit(""))

        def word(i: Column) -> Column:
            own = (f(i) != "") & ((f(i) == f(i + 1)) | (f(i) == f(i + 2)))
            return F.when(own, f(i)).when((f(i + 1) != "") & (f(i + 1) == f(i + 2)), f(i + 1))

        places = F.when(F.size(p["firsts"]) >= 2, F.sequence(F.lit(0), F.size(p["firsts"]) - 2))
        found = F.get(F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), word(i).alias("w"))), lambda x: x["w"].isNotNull()), 0)
        told = lambda x: _violation(p["start"], F.lit(1), excerpt(F.get(p["sentences"], x["i"]), F.lit(0), 10), F.concat(F.lit("consecutive sentences start with '"), x["w"], F.lit("'")))
        return let(found, lambda x: F.when(x.isNotNull(), told(x)))

    return F.filter(F.transform(paras, one), lambda v: v.isNotNull())


def closers(paras: Column) -> Column:
    """Paragraphs whose last sentence restates or sums up."""

    def one(p: Column) -> Column:
        last = F.try_element_at(p["sentences"], F.lit(-1))
        told = _violation(p["start"] + p["n_lines"] - 1, F.lit(1), excerpt(last, F.lit(0), 10), F.lit("paragraph ends with a summary / restatement"))
        return F.when(last.rlike(CLOSER) | last.rlike(SUMMARY), told)

    return F.filter(F.transform(paras, one), lambda v: v.isNotNull())


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _coded(lines: Column, pattern: str, find=find_all) -> Column:
    """How many matches in lines with backticks stand outside of inline code."""
    free = lambda x: F.size(F.filter(find(x, pattern), lambda m: ~m["coded"]))
    return _sum(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), free))


def _count(d: dict[str, Column], pattern: str, *signs: str) -> Column:
    """How many matches stand outside of inline code; each match holds one of ``signs``."""
    held = reduce(or_, [d["clear"].contains(sign) for sign in signs])
    return F.when(held, F.regexp_count(d["clear"], F.lit(pattern))).otherwise(0) + _coded(d["coded"], pattern)


def _led(text: Column) -> Column:
    """``text`` behind a line end."""
    return F.concat(F.lit("\n"), text)


def marked(text: Column) -> Column:
    """Whether a text may hold jargon or clichés; one search for both kinds, after which most texts need no other."""
    return _led(text).rlike(ANY_MARK)


def count_jargon(d: dict[str, Column]) -> Column:
    return F.when(d["marked"], F.regexp_count(_led(d["clear"]), F.lit(ANY_JARGON))).otherwise(0) + _coded(d["coded"], JARGON_WORD)


def count_openers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(OPENER_LINE))


def count_headings(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HEADING))
    found = heading_case(F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(0).alias("n"), F.lit(False).alias("hidden"))))
    return F.when(text.contains("#"), F.size(found)).otherwise(0)


def count_long_sentences(text: Column, most: int = 30) -> Column:
    long = rf"{SENTENCE}(?:{NEXT_WORD}){{{most + 1}}}+"
    prose = F.when(text.contains("#") | text.contains("|"), F.regexp_replace(text, NO_PROSE, "")).otherwise(text)
    return F.regexp_count(_led(prose), F.lit(long))


def count_cliches(d: dict[str, Column]) -> Column:
    def plain(text: Column) -> Column:
        return sum(F.regexp_count(text, F.lit(pattern if find is find_all else f"(?={pattern})")) for find, pattern in CLICHE_SEARCHES)

    lower = F.transform(d["coded"], F.lower)
    coded = sum(_coded(lower, pattern, find) for find, pattern in CLICHE_SEARCHES)
    return F.when(d["marked"] & d["clear"].rlike(CLICHE_MARK), let(F.lower(d["clear"]), plain)).otherwise(0) + F.when(F.size(d["coded"]) > 0, coded).otherwise(0)


def count_lists(lists: Column) -> Column:
    return F.size(F.filter(lists, lambda x: (F.size(x["items"]) <= 2) | F.forall(x["items"], lambda t: token_count(t) <= 8)))


def _alike(firsts: Column) -> Column:
    """Whether two of three neighbouring words in an array are the same."""
    near = lambda w, i: (w != "") & ((w == F.coalesce(F.get(firsts, i + 1), F.lit(""))) | (w == F.coalesce(F.get(firsts, i + 2), F.lit(""))))
    return F.exists(F.transform(firsts, near), lambda x: x)


def count_same_starts(paras: Column) -> Column:
    return F.size(F.filter(paras, lambda p: _alike(p["firsts"])))


#: What a detector finds and how often, without telling where; rules whose findings are few are counted as they are.
KINDS = {
    ("RULE-05", "mechanical"): (lambda d: cliches(d["lines"]), count_cliches),
    ("RULE-06", "mechanical"): (lambda d: jargon(d["lines"]), count_jargon),
    ("RULE-12", "mechanical"): (lambda d: long_sentences(d["lines"]), lambda d: count_long_sentences(d["open"])),
    ("RULE-B", "mechanical"): (lambda d: dashes(d["lines"]), lambda d: _count(d, DASH, "—", "–")),
    ("RULE-D", "mechanical"): (lambda d: openers(d["lines"]), lambda d: count_openers(d["open"])),
    ("RULE-G", "mechanical"): (lambda d: heading_case(d["lines"]), lambda d: count_headings(d["open"])),
    ("RULE-I", "mechanical"): (lambda d: contractions(d["lines"]), lambda d: _count(d, CONTRACTION, "'")),
    ("RULE-A", "structural"): (lambda d: list_overuse(d["lists"], d["lines"]), lambda d: count_lists(d["lists"])),
    ("RULE-C", "structural"): (lambda d: same_starts(d["paras"]), lambda d: count_same_starts(d["paras"])),
    ("RULE-E", "structural"): (lambda d: closers(d["paras"]), lambda d: F.size(closers(d["paras"]))),
}


def all_detectors(mechanical_only: bool = False, rules: list[str] | None = None, counts_only: bool = False) -> dict[tuple[str, str], Column]:
    """Violations by rule and kind, over the columns of ``structure.with_structure``; of ``rules`` only, if given. With
    ``counts_only`` their number instead, also over the columns of ``structure.with_open_text`` and over ``marked``."""
    data = {name: F.col(name) for name in ("lines", "paras", "lists", "open", "clear", "coded", "marked")}
    wanted = [k for k in KINDS if (rules is None or k[0] in rules) and not (mechanical_only and k[1] == "structural")]
    return {k: KINDS[k][counts_only](data) for k in wanted}
