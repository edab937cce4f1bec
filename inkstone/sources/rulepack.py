"""Rule packs: find the file, parse its rules, render the compact form, check it.

Work happens inside the row, so packs of any number need no shuffle. Defined results: a null or empty text has no rules
and no headings; repeated rows give repeated results; columns beside the key and ``text`` are left out, whatever their
names, except in the checks, which keep them.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.chars import WS, let, strip
from inkstone.sources.documents import read_texts

# A rule's block opens with its heading; all other fields stand in its head or behind headings of level 5.
RULE_START = rf"(?m)(?=^####[{WS}]++RULE-[0-9A-I]++:[{WS}]*+[^{WS}])"


def resolve(start: str, name: str = "RULES.md", bundle: str | None = None) -> tuple[str, str]:
    """(source, path) of the nearest pack: in ``start`` or a folder above it, else the bundled one, else an error.

    Local steps only: running other programs and fetching from the network are left out.
    """
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (folder / name).is_file():
            return "project-local", str(folder / name)
    if bundle and Path(bundle).is_file():
        return "package-bundle", bundle
    raise FileNotFoundError(f"no {name} from {start} upwards and no bundle")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the pack at ``path``."""
    return parse(read_texts(spark, path), "file")


def resolve_all(folders: DataFrame, files: DataFrame, name: str = "RULES.md", bundle: str | None = None) -> DataFrame:
    """``folder, source, path`` of the nearest pack of each folder: a file ``name`` in it or in a folder above it, the
    deepest first, else the bundled one; ``source`` is null where there is neither. ``files`` lists the ``path`` of files.

    Folders meet packs by equality of a folder above, so no path is compared with all others; of equal paths one counts.
    Paths have forward slashes, an absolute one begins with a slash; trailing slashes do not count.
    """
    slashed = F.regexp_replace("path", "/+$", "")
    packs = files.select(slashed.alias("path")).where(F.element_at(F.split("path", "/"), -1) == name).distinct()
    packs = packs.select("path", F.when(F.col("path").contains("/"), F.regexp_replace("path", "(?<=.)/[^/]*$|(?<=^/)[^/]*$", "")).otherwise("").alias("at"))
    steps = F.split(F.regexp_replace("folder", "/+$", ""), "/")
    absolute = F.col("folder").startswith("/")
    # The root of relative paths is the empty text, before any step; that of absolute ones is a slash, the empty first step.
    at = lambda n: F.when(absolute & (n == 1), "/").otherwise(F.array_join(F.slice(steps, F.lit(1), n), "/"))
    above = F.transform(F.sequence(absolute.cast("int"), F.size(steps)), lambda n: F.struct(n.alias("depth"), at(n).alias("at")))
    reached = folders.select("folder", F.inline(above)).join(packs, "at")
    best = reached.groupBy("folder").agg(F.max(F.struct("depth", "path")).alias("b")).select("folder", F.col("b.path").alias("path"))
    every = folders.select("folder").distinct().join(best, "folder", "left")
    source = F.when(F.col("path").isNotNull(), "project-local")
    if bundle:
        source = source.otherwise("package-bundle")
    return every.select("folder", source.alias("source"), F.coalesce("path", F.lit(bundle)).alias("path"))


def _fields(head: Column) -> Column:
    """The list fields of a rule's head, as a map from lower-case names to values; of repeated names the first counts."""
    listed = F.filter(F.split(head, "\n", -1), lambda x: x.startswith("- **") & x.contains("**:"))
    name = lambda x: F.lower(F.substring_index(F.substring(x, F.lit(5), F.length(x)), "**:", 1))
    pairs = F.transform(listed, lambda x: F.struct(name(x).alias("k"), strip(F.substring(x, F.instr(x, "**:") + 3, F.length(x))).alias("v")))

    def first_of_each(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(pairs, lambda p: p["k"] == n), F.lit(0))["v"]))

    return let(pairs, first_of_each)


def parse(packs: DataFrame, key: str = "file") -> DataFrame:
    """``key, ord, rule, title, severity, scope, source, directive, rationale``; a missing field is the empty string, and
    so is a directive that no further heading of level 5 follows.

    A text is cut at its rules, a rule at its headings of level 5; every field is then taken from a short piece."""
    blocks = F.filter(F.split("text", RULE_START, -1), lambda b: b.rlike(rf"^####[{WS}]++RULE-"))
    rules = packs.select(key, F.posexplode(blocks).alias("ord", "block")).select(key, (F.col("ord") + 1).alias("ord"), F.split("block", r"(?m)(?=^#####[ \t])", -1).alias("parts"))
    head = F.get("parts", F.lit(0))
    first = F.substring_index(head, "\n", 1)
    tag = F.regexp_extract(first, rf"^####[{WS}]++(RULE-[0-9A-I]++):", 1)
    heading = lambda part: strip(F.regexp_replace(F.substring_index(part, "\n", 1), "^#####", ""))
    body = lambda part: F.when(part.contains("\n"), strip(F.substring(part, F.instr(part, "\n") + 1, F.length(part)))).otherwise("")
    last = F.size("parts") - 1

    def section(title: str, closed: bool) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.lower(heading(F.get("parts", i))) == title.lower())
        return let(F.get(at, F.lit(0)), lambda i: F.when(i.isNotNull() & ((i < last) | F.lit(not closed)), body(F.get("parts", i))).otherwise(""))

    got = rules.select(key, "ord", "parts", tag.alias("rule"), strip(F.substring(first, F.instr(first, ":") + 1, F.length(first))).alias("title"), _fields(head).alias("__fields"))
    field = lambda name: F.coalesce(F.try_element_at("__fields", F.lit(name)), F.lit(""))
    return got.select(
        key, "ord", "rule", "title", F.lower(F.regexp_extract(field("severity"), "^[A-Za-z]+", 0)).alias("severity"), field("scope").alias("scope"), field("source").alias("source"),
        section("Directive", True).alias("directive"), section("Rationale for AI Agent", False).alias("rationale"),
    )


_MARK, _ESCAPE = "\ufdd0", "\ufdd1"
_PAIR = r"(?msd)\A(?>.*?^(?=- BAD))(.*?^- GOOD.*?)(?=^- BAD|^- GOOD|\z)"


def _fences_marked(text: Column) -> Column:
    """``text`` behind a line end, with the noncharacter U+FDD0 before each line from an opening ``` to its closing one,
    so that line patterns pass them by. U+FDD0 in the text itself is escaped; ``_unmarked`` brings it back."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_ESCAPE), F.lit(f"{_ESCAPE}1")), F.lit(_MARK), F.lit(f"{_ESCAPE}0"))
    pieces = F.split(F.concat(F.lit("\n"), plain), r"(?md)(?=^[ \t]*```)", -1)
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.regexp_replace(p, r"(?md)^(?=.)", _MARK)).otherwise(p)), "")


def _unmarked(text: Column) -> Column:
    """A piece of a marked text as it was."""
    return F.replace(F.replace(F.replace(text, F.lit(_MARK), F.lit("")), F.lit(f"{_ESCAPE}0"), F.lit(_MARK)), F.lit(f"{_ESCAPE}1"), F.lit(_ESCAPE))


def _no_blank_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+\z", "")


def headings(packs: DataFrame, key: str = "file") -> DataFrame:
    """``key, line, level, title``: headings of one to six ``#`` outside of ``` fences; lines count from 1, closing ``#``
    and blanks around a title go. A null text has none; repeated rows give repeated headings."""
    lines = packs.select(key, F.posexplode(F.split(_fences_marked(F.col("text")), "\n", -1)).alias("line", "t"))
    heading = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
    found = lines.where(F.col("t").rlike(heading))
    return found.select(key, "line", F.length(F.regexp_extract("t", heading, 1)).alias("level"), _unmarked(F.regexp_extract("t", heading, 2)).alias("title"))


def compact(packs: DataFrame, key: str = "file", intro: str | None = None) -> DataFrame:
    """``key, rules, compact, errors``: the short form of packs, by headings outside of ``` fences.

    What stands before the first heading of level 2 to 4 stays (with ``intro``: up to the title's line, then ``intro``);
    sections of level 2 and 3 stay whole, wherever they stand; of a rule (level 4) its heading, its directive and its
    first complete pair stay: the first BAD line and all up to the end of the first GOOD item behind it, continuation
    lines included, lines in fences not looked at.

    Defined results: ``errors`` names a missing title, directive or pair and headings of level 4 that are no rule (they
    stay as they are). A directive without text keeps its blank lines but the one before the next heading. A null or empty
    text gives one line end and the error of the title. Repeated rows are repeated.
    """
    opens = lambda section, pattern: section.rlike(rf"(?d)\A {{0,3}}{pattern}")
    first_line = lambda x: F.substring_index(x, "\n", 1)
    is_rule = lambda s: opens(s, r"####[ \t]+RULE-")
    part = lambda s, pattern: F.coalesce(F.get(F.filter(F.split(s, r"(?md)(?=^ {0,3}#####[ \t])", -1), lambda x: opens(x, pattern)), F.lit(0)), F.lit(""))
    empty = r"\A([^\n]*+\n*?)\n{1,2}\z"
    directive = lambda s: let(part(s, r"#####[ \t]+Directive[ \t]*(?:\n|\z)"), lambda d: F.when(d.rlike(empty), F.regexp_extract(d, empty, 1)).otherwise(_no_blank_end(d)))
    pairs = lambda s: part(s, r"#####[ \t](?=[^\n]*BAD)(?=[^\n]*GOOD)")
    pair = lambda s: _no_blank_end(F.regexp_extract(pairs(s), _PAIR, 1))
    joined = lambda xs: F.array_join(F.filter(xs, lambda x: x != ""), "\n\n")

    def problems(s: Column) -> Column:
        named = lambda bad, what: F.when(bad, F.concat(first_line(s), F.lit(f": {what}")))
        rule = F.array(named(directive(s) == "", "no directive"), named(pair(s) == "", "no pair"))
        return F.when(is_rule(s), rule).when(opens(s, r"####[ \t]"), F.array(named(F.lit(True), "no rule"))).otherwise(F.array().cast("array<string>"))

    parts = packs.select(key, F.split(_fences_marked(F.col("text")), r"(?md)(?=^ {0,3}#{2,4}[ \t])", -1).alias("parts"))
    head = F.substring(F.get("parts", F.lit(0)), F.lit(2), F.length(F.get("parts", F.lit(0))))
    title = r"(?sd)\A((?:.*?\n)?? {0,3}#[ \t][^\n]*)"
    start = _no_blank_end(head) if intro is None else F.concat(F.regexp_extract(head, title, 1), F.lit(f"\n\n{intro}"))
    split = parts.select(key, head.alias("head"), start.alias("start"), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))).alias("sections"))
    short = lambda s: F.when(is_rule(s), joined(F.array(first_line(s), directive(s), first_line(pairs(s)), pair(s)))).otherwise(_no_blank_end(s))
    text = joined(F.concat(F.array("start"), F.transform("sections", short)))
    errors = F.concat(F.array(F.when(~F.col("head").rlike(title), "no title")), F.flatten(F.transform("sections", problems)))
    return split.select(
        key,
        F.size(F.filter("sections", is_rule)).alias("rules"),
        F.concat(_no_blank_end(_unmarked(text)), F.lit("\n")).alias("compact"),
        F.transform(F.filter(errors, lambda e: e.isNotNull()), _unmarked).alias("errors"),
    )


def check_compact(compacted: DataFrame, rules: int = 21) -> DataFrame:
    """``compact`` with ``problems``: what the compact form must have and must not have."""
    text = F.col("compact")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    tests = [
        (count(r"(?m)^#### RULE-") != rules, "number of rules"),
        (count(r"(?m)^##### Directive$") != rules, "number of directives"),
        (count(r"(?m)^- BAD[^:\n]*:") != rules, "number of BAD examples"),
        (count(r"(?m)^- GOOD[^:\n]*:") != rules, "number of GOOD examples"),
        (count(r"(?m)^##### Rationale") > 0, "a rationale is left"),
        (count(r"(?im)^- \*\*(?:severity|scope|source)\*\*") > 0, "metadata is left"),
        (count(r"(?m)^[ \t]*(?:```|~~~)") % 2 != 0, "a fence is open"),
        (text.contains("\r") | ~text.endswith("\n") | text.endswith("\n\n"), "line ends"),
    ]
    return compacted.withColumn("problems", F.filter(F.array(*[F.when(bad, what) for bad, what in tests]), lambda x: x.isNotNull()))


def check_depth(packs: DataFrame, rules: int = 21) -> DataFrame:
    """``packs`` with ``complete``: as many directives and rationales as rules, and the first rule of each series there."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    whole = (count(r"(?m)^#### RULE-") == rules) & (count(r"(?m)^##### Directive") == rules) & (count(r"(?m)^##### Rationale") == rules)
    return packs.withColumn("complete", whole & F.col("text").rlike(r"(?m)^#### RULE-01:") & F.col("text").rlike(r"(?m)^#### RULE-A:"))


def same_tail(a: Column, b: Column) -> Column:
    """Whether two packs agree from their first heading on (their notes before it may differ)."""
    tail = lambda t: F.regexp_extract(t, r"(?ms)^# .*", 0)
    return tail(a) == tail(b)


def refresh_alias(alias: Column, source: Column) -> Column:
    """The alias's own notes before its first heading, then the source from its first heading on."""
    return F.concat(F.regexp_extract(alias, r"(?s)\A(.*?)(?=^# |\z)".replace("(?s)", "(?ms)"), 1), F.regexp_extract(source, r"(?ms)^# .*", 0))
