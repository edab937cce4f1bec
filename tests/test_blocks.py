"""Headings by block structure against a reader of lines."""

import random
import re
import time

from inkstone.sources import blocks

CASES = {
    "Title\n===\n\n# One #\n": [(1, 2, 1, "Title"), (4, 4, 1, "One")],
    "a\nb\n---\nc": [(1, 3, 2, "a\nb")],
    "````\n# no\n```\n# no\n````\n# yes\n": [(6, 6, 1, "yes")],
    "~~~ x\n# no\n```\n~~~~ \n## yes ##": [(5, 5, 2, "yes")],
    "``` a`b\n# yes\n": [(2, 2, 1, "yes")],
    "    # code\n# yes\n\t# code\n": [(2, 2, 1, "yes")],
    "para\n    # part\n===\n": [(1, 3, 1, "para\n    # part")],
    "<div>\n# no\n\n# yes\n": [(4, 4, 1, "yes")],
    "<script>\n\n# no\n</script> x\n# yes": [(5, 5, 1, "yes")],
    "<!-- a\n\n# no -->\n# yes\n": [(4, 4, 1, "yes")],
    "<b>\n# no\n\n# yes": [(4, 4, 1, "yes")],
    "<b>x\n# yes\n": [(2, 2, 1, "yes")],
    "text\n<b>\n===\n": [(1, 3, 1, "text\n<b>")],
    "- item\n---\n# yes\n": [(3, 3, 1, "yes")],
    "> quote\nlazy\n===\n\n# yes": [(5, 5, 1, "yes")],
    "***\n---\n# yes": [(3, 3, 1, "yes")],
    "#\n#hash\n####### seven\n###### six\n": [(1, 1, 1, ""), (4, 4, 6, "six")],
    "a\r\n===\r\n# b\r": [(1, 2, 1, "a"), (3, 3, 1, "b")],
    "# a ## b ##\n# c##\n# ###\n": [(1, 1, 1, "a ## b"), (2, 2, 1, "c##"), (3, 3, 1, "")],
    "```\n# open\n": [],
    "": [],
    "\n\n===\n": [],
    "text\n1. one\n---\n": [],
    "text\n2. two\n---\n": [(1, 3, 2, "text\n2. two")],
}


def told(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "file long, text string").selectExpr("file", "text", "'x' as block", "1 as level")
    found = {k: [] for k in range(len(texts))}
    for r in blocks.headings(rows).collect():
        found[r.file].append((r.line, r.last, r.level, r.title))
    return [sorted(x) for x in found.values()]


def reader(text):
    """Fences, indented code, HTML with a blank behind, heading lines and underlines, line by line."""
    found, fence, html, para, skip = [], None, False, [], False
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    for n, line in enumerate(lines, 1):
        if fence:
            close = re.fullmatch(r" {0,3}(`{3,}|~{3,})[ \t]*", line)
            fence = None if close and close[1][0] == fence[0] and len(close[1]) >= len(fence) else fence
            continue
        if html:
            html = bool(line.strip(" \t"))
            continue
        start = re.match(r" {0,3}(?:(`{3,})[^`]*$|(~{3,}))", line)
        under = re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line)
        atx = re.match(r" {0,3}(#{1,6})(?:[ \t](.*))?$", line)
        if not line.strip(" \t"):
            para, skip = [], False
        elif para and under:
            found.append((n - len(para), n, 1 if "=" in line else 2, "\n".join(para).strip(" \t")))
            para = []
        elif start:
            fence, para, skip = start[1] or start[2], [], False
        elif atx:
            title = re.sub(r"(?:^|[ \t]+)#+$", "", (atx[2] or "").strip(" \t"))
            found.append((n, n, len(atx[1]), title))
            para, skip = [], False
        elif re.match(r" {0,3}<div>", line):
            html, para, skip = True, [], False
        elif re.fullmatch(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,})", line):
            para, skip = [], False
        elif re.match(r" {0,3}(?:>|[-*] +\S)", line):
            para, skip = [], True
        elif not para and not skip and re.match(r" {4}|\t", line):
            continue
        elif not skip:
            para.append(line)
    return found


def test_cases(spark):
    assert told(spark, list(CASES)) == list(CASES.values())
    assert told(spark, [None]) == [[]]


def test_equal_to_a_reader_of_lines(spark):
    rng = random.Random(2)
    lines = ["a b", "c", "# h", "## h ##", "===", "---", "- - -", "```", "````", "~~~", "``` x", "    # x", "\t# y", "<div>", "", "", " ", "> q", "- i", "***", "   # z", "####### no", "  ===  "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for _ in range(800)]
    for text, found in zip(texts, told(spark, texts), strict=True):
        assert found == sorted(reader(text)), text


def test_long_texts_take_linear_time(spark):
    texts = ["- " * 500_000, "#" * 1_000_000, "# " + "#" * 1_000_000 + "x", "```\n" + "a\n" * 300_000, "<b " * 300_000, "a\n" * 300_000 + "===", "`" * 1_000_000, "<!-- " * 200_000]
    told(spark, ["# x"])
    began = time.time()
    assert [len(x) for x in told(spark, texts)] == [0, 0, 1, 0, 0, 1, 0, 0]
    assert time.time() - began < 60
