"""Canonical bytes, signatures, marker blocks and paths as Column functions.

``owner`` names whoever signs a file or owns a block in it.

Defined results: null texts give null; an empty text has the canonical form of one line end, is unsigned and has no
block. Texts of any length are worked on whole; equal texts give equal results. Only a signature in
the last line counts. A block that stands more than once is told as ambiguous, and such texts stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.chars import let

OWNER = "inkstone"


def canonical(text: Column) -> Column:
    """No byte-order mark, LF line ends, exactly one at the end."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\A\x{feff}", ""), r"\r\n?", "\n")
    return F.concat(F.regexp_replace(plain, r"\n+\z", ""), F.lit("\n"))


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _signature(owner: str) -> str:
    return rf"<!-- owned-by: {re.escape(owner)}; version: v([\p{{L}}\p{{N}}_.+-]+); sha256: ([0-9a-f]{{64}}) -->\n?\z"


def signature(text: Column, owner: str = OWNER) -> Column:
    """``version, sha256`` of the signature at the end of a text; null without one."""
    pattern = _signature(owner)
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("version"), F.regexp_extract(text, pattern, 2).alias("sha256"))
    return F.when(text.rlike(pattern), found)


def strip_signature(text: Column, owner: str = OWNER) -> Column:
    return F.regexp_replace(text, _signature(owner), "")


def _body(text: Column, owner: str) -> Column:
    return F.concat(F.regexp_replace(strip_signature(text, owner), r"\n+\z", ""), F.lit("\n"))


def sign(text: Column, version: str, owner: str = OWNER) -> Column:
    """The text with a signature of its canonical bytes as last line."""
    return let(_body(text, owner), lambda b: F.concat(b, F.lit(f"<!-- owned-by: {owner}; version: v{version}; sha256: "), canonical_hash(b), F.lit(" -->\n")))


def verify(text: Column, owner: str = OWNER) -> Column:
    """'valid', 'mismatch' or 'unsigned'."""
    declared = signature(text, owner)["sha256"]
    return F.when(declared.isNull(), "unsigned").when(declared == canonical_hash(_body(text, owner)), "valid").otherwise("mismatch")


def _marks(owner: str) -> tuple[str, str]:
    return rf"<!-- BEGIN {re.escape(owner)}(?: v[\p{{L}}\p{{N}}_.+-]+)? -->", rf"<!-- END {re.escape(owner)} -->"


def block_state(text: Column, owner: str = OWNER) -> Column:
    """'none', 'one', or 'ambiguous' where marks are not exactly one pair in order."""
    begin, end = _marks(owner)
    b, e = F.regexp_count(text, F.lit(begin)), F.regexp_count(text, F.lit(end))
    ordered = text.rlike(rf"(?s){begin}.+{end}")
    return F.when((b == 0) & (e == 0), "none").when((b == 1) & (e == 1) & ordered, "one").otherwise("ambiguous")


def _around(text: Column, owner: str) -> tuple[Column, Column]:
    begin, end = _marks(owner)
    return F.split(text, begin, -1)[0], F.element_at(F.split(text, end, -1), -1)


def upsert_block(text: Column, version: str, content: Column, owner: str = OWNER) -> Column:
    """``text, action``: the block replaced in place or added at the end; ambiguous texts stay, with action 'error'."""
    body = F.regexp_replace(content, r"\A\n+|\n+\z", "")
    block = F.concat(F.lit(f"<!-- BEGIN {owner} v{version} -->\n"), body, F.lit(f"\n<!-- END {owner} -->"))
    before, after = _around(text, owner)
    gap = F.when(text == "", "").when(~text.endswith("\n"), "\n\n").when(~text.endswith("\n\n"), "\n").otherwise("")
    state = block_state(text, owner)
    new = F.when(state == "one", F.concat(before, block, after)).when(state == "none", F.concat(text, gap, block, F.lit("\n"))).otherwise(text)
    action = F.when(state == "one", "update-marker").when(state == "none", "create").otherwise("error")
    return F.struct(new.alias("text"), action.alias("action"))


def remove_block(text: Column, owner: str = OWNER) -> Column:
    """``text, action``: the text without its block and with at most one blank line in its place."""
    before, after = _around(text, owner)
    before, after = F.regexp_replace(before, r"\n+\z", ""), F.regexp_replace(after, r"\A\n+", "")
    joined = F.when((before != "") & (after != ""), F.concat(before, F.lit("\n\n"), after)).otherwise(F.concat(before, after))
    state = block_state(text, owner)
    action = F.when(state == "one", "remove-marker").when(state == "none", "noop").otherwise("error")
    return F.struct(F.when(state == "one", joined).otherwise(text).alias("text"), action.alias("action"))


def posix_path(path: Column) -> Column:
    """Forward slashes, without one leading './'."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A\./", "")
