"""Personal data: base patterns, and bootstrapped extraction of what they miss.

Base spans (email, ip, card, phone) come from one pass over the texts. They are the seeds. The same pass lists
candidates: runs of neighbouring tokens with five to ``most_digits`` digits, in whatever number of groups, or an ``@``
that touch no base span, such as a telephone number that the greedy base pattern ran together with the card number after
it. Marks behind a token do not belong to it, and end a run unless they are closing brackets.

Each seed and candidate induces lexical patterns: its written shape (digits as 0, letters as a), and its cue, the word
right before it that ends in a colon, an equals sign or a hash, together with the characters it uses. Patterns and
instances form a graph, which Spark scores in rounds:

    confidence(pattern, kind) = sum of its instances' scores for the kind / (number of its instances + 1)
    score(candidate, kind)    = the greatest confidence of its patterns that have at least ``support`` of score

Seeds keep score 1 for their kind. Rounds go on until no score changes in its third decimal; scores only rise, and stay
below 1, so they settle. Then candidates with a score of ``accept`` or more are added,
provided they are valid for their kind (digits in range, Luhn for cards). Where added spans of a kind overlap, the
better, then longer, then earlier one stays.

Scale: text crosses to Python once and only entities and candidates come back. Copies of an instance are merged before
the graph is built, sums combine before they shuffle, and only patterns at or over the least useful confidence go into
the join that spreads scores. Joins on patterns and surfaces, which very many rows may share, are dealt over salts.

Defined results: a null text is an empty one and has no spans. Rows with the same doc_id and text get the same spans,
rows with the same doc_id and different texts their own. Extra columns are left behind by ``find`` and kept by
``redact``. Empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices
from inkstone.runtime import cut_lineage

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_HINT = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_FRONT = re.compile(r"[^0-9A-Za-z+(]*")
_PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


def _ip_parts(found: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _card_number(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_number(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards: the part before it is the whole run of its letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    if not _HINT.search(text):
        return []
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, valid in (("ip", _IP, _ip_parts), ("card", _CARD, _card_number), ("phone", _PHONE, _phone_number)):
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return spans


def shape(surface: str) -> str:
    return re.sub("[0-9]", "0", re.sub("[^\\W\\d_]", "a", surface))


def valid_kinds(surface: str) -> list[str]:
    """Kinds that a candidate can be."""
    found = []
    if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", surface):
        found.append("email")
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", surface) and _ip_parts(surface):
        found.append("ip")
    if re.fullmatch(r"[0-9](?:[ -]?[0-9])+", surface) and _card_number(surface):
        found.append("card")
    if re.fullmatch(r"\+?[(0-9][ ().0-9-]*[0-9]", surface) and _phone_number(surface):
        found.append("phone")
    return found


def _cue(text: str, start: int) -> str:
    """The word that ends, in a colon, an equals sign or a hash, right before ``start``, or ''."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    at = end
    while at and text[at - 1] in ":=#":
        at -= 1
    if at == end:
        return ""
    while at and (text[at - 1].isalnum() or text[at - 1] in "._-/"):
        at -= 1
    return text[at:end]


def _patterns(text: str, start: int, surface: str) -> list[str]:
    written = shape(surface)
    found = [f"shape {written}"]
    if cue := _cue(text, start):
        used = "".join(sorted(set(re.sub("a+", "a", written))))
        found.append(f"cue {_DIGIT.sub('0', cue.lower())} {used}")
    return found


def instances(text: str, spans: list[Span], most_digits: int = 19) -> list[tuple]:
    """Seeds and candidates of a text: (start, end, surface, seed's kind or '', patterns)."""
    found = [(a, b, text[a:b], kind, _patterns(text, a, text[a:b])) for kind, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    run: list[tuple[int, int, int, int]] = []  # start, end without marks, end, digits; every part has a digit
    at = 0

    def grams():
        for i, (a, *_) in enumerate(run):
            digits = 0
            for j in range(i, len(run)):
                b, digits = run[j][1], digits + run[j][3]
                if digits > most_digits:
                    break
                if digits >= 5:
                    found.append((a, b, text[a:b], "", _patterns(text, a, text[a:b])))
        run.clear()

    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        free = at == len(taken) or taken[at][0] >= b
        if not free or not _HINT.search(m[0]):
            grams()
            continue
        low, high = _FRONT.match(text, a, b).end(), b
        while high > low and text[high - 1] not in _PLAIN:
            high -= 1
        if "@" in m[0]:  # an address never goes over white space
            grams()
            if low < high:
                found.append((low, high, text[low:high], "", _patterns(text, low, text[low:high])))
            continue
        if run and text[run[-1][2] : low] != " ":
            grams()
        if low < high:
            run.append((low, high, b, sum(map(str.isdigit, text[low:high]))))
        if text[high:b].strip(")"):  # more than brackets was cut off behind the token: no longer run goes over it
            grams()
    grams()
    return found


def _join(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


_SCAN = "doc_id long, text_hash long, base string, found array<struct<start:long,end:long,surface:string,kind:string,patterns:array<string>,valid:array<string>>>"


def scan(docs: DataFrame, most_digits: int = 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and instances of each row."""

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string())), ("valid", pa.list_(pa.string()))])
        for batch in slices(batches):
            base, found = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append(_join(spans))
                rows = instances(text, spans, most_digits) if spans or _HINT.search(text) else []
                found.append([(a, b, s, k, p, [] if k else valid_kinds(s)) for a, b, s, k, p in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(base), pa.array(found, pa.list_(kind))], ["doc_id", "text_hash", "base", "found"]
            )

    plain = id_and_text(docs, id_col, text_col)
    return plain.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, _SCAN)


def _dealt(rows: DataFrame, by: list, side: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """``rows`` join ``side`` (small rows) on keys that very many rows may share."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies, [*on, "salt"]).drop("salt")


def score_graph(edges: DataFrame, support: float = 3.0, useful: float = 0.5, rounds: int | None = None) -> DataFrame:
    """``surface, kind, score`` of seeds (1.0) and of the candidates that the graph reaches, once nothing changes (or after
    ``rounds``); its edges are ``pattern, surface, kind``, the kind being a seed's or ''."""
    edges = cut_lineage(edges.groupBy("pattern", "surface").agg(F.max("kind").alias("kind")))
    seeds = edges.where("kind <> ''").select("surface", "kind").distinct().withColumn("score", F.lit(1.0))
    sizes = cut_lineage(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    open_edges = edges.where("kind = ''").select("pattern", "surface")
    scores, state, done = seeds, None, 0
    while rounds is None or done < rounds:
        told = edges.select("pattern", "surface").join(scores, "surface").groupBy("pattern", "kind").agg(F.sum("score").alias("told"))
        sure = told.where(F.col("told") >= support).join(sizes, "pattern").withColumn("confidence", F.col("told") / (F.col("n") + 1))
        sure = sure.where(F.col("confidence") >= useful).select("pattern", "kind", "confidence")
        reached = _dealt(open_edges, ["surface"], sure, ["pattern"])
        found = cut_lineage(reached.groupBy("surface", "kind").agg(F.max("confidence").alias("score")))
        scores, done, before = seeds.unionByName(found), done + 1, state
        state = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("surface", "kind", F.round("score", 3)).cast("decimal(38,0)"))).first())
        if state == before:
            break
    return scores


def find(docs: DataFrame, accept: float = 0.7, rounds: int | None = None, support: float = 3.0, most_digits: int = 19, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``doc_id, text_hash, base``; added spans ``doc_id, text_hash, kind, start, end, score``)."""
    scanned = cut_lineage(scan(docs, most_digits, id_col, text_col))
    each = scanned.where(F.size("found") > 0).select("doc_id", "text_hash", F.explode("found").alias("x")).select("doc_id", "text_hash", "x.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "surface", "kind")
    good = score_graph(edges, support, rounds=rounds).where(F.col("score") >= accept)
    options = each.where("kind = ''").select("doc_id", "text_hash", "start", "end", "surface", F.explode("valid").alias("kind"))
    added = _dealt(options, ["doc_id", "text_hash", "start"], good, ["surface", "kind"]).select("doc_id", "text_hash", "kind", "start", "end", "score").distinct()
    return scanned.select("doc_id", "text_hash", "base"), cut_lineage(added)


def settle(added: list[tuple]) -> list[Span]:
    """Of overlapping additions (kind, start, end, score) the best: by score, then length, then start, then kind."""
    kept: list[Span] = []
    starts: list[int] = []  # of what is kept, in order, with the ends
    ends: list[int] = []
    for kind, a, b, _ in sorted(added, key=lambda x: (-x[3], x[1] - x[2], x[1], KINDS.index(x[0]))):
        at = bisect_left(starts, b)  # the last kept span that starts before this one's end
        if at == 0 or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            kept.append((kind, a, b))
    return kept


def _parse(text: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]


def _per_text(added: DataFrame) -> DataFrame:
    return added.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "score"))).alias("added"))


def _with_added(rows: DataFrame, added: DataFrame, most: int = 100_000) -> DataFrame:
    """Attach additions to rows by doc_id and text; they are broadcast only where there are few."""
    lists = cut_lineage(_per_text(added)).withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash", "added": "__added"})
    few = added.count() <= most
    same = rows["doc_id"].eqNullSafe(F.col("__doc")) & (rows["text_hash"] == F.col("__hash"))
    return rows.join(F.broadcast(lists) if few else lists, same, "left").drop("__doc", "__hash")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, counts and digest of base spans, and all spans, of each row."""
    base, added = find(docs, id_col=id_col, text_col=text_col, **options)

    def run(batches):
        for batch in slices(batches, 4096):
            spans = []
            for own, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                more = settle([(x["kind"], x["start"], x["end"], x["score"]) for x in more or []])
                spans.append(_join(_parse(own) + more) if more else own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.string())], ["doc_id", "base", "spans"])

    told = _with_added(base, added).select("doc_id", "base", "__added").mapInArrow(run, "doc_id long, base string, spans string")
    counts = [F.regexp_count("base", F.lit(f"(?:^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return told.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all spans masked; every column stays, ``n_chars`` follows the text if there is one."""
    _, added = find(docs, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"),
    )
    joined = _with_added(keyed, added).select(F.col(f"row.`{text_col}`").alias("text"), "row", "__added")

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text, more in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                more = settle([(x["kind"], x["start"], x["end"], x["score"]) for x in more or []])
                spans = base_spans(text) + more if text else []
                texts.append(mask(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "row"])

    schema = joined.select("text", "row").schema
    masked = joined.mapInArrow(run, schema)
    out = {text_col: F.col("text")}
    if "n_chars" in names:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`").alias(c) for c in names])
