"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

``responses`` turns a table of pages into response records (HTTP header block and payload). ``derive`` makes of each one
    metadata     application/warc-fields: title, number of links, language, sizes, and the source's status, headers
                 (in their order, as ``source-<name>``) and digests
    conversion   text/plain: the payload without markup; a payload that is declared to be no HTML stays as it is
Both carry WARC-Refers-To with the response's identifier, its target URI and date. Identifiers are version-5 UUIDs of what
a record is made from, so a retried task writes the same ones. Digests are SHA-256 in hexadecimal. ``serialise`` writes
records as they stand in a file, ``read`` takes them apart again.

Each row is converted on its own: no shuffle, no Python; the two records come from one pass over the payload. The time
grows with the page whatever it holds: patterns that run up to a closing mark are only tried where one follows. Pages with
a comment or dropped element that nothing closes (rare, and found by plain searches) first get those openings renamed.

Defined results: a null payload is an empty one, a null header block an empty one; a null URL leaves out the target
headers. A dropped element ends at the next ``</name``. References that name no character stay; numbers that are none
become U+FFFD. Header lines without a colon are left out, folded ones joined. Equal rows give equal records with equal
identifiers. Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.chars import let

# Elements whose content is no text, and tags that end a line.
DROPPED = ("script", "style", "noscript", "template", "svg")
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|section|article|aside|main|header|footer|nav|title|head|body|html|blockquote|pre|form|hr)(?:[ \t\r\n/][^>]*)?>"
TAG = r"<[!/?a-zA-Z][^>]*>"
#: Comments and dropped elements in one pattern: one pass over the page.
UNSEEN = rf"(?is)<(?:!--.*?-->|({'|'.join(DROPPED)})(?:[ \t\r\n/][^<>]*)?>.*?</\1[^<>]*>?)"
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
TITLE = r"(?is)<title[^<>]*>(.*?)</title"
LINK = r"(?i)<a[ \t\r\n][^<>]*href[ \t]*="
LANGUAGE = r"""(?i)<html[^<>]*[ \t\r\n]lang[ \t]*=[ \t]*["']?([A-Za-z-]+)"""
#: Runs of blanks but for a single space, which stays as it is.
BLANKS = r"[\t\r\f\x0b\x{a0}][ \t\r\f\x0b\x{a0}]*| [ \t\r\f\x0b\x{a0}]+"
HTML_TYPE = r"(?i)^(?:text/html|application/xhtml\+xml)?[ \t]*(?:;|$)"
#: Namespace of names that are URLs (RFC 4122).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _closed(html: Column) -> Column:
    """``html`` with openings renamed that no closing mark follows, so that no pattern looks for one in vain."""
    marks = [("<!--", "-->", "<!unclosed")] + [(f"<{name}", f"</{name}", f"<unclosed-{name}") for name in DROPPED]

    def lost(low: Column) -> Column:
        """The marks that stand in a lower-cased page after their last closing mark."""
        return F.filter(F.array(*[F.when(F.substring_index(low, end, -1).contains(start), k) for k, (start, end, _) in enumerate(marks)]), lambda k: k.isNotNull())

    def renamed(text: Column, k: Column) -> Column:
        start, end, other = (F.element_at(F.array(*[F.lit(m[i]) for m in marks]), k + 1) for i in range(3))

        def after(head: Column) -> Column:
            return F.concat(head, F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), F.concat(F.lit("(?i)"), start), other))

        return let(F.coalesce(F.regexp_substr(text, F.concat(F.lit("(?is)^.*"), end)), F.lit("")), after)

    return F.aggregate(let(F.lower(html), lost), html, renamed)


def decode_references(text: Column) -> Column:
    """Character references, named (those of HTML 4) and numeric, as the characters they name."""
    names = sorted(name2codepoint, key=lambda n: (n not in ("nbsp", "amp", "quot", "lt", "gt", "copy", "middot"), n))
    table = F.create_map(*[F.lit(x) for n in names for x in (n, chr(name2codepoint[n]))], F.lit("apos"), F.lit("'"))

    def one(piece: Column) -> Column:
        kept = F.concat(F.lit("&"), piece)

        def by(ref: Column) -> Column:
            rest = F.substring(piece, F.length(ref) + 2, F.length(piece))
            number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).cast("int")
            valid = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            char = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")
            named = let(F.try_element_at(table, ref), lambda c: F.when(c.isNotNull(), F.concat(c, rest)).otherwise(kept))
            return F.when(ref == "", kept).when(ref.startswith("#"), F.concat(let(number, char), rest)).otherwise(named)

        return let(F.regexp_extract(piece, REFERENCE, 1), by)

    def whole(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&", -1), whole)).otherwise(t))


def plain_text(html: Column, long_page: int = 8192) -> Column:
    """The text of a page: one line per block, no blank lines. On shorter pages than ``long_page`` bytes patterns may look
    for a closing mark in vain, which changes the time, never the text."""
    # No tag begins after the last >, so the patterns of tags always find their end in the part before it.
    def marked(tail: Column) -> Column:
        head = F.when(F.contains(html, F.lit(">")), F.substring(html, F.lit(1), F.length(html) - F.length(tail))).otherwise("")
        text = F.regexp_replace(let(head, lambda h: F.when(F.octet_length(h) > long_page, _closed(h)).otherwise(h)), UNSEEN, " ")
        return F.concat(F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, ""), tail)

    text = decode_references(let(F.substring_index(html, ">", -1), marked))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def _uuid(name: Column) -> Column:
    """Version-5 UUID of a name, as a URN."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages: ``page_id, record_id, target_uri, date, http, payload, payload_digest, block_digest``.

    An empty page is a 404 response of plain text; the headers name the page's location and language where it has them.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    empty = F.col("payload") == ""
    language = F.regexp_extract("payload", LANGUAGE, 1)
    http = F.concat(
        F.when(empty, "HTTP/1.1 404 Not Found\r\n").otherwise("HTTP/1.1 200 OK\r\n"),
        header("Content-Type", F.when(empty, "text/plain").otherwise("text/html; charset=utf-8")),
        F.when(language != "", header("Content-Language", language)).otherwise(""),
        F.coalesce(header("Content-Location", F.col("target_uri")), F.lit("")),
        header("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"),
    )
    rows = rows.withColumn("http", http).withColumn("payload_digest", _digest(F.col("payload")))
    name = F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), "target_uri", "payload_digest")
    return rows.withColumn("record_id", _uuid(name)).withColumn("date", F.lit(date)).withColumn("block_digest", _digest(F.concat("http", "payload")))


def http_fields(http: Column) -> tuple[Column, Column]:
    """(status, array of ``name`` in lower case and ``value``) of a header block."""
    head = F.regexp_replace(F.substring_index(F.coalesce(http, F.lit("")), "\r\n\r\n", 1), r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(head, r"\r?\n", -1), lambda x: x.rlike("^[^: \t]+:"))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.regexp_extract(head, r"^HTTP/[0-9.]+ ([0-9]{3})", 1), fields


def derive(found: DataFrame) -> DataFrame:
    """The two derived records of each response, as header columns and a block."""
    html = F.coalesce("payload", F.lit(""))
    low = F.lower(html)
    titled = F.substring(html, F.lit(1), F.length(low) - F.length(F.substring_index(low, "</title", -1)))  # up to the last closing mark
    title = F.trim(F.regexp_replace(F.regexp_extract(titled, TITLE, 1), r"[ \t\r\n]+", " "))
    status, fields = http_fields(F.col("http"))
    rows = found.withColumn("payload", html).withColumn("status", status).withColumn("fields", fields).withColumn("title", title)
    declared = F.coalesce(F.get(F.filter("fields", lambda x: x["name"] == "content-type"), F.lit(0))["value"], F.lit(""))
    rows = rows.withColumn("text", F.when(declared.rlike(HTML_TYPE), plain_text(F.col("payload"))).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))
    block = F.concat(
        line("title", F.col("title")),
        line("language", F.lower(F.regexp_extract("payload", LANGUAGE, 1))),
        line("outlinks", F.regexp_count("payload", F.lit(LINK))),
        line("text-length", F.octet_length("text")),
        line("source-length", F.octet_length("payload")),
        line("source-status", F.col("status")),
        F.array_join(F.transform("fields", lambda x: F.concat(F.lit("source-"), x["name"], F.lit(": "), x["value"], F.lit("\r\n"))), ""),
        line("source-payload-digest", F.col("payload_digest")),
        line("source-block-digest", F.col("block_digest")),
    )
    record = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(record("metadata", "application/warc-fields", block), record("conversion", "text/plain; charset=utf-8", F.col("text")))
    made = rows.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.inline(both))
    return made.select(
        "page_id", "record_type",
        _uuid(F.concat_ws("|", "record_type", "record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        _digest(F.col("block")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        "block",
    )


def serialise(records: DataFrame) -> DataFrame:
    """``page_id, record``: each derived record as it stands in a WARC file."""
    head = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(value).cast("string"), F.lit("\r\n")), F.lit(""))
    return records.select(
        "page_id",
        F.concat(
            F.lit("WARC/1.1\r\n"), head("WARC-Type", "record_type"), head("WARC-Record-ID", "record_id"),
            head("WARC-Refers-To", "refers_to"), head("WARC-Refers-To-Target-URI", "target_uri"), head("WARC-Refers-To-Date", "date"),
            head("WARC-Target-URI", "target_uri"), head("WARC-Date", "date"), head("WARC-Block-Digest", "block_digest"),
            head("WARC-Source-Payload-Digest", "source_payload_digest"),
            head("Content-Type", "content_type"), head("Content-Length", "content_length"), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
        ).alias("record"),
    )


def read(written: DataFrame) -> DataFrame:
    """The columns of ``derive`` from serialised records, with the size and digest of what was read."""
    head = F.substring_index("record", "\r\n\r\n", 1)
    rows = written.withColumn("head", head)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    block = F.substring("record", F.length("head") + 5, F.length("record") - F.length("head") - 8)
    return rows.select(
        "page_id", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"), field("Content-Type").alias("content_type"),
        field("Content-Length").cast("long").alias("content_length"), field("WARC-Block-Digest").alias("block_digest"),
        field("WARC-Source-Payload-Digest").alias("source_payload_digest"), block.alias("block"),
        F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"),
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle() -> str:
    end = "|| chr(13) || chr(10)"
    unseen = "(?is)<!--.*?-->|" + "|".join(rf"<{name}(?:[ \t\r\n/][^<>]*)?>.*?</{name}[^<>]*>?" for name in DROPPED)
    text = f"regexp_replace(payload, {_sql(unseen)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {_sql(BREAKS)}, chr(10), 'g'), {_sql(TAG)}, '', 'g')"
    names = ", ".join(f"{_sql(n)}: chr({c})" for n, c in {**name2codepoint, "apos": 39}.items())
    number = "case when x.ref ilike '#x%' then ('0x' || substr(x.ref, 3))::bigint when x.ref like '#%' then substr(x.ref, 2)::bigint end"
    char = f"case when {number} is null then list_extract(map_extract(names, x.ref), 1) when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr(({number})::int) else chr(65533) end"
    pieces = f"list_transform(string_split(marked, '&')[2:], lambda p: {{'p': p, 'ref': regexp_extract(p, {_sql(REFERENCE)}, 1)}})"
    decoded = f"string_split(marked, '&')[1] || coalesce(array_to_string(list_transform({pieces}, lambda x: coalesce({char} || substr(x.p, length(x.ref) + 2), '&' || x.p)), ''), '')"
    clean = rf"regexp_replace(regexp_replace({decoded}, '[ \t\r\f\x0b\x{{a0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    clean = rf"case when payload = '' then '' else regexp_replace({clean}, '^[ \n]+|[ \n]+$', '', 'g') end"
    hexed = lambda x: f"sha1(unhex('{NAMESPACE}') || encode({x}))"
    uuid = lambda x: (
        f"'<urn:uuid:' || substr({hexed(x)}, 1, 8) || '-' || substr({hexed(x)}, 9, 4) || '-5' || substr({hexed(x)}, 14, 3) || '-' || "
        f"translate(substr({hexed(x)}, 17, 1), '0123456789abcdef', '{'89ab' * 4}') || substr({hexed(x)}, 18, 3) || '-' || substr({hexed(x)}, 21, 12) || '>'"
    )
    source = uuid("concat_ws('|', 'response', page_id::varchar, target_uri, payload_digest)")
    return rf"""
with names as (select map {{{names}}} as names), r as (
  select page_id, url as target_uri, coalesce(html, '') as payload, 'sha256:' || sha256(coalesce(html, '')) as payload_digest,
         strlen(coalesce(html, '')) as size, regexp_extract(coalesce(html, ''), {_sql(LANGUAGE)}, 1) as lang
  from pages
), s as (
  select *, {source} as source_id,
         case when payload = '' then 'text/plain' else 'text/html; charset=utf-8' end as type,
         case when payload = '' then '404 Not Found' else '200 OK' end as status, {text} as marked
  from r
), t as (
  select *, {clean} as text,
         'sha256:' || sha256('HTTP/1.1 ' || status {end} || 'Content-Type: ' || type {end} || case when lang <> '' then 'Content-Language: ' || lang {end} else '' end
           || coalesce('Content-Location: ' || target_uri {end}, '') || 'Content-Length: ' || size {end} {end} || payload) as source_block,
         trim(regexp_replace(regexp_extract(payload, {_sql(TITLE)}, 1), '[ \t\r\n]+', ' ', 'g')) as title,
         len(regexp_extract_all(payload, {_sql(LINK)})) as links
  from s cross join names
), b as (
  select page_id, 'metadata' as record_type, source_id, target_uri, 'application/warc-fields' as content_type, payload_digest,
         'title: ' || title {end} || 'language: ' || lower(lang) {end} || 'outlinks: ' || links {end} || 'text-length: ' || strlen(text) {end}
         || 'source-length: ' || size {end} || 'source-status: ' || substr(status, 1, 3) {end} || 'source-content-type: ' || type {end}
         || case when lang <> '' then 'source-content-language: ' || lang {end} else '' end
         || coalesce('source-content-location: ' || target_uri {end}, '') || 'source-content-length: ' || size {end}
         || 'source-payload-digest: ' || payload_digest {end} || 'source-block-digest: ' || source_block {end} as block
  from t
  union all
  select page_id, 'conversion', source_id, target_uri, 'text/plain; charset=utf-8', payload_digest, text from t
), d as (
  select *, {uuid("concat_ws('|', record_type, source_id)")} as record_id, '1970-01-01T00:00:00Z' as date, strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest
  from b
), w as (
  select *, 'WARC/1.1' {end} || 'WARC-Type: ' || record_type {end} || 'WARC-Record-ID: ' || record_id {end} || 'WARC-Refers-To: ' || source_id {end}
         || coalesce('WARC-Refers-To-Target-URI: ' || target_uri {end}, '') || 'WARC-Refers-To-Date: ' || date {end} || coalesce('WARC-Target-URI: ' || target_uri {end}, '')
         || 'WARC-Date: ' || date {end} || 'WARC-Block-Digest: ' || block_digest {end} || 'WARC-Source-Payload-Digest: ' || payload_digest {end}
         || 'Content-Type: ' || content_type {end} || 'Content-Length: ' || content_length {end} {end} || block {end} {end} as record
  from d
)
select page_id, record_type, record_id, source_id as refers_to, target_uri, date, content_type, content_length, block_digest,
       payload_digest as source_payload_digest, block, strlen(record)::bigint as record_length, sha256(record) as record_sha256
from w
"""


ORACLE_SQL = _oracle()
