import hashlib
import html as html_lib
import re
import time
import uuid

import duckdb

from inkstone.llm import warc

PAGE = """<!DOCTYPE html><html lang="EN"><head><title> A &amp; B
 </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One <b>two</b>&nbsp;three &lt;tag&gt;<br/>
 line &#39;q&#39; &eacute;&#8217;&#x1F600;&nosuch;&#0; 2 < 3</p><a class=x href="/u">link</a><A HREF='v'>w</A></body></html>"""
ROWS = [(1, "http://a/", PAGE), (2, None, "plain é text\r\n\r\n more"), (3, "http://b/", None), (4, "http://c/", ""), (1, "http://a/", PAGE), (5, "http://d/", "<p>" + "word " * 100_000), (None, "u", "<script>open"), (6, "u", "<a>b</ a>&amp;lt;"),
        (7, "u", "<p>word\t one\u00a0 </p>" * 700 + "<!-- a <script>x</script> --> y <style>z <!-- open <svg> <SCRIPT src=x>q</script > end"), (8, "u", "<script>a<b</style>" * 900)]


def records(spark, rows=ROWS):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_id string")
    return warc.derive(warc.responses(pages))


def test_text_and_fields(spark):
    got = {(r.page_id, r.record_type): r for r in records(spark).collect()}
    text = got[1, "conversion"].block
    assert text == "A & B\nOne two three <tag>\nline 'q' é’😀&nosuch;\ufffd 2 < 3\nlinkw"
    meta = dict(x.split(": ", 1) for x in got[1, "metadata"].block.split("\r\n") if x)
    assert meta["title"] == "A &amp; B" and meta["language"] == "en" and meta["outlinks"] == "2" and meta["text-length"] == str(len(text.encode()))
    assert meta["source-payload-digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest() == got[1, "conversion"].source_payload_digest
    assert got[3, "conversion"].block == "" and got[6, "conversion"].block == "b&lt;" and got[2, "conversion"].block == "plain é text\nmore"


def test_records_are_linked_and_digests_hold(spark):
    rows = records(spark).collect()
    assert len(rows) == 2 * len(ROWS)
    assert len({r.record_id for r in rows}) == 2 * (len(ROWS) - 1)  # the repeated row has equal identifiers
    by_source = {}
    for r in rows:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        by_source.setdefault(r.refers_to, set()).add(r.record_type)
    assert all(v == {"metadata", "conversion"} for v in by_source.values())


def test_serialised_records_parse_back(spark):
    made = records(spark)
    key = lambda r: (r.page_id is None, r.page_id or 0, r.record_type)
    back = sorted(warc.read(warc.serialise(made)).select(*made.columns).collect(), key=key)
    assert back == sorted(made.collect(), key=key)
    for r in warc.serialise(made).collect():
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        body = rest.encode()[: int(fields["Content-Length"])]
        assert rest.encode()[len(body) :] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()


def test_source_headers_are_preserved(spark):
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: application/json; charset=latin1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Fold: one\r\n  two: three\r\nbroken line\r\n\r\n"
    rows = warc.responses(spark.createDataFrame([(1, "u", "<p>x</p> &amp;"), (2, "u", "<p>y</p>"), (3, "u", None)], "page_id long, url string, html string")).collect()
    given = [(*r[:1], *r[1:]) for r in rows]
    names = list(rows[0].__fields__)
    own = [http, None, "HTTP/1.0 200\nContent-Type: text/html\n\n"]
    changed = [tuple(h if n == "http" else v for n, v in zip(names, r, strict=True)) for r, h in zip(given, own, strict=True)]
    frame = spark.createDataFrame(changed, "page_id long, target_uri string, payload string, http string, payload_digest string, record_id string, date string, block_digest string")
    got = {(r.page_id, r.record_type): r.block for r in warc.derive(frame.select(*names)).collect()}
    lines = got[1, "metadata"].split("\r\n")
    assert "source-status: 404" in lines and "source-content-type: application/json; charset=latin1" in lines and "source-x-fold: one two: three" in lines
    assert [x for x in lines if "cookie" in x] == ["source-set-cookie: a=1", "source-set-cookie: b=2"] and not any("broken" in x for x in lines)
    assert got[1, "conversion"] == "<p>x</p> &amp;" and got[2, "conversion"] == "y" and got[3, "conversion"] == ""
    assert "source-status: " in got[2, "metadata"].split("\r\n") and "source-status: 200" in got[3, "metadata"].split("\r\n")


def test_identifiers_are_version_five(spark):
    r = warc.responses(spark.createDataFrame([(1, "http://é/", "x")], "page_id long, url string, html string")).first()
    want = uuid.uuid5(uuid.NAMESPACE_URL, f"response|1|http://é/|{r.payload_digest}")
    assert r.record_id == f"<urn:uuid:{want}>" and want.version == 5


def test_references_equal_the_library(spark):
    texts = ["&copy;&middot;&amp;lt; &lt &#65;&#x41;&#X1f600; &;&#;& &Aacute;&aacute;", "a & b", "&#1114112;&#55296;", "&#9;x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.decode_references(warc.F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [html_lib.unescape(t.replace("&lt ", "&amp;lt ")) for t in texts]


def test_hostile_pages_take_linear_time(spark):
    marks = ["<script>a", "<!--", "<script ", "<a ", "<p ", "<title>", "</title><title>", "<style></script>", "<svg <svg>", "<!-->", "&amp", "<html lang", "</script"]
    rows = [(i, "u", m * (1_000_000 // len(m))) for i, m in enumerate(marks)] + [(90, "u", "<style>" * 100_000 + "</script>" * 10 + "</style>x"), (91, "u", "<script>" * 120_000 + "</style>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    warc.derive(warc.responses(pages.where("page_id < 0"))).count()
    for i, _, _ in rows:
        began = time.time()
        warc.derive(warc.responses(pages.where(f"page_id = {i}"))).write.format("noop").mode("overwrite").save()
        assert time.time() - began < 6, i


def test_sql_gives_the_same_rows(spark):
    got = warc.read(warc.serialise(records(spark)))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [list(r) for r in ROWS])
    cursor = con.execute(warc.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()))
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in got.collect()) == want
    assert records(spark, []).count() == 0
