import base64
import gzip
import hashlib
import zlib
from html.parser import HTMLParser

from lectern.llm import common, warc

PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>T &amp;
 t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><!-- x > y --><a href='/a?b=1&amp;c'>one</a> two<p>th<b>r</b>ee<br>4 &lt;5&gt; &eacute;</p><a title="a>b" href="http://e.org/">six</a><br/>a < b</body></html>"""


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        self.out.append("" if self.skip else data.replace("\n", " "))


def test_text_and_metadata():
    assert warc.plain_text(PAGE) == "T & t\none two\nthree\n4 <5> é\nsix\na < b"
    block = warc.metadata_block(PAGE, "HTTP/1.1 200 OK\r\nServer: x\r\n", "http://h.org/d/")
    assert block.split("\r\n") == ["source-header: HTTP/1.1 200 OK", "source-header: Server: x", "title: T & t", "language: fr", "outlink: http://h.org/a?b=1&c", "outlink: http://e.org/", ""]
    assert warc.plain_text("<a" * 20000) == "<a" * 20000 and warc.plain_text("<script>open") == ""


def test_text_matches_a_parser_on_stored_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    lines = lambda t: [x for x in (" ".join(x.split()) for x in t.split("\n")) if x]
    for r in pages:
        p = Plain()
        p.feed(r.html)
        assert lines(warc.plain_text(r.html)) == lines("".join(p.out))


def test_records_link_and_round_trip(spark):
    rows = [(1, "http://h.org/", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "http://[bad", "<a href='//[x'>" + "w " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    source = {(r.page_id, r.record_id): r for r in warc.page_responses(pages).collect()}
    derived = warc.derive(warc.page_responses(pages))
    found = derived.collect()
    assert len(found) == 8 and all((r.page_id, r.refers_to) in source for r in found)
    for r in found:
        digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == digest(bytes(source[r.page_id, r.refers_to].payload))
        assert r.target_uri == source[r.page_id, r.refers_to].target_uri
    assert len({r.record_id for r in found}) == 6
    folder = common.shared_path(spark, "warc")
    assert sum(r.records for r in warc.write_warc(derived, folder).collect()) == 8
    files = spark.read.format("binaryFile").load(folder + "/*.warc.gz").collect()
    back = [(h["warc-record-id"], h["warc-refers-to"], b.decode()) for f in files for h, b in warc.parse(bytes(f.content))]
    assert sorted(back) == sorted((r.record_id, r.refers_to, r.block) for r in found)
    assert warc.derive(warc.page_responses(pages.limit(0))).collect() == []


def test_reads_responses_of_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9</p>"
    data = b"".join(b"WARC/1.0\r\nWARC-Type: " + k + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n" for k in (b"request", b"response"))
    (tmp_path / "a.warc").write_bytes(data)
    found = warc.derive(warc.read_responses(spark, f"file://{tmp_path}")).collect()
    assert {(r.record_type, r.refers_to, r.date) for r in found} == {("metadata", "<urn:uuid:1>", "2020-01-01T00:00:00Z"), ("conversion", "<urn:uuid:1>", "2020-01-01T00:00:00Z")}
    assert [r.block for r in found if r.record_type == "conversion"] == ["café"]


def test_codings_are_undone():
    page, head = b"<p>hello</p>" * 50, "HTTP/1.1 200 OK\r\n"
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(page[i : i + 77]), page[i : i + 77]) for i in range(0, len(page), 77)) + b"0\r\n\r\n"
    assert warc.entity(chunked, head + "Transfer-Encoding: Chunked\r\n") == page
    raw = zlib.compressobj(wbits=-15)
    for coding, data in (("gzip", gzip.compress(page)), ("deflate", zlib.compress(page)), ("deflate", raw.compress(page) + raw.flush()), ("deflate, gzip", gzip.compress(zlib.compress(page))), ("br", page), ("gzip", page)):
        assert warc.entity(data, f"{head}Content-Encoding: {coding}\r\n") == page
    assert warc.entity(gzip.compress(page)[:-9], head + "Content-Encoding: gzip") in page  # cut off
    assert warc.entity(page, head + "Transfer-Encoding: chunked") == page


def test_headers_can_not_be_injected_and_broken_files_are_read_as_far_as_they_go():
    record = {"record_type": "metadata", "record_id": "<urn:uuid:1>", "refers_to": "<urn:uuid:2>", "target_uri": "http://h/\r\nWARC-Type: response\r\n\r\nx", "date": None, "block_digest": "d", "source_payload_digest": "e", "content_type": "text/plain", "block": "a\r\n\r\nWARC/1.1 b"}
    data = warc.serialize(record)
    (fields, block), = warc.parse(data)
    assert fields["warc-type"] == "metadata" and fields["warc-target-uri"] == "http://h/%0D%0AWARC-Type: response%0D%0A%0D%0Ax" and block == record["block"].encode()
    members = b"".join(gzip.compress(data) for _ in range(3))
    assert len(list(warc.parse(members))) == 3 and len(list(warc.parse(members[:-20]))) >= 2 and len(list(warc.parse(b"junk\r\n" + data + b"junk\n" + data))) == 2
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"WARC/1.0\r\n")) == [] and list(warc.parse(b"x" * 3_000_000)) == []
    cut = data[: data.index(b"\r\n\r\n") + 5]
    assert [b for _, b in warc.parse(cut)] == [b"a"]
