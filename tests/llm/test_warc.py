import base64
import hashlib
import io
import json
import time

import pytest

from probity.llm.queries import QUERIES
from probity.llm.warc import build_derivatives, derive, frame_record, language, links, parse_warc, plain_text, read_warc, tags, title, write_warc

BREAKS = set("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html body head title li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
PAGE = """<!DOCTYPE html><html lang="fr"><head><title>Caf&eacute; &amp; co</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body><nav><a href="/a">A</a></nav><!-- hidden --><p>One <b>two</b><br>three<p title="a > b">four &lt;five&gt;<img src='x.png'></body></html>"""


def pages(spark):
    rows = [(1, "https://h.example/d/p", PAGE), (2, None, None), (3, "u", ""), (None, "https://h.example/", "<p>x"), (1, "https://h.example/d/p", PAGE), (4, "u", "<p>" + "long " * 50_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_id string")


def test_text():
    assert plain_text(PAGE) == "Café & co\nA\nOne two\nthree\nfour <five>"
    assert plain_text("a<script>never closed") == "a" and plain_text("") == ""


def test_language_of_the_whole_page(spark):
    late = f"<!-- {'x' * 10_000} lang=xx --><script>lang='yy'</script><p title='lang=zz' data-lang='ww'>a</p><HTML class=a lang = 'pt-BR'>"
    got = spark.createDataFrame([(1, "u", late)], "page_id long, url string, html string")
    meta = [json.loads(r.block) for r in build_derivatives(got).where("record_type = 'metadata'").collect()]
    assert meta[0]["HTML-Metadata"]["Language"] == "pt-BR"
    assert language("<html><body lang=de><p lang=en>") == "de" and language("<body lang=de><html lang=fr>") == "fr"
    assert language("no tag lang=en") is None and language("<html lang=''><p lang=it>") == "it"
    assert language('<html xmlns="x" xml:lang="nl">') == "nl"


def test_linked_records(spark):
    got = build_derivatives(pages(spark)).collect()
    assert len(got) == 18
    first = {r.record_type: r for r in got if r.page_id == 1}
    payload = PAGE.encode()
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert first["response"].payload_digest == sha(payload)
    for kind in ("metadata", "conversion"):
        r = first[kind]
        assert r.refers_to == first["response"].record_id and r.target_uri == "https://h.example/d/p"
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
    meta = json.loads(first["metadata"].block)
    assert meta["WARC-Header-Metadata"]["WARC-Payload-Digest"] == sha(payload)
    assert meta["HTTP-Response-Metadata"]["Headers"]["Content-Length"] == str(len(payload))
    assert [x["url"] for x in meta["HTML-Metadata"]["Links"]] == ["https://h.example/a", "https://h.example/d/x.png"]
    assert meta["HTML-Metadata"]["Title"] == "Café & co" and meta["HTML-Metadata"]["Language"] == "fr"
    assert len({r.record_id for r in got}) == 15  # the repeated page repeats its records


def test_files_round_trip(spark, tmp_path):
    built = build_derivatives(pages(spark))
    want = sorted((r.record_id, r.refers_to, r.block) for r in built.where("record_type = 'conversion'").collect())
    back = read_warc(write_warc(built, "conversion", f"file://{tmp_path}/w"))
    assert sorted((r.record_id, r.refers_to, r.block) for r in back.collect()) == want


def test_empty(spark):
    none = build_derivatives(pages(spark).where("false"))
    assert none.count() == 0 and read_warc(write_warc(none, "metadata")).count() == 0


def test_broken_markup():
    assert plain_text("a < b <3 <> c <b") == "a < b <3 <> c <b" and plain_text("1<p title='x>2") == "1\n2"
    assert plain_text('x<a title="<b>">y</a>') == "xy" and plain_text('x<a t="<b>" y') == 'x" y'
    assert [t.name for t in tags("<P><!-- <a> --></p><?php x?><!DOCTYPE html><style>a>b{}</style>")] == ["p", "", "/p", "", "", "style"]
    assert title("<title>a <i>b</i></title >c") == "a b" and title("<title>open") is None and title("<script><title>x</title></script>") is None
    assert links("<a href=x><script src='y'></script><img src=\"z\">", "http://h/") == [{"path": "A@/href", "url": "http://h/x"}, {"path": "IMG@/src", "url": "http://h/z"}]


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\">", "<!", "<title", '<a ">" ', "<script ", "&"])
def test_broken_pages_take_time_in_proportion(part):
    took = []
    for n in (20_000, 160_000):
        start = time.perf_counter()
        derive(1, "http://h/", part * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0] + 1


def test_reader_holds_one_record():
    rows = [{"block": "x" * i, "block_digest": derive_digest("x" * i), "record_id": f"<{i}>", "record_type": "conversion", "warc_date": "d", "target_uri": "u", "refers_to": None, "warcinfo_id": None, "content_type": "t"} for i in range(300)]
    data = b"".join(map(frame_record, rows))
    for piece in (1, 100, 1 << 16):
        assert [b for _, b in parse_warc(io.BytesIO(data), piece)] == [r["block"].encode() for r in rows]
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        frame_record(rows[5] | {"block": "other"})


def derive_digest(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block.encode()).digest()).decode()


def test_responses_are_not_written_without_their_block(spark):
    with pytest.raises(ValueError):
        write_warc(build_derivatives(pages(spark)), "response")


def test_registered_query_by_another_parser(spark, sf_dir):
    """All pages of the smallest table against Python's own HTML parser, digests and lengths."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden, self.urls, self.lang = [], 0, [], None

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            if not self.hidden:
                self.urls += [v for k, v in attrs if k in ("href", "src")]
            self.lang = self.lang or (dict(attrs).get("lang") if tag == "html" else None)
            self.words.append(" ") if tag in BREAKS else None

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")
            self.words.append(" ") if tag in BREAKS else None

        def handle_data(self, data):
            if not self.hidden:
                self.words.append(data)

    source = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op8_warc_derivatives"](spark, sf_dir).collect()
    assert len(got) == 3 * len(source)
    for r in got:
        page = source[r.page_id]
        reader = Reader()
        reader.feed(page.html or "")
        reader.close()
        if r.record_type == "conversion":
            assert r.block.split() == "".join(reader.words).split()
        elif r.record_type == "metadata":
            meta = json.loads(r.block)["HTML-Metadata"]
            assert len(meta["Links"]) == len(reader.urls) and meta["Language"] == reader.lang
        if r.block is not None:
            assert (r.block_digest, r.content_length) == (derive_digest(r.block), len(r.block.encode()))
        else:
            assert r.payload_digest == derive_digest(page.html or "")


def test_every_file_begins_with_its_warcinfo_record(spark, tmp_path):
    """Each record names the warcinfo record of its own file, and files have different ones."""
    manifest = write_warc(build_derivatives(pages(spark).repartition(3)), "conversion", str(tmp_path / "out")).collect()
    seen = set()
    for part in manifest:
        with open(f"{part.folder}/{part.file}", "rb") as f:
            records = list(parse_warc(f))
        head, block = records[0]
        assert head["WARC-Type"] == "warcinfo" and f"filename: {part.file}".encode() in block and len(records) == part.records + 1
        assert {h["WARC-Warcinfo-ID"] for h, _ in records[1:]} == {head["WARC-Record-ID"]}
        seen.add(head["WARC-Record-ID"])
    assert len(seen) == len(manifest) >= 2
