"""WARC records against the standard library's parser and malformed files; very long items and texts in decontamination."""

import gzip
import hashlib
import os
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from citeweave.llm import components, decontaminate, warc

PAGES = "/root/testdata/sf0.001/pages.parquet"
BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav title blockquote pre td th hr main aside dd dt dl form body html head option".split())


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden, self.title = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        self.out.append("\n" if tag in BLOCKS else "")
        self.hidden += tag in ("script", "style", "noscript", "template", "svg")
        if tag == "a" and dict(attrs).get("href") is not None and not self.hidden:
            self.links.append(dict(attrs)["href"].strip())
        if tag == "title" and self.title is None:
            self.title = ""
            self.in_title = True

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in BLOCKS else "")
        self.hidden -= tag in ("script", "style", "noscript", "template", "svg")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if getattr(self, "in_title", False):
                self.title += data


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no tables here")
def test_all_pages_against_the_library(spark):
    pages = spark.read.parquet(PAGES)
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(pages).collect()}
    rows = pages.collect()
    assert len(got) == 2 * len(rows) > 0
    for r in rows:
        p = Plain()
        p.feed(r.html or "")
        p.close()
        lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
        text, about = got[r.page_id, "conversion"], got[r.page_id, "metadata"]
        assert text.payload == "\n".join(x for x in lines if x)
        fields = [tuple(x.split(": ", 1)) for x in about.payload.split("\r\n") if x]
        assert [v for k, v in fields if k == "outlink"] == [urljoin(r.url or "", x) for x in p.links]
        assert dict(fields)["title"].split() == (p.title or "").split()
        body = (r.html or "").encode()
        sums = {warc.base64.b32decode(dict(fields)[k].removeprefix("sha1:")) for k in ("source-payload-digest",)}
        assert sums == {hashlib.sha1(body).digest()} and dict(fields)["source-content-length"] == str(len(body))
        assert text.refers_to == about.refers_to and text.target_uri == (r.url or "")


def test_malformed_records():
    good = lambda i, block=b"text": warc.record("conversion", f"<{i}>", [("WARC-Target-URI", f"u{i}")], block, "text/plain") + b"\r\n"
    cases = {
        "no length": good(1).replace(b"Content-Length: 4\r\n", b""),
        "no number": good(1).replace(b"Content-Length: 4", b"Content-Length: four"),
        "too short": good(1).replace(b"Content-Length: 4", b"Content-Length: 2"),
        "too long": good(1).replace(b"Content-Length: 4", b"Content-Length: 11"),
        "far too long": good(1).replace(b"Content-Length: 4", b"Content-Length: 99999999999"),
        "other case": good(1).replace(b"Content-Length", b"CONTENT-length").replace(b"WARC-Type:", b"warc-type:  "),
        "not UTF-8": good(1).replace(b"text/plain", b"\xff\xfe"),
        "twice": good(1).replace(b"Content-Length: 4\r\n", b"Content-Length: 4\r\nContent-Length: 9\r\n"),
    }
    for name, middle in cases.items():
        got = list(warc.records_of(b"junk\r\n" + good(0, b"a\r\n\r\nb") + middle + good(2, b"")))
        assert [(r[1], r[3], r[4]) for r in got] == [("<0>", "u0", b"a\r\n\r\nb"), ("<1>", "u1", b"text"), ("<2>", "u2", b"")], name
    assert [r[4] for r in warc.records_of(good(0) + good(1)[:-6])] == [b"text", b"te"]
    assert [r[1] for r in warc.records_of(good(0) + b"WARC/1.1\r\nWARC-Type: x\r\n")] == ["<0>"]
    bare = list(warc.records_of(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert bare == [(None, None, None, None, b"")] and not list(warc.records_of(b"")) and not list(warc.records_of(b"nothing"))
    # quoted records within a block of the right length are text
    inner = b"see\r\nWARC/1.0\r\n\r\nend"
    assert [r[4] for r in warc.records_of(good(0, inner) + good(1))] == [inner, b"text"]
    assert [r[1] for r in warc.records_of(gzip.compress(good(0)) + gzip.compress(good(1)))] == ["<0>", "<1>"]


def test_files_with_bad_records(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Record-ID: <\xff>\r\n\r\nrest")
    (folder / "b.warc").write_bytes(b"")
    got = warc.read(spark, str(folder)).collect()
    assert [(r.record_type, r.record_id, bytes(r.payload)) for r in got] == [(None, "<�>", b"rest")]


def test_long_items_and_texts(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    item = words(1500)
    lost = item[:400] + item[410:900] + ["new"] * 20 + item[900:]
    far = words(30_000)
    texts = {0: words(200_000) + lost + words(500), 1: item[:1150], 2: far, 3: item[:1201], None: item, 4: far[:63] + item + far[:1]}
    docs = spark.createDataFrame([(k, " ".join(v).upper()) for k, v in [*texts.items(), (3, item[:1201])]], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(far[100:112])), (None, " ".join(far[-9:])), (7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_words): (r.distance, r.first_word, r.end_word) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 7, 1500): (30, 200_000, 200_000 + len(lost)), (3, 7, 1500): (299, 0, 1201), (None, 7, 1500): (0, 0, 1500), (4, 7, 1500): (0, 63, 1563), (2, 7, 12): (0, 100, 112), (2, None, 9): (0, 29_991, 30_000)}


def test_components_of_a_hub(spark):
    """A node with most of the edges, a long path through it, and small parts beside."""
    edges = [(5, i) for i in range(10, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(5200, 17), (8001, 8000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 8000 if n >= 8000 else 5 for e in edges for n in e}
