import html as entities
from html.parser import HTMLParser

from pyspark.sql import functions as F

from citeweave.llm import extraction as X
from citeweave.llm.layouts import labelled_pages
from citeweave.llm.queries import op11_html_extraction


class _Article(HTMLParser):
    """Lines of what stands within article, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def _text(page):
    cut = X.blocks(page)
    return "\n".join(b.text for b, on in zip(cut, X.built_in().decode([cut])) if on)


def test_given_pages_equal_their_articles(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op11_html_extraction(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        p = _Article()
        p.feed(r.html)
        want = "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_held_out_layouts():
    pages = list(labelled_pages(200, 50_000))
    cut = [X.blocks(h) for h, _ in pages]
    got = X.built_in().decode(cut).tolist()
    want = [x for c, (_, text) in zip(cut, pages) for x in X.labels_of(c, text)]
    wrong = sum(a != b for a, b in zip(got, want))
    assert wrong <= 0.015 * len(want)


def test_labelled_pages_are_read_back():
    for page, text in labelled_pages(150, 900_000):
        cut = X.blocks(page)
        assert "\n".join(b.text for b, on in zip(cut, X.labels_of(cut, text)) if on) == text


def test_decoding_is_the_best_of_all_ways():
    model = X.built_in()
    pages = [X.blocks(h)[:7] for h, _ in labelled_pages(12, 70_000)]
    pages.insert(3, [])
    got, at = model.decode(pages), 0
    for page in pages:
        e = model.scores([page])
        ways = [[w >> i & 1 for i in range(len(page))] for w in range(1 << len(page))] if page else []
        value = lambda y: model.first[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(model.change[a, b] for a, b in zip(y, y[1:]))
        if ways:
            assert got[at : at + len(page)].tolist() == max(ways, key=value)
        at += len(page)


def test_parts_that_are_no_article_go():
    story = "<h1>A tale</h1><p>It was a long day, and the rain didn&#39;t end &amp; nobody came.</p><p>Then it was night.</p>"
    page = f"""<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
    <div class="cookie-notice">We use cookies, and you will like them.<button>ok</button></div><div class="ad">Buy this now.</div>
    <article>{story}<div class="ad">Buy that too.</div><script>var a = "<p>no</p>";</script></article>
    <aside class="sidebar"><h3>More</h3><p>Other stories are here.</p></aside><section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story, it was long.</p></div></section>
    <form><label>Mail</label><input><p>Write to us.</p></form><footer><p>&copy; 2020 Somebody. All rights reserved.</p></footer></body></html>"""
    assert _text(page) == "A tale\nIt was a long day, and the rain didn't end & nobody came.\nThen it was night."


def test_malformed_pages():
    say = lambda page: [b.text for b in X.blocks(page)]
    assert say(None) == say("") == say("<p> \n </p>") == say("<script>if (a < b) x = '</p>'") == say("<!-- <p>a") == []
    assert say("a < b <p>c & d &amp") == ["a < b", "c & d &"]
    assert say("<P CLASS=x>one<p>two</div>three<li>four<li>five") == ["one", "two", "three", "four", "five"]
    assert say('<a title="x > y">in</a> side<br>line\xa0end<') == ["in side line end<"]
    assert say("<b>bold<div>own</b> line</div>rest") == ["bold", "own line", "rest"]
    assert say("<div>" * 30_000 + "deep" + "</div>" * 30_000) == ["deep"]
    assert say("<b>" * 3000 + "x<hr>y" * 3000)[:2] == ["x", "yx"]
    assert say("<p>" + "word " * 200_000)[0].count("word") == 200_000


def test_empty_null_and_repeated_rows(spark):
    page = "<article><p>One line of text, as it should be.</p></article>"
    df = spark.createDataFrame([(1, "u", page, "a", 5), (1, "u", page, "a", 5), (None, None, None, None, None), (3, "", "", "b", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(X.main_text(df).collect(), key=lambda r: r.page_id or 0)
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "", 0), *[(1, "One line of text, as it should be.", 34)] * 2, (3, "", 0)]
    assert X.main_text(df.limit(0)).count() == 0
    assert X.main_text(df).columns == ["page_id", "url", "text", "n_chars"]


def test_fitted_on_a_table(spark):
    rows = [(f"<div class=z{i % 2}><p>{entities.escape(f'w{i} and so on')}</p></div><div class=q><p>other {i}</p></div>", f"w{i} and so on") for i in range(60)]
    model = X.fitted(spark.createDataFrame(rows + [(None, "x")], "html string, text string").withColumn("extra", F.lit(1)), 40)
    cut = X.blocks("<div class=z1><p>w and more</p></div><div class=q><p>other 9</p></div>")
    assert model.decode([cut]).tolist() == [1, 0]
    assert X.fit([]).decode([cut]).tolist() == [0, 0]
