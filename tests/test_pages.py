import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapweave.functions import pageindex
from mapweave.functions import pages as pg
from mapweave.operators import pages as ops


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "html string")


def test_text_and_cleaning(spark):
    page = """<html><head><title>T</title><style>.x{}</style></head><body><h1>Hello World</h1>
      <nav class="main-nav"><p>menu</p></nav><div class="ad-box">buy <div>now</div></div>
      <p>This is a paragraph.</p><p>Second &amp; last<script>var a = "<p>no</p>";</script></body></html>"""
    text = frame(spark, page, "", "<p>open <b>never closed").select(pg.extract_text("html").alias("t")).collect()
    assert text[0]["t"] == "T\nHello World\nThis is a paragraph.\nSecond & last"
    assert text[1]["t"] == ""
    assert text[2]["t"] == "open\nnever closed"
    cleaned = frame(spark, page).select(pg.clean_html("html").alias("t")).first()["t"]
    assert "menu" not in cleaned and "buy" not in cleaned and "script" not in cleaned and "&amp;" in cleaned


def test_removed_block_may_hold_nested_and_void_elements(spark):
    page = '<div class="popup"><div><br><img src="x"></div>gone</div><p>kept</p>'
    assert frame(spark, page).select(pg.extract_text("html").alias("t")).first()["t"] == "kept"


def test_titles(spark):
    got = frame(
        spark, "<title>Test Page Title</title><h1>Content</h1>", "<h1>Page Heading</h1>",
        '<meta property="og:title" content="OG"><h1>H</h1>', "<p>none</p>", "<title> </title><h1>Back</h1>",
    ).select(pg.title("html").alias("t")).collect()
    assert [r["t"] for r in got] == ["Test Page Title", "Page Heading", "OG", None, "Back"]


def test_links(spark):
    page = """<a href="https://example.com/page1">1</a><a href='/relative/path'>2</a><a href="#anchor">3</a>
      <a href="mailto:x@y.z">4</a><a class="k" href="../up/./x?q=1#f">5</a><a href="//cdn.org/z">6</a>
      <a href="ftp://no.org/">7</a><a href="page1">8</a><a href="/relative/path">9</a>"""
    got = frame(spark, page).select(pg.links("html", F.lit("https://example.com/a/b/c")).alias("l")).first()["l"]
    assert got == [
        "https://example.com/page1", "https://example.com/relative/path", "https://example.com/a/up/x?q=1",
        "https://cdn.org/z", "https://example.com/a/b/page1",
    ]


def test_attributes_in_any_quotes(spark):
    page = """<meta name='description' content='single "inner"'><meta data-content="no" content=bare name="twitter:title">"""
    row = frame(spark, page).select(pg.meta_description("html").alias("d"), pg.title("html").alias("t")).first()
    assert row["d"] == 'single "inner"' and row["t"] == "bare"
    later = frame(spark, "<h1><b>first</b></h1><h1>second</h1>", "<h1>plain</h1>").select(pg.title("html").alias("t")).collect()
    assert [r["t"] for r in later] == ["first", "plain"]


def test_links_of_markup_only(spark):
    page = """<a data-href="/no" href="/a b">1</a><!-- <a href="/comment">x</a> --><script>var s = '<a href="/script">'</script>
      <a title="x > y" href='/q'>2</a><a href=/bare>3</a><a data-href="/none">4</a>"""
    got = frame(spark, page).select(pg.links("html", F.lit("https://example.com/")).alias("l")).first()["l"]
    assert got == ["https://example.com/a b", "https://example.com/q", "https://example.com/bare"]


def test_structured_data(spark):
    page = """<meta property="og:type" content="a"><meta property="og:type" content="b"><meta name="twitter:card" content="c">
      <script type="application/ld+json">{"x": 1}</script><script type="application/ld+json">{bad</script>"""
    row = frame(spark, page).select(pg.structured_data("html").alias("s")).first()["s"]
    assert row["json_ld"] == ['{"x": 1}']
    assert row["open_graph"] == {"og:type": "b"} and row["twitter_card"] == {"twitter:card": "c"}


def test_flags(spark):
    rows = frame(spark, "Ray ID: 1", "x recaptcha", "recaptcha" + "y" * 6000, "Slow Down", "fine").select(
        pg.is_challenge_page("html").alias("c"), pg.is_rate_limited("html", F.lit(200)).alias("r")).collect()
    assert [r["c"] for r in rows] == [True, True, False, False, False]
    assert [r["r"] for r in rows] == [False, False, False, True, False]


def test_long_text_is_cut_at_a_character(spark):
    text = "é" * 10 + "\x00"
    got = frame(spark, text).select(pg.clean_text("html", 7).alias("a"), pg.clean_text("html", 20).alias("b")).first()
    assert got["a"] == "é" * 3 + pg.TRUNCATED_NOTE
    assert got["b"] == "é" * 10
    binary = frame(spark, "\x01" * 101 + "x").select(pg.clean_text("html").alias("a")).first()["a"]
    assert binary == pg.BINARY_NOTE


def test_link_levels_follow_successes_only(spark):
    pages = spark.createDataFrame([("u1", "success"), ("u2", "failed"), ("u3", "success"), ("u4", "success")], "url string, status string")
    links = spark.createDataFrame([("u1", "u2"), ("u1", "u3"), ("u2", "u4"), ("u3", "u4"), ("u3", "u1")], "url string, link string")
    seeds = spark.createDataFrame([("u1",), ("u2",)], "url string")
    got = sorted((r["depth"], r["url"], r["scraped"]) for r in ops.link_levels(seeds, pages, links, 3).collect())
    assert got == [(1, "u1", True), (1, "u2", False), (2, "u2", False), (2, "u3", True), (3, "u2", False), (3, "u4", True)]


class PlainReader(HTMLParser):
    """What a page reads as by the standard library's parser: text nodes outside of removed elements."""

    RAW = ("script", "style", "iframe", "xmp", "noembed", "noframes", "title", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts = [], [""]

    @staticmethod
    def removed(tag, classes):
        return tag in ("script", "style", "noscript", "iframe") or "popup" in classes or (tag == "nav" and "menu" in classes)

    def flush(self):
        if not any(gone for _, gone in self.stack):
            self.texts.append("")

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        self.stack.append((tag, self.removed(tag, (dict(reversed(attrs)).get("class") or "").lower())))
        self.flush()
        if tag in ("br", "img", "hr", "meta"):
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_comment(self, data):
        self.flush()

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            self.flush()
            while self.stack.pop()[0] != tag:
                pass
        else:
            self.flush()

    def handle_data(self, data):
        if not any(gone for _, gone in self.stack):
            self.texts[-1] += data


PIECES = st.sampled_from(["<p>", "</p>", "<div>", "</div>", '<div class="a popup">', "<nav class='Menu x'>", "</nav>", "<nav>", "<li>", "</li>", "<b>", "</b>",
                          "<br>", "<br/>", "<div/>", "<noscript>", "</noscript>", "<!-- <p>no</p> -->", "<script>var a='<p>x</p>' < 3;</script>",
                          "<style>p{}</style>", "one", " two ", "&amp;", "a &lt; b", "\n", "é", '<a title="x > y" href=q>', "</a>", "<img alt='>'>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25), min_size=1, max_size=6))
def test_text_equals_a_plain_parser(pages):
    pages = ["".join(p) for p in pages]
    got = pageindex._parts([p.encode() for p in pages], ("text", "clean_html"))
    for page, text, cleaned in zip(pages, got[0].to_pylist(), got[1].to_pylist(), strict=True):
        reader = PlainReader()
        reader.feed(page)
        reader.close()
        want = re.sub(r" +", " ", re.sub(r"\n\s*\n", "\n\n", "\n".join(x.strip() for x in reader.texts if x.strip()))).strip()
        assert text == want
        again = pageindex._parts([cleaned.encode()], ("whole_text",))[0][0].as_py()
        assert "<script" not in cleaned.replace("<!-- <p>no</p> -->", "") and again == text


def test_markup_only_in_markup(spark):
    page = """<!-- <title>old</title> <meta name="description" content="old"><script type="application/ld+json">{"o": 1}</script><p><p><p><article> -->
      <script>var x='<title>js</title>'</script><title>re&eacute;l</title><meta content='a > b' name=description>
      <script type="application/ld+json">{"n": 2}</script><textarea><p><p><p></textarea>"""
    row = frame(spark, page).select(
        pg.title("html").alias("t"), pg.meta_description("html").alias("d"), pg.structured_data("html").alias("s"),
        pg.is_content_page("html", "html", 10).alias("c")).first()
    assert row["t"] == "reél" and row["d"] == "a > b" and row["s"]["json_ld"] == ['{"n": 2}'] and row["c"] is False


def test_broken_markup(spark):
    pages = ["<p>a<!-- never closed <b>x", "<div class='popup'>gone<p>all", 'x<a href="never closed><p>y', "<", "a < b <> </ > c", "<script>only", None,
             "</div></p>text", "<title>t", "<!-->shown<!--->too", "<div " + 'a="b" ' * 3000]
    got = frame(spark, *pages).select(pg.extract_text("html").alias("t"), pg.clean_html("html").alias("c"), pg.title("html").alias("n")).collect()
    assert [r["t"] for r in got] == ["a", "", "x\ny", "<", "a < b <>\nc", "", "", "text", "t", "shown\ntoo", ""]
    assert got[1]["c"] == "" and got[3]["c"] == "<" and got[6]["c"] == "" and got[8]["n"] == "t"


def test_long_pages_are_indexed_by_themselves(spark):
    page = "<p>word</p>" * 300_000
    row = frame(spark, "<p>a", page, "b").select(F.length(pg.extract_text("html")).alias("n")).collect()
    assert [r["n"] for r in row] == [1, 5 * 300_000 - 1, 1]


def test_binary_is_judged_by_the_whole_text_unless_told(spark):
    late = "a" * 2000 + "\x01" * 500
    row = frame(spark, late).select(pg.clean_text("html").alias("all"), pg.clean_text("html", sample=1000).alias("first")).first()
    assert row["all"] == pg.BINARY_NOTE and row["first"] == late
