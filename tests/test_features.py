"""Feature columns against a tag walk with the standard library's HTML parser."""

import time
from html.parser import HTMLParser

from sitegauge.operators.features import page_features, page_forms, page_headings
from sitegauge.operators.links import links
from sitegauge.sources.crawl import keep_html_only

PAGES = [
    '<html><head><TITLE> A &amp; <b>B</b> </TITLE><meta content="d &lt; e" name="description"></head>'
    '<body><h1>One <i>two</i></h1><h1>x</h1><img src=a><img alt="  "><img alt=ok></body></html>',
    '<!-- <h1>no</h1> <img> --><script>var a = "<h1>no</h1><img>";</script><style>a{content:"<p>"}</style>'
    '<p title="a > b"><img title="alt=x" src="y"><img src="z" alt=\'two words\'><br/>',
    '<form action="/go?a=1&amp;b=2" METHOD=post><input required><input type="text"></form>'
    '<form><input pattern="[a-z]+"></form><form><select></select></form><form><input type=email></form>'
    '<form><input required="required"></form><form><input type="Email"></form>',
    '<meta name="meta-description" content="second"><meta name="viewport"><meta property="og:title" content>'
    '<link rel="alternate canonical" href="/c"><button>1</button><button type=submit>2</button>',
    '<meta name="description"><meta name="description" content="late"><link rel="canonicals">'
    '<h2>a</h2><H2 class="x">b</H2><h3></h3>',
    '<a href="/p?x=1#y">1</a><a href=rel>2</a><a href="#top">3</a><a href="mailto:a@b">4</a><a name="n">5</a>'
    '<a href=" https://www.s.test/w ">6</a><a href="//other.test/q">7</a><a href="">8</a><a data-href="/no">9</a>'
    '<abbr href="/no">10</abbr><a href="javascript:x()">11</a><a href="ftp://f/x">12</a><a href="/d" href="/e">13</a>',
    "plain text", "",
]


class Walk(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.tags = []
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))

    def named(self, *names):
        return [a for t, a in self.tags if t in names]


def rows(crawl):
    pages = crawl(*[{"html": h} for h in PAGES])
    return pages, page_features(pages).orderBy("ord").collect()


def test_counts_and_flags(crawl):
    _, got = rows(crawl)
    for text, row in zip(PAGES, got):
        assert row.has_html == (text != "")
        if not text:
            assert row.title is None and row.img_total is None and row.has_viewport is None
            continue
        walk = Walk(text)
        images = walk.named("img")
        metas = walk.named("meta")
        assert row.element_count == len(walk.tags), text
        assert row.img_total == len(images)
        assert row.img_missing_alt == sum(not a.get("alt", "").strip() for a in images)
        assert row.button_count == len(walk.named("button"))
        assert row.scripts == len(walk.named("script"))
        assert row.form_count == len(walk.named("form"))
        assert row.h1_count == len(walk.named("h1"))
        assert row.has_viewport == any(a.get("name") == "viewport" for a in metas)
        assert row.has_og == any(a.get("property") == "og:title" for a in metas)
        assert row.has_canonical == any("canonical" in a.get("rel", "").split() for a in walk.named("link"))


def test_texts(crawl):
    _, got = rows(crawl)
    assert got[0].title == "A &B" and got[0].has_title
    assert got[0].meta_description == "d < e"
    assert got[0].headings == {"h1": ["Onetwo", "x"], "h2": [], "h3": [], "h4": []}
    assert got[1].title == "" and not got[1].has_title
    assert got[3].meta_description == "second"
    # an empty first description tag is not skipped
    assert got[4].meta_description == "" and not got[4].has_meta_description
    assert got[4].headings["h2"] == ["a", "b"] and got[4].headings["h3"] == [""]


def test_forms(crawl):
    pages, got = rows(crawl)
    forms = [tuple(f) for f in got[2].forms]
    assert forms == [("/go?a=1&b=2", "POST", 2, False), ("", "GET", 1, True), ("", "GET", 0, False),
                     ("", "GET", 1, True), ("", "GET", 1, True), ("", "GET", 1, False)]
    assert page_forms(page_features(pages)).count() == 6
    assert page_headings(page_features(pages)).count() == 5


def test_links(crawl):
    pages, _ = rows(crawl)
    got = [(r.dst_url, r.dst_clean, r.is_internal)
           for r in links(page_features(pages)).where("src_url like '%/5'").orderBy("pos").collect()]
    assert got == [
        ("https://s.test/p?x=1#y", "https://s.test/p", True), ("https://s.test/rel", "https://s.test/rel", True),
        ("https://www.s.test/w", "https://www.s.test/w", True), ("https://other.test/q", "https://other.test/q", False),
        ("https://s.test/", "https://s.test/", True), ("https://s.test/e", "https://s.test/e", True)]


def test_html_is_kept_for_html_types_only(crawl):
    pages = crawl({"html": "<p>", "content_type": "application/pdf"}, {"html": "<p>", "content_type": None},
                  {"html": "<p>", "content_type": "text/html; x", "status_code": 404})
    assert [r.html for r in keep_html_only(pages).orderBy("ord").collect()] == [None, None, "<p>"]


def test_long_and_broken_markup_is_processed_whole(crawl):
    text = "<p>" * 20000 + "<a title='" + "x" * 200000 + "' href='/y'>" + "<img>" * 5000 + "<script>" + "<" * 50000
    row = page_features(crawl({"html": text})).first()
    assert row.element_count == 20000 + 1 + 5000 + 1
    assert row.img_total == row.img_missing_alt == 5000
    assert [u.dst_url for u in row.links] == ["https://s.test/y"]


def test_unclosed_elements(crawl):
    html = "<h1>one<h1>two</h1><form><input><form><input></form><h2>open <b>end"
    row = page_features(crawl({"html": html})).first()
    assert row.headings["h1"] == ["one", "two"] and row.h1_count == 2 and row.headings["h2"] == ["openend"]
    assert row.form_count == 2 and [f.input_count for f in row.forms] == [1, 1]
    hidden = page_features(crawl({"html": "<img><!-- never closed <img><h1>x</h1>"})).first()
    assert hidden.img_total == 1 and hidden.h1_count == 0


def test_character_references_and_unicode_space(crawl):
    blank, named = page_features(crawl(
        {"html": "<title>&nbsp;</title><img alt='&#160;'><img alt='&#xA0;x'>"},
        {"html": "<title>&eacute;&#233;&#xE9; &amp;lt; &bogus; &#0;</title><a href='/caf&eacute;'>x</a>"
                 "<meta name='description' content='&ldquo;a&rdquo;'>"})).orderBy("ord").collect()
    assert blank.title == "" and not blank.has_title and blank.img_missing_alt == 1
    assert named.title == "ééé &lt; &bogus; �" and named.meta_description == "“a”"
    assert [u.dst_url for u in named.links] == ["https://s.test/café"]


def test_quoted_values_hide_tags_and_comments(crawl):
    html = ('<div title="<a href=/no>"><img alt="<!-- not a comment"><p data-x=\'</p><h1>no</h1>\'>'
            '<h2 title="a>b">two</h2><h3>x<b title="1>0">y</b></h3><a href="/yes">z</a>')
    row = page_features(crawl({"html": html})).first()
    walk = Walk(html)
    assert row.element_count == len(walk.tags) and row.img_total == 1 and row.h1_count == 0
    assert [u.dst_url for u in row.links] == ["https://s.test/yes"]
    assert row.headings["h2"] == ["two"] and row.headings["h3"] == ["xy"]


def test_a_start_tag_that_never_ends_hides_the_rest(crawl):
    for tail in ("<a href=x ", "<a href=x <img alt='>' ", "<form action='/x", "<h1 x", "<title ", "<script x", '<i t="<b>"'):
        row = page_features(crawl({"html": "<h1>one</h1><form><input></form><a href=/y>y</a>" + tail + "<img <p "})).first()
        assert (row.element_count, row.h1_count, row.form_count, row.img_total, row.title) == (4, 1, 1, 0, ""), tail
        assert row.headings["h1"] == ["one"] and [u.dst_url for u in row.links] == ["https://s.test/y"], tail


#: Shapes that cost the square of their number where a scan begins anew at each.
HOSTILE = ["<!-- x ", "<h2>", "<title>", "<form>", "<script>", "<a href=x ", "<a href='", '<img alt="', "<script x ",
           "<script></script ", "</b ", "<h1></h1 ", "<form x ", "<h3 ", "<b t=\"<a x=\">'", "<", "</", "<a =", "a" + " " * 9 + "&#32;",
           "<i>" + " " * 7, "=' \"", "<meta content='x> "]


def test_time_grows_with_the_page_not_its_square(crawl):
    """Pages of four times the unclosed marks must not take much more than four times as long."""
    took = []
    for n in (8_000, 8_000, 32_000):
        pages = crawl(*[{"html": mark * n} for mark in HOSTILE])
        began = time.monotonic()
        page_features(pages).collect()
        took.append(time.monotonic() - began)
    assert took[2] < 4 * took[1] + 8, took


def test_one_long_run_of_space(crawl):
    began = time.monotonic()
    html = "<h1>a" + " " * 300_000 + "b</h1><img alt='" + " " * 300_000 + "x'><a href='" + " " * 300_000 + "/y z'>c</a>"
    row = page_features(crawl({"html": html})).first()
    assert row.img_missing_alt == 0 and len(row.headings["h1"][0]) == 300_002
    assert time.monotonic() - began < 30
