from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from rollcall.functions import markup
from rollcall.operators import links

PAGES = [
    (0, "http://h.org/x", "plain text, 1 > 0"),
    (1, "http://h.org", '<span class="b"><a href="/in">x</a></span>'),
    (2, "http://h.org/", '<a href="/in">x</a><a href="http://out.org/">y</a>'),
    (3, "http://h.org", '<p><a href="http://out.org/">y</a></p><br/><br/>'),
    (4, "http://h.org:80/x?q", "<a>no link</a><a name='n' href='//two//'>z</a>"),
    (5, "nowhere", """<a title="a > b href='/not'" data-href="/nor" href = '/yes'>x</a>"""),
    (6, "http://h.org", "<!-- <p> --><![CDATA[<script>]]><a/>"),
    (7, "http://h.org", '<abbr>x</abbr><A href="/upper">x</A>'),
    (8, "http://h.org", '<s:a s:href="/prefixed">x</s:a><a href="/open'),
    (9, None, ""),
    (10, "http://h.org", None),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def test_audit(pages):
    rows = {row.page_id: tuple(row)[2:] for row in links.markup_audit(pages).collect()}
    assert rows.pop(10)[-1] == "ALLOW"
    assert rows == {
        0: ([], 0, 0, "ALLOW"),
        1: ([], 1, 0, "ALLOW"),
        2: ([], 2, 1, "ESCAPE_LINK"),
        3: (["br", "p"], 1, 1, "ESCAPE_TAG"),
        4: ([], 2, 0, "ALLOW"),
        5: ([], 1, 0, "ALLOW"),
        6: ([], 1, 0, "ALLOW"),
        7: (["A", "abbr"], 0, 0, "ESCAPE_TAG"),
        8: ([], 1, 0, "ESCAPE_MALFORMED"),
        9: ([], 0, 0, "ALLOW"),
    }


def test_allowed_tags_can_be_widened(pages):
    audit = links.markup_audit(pages, ("a", "span", "br", "p"))
    assert audit.filter("page_id = 3").first().verdict == "ESCAPE_LINK"


def test_summaries(pages):
    counts = {tuple(row) for row in links.markup_summary(pages).collect()}
    assert counts == {
        ("h.org", "ALLOW", 5), ("h.org", "ESCAPE_LINK", 1), ("h.org", "ESCAPE_TAG", 2),
        ("h.org", "ESCAPE_MALFORMED", 1),
        (None, "ALLOW", 2),
    }
    tags = {tuple(row) for row in links.offending_tags(pages).collect()}
    assert tags == {("br", 1), ("p", 1), ("A", 1), ("abbr", 1)}


def test_links_lose_one_slash_on_each_side(pages):
    found = {tuple(row) for row in links.resolve_links(pages).collect()}
    assert found == {
        (1, "/in", "http://h.org/in"),
        (2, "/in", "http://h.org/in"),
        (4, "//two//", "http://h.org:80//two//"),
        (5, "/yes", "/yes"),
        (8, "/prefixed", "http://h.org/prefixed"),
    }
    proxied = links.resolve_links(pages, "/proxy//").filter("page_id = 4").first()
    assert proxied.resolved == "/proxy///two//"
    degree = {tuple(row) for row in links.link_in_degree(pages).collect()}
    assert ("http://h.org/in", 2) in degree


@pytest.mark.parametrize(
    "html",
    [
        "<a href=http://evil.org>x</a>",
        '<a/href="http://evil.org">x</a>',
        '<a href="http://evil.org" x=">',
        """<a title="it's" href=//e.org>x""",
        "<span onclick=x()>y</span>",
        '<a href="/in" b>x</a>',
        '<span',
    ],
)
def test_what_is_not_whole_is_never_allowed(spark, html):
    pages = spark.createDataFrame([(1, "http://h", html)], "page_id bigint, url string, html string")
    assert links.markup_audit(pages).first().verdict == "ESCAPE_MALFORMED"
    assert "<" not in links.shown_markup(pages, "/p").first().shown


def test_shown_markup(spark):
    html = """<a title="href='/t'" href="/in">href="/x"</a><s:span/><a href='rel'>y</a>"""
    rows = [(1, '<a class="c" href="/in">href="/x"</a>'), (2, "<b>&'\"</b>"), (3, None), (4, html)]
    pages = spark.createDataFrame([(i, "http://h", t) for i, t in rows], "page_id bigint, url string, html string")
    shown = {r.page_id: (r.verdict, r.shown) for r in links.shown_markup(pages, "/p$1/").collect()}
    assert shown[1] == ("ALLOW", '<a class="c" href="/p$1/in">href="/x"</a>')
    assert shown[2] == ("ESCAPE_TAG", "&lt;b&gt;&amp;&#39;&quot;&lt;/b&gt;") and shown[3] == ("ALLOW", None)
    assert shown[4][0] == "ESCAPE_LINK"


def test_unclosed_comments_take_linear_time(spark):
    pages = spark.createDataFrame([(1, "http://h", "<a href='/x'/>" + "<!-- " * 200_000), (2, "http://h", "<a " + "x" * 300_000)], "page_id bigint, url string, html string")
    assert [r.verdict for r in links.markup_audit(pages).orderBy("page_id").collect()] == ["ESCAPE_MALFORMED", "ESCAPE_MALFORMED"]


def test_very_long_tags_are_read_whole(spark):
    attributes = " ".join(f"""a{n}="'x>" b{n}='"'""" for n in range(60_000))
    html = f'<a {attributes} href="/end">x</a>' + "<a " + "'\"" * 50_000
    pages = spark.createDataFrame([(1, "http://h", html)], "page_id bigint, url string, html string")
    row = links.markup_audit(pages).first()
    assert (row.anchors, row.outside_links, row.verdict) == (1, 0, "ESCAPE_MALFORMED")
    assert links.resolve_links(pages).first().resolved == "http://h/end"


def strictly(html):
    """What a strict parser says of the page as the content of one element."""
    from xml.parsers import expat

    try:
        expat.ParserCreate().Parse(f"<page>{html}</page>", True)
        return True
    except (expat.ExpatError, ValueError):
        return False


MALFORMED = [
    "<span>unclosed", '<a href="/x"><span>t</a></span>', "</span>text", "<span>a & b</span>", "<span>a < b</span>",
    '<span x="1" x="2">y</span>', "<span>&nbsp;</span>", "<span x='1'y='2'/>", "<span x=1/>", "<span x/>", "&#0;", "&#xD800;", "&#x110000;",
    "<!-- a -- b -->", "<!-- a --->", "<!-- open", "<![CDATA[ open", "text ]]> more", "<?xml version='1.0'?>", "<!DOCTYPE a>", "< a/>", "</a >", "<a></a b='1'>",
    "<span>&amp</span>", '<a href="/?x=1&y=2">t</a>', '<a href="/?x=<b">t</a>', "\x01", "<a/><", "<a>" * 3 + "</a>" * 2, "<1/>", "<a></A>", "&;", "& amp;", "<a\x0bb='1'/>", "<a b='1' b = \"2\"/>",
    "</page><page>", "</page>", "<page>",
]
WELL_FORMED = [
    "", "plain > text", "<span>a &amp; &lt; &#65; &#x41; &#9;</span>", "<a/><a></a >", '<a href="/?x=1&amp;y=2" title=\'"\'>t</a>', "<!-- <b> & - -->", "<![CDATA[ <b> & ]] > ]]>",
    "<?php <b> & ?>", "<s:a s:href='/x'>t</s:a>", "<a\n b = '1'\t/>", "<ä ö='1'>ü</ä>", "<a b='>'>x</a>", "<a.b-c_d/>", "<span><a>x</a><span><a/></span></span>", "&quot;&apos;", "<a b='' c=''/>", "]] >", "<page></page>",
    "<a>" * 40 + "</a>" * 40,
]


def test_well_formed_as_a_strict_parser_says(spark):
    import random

    assert not any(map(strictly, MALFORMED[:-3])) and all(map(strictly, WELL_FORMED))
    draw, made = random.Random(3), []
    parts = ["<a>", "</a>", "<span>", "</span>", "<a/>", "<a href='/x'>", '<a b="1" b="2">', "&amp;", "&", "<", ">", "text", "<!--", "-->", "--", "]]>", "<![CDATA[", "&#65;", "&x;", "'", '"', "<?p", "?>", "/"]
    for _ in range(1500):
        made.append("".join(draw.choice(parts) for _ in range(draw.randint(1, 7))))
    nest = lambda depth: "".join(f"<{(n := draw.choice(['a', 'span', 'b']))}>{nest(depth - 1)}</{n}>" for _ in range(draw.randint(0, 3))) if depth else "x"
    made += [nest(4) for _ in range(60)]
    pages = MALFORMED[:-3] + WELL_FORMED + made
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    found = {r.page_id: r.ok for r in frame.select("page_id", markup.well_formed(F.col("html")).alias("ok")).collect()}
    wrong = [(pages[k], ok) for k, ok in found.items() if ok != strictly(pages[k])]
    assert not wrong, wrong[:10]
    assert sum(found.values()) > 150


def test_malformed_pages_are_shown_escaped(spark):
    pages = [x for x in MALFORMED[:-3] if "DOCTYPE" not in x] + MALFORMED[-3:]
    frame = spark.createDataFrame([(k, None, x) for k, x in enumerate(pages)], "page_id bigint, url string, html string")
    shown = links.shown_markup(frame, "/proxy", ("a", "span", "page", "A")).collect()
    assert {r.verdict for r in shown} == {"ESCAPE_MALFORMED", "ESCAPE_TAG"} and not any("<" in r.shown for r in shown)
    seven = {r.verdict for r in shown if r.page_id < 7}
    assert seven == {"ESCAPE_MALFORMED"}


def test_deep_and_long_pages(spark):
    deep, long = "<a>" * 300_000 + "</a>" * 300_000, "<a href='/x' title='t &amp; u'>some text</a> " * 200_000
    pages = [deep, deep[:-4], long, long + "</a>", "<!--" + "x" * 5_000_000 + "-->", "x" * 5_000_000 + "&"]
    frame = spark.createDataFrame([(k, None, x) for k, x in enumerate(pages)], "page_id bigint, url string, html string").repartition(6)
    verdicts = {r.page_id: r.verdict for r in links.markup_audit(frame).collect()}
    assert [verdicts[k] for k in range(6)] == ["ALLOW", "ESCAPE_MALFORMED"] * 3
