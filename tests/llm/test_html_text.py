"""Main text of pages: a parser of the standard library beside it, differencing against a table of all pairs."""

from __future__ import annotations

import random
from html.parser import HTMLParser

from conftest import MEDIUM

from rollcall.llm import html_text
from rollcall.llm.html_text import blocks, common_lines, extracted
from rollcall.llm.queries import op7_html_text
from rollcall.sources import table

SCHEMA = "page_id long, url string, html string, host string, row int"


class Article(HTMLParser):
    """Text of the one article of a page without furniture in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in ("b", "a"):
            self.lines.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "a"):
            self.lines.append([])

    def handle_data(self, data):
        if self.inside:
            self.lines[-1].append(data)


def test_whole_table(spark):
    found = {r.page_id: r for r in op7_html_text(spark, MEDIUM).collect()}
    pages = table(spark, MEDIUM, "pages").collect()
    assert len(found) == len(pages)
    for page in pages:
        parser = Article()
        parser.feed(page.html)
        parser.close()
        text = "\n".join(x for x in (" ".join("".join(line).split()) for line in parser.lines) if x)
        row = found[page.page_id]
        assert (row.text, row.n_chars, row.url) == (text, len(text), page.url) and text


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p>a{}</style></head><body class="has-sidebar"><header>H</header><nav>N<ul><li>x</ul></nav>
      <div class='cookie-notice'>C<div>c</div></div><main><article data-x="a>b"><header><h1>Head &amp; more</h1></header><p>One <b>two</b>
      three&nbsp;four<br>five<script>var a="</p>";</script><p>six &lt;b&gt; <!-- no <p>no --> seven<aside>A</aside><form><p>F</form>
      <div class="share-buttons">S</div><ul><li>item</ul><figure><img alt="q"><figcaption>Cap</figcaption></figure><textarea><p>t</textarea></article>
      <section id="comments"><p>me too</section></main><footer>&copy; f</footer>tail</body></html>"""
    assert blocks(page) == [("Head & more", False), ("One two three four", False), ("five", False), ("six <b> seven", False), ("item", True), ("Cap", False)]
    assert blocks("plain 1 < 2 <p>para<div>d</div>") == [("plain 1 < 2", True), ("para", True), ("d", True)]
    assert blocks("") == [] and blocks("<nav>menu<article><p>a &am") == [("a &am", False)] and blocks("<article><p>cut </art") == [("cut", False)]
    assert blocks("<article>" + "<div>" * 20_000 + "x " * 100_000) == [(" ".join("x" * 100_000), True)]


def test_furniture_without_end_tags():
    texts = lambda page: [t for t, _ in blocks(page)]
    assert texts("<article><p class=ad>buy <b>now<script>x</script> or never<p>One<p>Two</article><p>out") == ["One", "Two"]
    assert texts("<article><div><p class=ad>buy</div>One<p>Two</p></article>") == ["One", "Two"]
    assert texts("<article><ul><li class=share>send<ul><li>x<li>y</ul><p>z</p>more<li>One<li>Two</ul><p>Three</article>") == ["One", "Two", "Three"]
    assert texts("<article><ul><li>One<li class=share><div>send</div></ul><p>Two</article>") == ["One", "Two"]
    assert texts("<article><dl><dt class=ad>a<dd>One<dt>Two<dd class=promo>b</dl>Three</article>") == ["One", "Two", "Three"]
    assert texts("<article><table><tr><td class=ad>a<table><tr><td>b</table>c<td>One<tr class=ad><td>d<tr><td>Two</table><p>Three</article>") == ["One", "Two", "Three"]
    assert texts("<article><p class=ad>buy</p>One<ul><li class=share>s</li><li>Two</ul></article>") == ["One", "Two"]


def test_names_count_as_wholes():
    texts = lambda page: [t for t, _ in blocks(page)]
    assert blocks("<article class='post has-sidebar'><p>One</article>") == [("One", False)]
    assert blocks("<div class='with-sidebar'><article><p>One</p><div>Two</div></article></div>") == [("One", False), ("Two", True)]
    assert blocks("<article><section id='related-work'><h2>Head<p>One<section><p>Two</section>Three</section><p>Four</article>") == [
        ("Head", True), ("One", True), ("Two", True), ("Three", True), ("Four", False)
    ]
    assert texts("<article><pre>x = 1 <span class='comment'># one</span></pre><code><span class=comment>c</span></code></article>") == ["x = 1 # one", "c"]
    assert texts("<article><p>One<div class='cookieBanner'>c</div><div class='social share-buttons'>s</div><div aria-label='Share this article'>t</div><p>Two") == ["One", "Two"]
    assert texts("<div class='page-header'>h</div><div class='post-header'>Title</div><div data-class='ad'>Text") == ["Title", "Text"]
    assert texts("<article><p>One</article><div id=comments><article class=comment><p>c</article></div><article class='comment'>d</article>") == ["One"]


def test_copies_keep_their_text(spark):
    story = "".join(f"<p>Paragraph {i} of a story that several pages tell in the same words</p>" for i in range(8))
    rows = [(i, f"http://x.org/x?copy={i}", story, "", 1) for i in range(4)] + [(4, "http://x.org/x2", story + "<div>Printed at noon</div>", "", 1)]
    rows += [(10, "http://y.org/a", f"<div>Menu of y</div>{story}", "", 1), (11, "http://y.org/a1", f"<div>Menu of y</div>{story}<p>new</p>", "", 1)]
    rows += [(12, "http://y.org/b", "<div>Menu of y</div><p>Other words on quite another matter</p>", "", 1)]
    rows += [(20, "http://z.org/a/1", "<article><div class='related-work'>Old</div><p>One</article>", "", 1), (21, "http://z.org/a/2", "<article><div class='related-work'>Old</div><p>Two", "", 1)]
    rows += [(22, "http://z.org/", "<article><div class='related-work'>New</div><p>Three</article>", "", 1)]
    found = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    lines = "\n".join(blocks(story)[i][0] for i in range(8))
    assert {i: found[i] for i in range(5)} == dict.fromkeys(range(4), lines) | {4: f"{lines}\nPrinted at noon"}
    # The copy before is passed over, so the menu is found in the page after; where there is a copy only, nothing is cut.
    assert found[11] == f"{lines}\nnew" and found[10] == f"Menu of y\n{lines}" and found[12] == "Other words on quite another matter"
    assert (found[20], found[21], found[22]) == ("One", "Two", "New\nThree")


def test_common_lines():
    draw = random.Random(6)
    for _ in range(100):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        places = common_lines(a, b)
        rest = iter(b)
        assert len(places) == row[-1] and places == sorted(places) and all(any(a[p] == y for y in rest) for p in places)


def test_nearest_pages_share_lines(spark):
    rows = []
    for i in range(40):
        body = f"<div>Top of site</div><p>Story number {i} alone</p><div>All stories</div>"
        rows.append((i, f"https://Site.org:80/a/{i:03d}?q=1", body, "h", 1))
    rows += [(100, "http://other.org/x", "<div>Top of site</div><p>x</p>", "h", 1), (101, None, "<p>n</p>", None, None), (102, None, None, None, None), (None, "http://o2.org/", "", "h", 1)]
    rows += [(200, "http://p.org/b/1", "<div>far</div><p>q</p>", "", 1), (201, "http://p.org/b/2", "<div>far</div><div>near</div>", "", 1), (202, "http://p.org/b/22", "<div>near</div>", "", 1)]
    rows += [(300 + k, "http://c.org/1", "<article><p>same article</p><div>more</div></article>", "", 1) for k in range(2)]
    expected = {i: f"Story number {i} alone" for i in range(40)} | {100: "Top of site\nx", 101: "n", 102: "", None: "", 200: "q", 201: "far", 202: ""} | dict.fromkeys((300, 301), "same article\nmore")
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found = extracted(frame).collect()
        assert {r.page_id: r.text for r in found} == expected and len(found) == len(rows)
        assert all(r.n_chars == len(r.text) for r in found)
    assert extracted(frame.limit(0)).count() == 0
    assert html_text.TAG.search("a < b") is None
