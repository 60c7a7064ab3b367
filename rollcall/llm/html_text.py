"""Main text of web pages: markup first, then differencing with the page of the nearest URL.

1. Markup. Blocks of text are read in page order from the page's article (or main) elements, or from its whole
   body if it has none. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
   reader comments are left out by element, and where a whole name of a class, id, role or label says so
   (``cookie-notice``, but not ``has-sidebar``). A block ends at block elements and line breaks; white space in it becomes one space.
2. Differencing. Markup leaves some blocks open: those of pages without an article, those in an article that are no
   headings, paragraphs, quotations, code, cells or captions, and all in an element of which only a part of a name
   speaks of furniture. Pages of a host with equal blocks are one class, and classes with open blocks are sorted by the smallest URL path; each is
   paired with the neighbour whose path shares the longer beginning (ties: the one before). All their blocks
   are aligned by the longest common subsequence. Pages with ``COPY`` of their text in common are copies, and the other neighbour, if any, is
   taken; else shared open blocks are deleted. Blocks that markup declares as prose of the article stay.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.tables import stored
from rollcall.llm.words import slices

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))""", re.S)
NAMES = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RAW = frozenset("script style textarea title noscript iframe xmp template svg math object canvas select option noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside form button menu dialog fieldset label input".split()) | RAW
CODE = frozenset(("pre", "code"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROOTS = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption caption".split())
BREAKING = PROSE | ROOTS | LEFT_OUT | frozenset(
    "html body div section header hgroup ul ol li dl table thead tbody tfoot tr figure address details summary hr br center".split()
) - frozenset("label input button".split())
#: Elements whose end tag may be left out, with what holds them: within another of these a like element is no sibling.
HOLDERS = {"p": frozenset(), "li": frozenset(("ul", "ol", "menu"))} | dict.fromkeys(("dd", "dt"), frozenset(("dl",)))
HOLDERS |= dict.fromkeys("td th tr thead tbody tfoot".split(), frozenset(("table",)))
#: The start tags that end such an element.
_GROUPS = frozenset(("thead", "tbody", "tfoot"))
NEXT = {"p": BREAKING - RAW - frozenset("br html head body".split()), "li": frozenset(("li",)), "tr": _GROUPS | {"tr"}} | dict.fromkeys(("dd", "dt"), frozenset(("dd", "dt")))
NEXT |= dict.fromkeys(("td", "th"), _GROUPS | {"td", "th", "tr"}) | dict.fromkeys(_GROUPS, _GROUPS)
#: Words of class, id and role that mark what is not main text.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login paywall sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar "
    "toolbar share sharing social related recommended recommendations trending widget comment comments commentlist replies reply disqus discussion respond "
    "complementary contentinfo search skip hidden".split()
)
#: Words that may stand beside those without changing what the name says.
BESIDE = frozenset(
    "site page main top bottom left right global blog web post article user reader box block bar list item items group unit slot area panel section container wrapper inner row "
    "column link links button buttons icon icons form field text title header content visually is on the this our to us all posts articles stories".split()
)
#: The same for ``header``: an article's own header is no furniture.
HEADER = frozenset("header site page main top global blog web bar container wrapper inner".split())
#: Whole names by which even an article element is a reader's or an advertiser's.
NO_ARTICLE = frozenset("comment reply ad advert advertisement sponsored promo".split())
#: From this share of their text in common on, two pages are copies.
COPY = 0.8


def _names(attributes: str) -> Iterator[str]:
    """Names of classes, ids and roles one by one, labels as wholes."""
    for found in NAMES.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        yield from (value,) if found[1][:1] in "aA" else value.split()


def _furniture(attributes: str) -> int:
    """What the names say: 2 furniture, 1 perhaps, as furniture is a part of a name only, 0 nothing."""
    verdict = 0
    for name in _names(attributes):
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if not FURNITURE.isdisjoint(words):
            if all(w in FURNITURE or w in BESIDE for w in words):
                return 2
            verdict = 1
        elif "header" in words and HEADER.issuperset(words):
            return 2
    return verdict


def _foreign(attributes: str) -> bool:
    """Whether an article element is a reader's comment or an advert."""
    return any(name.lower() in NO_ARTICLE for name in _names(attributes))


def _ended(element: str, inner: list[str], name: str, closing: bool, empty: bool) -> bool:
    """Whether a tag ends an element whose end tag may be left out: its own end tag, a next sibling, or the end of an ancestor.

    ``inner`` are the open elements within it, and is kept up to date.
    """
    if not closing:
        if name in NEXT[element] and HOLDERS[element].isdisjoint(inner):
            return True
        if name in BREAKING and name not in VOID | RAW and name not in HOLDERS and not empty:
            inner.append(name)
        return False
    if name in inner:
        while inner.pop() != name:
            pass
        return False
    if name in HOLDERS:
        return name == element == "p" or (name != "p" and HOLDERS[name].isdisjoint(inner))
    return name in BREAKING and name not in VOID | RAW


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, open) of the page's blocks in order. Malformed markup is read as far as it goes."""
    rooted = bool(re.search(r"<(?:article|main)\b|\brole\s*=\s*[\"']?main\b", page, re.I))
    found: list[tuple[str, bool]] = []
    parts: list[str] = []
    prose, roots, outside, depth, code = False, 0, "", 0, 0
    doubt, doubted = "", 0  # an element that is perhaps furniture, and how deep its name is nested
    inner: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((text, not (rooted and prose) or bool(doubt)))

    at, close_root = 0, []
    while True:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else len(page)
        if stop > at and not outside and (roots or not rooted):
            parts.append(page[at:stop])
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] == "/", tag[3] or ""
        starts_root = name in ROOTS and not closing and not roots and not (attributes and _foreign(attributes))
        if outside:
            # Inside what is left out, only its own element's tags count, and an article that starts after all; where its
            # end tag may be left out, so do the next sibling and the end of an ancestor.
            own = closing and name == outside
            if outside in NEXT:
                if starts_root or _ended(outside, inner, name, closing, attributes.endswith("/")):
                    outside = ""
            elif name == outside and name not in VOID:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
                outside = outside if depth > 0 else ""
            elif starts_root:
                outside = ""
            if outside:
                if name in RAW and not closing and name != outside:
                    at = _after(page, name, at)
                continue
            if own:
                continue
        if name in BREAKING:
            end_block()
        if name in CODE:
            code = max(0, code - 1) if closing else code + 1
        if name == doubt:
            doubted += -1 if closing else 0 if attributes.endswith("/") else 1
            doubt = doubt if doubted > 0 else ""
        if closing:
            if close_root and name == close_root[-1]:
                close_root.pop()
                roots -= 1
            elif name in PROSE:
                prose = False
            continue
        if name in RAW:
            at = _after(page, name, at)
            continue
        named = 0
        if attributes and name not in ("html", "body") and not (code and name not in BREAKING):
            named = 2 * _foreign(attributes) if name in ROOTS else _furniture(attributes)
        if name in LEFT_OUT or (name == "header" and not roots) or named == 2:
            end_block()
            if name not in VOID and not attributes.endswith("/"):
                outside, depth, inner = name, 1, []
            continue
        if name in ROOTS or (attributes and re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)):
            end_block()
            close_root.append(name)
            roots += 1
            prose, doubt = False, ""
        elif name in PROSE:
            prose = True
        elif name in BREAKING and name != "br":
            prose = False
        if named == 1 and not doubt and name in BREAKING and name not in HOLDERS and name not in ROOTS and name not in VOID and not attributes.endswith("/"):
            doubt, doubted = name, 1
    end_block()
    return found


def _after(page: str, name: str, at: int) -> int:
    """Behind the end tag of an element whose content is no markup."""
    end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def common_lines(left: list[int], right: list[int]) -> list[int]:
    """Places in ``left`` of a longest common subsequence: the longest increasing run of matching places."""
    places: dict[int, list[int]] = {}
    for at, value in enumerate(right):
        places.setdefault(value, []).append(at)
    ends: list[int] = []
    nodes: list[tuple[int, int]] = []  # (place in left, node before)
    tails: list[int] = []
    for at, value in enumerate(left):
        for other in reversed(places.get(value, ())):
            size = bisect_left(ends, other)
            nodes.append((at, tails[size - 1] if size else -1))
            if size == len(ends):
                ends.append(other)
                tails.append(len(nodes) - 1)
            else:
                ends[size], tails[size] = other, len(nodes) - 1
    chosen, node = [], tails[-1] if tails else -1
    while node >= 0:
        at, node = nodes[node]
        chosen.append(at)
    return chosen[::-1]


_MARKS = "array<struct<line:bigint,size:int,open:boolean>>"


def _parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(row, page_id, url, host, path, lines, marks, class): marks has hash, size and openness of each line, if any is open.

    Pages of a host have one class if their lines are equal; a page without open lines has one of its own.
    """
    from zlib import adler32, crc32

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                lines, hashes = [], []
                for page in texts.to_pylist():
                    found = blocks(page)
                    lines.append([t for t, _ in found])
                    hashes.append([{"line": crc32(t.encode()) << 31 ^ adler32(t.encode()), "size": len(t), "open": o} for t, o in found] if any(o for _, o in found) else [])
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(lines, pa.list_(pa.string())),
                        pa.array(hashes, pa.list_(pa.struct([("line", pa.int64()), ("size", pa.int32()), ("open", pa.bool_())]))),
                    ],
                    names=["row", "page_id", "url", "lines", "marks"],
                )
                row += n

    frame = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = dict(frame.dtypes)["page_id"]
    rows = frame.mapInArrow(parse, f"row long, page_id {kind}, url string, lines array<string>, marks {_MARKS}")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.lower(F.regexp_replace(bare, r"(/.*|:[0-9]+(/.*)?)$", ""))
    alike = F.when(F.size("marks") > 0, F.xxhash64("marks")).otherwise(F.col("row"))
    return rows.withColumns({"host": host, "path": F.regexp_replace(bare, r"^[^/]*", ""), "class": alike})


def _shared(rows: DataFrame) -> DataFrame:
    """(host, class, cut): places of open lines that the nearest page shares, from rows (class, host, path, marks).

    Pages of a class combine before the shuffle, and the smallest path stands for them. Classes are sorted over all partitions. Within
    one, neighbours are next to each other; the last and first rows of partitions are exchanged through a table of one row for each partition.
    """
    classes = rows.groupBy("host", "class").agg(F.min("path").alias("path"), F.first("marks").alias("marks"))
    # Written first: a range shuffle reads its input twice.
    classes = stored(classes.select("class", "host", "path", "marks"), "page-classes")
    ordered = classes.repartitionByRange("host", "path", "class").sortWithinPartitions("host", "path", "class")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.num_rows
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns], names=["part", "at", *batch.schema.names])
            at += n

    kind = f"class long, host string, path string, marks {_MARKS}"
    numbered = stored(ordered.mapInArrow(number, f"part int, at long, {kind}"), "sorted-pages")
    page = F.struct("host", "path", F.col("marks.line").alias("lines"), F.aggregate("marks.size", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    edges = numbered.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"))
    by_part = Window.orderBy("part")  # one row for each partition
    edges = stored(edges.select("part", "low", "high", F.lag("last").over(by_part).alias("above"), F.lead("first").over(by_part).alias("below")), "edges")
    rows = numbered.join(F.broadcast(edges), "part").repartition("part").sortWithinPartitions("part", "at")
    within = Window.partitionBy("part").orderBy("at")
    rows = rows.withColumns({"before": F.coalesce(F.lag(page).over(within), "above"), "after": F.coalesce(F.lead(page).over(within), "below")})

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for alike, host, path, marks, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = sorted((x for x in (before, after) if x and x["host"] == host), key=lambda x: -_beginning(path, x["path"]))
                hashes, whole = [x["line"] for x in marks], sum(x["size"] for x in marks)
                for page in near:
                    common = common_lines(hashes, page["lines"])
                    if sum(marks[i]["size"] for i in common) < COPY * max(whole, page["size"]):
                        cut = [i for i in common if marks[i]["open"]]
                        if cut:
                            out.append((alike, host, cut))
                        break
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["class", "host", "cut"]
                )

    return rows.select("class", "host", "path", "marks", "before", "after").mapInArrow(align, "class long, host string, cut array<int>")


def _beginning(left: str, right: str) -> int:
    """How many code points two paths begin with in common."""
    size = 0
    for a, b in zip(left, right):
        if a != b:
            break
        size += 1
    return size


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page row.

    A null or empty html, and one without main text, has an empty text. Pages without a url are of the host ''. Nulls in
    ``key`` stay null; repeated rows, as all pages of a host with equal blocks, are cut alike;
    an empty table gives no rows. Other columns are not read.
    """
    rows = stored(_parsed(pages, key, url, html), "pages")
    cut = stored(_shared(rows.where(F.size("marks") > 0).select("class", "host", "path", "marks")), "shared-lines")
    kept = F.when(F.col("cut").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("cut", i)))
    found = rows.join(cut, ["host", "class"], "left").select(F.col("page_id").alias(key), F.col("url").alias(url), F.array_join(kept, "\n").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
