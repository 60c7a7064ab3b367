"""Link policy over web pages: which pages may be shown as markup, and where they link.

A page may be shown if it uses only the allowed tags and all its links start at the
root; otherwise it is to be escaped. All work is per page; only counts are shuffled.

Lists are exploded with ``explode_outer`` and nulls dropped after: for ``explode`` the
optimizer adds a test for empty lists that reads every page a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import markup

# Tags a page may use.
ALLOWED_TAGS = ("a", "span")

ESCAPE_TAG = "ESCAPE_TAG"
ESCAPE_MALFORMED = "ESCAPE_MALFORMED"
ESCAPE_LINK = "ESCAPE_LINK"
ALLOW = "ALLOW"


def markup_audit(
    pages: DataFrame, allowed: tuple[str, ...] = ALLOWED_TAGS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per page: offending tags, anchors, links not from the root, and the verdict; ``keep`` adds columns.

    Tags are judged first, then whether a strict parser would take the page (see ``markup.well_formed``; if
    not, it is never allowed), then links.
    """
    seen = pages.select("page_id", "url", *keep, F.col("html").alias("_html"), markup.visible(F.col("html")).alias("_seen")).select(
        "page_id",
        "url",
        *keep,
        "_html",
        markup.tags(F.col("_seen")).alias("tags"),
        markup.anchors(F.col("_seen")).alias("anchor_texts"),
    )
    permitted = F.array(*[F.lit(tag) for tag in allowed])
    outside = F.filter(markup.hrefs(F.col("anchor_texts")), lambda href: ~href.startswith("/"))
    return (
        seen.select(
            "page_id",
            "url",
            *keep,
            F.sort_array(F.array_except("tags", permitted)).alias("offending_tags"),
            F.size("anchor_texts").alias("anchors"),
            F.size(outside).alias("outside_links"),
            "_html",
        )
        .withColumn(
            "verdict",
            F.when(F.size("offending_tags") > 0, ESCAPE_TAG)
            .when(~markup.well_formed(F.col("_html")), ESCAPE_MALFORMED)
            .when(F.col("outside_links") > 0, ESCAPE_LINK)
            .otherwise(ALLOW),
        )
        .drop("_html")
    )


def shown_markup(pages: DataFrame, base: str, allowed: tuple[str, ...] = ALLOWED_TAGS) -> DataFrame:
    """Per page the verdict and the text to show: ``page_id, verdict, shown``.

    An allowed page has ``base`` put before its links; any other is escaped whole. A null page
    is shown as a null.
    """
    html = F.col("html")
    escaped = html
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(entity))
    linked = markup.with_base(html, base)
    judged = markup_audit(pages.select("page_id", F.lit(None).cast("string").alias("url"), "html"), allowed, keep=("html",))
    return judged.select("page_id", "verdict", F.when(F.col("verdict") == ALLOW, linked).otherwise(escaped).alias("shown"))


def markup_summary(pages: DataFrame, allowed: tuple[str, ...] = ALLOWED_TAGS) -> DataFrame:
    """Pages per host and verdict; a URL without a host counts under null."""
    return (
        markup_audit(pages, allowed)
        .select(F.try_parse_url("url", F.lit("HOST")).alias("host"), "verdict")
        .groupBy("host", "verdict")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def offending_tags(pages: DataFrame, allowed: tuple[str, ...] = ALLOWED_TAGS) -> DataFrame:
    """Pages per tag outside the allowed ones."""
    return (
        markup_audit(pages, allowed)
        .select(F.explode_outer("offending_tags").alias("tag"))
        .filter(F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def resolve_links(pages: DataFrame, base: str | Column | None = None) -> DataFrame:
    """One row per root-relative link: page, link as written, resolved URL.

    ``base`` is one path for all pages or a column; by default each page's own site.
    """
    if base is None:
        base = markup.site(F.col("url"))
    elif isinstance(base, str):
        base = F.lit(base)
    links = markup.hrefs(markup.anchors(markup.visible(F.col("html"))))
    return (
        pages.select("page_id", base.alias("base"), F.explode_outer(links).alias("href"))
        .filter(F.col("href").startswith("/"))
        .select(
            "page_id", "href", markup.resolved(F.col("base"), F.col("href")).alias("resolved")
        )
    )


def link_in_degree(pages: DataFrame, base: str | Column | None = None) -> DataFrame:
    """Links to each resolved URL, counted before the shuffle."""
    return (
        resolve_links(pages, base)
        .groupBy("resolved")
        .agg(F.count(F.lit(1)).alias("links"))
    )
