"""Tags and links of a page as native columns, and whether a strict parser would take it.

Tags and links are read by regular expression over the whole text, also of pages that a strict parser would
refuse; :func:`well_formed` tells which those are. Names are compared as
written (``A`` is not ``a``) and without namespace prefix.

Quantifiers over unbounded text are possessive where alternatives repeat, so a match
takes linear time and constant stack however long a tag is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is opened and never closed hides the rest, so that no place is searched twice.
_HIDDEN = r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)"
_OPENING = r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)"
_ANCHOR = r"""<(?:[\w.-]+:)?a(?:\s((?:[^>"']++|"[^"]*+"|'[^']*+')*+))?/?>"""
_ATTRIBUTE = r"""[^\s=>"'/]++\s*=\s*(?:"[^"]*"|'[^']*')"""
_BLANK = r"[\x20\t\r\n]"
_NAME = r"[\p{L}_:][\p{L}\p{M}\p{N}_:.\u00B7-]*+"
# What is markup, in page order: hidden parts, instructions, tags whole or not, any other sign that opens one, references, and the end of a section.
_MARKUP = (
    _HIDDEN
    + r"""|<\?.*?(?:\?>|\z)|<[/\p{L}_:](?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>?|<|&[^&;<\s]*+;?|\]\]>"""
)
_OPENS = rf"""^<({_NAME})(?:{_BLANK}++{_NAME}{_BLANK}*+={_BLANK}*+(?:"[^"<]*+"|'[^'<]*+'))*+{_BLANK}*+/?>$"""
_CLOSES = rf"^</({_NAME}){_BLANK}*+>$"
_KEY = rf"""{_BLANK}({_NAME}){_BLANK}*+={_BLANK}*+(?:"[^"<]*+"|'[^'<]*+')"""
_REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]++|#x[0-9a-fA-F]++);"
_NUMBER = r"&#(x?[0-9a-fA-F]++);"
_INSTRUCTION = rf"(?s)^<\?(?![xX][mM][lL](?:{_BLANK}|\?)){_NAME}(?:{_BLANK}.*)?\?>$"
_NO_CHARACTER = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
_HREF = r"^(?:[\w.-]+:)?href\s*="
_QUOTED = r"""(?s)["'](.*)["']$"""
_SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def visible(html: Column) -> Column:
    """The page without comments and character data sections."""
    return F.regexp_replace(html, _HIDDEN, "")


def tags(html: Column) -> Column:
    """Names of all opening tags, with repeats."""
    return F.regexp_extract_all(html, F.lit(_OPENING), F.lit(1))


def _running_sum(values: Column) -> Column:
    """Sums of an array up to each place, in log2(size) passes over it."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))
    widths = F.transform(steps, lambda e: F.call_function("shiftleft", F.lit(1), e))
    return F.aggregate(widths, values, lambda sums, k: F.transform(sums, lambda x, i: F.when(i >= k, x + sums[i - k]).otherwise(x)))


def _nested(found: Column) -> Column:
    """Whether the tags of an array of (step, name), 1 for a start and -1 for an end, close in the order in which they open.

    An end belongs to the start before it on its level. On each level starts and ends take turns, so sorted by level
    and place they are pairs, and each pair has one name. No stack is carried from tag to tag.
    """

    def paired(sums: Column) -> Column:
        levels = F.transform(found, lambda tag, i: F.struct((sums[i] + F.when(tag["step"] < 0, 1).otherwise(0)).alias("level"), i.alias("at"), tag["step"].alias("step"), tag["name"].alias("name")))
        ordered = F.sort_array(levels)
        even = F.size(found) % 2 == 0
        pair = lambda tags, i: (tags[i]["step"] == 1) & (tags[i + 1]["step"] == -1) & (tags[i]["name"] == tags[i + 1]["name"]) & (tags[i]["level"] == tags[i + 1]["level"])
        firsts = F.sequence(F.lit(0), F.size(found) - 2, F.lit(2))
        return even & F.forall(sums, lambda x: x >= 0) & F.transform(F.array(ordered), lambda tags: F.forall(firsts, lambda i: pair(tags, i)))[0]

    sums = F.array(_running_sum(F.transform(found, lambda tag: tag["step"])))
    return F.when(F.size(found) == 0, True).when(F.size(found) % 2 == 1, False).otherwise(F.transform(sums, paired)[0])


def _sound(piece: Column) -> Column:
    """Whether a piece of markup is right by itself."""
    comment = piece.endswith("-->") & (F.length(piece) >= 7) & (F.locate("--", piece, 5) == F.length(piece) - 2)
    keys = F.regexp_extract_all(piece, F.lit(_KEY), F.lit(1))
    tag = (piece.rlike(_OPENS) | piece.rlike(_CLOSES)) & (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.regexp_replace(piece, _REFERENCE, "").contains("&")
    return (
        F.when(piece.startswith("<!--"), comment)
        .when(piece.startswith("<![CDATA["), piece.endswith("]]>"))
        .when(piece.startswith("<?"), piece.rlike(_INSTRUCTION))
        .when(piece.startswith("&"), piece.rlike(f"^{_REFERENCE}$"))
        .otherwise(tag)
    )


def _character(number: Column) -> Column:
    """Whether a numeric reference, ``65`` or ``x41``, is that of a character a page may have."""
    digits = F.regexp_replace(number, "^x?0*", "")
    code = F.when(F.length(digits) > 9, F.lit(1 << 30)).when(number.startswith("x"), F.conv(digits, 16, 10).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))
    return code.isin(9, 10, 13) | code.between(32, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)


def well_formed(html: Column) -> Column:
    """Whether a strict parser takes the page as the content of one element.

    That is: every start tag is closed, in order; tags, comments and instructions are whole; no attribute stands
    twice in a tag; ``&`` and ``<`` stand for themselves nowhere, and references name one of the five entities or a character. A
    null page is well formed. Work is in proportion to the page's length (times its logarithm), whatever its depth.
    """
    pieces = F.array(F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0)))

    def judged(found: Column) -> Column:
        shown = F.filter(found, lambda x: ~x.startswith("<!") & ~x.startswith("<?") & (x.startswith("<") | x.startswith("&")))
        numbers = F.regexp_extract_all(F.array_join(shown, " "), F.lit(_NUMBER), F.lit(1))
        named = F.filter(shown, lambda x: x.startswith("<") & ~x.endswith("/>"))
        steps = F.transform(
            named,
            lambda x: F.struct(F.when(x.startswith("</"), -1).otherwise(1).alias("step"), F.regexp_extract(x, rf"^</?({_NAME})", 1).alias("name")),
        )
        return F.when(~F.forall(found, _sound), False).when(~F.forall(numbers, _character), False).otherwise(_nested(steps))

    return F.when(html.isNull(), True).when(html.rlike(_NO_CHARACTER), False).otherwise(F.transform(pieces, judged)[0])


def anchors(html: Column) -> Column:
    """Attribute text of every ``a`` tag, empty where it has none."""
    return F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1))


def hrefs(anchor_texts: Column) -> Column:
    """Every href value in the attribute texts, in page order."""
    attributes = F.regexp_extract_all(
        F.array_join(anchor_texts, " "), F.lit(_ATTRIBUTE), F.lit(0)
    )
    links = F.filter(attributes, lambda attribute: attribute.rlike(_HREF))
    return F.transform(links, lambda link: F.regexp_extract(link, _QUOTED, 1))


def site(url: Column) -> Column:
    """Scheme and authority of a URL, empty where it has none."""
    return F.regexp_extract(url, _SITE, 0)


def resolved(base: Column, path: Column) -> Column:
    """Base without one trailing slash, a slash, path without one leading slash."""
    return F.concat(
        F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", "")
    )


def with_base(html: Column, base: str) -> Column:
    """The page with ``base`` put before every href of an ``a`` tag, one slash between them."""
    before = r"""(<(?:[\w.-]+:)?a(?:\s++(?!(?:[\w.-]+:)?href\s*=)[^\s=<>"'/]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s++(?:[\w.-]+:)?href\s*=\s*["'])/?"""
    return F.regexp_replace(html, F.lit(before), F.concat(F.lit("$1"), F.lit(base.rstrip("/").replace("\\", "\\\\").replace("$", "\\$")), F.lit("/")))
