r"""Personal data, and the words that give it away, found by column expressions only.

Base kinds are patterns with a check: email, ip, card, phone. Each distinct value is a
protected entity. A term (a run of letters, A-Z lower-cased) within ``REACH`` code points
of an entity's occurrence discloses it when their pointwise mutual information over documents,

    log2(n_et * N / (n_e * n_t)),

is at least ``disclosure`` times the entity's information content log2(N / n_e), where N counts
documents, n_e those with the entity, n_t those with the term, and n_et those where the
term stands near the entity. Pairs seen in one text only, however often that is copied, say nothing about
co-occurrence and are passed over. Disclosing terms become spans of kind ``term``.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within a kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import kept, row_print, scratch, short, spare, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Code points on either side of an entity in which terms are looked at.
REACH = 64
#: Spans near a span that can reach into its surroundings: the shortest matches have
#: 5, 7, 13 and 11 code points, so fewer than 40 fit into REACH on one side.
NEAR = 40

_NAME = "A-Za-z0-9._%+-"
# Each pattern finds what the plain one in its comment finds, in linear time: a match can only
# start where a run of its first class starts, or right after the match before.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+, and single digits, which no check lets pass
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = r"\p{L}+"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


@dataclass(frozen=True)
class Disclosure:
    """When a term discloses an entity."""

    share: float = 0.8
    texts: int = 2


def running(values: Column, join) -> Column:
    """Running results of an associative function over an array, in log2(size) passes."""
    steps = F.transform(
        F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")), lambda e: F.call_function("shiftleft", F.lit(1), e)
    )
    return F.aggregate(steps, values, lambda sums, k: F.transform(sums, lambda x, i: F.when(i >= k, join(x, sums[i - k])).otherwise(x)))


def _starts(text: Column, matches: Column, pattern: str) -> Column:
    """Where each match starts: the gaps and matches before it, summed."""
    gaps = F.split(text, pattern, -1)
    steps = F.transform(gaps, lambda gap, i: F.length(gap) + F.when(i > 0, F.length(matches[i - 1])).otherwise(0))
    return running(steps, lambda a, b: a + b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def added(i: Column) -> Column:
        digit = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + added(i)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _check(kind: str, field: str | None = None):
    return lambda v: _passes(kind, v[field] if field else v)


def _built(kind: str, matches: Column, starts: Column) -> Column:
    return F.transform(
        matches, lambda v, i: F.struct(F.lit(kind).alias("kind"), starts[i].alias("start"), (starts[i] + F.length(v)).alias("end"), v.alias("entity"))
    )


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


_SPAN = "array<struct<kind:string,start:int,end:int,entity:string>>"


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column ``spans``: base spans by kind, then start."""
    found = {f"found_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    rows = rows.withColumns(found)
    parts = {}
    for kind, pattern in PATTERNS.items():
        matches = F.col(f"found_{kind}")
        worth = F.exists(matches, _check(kind))
        parts[f"starts_{kind}"] = F.when(worth, _starts(F.col(text), matches, pattern))
    rows = rows.withColumns(parts)
    spans = []
    for kind in KINDS:
        matches, starts = F.col(f"found_{kind}"), F.col(f"starts_{kind}")
        good = F.filter(_built(kind, matches, starts), _check(kind, "entity"))
        spans.append(F.when(starts.isNotNull(), good.cast(_SPAN)).otherwise(_nothing(_SPAN)))
    return rows.withColumn("spans", F.concat(*spans)).drop(*found, *parts)


def _terms(text: Column, first: Column, size: Column, cut_left: Column, cut_right: Column) -> Column:
    """Terms of a stretch of the text, but for one that touches a cut edge."""
    stretch = F.substring(text, first + 1, size)

    def of(at: Column) -> Column:
        words = F.regexp_extract_all(at, F.lit(LETTERS), F.lit(0))
        starts = _starts(at, words, LETTERS)
        built = F.transform(
            words,
            lambda w, i: F.struct(
                F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"),
                (first + starts[i]).alias("start"),
                (first + starts[i] + F.length(w)).alias("end"),
            ),
        )
        return F.filter(built, lambda t: ~(cut_left & (t["start"] == first)) & ~(cut_right & (t["end"] == first + size)))

    return F.transform(F.array(stretch), of)[0]


def _surroundings(text: Column, spans: Column) -> Column:
    """(entity, term, start, end) of all terms near base spans and in none of them."""
    length = F.length(text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["entity"])))

    def around(ordered: Column) -> Column:
        def of(s: Column, i: Column) -> Column:
            left = F.greatest(s["start"] - REACH, F.lit(0))
            right = F.least(s["end"] + REACH, length)
            both = F.concat(
                _terms(text, left, s["start"] - left, left > 0, F.lit(False)), _terms(text, s["end"], right - s["end"], F.lit(False), right < length)
            )
            close = F.slice(ordered, F.greatest(i - NEAR, F.lit(0)) + 1, 2 * NEAR + 1)
            free = F.filter(both, lambda t: ~F.exists(close, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))
            return F.transform(free, lambda t: F.struct(F.concat_ws(":", s["kind"], s["entity"]).alias("entity"), t["term"], t["start"], t["end"]))

        return F.flatten(F.transform(ordered, of))

    return F.transform(F.array(ordered), around)[0]


def located(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row for each document: key, prints, base spans and the terms around them."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = base_spans(rows, "text")
    near = F.when(F.size("spans") > 0, _surroundings(F.col("text"), F.col("spans"))).otherwise(
        _nothing("array<struct<entity:string,term:string,start:int,end:int>>")
    )
    return rows.select(F.col("key").alias(key), *row_print(F.col("key"), F.col("text")), F.xxhash64("text").alias("body"), "spans", near.alias("near"))


def disclosing(rows: DataFrame, documents: DataFrame, rule: Disclosure, text: str = "text") -> DataFrame:
    """(entity, term) pairs that disclose, from :func:`located` rows and the documents they are of.

    Counts go over all documents and combine before each shuffle; N is the only value the driver gets.
    """
    total = float(rows.count())
    pairs = rows.where(F.size("near") > 0).select("body", F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"], x["term"])))).alias("p"))
    joint = (
        pairs.groupBy("p.entity", "p.term", "body")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= rule.texts)
    )
    joint = stored(joint, "entity-terms")
    held = F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["entity"])))).alias("entity")
    entities = stored(rows.where(F.size("spans") > 0).select(held).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    letters = F.regexp_extract_all(F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(LETTERS), F.lit(0))
    terms = documents.select(F.explode(F.array_distinct(letters)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    terms = stored(terms.join(stored(joint.select("term").distinct(), "near-terms"), "term", "left_semi"), "terms")
    information = F.log2(F.lit(total) / F.col("n_e"))
    shared = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    good = joint.join(entities, "entity").join(terms, "term").where((information > 0) & (shared >= rule.share * information))
    return good.select("entity", "term")


def found(documents: DataFrame, rule: Disclosure = Disclosure(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, prints and ``all_spans`` (base spans by kind and start, then terms by start) of each row.

    Null and empty texts have no spans. Repeated rows count as documents of one text and get equal spans. Nulls
    in ``key`` stay null. Other columns are not read; an empty table gives no rows.
    """
    rows = stored(located(documents, key, text), "personal-data")
    pairs = stored(disclosing(rows, documents, rule, text), "disclosing")
    near = rows.where(F.size("near") > 0).select("print_0", "print_1", F.explode("near").alias("at"))
    marked = near.join(pairs, (F.col("at.entity") == pairs["entity"]) & (F.col("at.term") == pairs["term"]))
    marked = marked.groupBy("print_0", "print_1").agg(
        F.sort_array(F.collect_set(F.struct(F.lit(TERM).alias("kind"), F.col("at.start").alias("start"), F.col("at.end").alias("end")))).alias("terms")
    )
    base = F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    every = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "terms"))
    return rows.join(marked, ["print_0", "print_1"], "left").select(key, "print_0", "print_1", every.alias("all_spans"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`found` rows."""
    spans = F.col("all_spans")
    counts = [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = written(F.filter(spans, lambda s: s["kind"] != TERM))
    terms = F.size(_of_kind(spans, TERM)).cast("long").alias("n_term")
    return rows.select(key, *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"), terms)


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with spans replaced: base kinds by their label, capitalised terms by [NAME], other terms by nothing."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def of(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def pieces(ends: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i > 0, ends[i - 1]).otherwise(0)
                word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
                label = F.when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
                for kind, sign in LABELS.items():
                    label = F.when(s["kind"] == kind, sign).otherwise(label)
                gap = F.substring(text, before + 1, F.greatest(s["start"] - before, F.lit(0)))
                return F.concat(gap, F.when(s["start"] >= before, label).otherwise(""))

            return F.concat(F.array_join(F.transform(ordered, piece), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

        return F.transform(F.array(ends), pieces)[0]

    return F.transform(F.array(ordered), of)[0]


def sanitised(documents: DataFrame, rule: Disclosure = Disclosure(), key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents with personal data generalised, disclosing terms generalised or removed, and all their columns.

    ``size``, if there is such a column, is set to the new number of code points of changed texts. Null and empty texts
    stay as they are, and so do null keys; repeated rows are changed alike. Columns of any name pass through; an empty table gives no rows.
    """
    first, second, at = (spare(documents, x) for x in ("print_0", "print_1", "all_spans"))
    with scratch(documents.sparkSession):
        spans = found(documents, rule, key, text).where(F.size("all_spans") > 0).select("print_0", "print_1", "all_spans").dropDuplicates(["print_0", "print_1"])
        spans = kept(spans.toDF(first, second, at), "spans")
    prints = row_print(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = documents.withColumns({first: prints[0], second: prints[1]}).join(short(spans, F.size(at)), [first, second], "left")
    joined = joined.withColumn(text, F.when(F.col(at).isNotNull(), _rewritten(F.col(text), F.col(at))).otherwise(F.col(text)))
    if size in documents.columns:
        joined = joined.withColumn(size, F.when(F.col(at).isNotNull(), F.length(text)).otherwise(F.col(size)).cast(documents.schema[size].dataType))
    return joined.select(*documents.columns)
