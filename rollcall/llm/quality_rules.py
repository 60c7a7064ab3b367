r"""Quality rules over the lines and words of documents, as column expressions only.

Base rules look at one text. The cross-document rule counts, for each host and normalised
line, the distinct documents that have the line, removes lines above the limit, and rejects
documents of which too little is left.

Words are runs of ``[^\x20\x09-\x0D]``; lines are split at ``\n``. A line is normalised by
lower-casing A-Z, writing runs of digits as 0 and runs of white space as one space, and
trimming.

Copies are not the matter of this rule: documents of one host whose runs of five words have the same smallest
MD5 digest count as one document, so a text that was copied or lightly edited thousands of
times does not make its own lines frequent. Which run that is does not depend on how long or common it is, so a
line takes part in it by no more than its share of a document's runs, and can't hide its own frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import kept, row_print, scratch, short, spare, stored

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
RUN = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineRule:
    """A line is frequent from max(documents, share of the host's documents) documents on."""

    documents: int = 5
    share: float = 0.01
    words_left: int = 5
    share_left: float = 0.3


def normal_line(line: Column) -> Column:
    """A line as it is counted."""
    folded = F.translate(line, _UPPER, _LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[0-9]+", "0"), f"[{SPACE}]+", " "))


def _words_in(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1)))


def _repeated(runs: Column) -> Column:
    """Words in runs whose hash is in the (sorted) array of (hash, place) more than once."""
    last = F.size(runs) - 1
    hash_at = lambda k: runs[k]["hash"]
    again = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: ((k > 0) & (hash_at(F.greatest(k - 1, F.lit(0))) == hash_at(k))) | ((k < last) & (hash_at(F.least(k + 1, last)) == hash_at(k))),
    )
    return F.array_sort(F.transform(again, lambda k: runs[k]["place"]))


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One narrow row for each document: key, base measures, prints, and its lines.

    A null text is an empty one: no words, no lines. Nulls in ``key`` stay null and a null host is a host
    of its own. Other columns are not read.
    """
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), text_of.alias("text"))
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), "lines": F.split("text", "\n", -1)})
    words, lines = F.col("words"), F.col("lines")
    places = F.when(F.size(words) >= RUN, F.sequence(F.lit(0), F.size(words) - RUN)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns(
        {
            "sizes": F.transform(words, lambda w: F.length(w)),
            "runs": F.transform(places, lambda i: F.xxhash64(*[words[i + k] for k in range(RUN)])),
            "spoken": F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    sizes, runs = F.col("sizes"), F.col("runs")
    rows = rows.withColumns(
        {
            "places": F.when(
                F.size(F.array_distinct(runs)) < F.size(runs),
                F.array_sort(F.transform(runs, lambda x, i: F.struct(x.alias("hash"), i.alias("place")))),
            ),
            "body": F.when(
                F.size(words) >= RUN, F.array_min(F.transform(places, lambda i: F.md5(F.concat_ws(" ", *[words[i + k] for k in range(RUN)]).cast("binary"))))
            ).otherwise(F.md5(F.concat_ws(" ", words).cast("binary"))),
        }
    )
    rows = rows.withColumn("again", F.when(F.col("places").isNotNull(), _repeated(F.col("places"))))
    again = F.col("again")
    repeated = F.when(
        again.isNotNull(),
        F.aggregate(
            F.slice(again, 2, F.size(again)),
            F.struct(F.element_at(again, 1).alias("last"), F.lit(RUN).alias("sum")),
            lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(RUN), x - s["last"])).alias("sum")),
        )["sum"],
    ).otherwise(0)
    return rows.select(
        F.col("key").alias(key),
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        *row_print(F.col("key"), F.col("host"), F.col("text")),
        F.xxhash64(F.col("host").isNull(), "host").alias("host_hash"),
        "body",
        F.transform(
            lines,
            lambda x: F.struct(F.xxhash64(F.col("host").isNull(), F.col("host"), normal_line(x)).alias("line"), _words_in(x).alias("words")),
        ).alias("lines"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or over a fifth of the words in repeated runs."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def frequent_lines(rows: DataFrame, rule: LineRule) -> DataFrame:
    """(line) hashes above the limit of their host, from :func:`measured` rows.

    Distinct documents are counted in two steps, each combined before its shuffle, so
    neither a line nor a host needs all its rows in one place.
    """
    held = rows.select("host_hash", "body", F.explode("lines").alias("at")).where(F.col("at.words") > 0)
    lines = held.select("host_hash", F.col("at.line").alias("line"), "body").distinct().groupBy("host_hash", "line").agg(F.count(F.lit(1)).alias("documents"))
    hosts = rows.select("host_hash", "body").distinct().groupBy("host_hash").agg(F.count(F.lit(1)).alias("of_host"))
    return (
        lines.where(F.col("documents") >= rule.documents)
        .join(hosts, "host_hash")
        .where(F.col("documents") >= rule.share * F.col("of_host"))
        .select("line")
    )


def assessed(documents: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Verdicts: key, measures, base_failed, kept, words_left, and the places of removed lines.

    One row for each input row. A document is kept if it passes the base rules and, after its
    frequent lines are removed, has at least ``words_left`` words and ``share_left`` of its words.
    Empty and null texts fail the base rules. Repeated rows get equal verdicts and, having one
    body, count once. An empty table gives an empty result.
    """
    rows = stored(measured(documents, key, text, host), "quality")
    frequent = stored(frequent_lines(rows, rule), "frequent-lines")
    lines = rows.select("print_0", "print_1", F.posexplode("lines").alias("place", "at")).where(F.col("at.words") > 0)
    removed = (
        lines.join(frequent, F.col("at.line") == frequent["line"])
        .groupBy("print_0", "print_1")
        .agg(F.collect_set(F.struct("place", F.col("at.words").alias("words"))).alias("cut"))
    )
    failed, left = base_failed(F.col("n_words"), F.col("n_repeat_words")), F.col("words_left")
    return (
        rows.drop("lines", "body", "host_hash")
        .join(removed, ["print_0", "print_1"], "left")
        .withColumn("words_left", F.col("n_words") - F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0)))
        .withColumn("removed_lines", F.coalesce(F.transform("cut", lambda x: x["place"]), F.array().cast("array<int>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= rule.words_left) & (left >= rule.share_left * F.col("n_words")))
        .drop("cut")
    )


def filtered(documents: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text", host: str = "source", size: str = "n_chars") -> DataFrame:
    """The kept documents without their frequent lines, with the columns they came with.

    ``size``, if there is such a column, is set to the new number of code points. Null, empty and short texts go, by the base
    rules; repeated rows go or stay together; rows with a null key or host are judged like any other. Columns of any name pass through;
    an empty table gives no rows.
    """
    first, second, cut = (spare(documents, x) for x in ("print_0", "print_1", "removed_lines"))
    with scratch(documents.sparkSession):
        verdicts = assessed(documents, rule, key, text, host).select("print_0", "print_1", "kept", "removed_lines")
        verdicts = stored(verdicts.where("not kept or size(removed_lines) > 0").dropDuplicates(["print_0", "print_1"]), "verdicts")
        gone = kept(verdicts.where("not kept").select(F.col("print_0").alias(first), F.col("print_1").alias(second)), "rejected")
        changed = kept(verdicts.where("kept").drop("kept").toDF(first, second, cut), "cut")
    prints = row_print(F.col(key), F.col(host).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = documents.withColumns({first: prints[0], second: prints[1]})
    joined = joined.join(short(gone), [first, second], "left_anti").join(short(changed, F.size(cut)), [first, second], "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(cut, i)), "\n")
    joined = joined.withColumn(text, F.when(F.size(cut) > 0, rest).otherwise(F.col(text)))
    if size in documents.columns:
        joined = joined.withColumn(size, F.when(F.size(cut) > 0, F.length(text)).otherwise(F.col(size)).cast(documents.schema[size].dataType))
    return joined.select(*documents.columns)
