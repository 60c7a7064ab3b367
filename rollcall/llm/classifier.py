r"""Quality classifier: a sparse rule ensemble over statistics of texts.

1. Statistics of each text are column expressions.
2. A small random forest is grown on labelled rows. Every path from a root to a node is a rule: a
   conjunction of bounds on statistics.
3. A logistic regression with an L1 penalty over the rules' 0/1 values keeps few of them.
4. The rules with a weight are compiled into one column expression, which scores any number of rows
   without a model object or Python in the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Bounds (low, high] on statistics, all of which hold, and a weight."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        parts = []
        for name, low, high in self.bounds:
            if low > -math.inf:
                parts.append(F.col(name) > F.lit(low))
            if high < math.inf:
                parts.append(F.col(name) <= F.lit(high))
        held = parts[0]
        for part in parts[1:]:
            held = held & part
        return held

    def holds(self, row: dict[str, float]) -> bool:
        return all(low < row[name] <= high for name, low, high in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    """An intercept and weighted rules."""

    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


#: All of them are at least 0; texts without words have 0 everywhere.
STATISTICS = (
    "n_words", "word_length", "distinct_words", "distinct_pairs", "upper", "digits", "marks", "symbols", "line_words", "distinct_lines", "other",
)


def with_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the statistics of each row's whole text (null: empty)."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumns({"words": F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))})
    words, lines = F.col("words"), F.col("lines")
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(words[i - 1], words[i])))
    rows = rows.withColumn("pairs", F.coalesce(pairs, F.array().cast("array<bigint>")))
    # How many code points a class has: what is left when the rest is removed.
    size = lambda cls: F.length(F.regexp_replace("text", f"[^{cls}]+", ""))
    letters = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{P}\p{S}\x20\x09-\x0D]+", ""))
    n, chars = F.size(words), F.length("text")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    return rows.select(
        F.col("key").alias(key),
        n.cast("double").alias("n_words"),
        share(F.length(F.array_join(words, "")), n).alias("word_length"),
        share(F.size(F.array_distinct(words)), n).alias("distinct_words"),
        share(F.size(F.array_distinct("pairs")), F.size("pairs")).alias("distinct_pairs"),
        share(size(r"\p{Lu}"), chars).alias("upper"),
        share(size(r"\p{N}"), chars).alias("digits"),
        share(size(r"\p{P}\p{S}"), chars).alias("marks"),
        share(size(r"#*$%&|<>!"), chars).alias("symbols"),
        share(n, F.size(lines)).alias("line_words"),
        share(F.size(F.array_distinct(lines)), F.size(lines)).alias("distinct_lines"),
        share(letters, chars).alias("other"),
    )


def tree_rules(node, names: tuple[str, ...], bounds: dict[str, tuple[float, float]] | None = None) -> set[Rule]:
    """Rules of all paths that start at a tree's root."""
    bounds = bounds or {}
    found = {Rule(tuple((k, *v) for k, v in sorted(bounds.items())))} if bounds else set()
    if node.getClass().getSimpleName() != "InternalNode":
        return found
    name, at = names[node.split().featureIndex()], node.split().threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    found |= tree_rules(node.leftChild(), names, bounds | {name: (low, min(high, at))})
    return found | tree_rules(node.rightChild(), names, bounds | {name: (max(low, at), high)})


def fitted(rows: DataFrame, label: str, names: tuple[str, ...] = STATISTICS, trees: int = 20, depth: int = 3, penalty: float = 0.002, most: int = 200_000, seed: int = 7) -> RuleModel:
    """Grow the trees and weigh their rules on ``rows``: statistics and a 0/1 label.

    More than ``most`` labelled rows are thinned to about as many, by a hash of their values. With no
    row the score is 1/2 everywhere; with rows of one label, close to that label.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return RuleModel(math.log(share / (1 - share)), ())
    if total > most:
        buckets = 1 << 20
        rows = rows.where(F.pmod(F.xxhash64(*names), F.lit(buckets)) < int(buckets * most / total))
    train = rows.select(*names, F.col(label).cast("double").alias("label"))
    train = stored(VectorAssembler(inputCols=list(names), outputCol="features").transform(train), "labelled")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, seed=seed, maxBins=64).fit(train)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._java_obj.rootNode(), names)}, key=lambda r: r.bounds)
    held = array_to_vector(F.array(*[r.column().cast("double") for r in rules]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    model = lasso.fit(stored(train.select("label", held.alias("features")), "rule-values"))
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleModel(float(model.intercept), tuple(Rule(r.bounds, w) for r, w in weights))


def scored(documents: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", threshold: float = 0.7, key: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """(key, held_out, score, predicted) of each document row, from labels of rows that are not held out.

    ``held_out`` is an expression over the key; where it is null the row counts as held out. Nulls in ``key`` stay
    null and learn nothing. A document with several labels takes their majority (a tie: 1); null
    labels and labels of no document are passed over. Repeated rows get equal scores; an empty
    table gives no rows. Other columns are not read.
    """
    rows = stored(with_statistics(documents, key, text).withColumn("held_out", F.coalesce(held_out, F.lit(True))), "statistics")
    answers = labels.where(F.col(label).isNotNull()).groupBy(F.col(key)).agg((F.avg(label) >= 0.5).cast("int").alias("_answer"))
    train = rows.where(~F.col("held_out")).join(answers, key).select(*STATISTICS, "_answer")
    model = fitted(train, "_answer", **fit)
    return rows.select(key, "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
