"""A sparse ensemble of rules that scores texts: tree paths as conjunctions, weighted by a lasso logistic regression.

Trees and weights are fitted by Spark on statistics of a bounded sample of labelled texts. The rules with a weight are
compiled into one column expression, so scoring is a projection without Python or shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import SPACES, count_of, let, ratio, unused, whole, words_of
from barlake.llm.quality_rules import STOP_WORDS
from barlake.session import stage


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled rows that are fitted on (in expectation; they are picked by a hash of the id)."""

    max_rows: int = 20_000
    trees: int = 12
    depth: int = 3
    penalty: float = 0.002
    seed: int = 7


@dataclass(frozen=True)
class Condition:
    """statistic <= threshold, or > if `above`."""

    statistic: str
    threshold: float
    above: bool


@dataclass(frozen=True)
class Ensemble:
    """score = 1 / (1 + exp(-(intercept + weights of the rules that hold)))."""

    intercept: float
    rules: tuple[tuple[frozenset[Condition], float], ...]

    def score(self, statistics: Column) -> Column:
        def holds(rule: frozenset[Condition]) -> Column:
            checks = sorted(rule, key=lambda c: (c.statistic, c.threshold, c.above))
            return reduce(and_, (statistics[c.statistic] > c.threshold if c.above else statistics[c.statistic] <= c.threshold for c in checks))

        total = reduce(add, (F.when(holds(rule), F.lit(weight)).otherwise(0.0) for rule, weight in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


STATISTICS = (
    "log_words",
    "mean_word_length",
    "symbols_per_word",
    "marks_per_word",
    "digit_ratio",
    "capital_ratio",
    "distinct_word_ratio",
    "stop_word_ratio",
    "distinct_line_ratio",
    "words_per_line",
    "full_stop_ratio",
)


def statistics_of(text: Column) -> Column:
    """A struct of the statistics of a text, each a double; 0 where there is nothing to divide by."""

    def of_words(words: Column) -> Column:
        count = F.size(words)
        return F.struct(
            count.alias("count"),
            F.size(F.array_distinct(words)).alias("distinct"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("stops"),
        )

    def of_parts(p: Column) -> Column:
        count, letters = p["w"]["count"], p["letters"]
        values = (
            F.log1p(count.cast("double")),
            ratio(letters, count),
            ratio(p["symbols"], count),
            ratio(p["marks"], count),
            ratio(p["digits"], letters),
            ratio(p["capitals"], letters),
            ratio(p["w"]["distinct"], count),
            ratio(p["w"]["stops"], count),
            ratio(p["distinct_lines"], p["lines"]),
            ratio(count, p["lines"]),
            ratio(p["stops"], count),
        )
        return F.struct(*(value.alias(name) for name, value in zip(STATISTICS, values, strict=True)))

    lines = F.split(text, "\n")
    parts = F.struct(
        let(words_of(text), of_words).alias("w"),
        F.length(F.translate(text, SPACES, "")).alias("letters"),
        count_of(text, "#*$%&|<>{}[]\\/@").alias("symbols"),
        count_of(text, "!?=_~^").alias("marks"),
        count_of(text, "0123456789").alias("digits"),
        F.length(F.regexp_replace(text, "\\P{Lu}+", "")).alias("capitals"),
        count_of(text, ".,;:").alias("stops"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("distinct_lines"),
    )
    return let(parts, of_parts)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, folder: str, settings: Settings, doc_id: str, text: str, label: str) -> DataFrame:
    """label (1.0, 0.0) and the statistics of a bounded sample of labelled texts; several labels of an id count as the lowest."""
    given = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
    given = given.where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, settings.max_rows / max(1, given.count()))
    grid = 1 << 30
    given = given.where(F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(grid)) < int(share * grid))
    given = stage(given.groupBy("doc_id").agg(F.min("label").alias("label")), folder, "labels")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the labels are at most about `max_rows` rows
    rows = texts.join(F.broadcast(given), "doc_id").select("label", statistics_of(whole("text")).alias("s"))
    return stage(rows.select("label", "s.*"), folder, "training")


def tree_rules(forest, names: tuple[str, ...] = STATISTICS) -> set[frozenset[Condition]]:
    """The conjunction of conditions on the way to each node (but the root) of each tree."""
    rules = set()

    def walk(node, way: frozenset[Condition]) -> None:
        if way:
            rules.add(way)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, threshold = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), way | {Condition(name, threshold, False)})
            walk(node.rightChild(), way | {Condition(name, threshold, True)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), frozenset())
    return rules


def fit(rows: DataFrame, settings: Settings = Settings()) -> Ensemble:
    """An ensemble fitted on `training_rows`. Rows of a single label, or none, give the smoothed share of label 1."""
    total, ones = rows.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0.0
    if ones in (0, total):
        return Ensemble(math.log((ones + 1) / (total - ones + 1)), ())
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, featureSubsetStrategy="0.5", seed=settings.seed)
    rules = sorted(tree_rules(forest.fit(vectors)), key=lambda rule: sorted(map(repr, rule)))
    if not rules:
        return Ensemble(math.log((ones + 1) / (total - ones + 1)), ())

    def holds(rule: frozenset[Condition]) -> Column:
        return reduce(and_, (F.col(c.statistic) > c.threshold if c.above else F.col(c.statistic) <= c.threshold for c in rule))

    held = rows.select("label", array_to_vector(F.array(*(holds(rule).cast("double") for rule in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=settings.penalty, standardization=False, maxIter=100)
    fitted = lasso.fit(held)
    weights = fitted.coefficients.toArray().tolist()
    return Ensemble(float(fitted.intercept), tuple((rule, w) for rule, w in zip(rules, weights, strict=True) if w))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.7,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 from `threshold` on).

    Only statistics of the whole text are inputs. A null text counts as empty and is scored as such; repeated rows get
    equal scores; a null doc_id is scored, never learnt from. Labels other than 0 and 1 are ignored; without labels of
    both kinds every score is the smoothed share of label 1 (0.5 without any). Other columns are not read.
    """
    ensemble = fit(training_rows(docs, labels, folder, settings, doc_id, text, label), settings)
    scored = docs.select(F.col(doc_id).alias("doc_id"), let(statistics_of(whole(text)), ensemble.score).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def of_quality(docs: DataFrame, labels: DataFrame, folder: str, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that the ensemble accepts, with all their columns, whatever their names are.

    A null or empty text is scored as an empty one; repeated rows go or stay alike, also those without doc_id. Without labels
    of both kinds all documents have one score, so all go or all stay. See `score_quality`.
    """
    ensemble = fit(training_rows(docs, labels, folder, Settings(), "doc_id", text, "quality"))
    score = unused("__score", docs)
    scored = docs.withColumn(score, let(statistics_of(whole(text)), ensemble.score))
    return scored.where(F.col(score) >= threshold).drop(score)
