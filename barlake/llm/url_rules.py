"""URL filters: fixed rules for hosts and paths, and rules of URL tokens that Spark's FP-growth mines from labels."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.session import empty, stage

#: Up to so many rows of the index of mined rules are broadcast; a larger index is joined with a shuffle.
BROADCAST_RULES = 200_000
BAD = "label:bad"
RULES = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("token", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class FixedRule:
    """`host` and its subdomains, below `path`; the longest rule that fits decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


# The rules of the base contract.
FIXED_RULES = (
    FixedRule("block", "net", "/"),
    FixedRule("allow", "example.net", "/en/"),
    FixedRule("block", "example.com", "/de/"),
    FixedRule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    """A mined rule needs `support`, its share of the examples that are bad, and `rows` of them. Its confidence, the share of bad
    ones among its examples, must lie this part of the way from the share among all examples to 1.
    """

    support: float = 0.002
    rows: int = 20
    gain: float = 0.6

    def confidence(self, base: float) -> float:
        return base + self.gain * (1 - base)


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. The host ends at `/`, `?` or `#`, the path at `?` or `#`; A-Z of the host in lower case."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.col(url).substr(start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def fixed_rule(host: Column, path: Column, rules: tuple[FixedRule, ...] = FIXED_RULES) -> Column:
    """A struct of name and verdict of the longest rule that fits, or null."""
    found = F.when(F.lit(False), F.lit(None).cast("struct<name:string,verdict:string>"))
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        found = found.when(rule.fits(host, path), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict")))
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted: scheme, words of the host, parts of the path, names in the query, the fragment.

    Runs of digits are one `0`, so that pages of a site share their tokens.
    """
    zero = lambda text: F.regexp_replace(text, "[0-9]+", "0")
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(
        named("scheme:", F.array(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        named("host:", F.split(zero(host), "[.-]")),
        named("path:", F.split(zero(path), "/")),
        named("query:", names),
        named("part:", F.array(zero(F.regexp_extract(url, "#(.*)$", 1)))),
    )
    return F.sort_array(F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(every)))


def mine_rules(labelled: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """rule_id, tokens, token and confidence of the mined rules; `token` is the rarest of the rule's tokens.

    `labelled` has tokens (distinct ones) and bad (boolean). FP-growth finds the frequent combinations; those that imply
    a bad label with enough confidence are kept. Without labels, or without any bad one, there are no rules.
    """
    spark = labelled.sparkSession
    count, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not count or not bad:
        return empty(spark, RULES)
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    support = min(1.0, max(settings.support, settings.rows / count))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=settings.confidence(bad / count)).fit(labelled.select(items.alias("items")))
    found = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.sort_array("antecedent").alias("tokens"), "confidence")
    found = stage(found.withColumn("rule_id", F.xxhash64("tokens")), folder, "rules")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    parts = found.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    return parts.groupBy("rule_id").agg(
        F.first("tokens").alias("tokens"), F.min_by("token", F.struct("freq", "token")).alias("token"), F.max("confidence").alias("confidence")
    ).select(*RULES.names)


def matched_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """signature and confidence of each set of tokens that a rule matches: all tokens of the rule are among those of the set.

    The index holds each rule under its rarest token, so a set only meets rules whose rarest token it has.
    """
    posted = sets.select("signature", "tokens", F.explode("tokens").alias("token"))
    index = rules.select("token", F.col("tokens").alias("needed"), "confidence")
    few = rules.count() <= BROADCAST_RULES
    met = posted.join(F.broadcast(index) if few else index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return met.groupBy("signature").agg(F.max("confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[FixedRule, ...] = FIXED_RULES,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and confidence (of the strongest mined rule that matches).

    The longest fixed rule that fits decides; else a page is blocked if a mined rule matches its tokens. Examples to mine are
    the pages that a fixed rule decides and those with a label: bad ones are those that a fixed rule blocks or whose id has a
    label of bad quality (0) or toxic (1); labels that contradict each other count as bad. Null urls and urls without `://`
    have no host, no tokens and no rule and are allowed. Repeated rows are judged alike; other columns are not read.

    Pages are matched by their distinct sets of tokens, which are folded before they are shuffled.
    """
    split = split_urls(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    tokens = tokens_of(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    rows = split.withColumn("tokens", tokens).withColumn("signature", F.array_join("tokens", "\n"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.bool_or(bad).alias("bad"))
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    examples = rows.select("page_id", "tokens", "fixed.verdict").join(known, "page_id", "left").where("verdict is not null or bad is not null")
    told = (F.coalesce("verdict", F.lit("")) == "block") | F.coalesce("bad", F.lit(False))
    labelled = stage(examples.select("tokens", told.alias("bad")), folder, "labelled")
    mined = stage(mine_rules(labelled, folder, settings), folder, "rules")
    sets = rows.where(F.size("tokens") > 0).groupBy("signature").agg(F.first("tokens").alias("tokens"))
    matched = stage(matched_sets(sets, mined), folder, "matched")
    few = matched.count() <= BROADCAST_RULES
    judged = rows.select("page_id", "host", "path", "signature", "fixed")
    judged = judged.join(F.broadcast(matched) if few else matched, "signature", "left")
    verdict = F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.name").alias("rule"), verdict.alias("verdict"), "confidence")
