"""Threshold rules for texts, compiled into one projection; nothing is shuffled and no Python runs on rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import SPACE, SPACES, count_of, let, ratio, whole, words_of

# The symbols of the base contract.
SYMBOLS = "#*$%&|<>"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was at by an are this from or which "
    "der die das und ist von zu mit den im ein eine auf für nicht sich des dem "
    "le la les de et un une du est que en dans pour qui au par sur pas "
    "el los las y del se por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Limit:
    """A text passes if `measure` lies in [low, high]; an open side is None."""

    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self, measures: Column) -> Column:
        value = measures[self.measure]
        checks = [value >= self.low] * (self.low is not None) + [value <= self.high] * (self.high is not None)
        return reduce(and_, checks)


#: The threshold table: measure, least, most.
LIMITS = (
    Limit("mean_word_length", 2.0, 15.0),
    Limit("symbols_per_word", None, 0.15),
    Limit("marks_per_word", None, 0.5),
    Limit("stop_word_ratio", 0.02, None),
    Limit("letter_word_ratio", 0.7, None),
    Limit("ellipsis_line_ratio", None, 0.5),
    Limit("bullet_line_ratio", None, 0.9),
)

#: Bits of a key that hold a window's place in its text.
PLACE_BITS = 24


def windows_key(words: Column, place: Column) -> Column:
    return F.xxhash64(F.get(words, place), F.get(words, place + 1), F.get(words, place + 2))


def same_window(words: Column, a: Column, b: Column) -> Column:
    equal = (F.get(words, a + k) == F.get(words, b + k) for k in range(3))
    return reduce(and_, equal)


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more.

    Windows are sorted by a hash with their place in the low bits, so equal windows are neighbours. Neighbours with
    equal hashes are compared word by word; if two of them differ (or the text is too long for the place bits), the
    windows of that text are sorted as strings instead, so the count is exact.
    """
    count = F.size(words)
    places = F.sequence(F.lit(0), count - 3)
    mask = (1 << PLACE_BITS) - 1

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.lit(mask)).cast("int")

    def hashed(keys: Column) -> Column:
        alike = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
        near = lambda key, k, step: F.coalesce(alike(key, F.get(keys, k + step)), F.lit(False))
        clash = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))),
            lambda k: F.coalesce(
                alike(F.get(keys, k), F.get(keys, k - 1)) & ~same_window(words, place(F.get(keys, k)), place(F.get(keys, k - 1))),
                F.lit(False),
            ),
        )
        found = F.filter(keys, lambda key, k: near(key, k, -1) | near(key, k, 1))
        return F.when(clash, F.lit(None)).otherwise(F.transform(found, place))

    def spelled(keys: Column) -> Column:
        window = lambda key: F.substring_index(key, " ", 3)
        near = lambda key, k, step: F.coalesce(window(key) == window(F.get(keys, k + step)), F.lit(False))
        found = F.filter(keys, lambda key, k: near(key, k, -1) | near(key, k, 1))
        return F.transform(found, lambda key: F.substring_index(key, " ", -1).cast("int"))

    quick = F.sort_array(
        F.transform(places, lambda p: F.shiftleft(windows_key(words, p), PLACE_BITS).bitwiseOR(p.cast("long")))
    )
    slow = F.sort_array(
        F.transform(
            places,
            lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2), F.lpad(p.cast("string"), 10, "0")),
        )
    )
    by_hash = F.when(count <= mask, let(quick, hashed))
    found = F.coalesce(by_hash, let(slow, spelled))
    covered = let(found, lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))))
    return F.when(count < 3, F.lit(0)).otherwise(covered).cast("long")


def measures_of(text: Column) -> Column:
    """One struct of counts and ratios of a text."""

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            ratio(F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))), F.size(lines)).alias("ellipsis_line_ratio"),
            ratio(F.size(F.filter(lines, lambda x: x.rlike("^\\s*[-*•‣]"))), F.size(lines)).alias("bullet_line_ratio"),
        )

    def of_words(words: Column) -> Column:
        count = F.size(words)
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
        return F.struct(
            count.cast("long").alias("n_words"),
            repeat_words(words).alias("n_repeat_words"),
            ratio(stops, count).alias("stop_word_ratio"),
            ratio(F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))), count).alias("letter_word_ratio"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    word_chars = F.length(F.translate(text, SPACES, "")).cast("long")
    symbols = count_of(text, SYMBOLS).cast("long")
    parts = F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        word_chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        count_of(text, "!?=_~^").alias("marks"),
    )
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["word_chars"].alias("word_chars"),
            p["n_symbols"].alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            p["w"]["n_repeat_words"].alias("n_repeat_words"),
            ratio(p["word_chars"], p["w"]["n_words"]).alias("mean_word_length"),
            ratio(p["n_symbols"], p["w"]["n_words"]).alias("symbols_per_word"),
            ratio(p["marks"], p["w"]["n_words"]).alias("marks_per_word"),
            p["w"]["stop_word_ratio"].alias("stop_word_ratio"),
            p["w"]["letter_word_ratio"].alias("letter_word_ratio"),
            p["l"]["ellipsis_line_ratio"].alias("ellipsis_line_ratio"),
            p["l"]["bullet_line_ratio"].alias("bullet_line_ratio"),
        ),
    )


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """One row per document: doc_id, the counts, `base_failed`, `kept` and `failed_rules` (names of the failed limits).

    A document is kept if it has 50 words or more, if at most half of its words lie in repeated three-word windows, and
    if it passes every limit of the table. A null text counts as empty and fails; repeated rows are judged alike; other
    columns of `docs` are not read.
    """
    judged = docs.select(F.col(doc_id).alias("doc_id"), measures_of(whole(text)).alias("m"))
    m = F.col("m")
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    failed = F.filter(F.array(*(F.when(~limit.passes(m), F.lit(limit.measure)) for limit in limits)), lambda x: x.isNotNull())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *(m[c].alias(c) for c in counts),
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )


def quality_sql(limits: tuple[Limit, ...] = LIMITS) -> str:
    """The same over the table `documents` in DuckDB's SQL."""
    words = "', '".join(STOP_WORDS)
    checks = []
    for limit in limits:
        checks += [f"{limit.measure} >= {limit.low}"] * (limit.low is not None)
        checks += [f"{limit.measure} <= {limit.high}"] * (limit.high is not None)
    names = ", ".join(
        "CASE WHEN NOT ("
        + " AND ".join(
            [f"{x.measure} >= {x.low}"] * (x.low is not None) + [f"{x.measure} <= {x.high}"] * (x.high is not None)
        )
        + f") THEN '{x.measure}' END"
        for x in limits
    )
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
    w AS (
        SELECT doc_id, s, regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+') AS w,
            list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
        FROM t),
    v AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n
        FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w))),
    r AS (
        SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM v WHERE n > 1) GROUP BY doc_id),
    c AS (
        SELECT doc_id, len(w) AS n_words, len(l) AS n_lines,
            CAST(length(regexp_replace(s, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(s, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            len(regexp_extract_all(s, '[!?=_~^]')) AS marks,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
            len(list_filter(w, lambda x: lower(x) IN ('{words}'))) AS stops,
            len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS letters,
            len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS ellipses,
            len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•‣]'))) AS bullets
        FROM w),
    m AS (
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
            CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
            CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
            CASE WHEN n_words > 0 THEN marks / n_words ELSE 0 END AS marks_per_word,
            CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio,
            CASE WHEN n_words > 0 THEN letters / n_words ELSE 0 END AS letter_word_ratio,
            CASE WHEN n_lines > 0 THEN ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
            CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END AS bullet_line_ratio
        FROM c LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND {" AND ".join(checks)} AS kept,
        array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS failed_rules
    FROM b"""
