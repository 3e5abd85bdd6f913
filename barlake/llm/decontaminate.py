"""Benchmark passages in documents, also with other numbers, names or units: templates are joined by hash.

Texts become tokens, of which numbers, names and units are slots. Windows of templates, in which a slot is only its type,
are joined by hash; the slots of matching passages must then map onto each other one to one. Windows of plain tokens are
joined in the same way, so that copies are found in any case and however many slots they have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import let, unused, whole
from barlake.llm.near_dup import pick
from barlake.session import stage

# Units of measure and money that follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yards yard mi mile miles mg g kg t ton tons tonnes gram grams kilogram kilograms "
    "lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre "
    "kilometres mph kmh percent dollar dollars cent cents euro euros usd eur gbp degrees"
).split()

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Stands before a word that is capitalised within a sentence.
MARK = "\u0002"
TOKEN = f"{MARK}?(?:\\p{{N}}+(?:[.,:/]\\p{{N}}+)*|\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{N}}]*)"
#: Up to so many windows of the benchmark (about 50 MB) are broadcast; more are joined with a shuffle.
BROADCAST_WINDOWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """A document holds an item if windows of `size` tokens cover `share` of the item's tokens, or `run` of them in a row.

    A window matches by its plain tokens, or by its template if that has `literals` tokens that are no slots. Items with
    fewer than `size` tokens are one window.
    """

    size: int = 8
    literals: int = 4
    share: float = 0.5
    run: int = 13


def tokens_of(text: Column) -> Column:
    """Tokens in lower case, in order; a word that is capitalised within a sentence keeps a mark in front of it."""
    marked = F.regexp_replace(text, "(?<=\\p{L}[,;]?)[\\s\\p{Z}]+(?=\\p{Lu}\\p{Ll})", f" {MARK}")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def plain_of(tokens: Column) -> Column:
    """The tokens without marks."""
    return F.when(F.exists(tokens, lambda t: t.startswith(MARK)), F.transform(tokens, lambda t: F.translate(t, MARK, ""))).otherwise(tokens)


def template_of(tokens: Column) -> Column:
    """The tokens with every slot replaced by its type."""

    def typed(token: Column, place: Column) -> Column:
        previous = F.when(place > 0, F.get(tokens, place - 1)).otherwise(F.lit(""))
        return (
            F.when(token.startswith(MARK), F.lit(NAME))
            .when(_is_number(token), F.lit(NUMBER))
            .when(token.isin(*UNITS) & _is_number(previous), F.lit(UNIT))
            .otherwise(token)
        )

    some = F.exists(tokens, lambda t: t.startswith(MARK) | _is_number(t))
    return F.when(some, F.transform(tokens, typed)).otherwise(tokens)


def _is_number(token: Column) -> Column:
    return token.rlike("^\\p{N}")


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def benchmark_windows(benchmark: DataFrame, settings: Settings, item_id: str, text: str) -> DataFrame:
    """item_id, n_tokens, place, length, hash, exact, and the tokens of each window of each item.

    Each window has a row for its plain tokens (exact), and one for its template if that has slots and literal tokens.
    """
    shapes = lambda t: F.struct(t.alias("t"), plain_of(t).alias("plain"), template_of(t).alias("p"))
    items = benchmark.select(F.col(item_id).alias("item_id"), let(tokens_of(whole(text)), shapes).alias("x"))
    items = items.select("item_id", F.col("x.t").alias("tokens"), "x.plain", F.col("x.p").alias("template")).distinct()
    items = items.withColumn("n_tokens", F.size("tokens")).where("item_id is not null and n_tokens > 0")
    items = items.withColumn("length", F.least("n_tokens", F.lit(settings.size)))
    places = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("length")))
    windows = items.select("*", places.alias("place"))
    window, plain = (F.slice(c, F.col("place") + 1, F.col("length")) for c in ("template", "plain"))
    slots = F.size(F.filter(window, _is_slot))
    templated = (slots > 0) & (F.col("length") - slots >= settings.literals)
    both = F.array(F.struct(F.xxhash64(plain).alias("hash"), F.lit(True).alias("exact")), F.when(templated, F.struct(F.xxhash64(window).alias("hash"), F.lit(False).alias("exact"))))
    given = F.slice("tokens", F.col("place") + 1, F.col("length")).alias("given")
    return windows.select("item_id", "n_tokens", "place", "length", given, F.explode(F.array_compact(both)).alias("w")).select("*", "w.hash", "w.exact").drop("w")


def window_matches(docs: DataFrame, windows: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """Each window of a document that matches one of the benchmark; key and text_hash tell the document."""

    def hashes(x: Column) -> Column:
        plain, template = x["plain"], x["template"]
        every = [F.when(F.size(plain) >= length, _hashes(plain, template, length)).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>")) for length in lengths]
        return F.concat(*every) if len(every) > 1 else every[0]

    shapes = let(tokens_of(F.col("text")), lambda t: F.struct(plain_of(t).alias("plain"), template_of(t).alias("template")))
    rows = docs.select("key", "text_hash", F.explode(let(shapes, hashes)).alias("w")).select("key", "text_hash", "w.at", "w.hash")
    return rows.join(F.broadcast(windows) if few else windows, "hash")


def _hashes(plain: Column, template: Column, length: int) -> Column:
    """The hashes of all windows of plain tokens, then of those templates that differ from them."""
    places = F.sequence(F.lit(0), F.size(plain) - length)
    exact = F.transform(places, lambda at: F.struct(at.alias("at"), F.xxhash64(F.slice(plain, at + 1, length)).alias("hash")))

    def templates(known: Column) -> Column:
        given = F.transform(places, lambda at: F.struct(at.alias("at"), F.xxhash64(F.slice(template, at + 1, length)).alias("hash")))
        return F.concat(known, F.filter(given, lambda w: w["hash"] != F.get(known, w["at"])["hash"]))

    return F.when(plain == template, exact).otherwise(let(exact, templates))


def consistent(matches: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """The matches without those windows whose slots contradict others of their passage.

    A passage is the windows of a document and an item at one distance. In it every value of the item must stand for one
    value of the document and the other way round. Windows that hold a value for which this fails are left out; windows of
    equal tokens match whatever the slots say.
    """
    matches = matches.withColumn("shift", F.col("at") - F.col("place"))
    columns = ["key", "text_hash", "item_id", "n_tokens", "shift", "place", "length"]
    plain, slotted = matches.where("exact").select(*columns), stage(matches.where("not exact"), folder, "slotted")
    if slotted.isEmpty():
        return plain
    wanted = stage(slotted.select("key", "text_hash").distinct(), folder, "wanted")
    texts = pick(docs, wanted, "left_semi").dropDuplicates(["key", "text_hash"]).select("key", "text_hash", tokens_of(F.col("text")).alias("found"))
    passage = ["key", "text_hash", "item_id", "shift"]
    pairs = F.arrays_zip(F.col("given"), F.slice("found", F.col("at") + 1, F.col("length")).alias("found"))
    pairs = F.filter(pairs, lambda p: p["given"].startswith(MARK) | p["found"].startswith(MARK) | _is_number(p["given"]) | p["given"].isin(*UNITS))
    joined = slotted.join(texts, ["key", "text_hash"]).withColumn("pairs", pairs).drop("found")
    values = joined.select(*passage, F.explode("pairs").alias("p")).select(*passage, "p.given", "p.found").distinct()
    one = values.groupBy(*passage, "given").agg(F.count("*").alias("n")).where("n > 1").select(*passage, F.col("given").alias("value"), F.lit(True).alias("own"))
    two = values.groupBy(*passage, "found").agg(F.count("*").alias("n")).where("n > 1").select(*passage, F.col("found").alias("value"), F.lit(False).alias("own"))
    clashes = one.union(two).groupBy(*passage).agg(
        F.collect_list(F.when(F.col("own"), F.col("value"))).alias("givens"), F.collect_list(F.when(~F.col("own"), F.col("value"))).alias("founds")
    )
    clashing = F.exists("pairs", lambda p: F.array_contains("givens", p["given"]) | F.array_contains("founds", p["found"]))
    kept = joined.join(clashes, passage, "left").where(F.col("givens").isNull() | ~clashing)
    return plain.union(kept.select(*columns))


def longest_run(places: Column, length: Column) -> Column:
    """How many tokens in a row windows of `length` tokens at these places (in order) cover at most."""

    def longer(acc: Column, place: Column) -> Column:
        begin = F.when(place <= acc["end"], acc["begin"]).otherwise(place)
        return F.struct(begin.alias("begin"), (place + length).alias("end"), F.greatest(acc["best"], place + length - begin).alias("best"))

    start = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.lit(0).alias("best"))
    return F.aggregate(places, start, longer, lambda acc: acc["best"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key (the id as text, empty for null), text_hash and text: they tell a document also where ids repeat or are null."""
    body = whole(text)
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", settings: Settings = Settings()
) -> DataFrame:
    """key, text_hash, item_id and coverage of each item that a document holds.

    Null and empty texts hold nothing, null items are not looked for, items with one id are looked for one by one and
    count together; repeated rows are judged alike. Whole texts are read; nothing but matches is shuffled as long as the
    benchmark has at most a million windows.
    """
    windows = stage(benchmark_windows(benchmark, settings, item_id, "text"), folder, "windows")
    lengths = sorted(row[0] for row in windows.select("length").distinct().collect())  # at most `size` of them
    rows = keyed(docs, doc_id, text)
    if not lengths:
        return rows.where(F.lit(False)).select("key", "text_hash", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("coverage"))
    matches = stage(window_matches(rows, windows, lengths, windows.count() <= BROADCAST_WINDOWS), folder, "matches")
    item = ["key", "text_hash", "item_id", "n_tokens"]
    passages = consistent(matches, rows, folder).groupBy(*item, "shift", "length").agg(F.sort_array(F.collect_set("place")).alias("places"))
    passages = passages.withColumn("run", longest_run(F.col("places"), F.col("length")))
    covered = passages.select(*item, "run", "length", F.explode("places").alias("place"))
    covered = covered.select(*item, "run", F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("at"))
    covered = covered.groupBy(*item, "at").agg(F.max("run").alias("run")).groupBy(*item).agg(F.count("*").alias("n"), F.max("run").alias("run"))
    coverage = F.col("n") / F.col("n_tokens")
    return (
        covered.where((coverage >= settings.share) | (F.col("run") >= settings.run))
        .groupBy("key", "text_hash", "item_id")
        .agg(F.max(coverage).alias("coverage"))
    )


def judge_leaks(docs: DataFrame, benchmark: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, contaminated, items (the ids of the items it holds, sorted) and coverage (the largest).

    See `leaks`; a clean document has an empty list and a coverage of 0. Other columns are not read.
    """
    found = leaks(docs, benchmark, folder, doc_id, text, settings=settings)
    found = found.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    found = stage(found, folder, "leaks")
    key, text_hash = F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(whole(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), text_hash.alias("text_hash"))
    few = found.count() <= BROADCAST_WINDOWS
    none = F.array().cast("array<bigint>")
    return rows.join(F.broadcast(found) if few else found, ["key", "text_hash"], "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names are.

    Documents with null or empty texts stay. Rows that repeat an id are judged by their own texts, repeated rows alike; an
    empty benchmark leaves all documents. See `leaks`.
    """
    found = stage(leaks(docs, benchmark, folder, doc_id, text).select("key", "text_hash").distinct(), folder, "leaks")
    key, text_hash = F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(whole(text))
    names = {"key": unused("__leak_key", docs), "text_hash": unused("__leak_hash", docs)}
    rows = docs.withColumns({names["key"]: key, names["text_hash"]: text_hash})
    return pick(rows, found.withColumnsRenamed(names), "left_anti").drop(*names.values())
