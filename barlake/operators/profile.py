"""Coverage, counts and distinct lists of the two tables.

Each function takes the rows of a table or its partials (rows, first and last time of parts of it, as a store keeps them for
its partitions); the results are the same, but partials need no scan of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import check_instrument, display_rank
from barlake.schema import RAW

TICK = "TICK"


def _folded(table: DataFrame, *by: str) -> DataFrame:
    """Range and count (n) by these columns, from rows or from partials."""
    if "rows" in table.columns:
        first, last, n = "first", "last", F.sum("rows")
    else:
        first, last, n = "timestamp", "timestamp", F.count("*")
    return table.groupBy(*by).agg(F.min(first).alias("min_date"), F.max(last).alias("max_date"), n.alias("n"))


def bar_coverage(bars: DataFrame) -> DataFrame:
    """Range, count and sorted sources of every series. The two-step fold keeps the first one hash-based."""
    per_source = _folded(bars, "instrument", "timeframe", "source")
    return per_source.groupBy("instrument", "timeframe").agg(
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.sum("n").alias("record_count"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )


def tick_coverage(ticks: DataFrame) -> DataFrame:
    found = _folded(ticks, "instrument").withColumnRenamed("n", "record_count")
    return found.select(
        "instrument",
        F.lit(TICK).alias("timeframe"),
        "min_date",
        "max_date",
        "record_count",
        F.array(F.lit(RAW)).alias("sources"),
    )


def coverage_catalog(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    return bar_coverage(bars).unionByName(tick_coverage(ticks))


def bar_stats(bars: DataFrame) -> DataFrame:
    """Row counts in total, per instrument and per timeframe, with the overall range, from one scan.

    The table is folded to one row per series first; the grouping sets then run over those few rows.
    """
    series = _folded(bars, "instrument", "timeframe")
    rows = series.groupingSets(
        [["instrument"], ["timeframe"], []], F.col("instrument"), F.col("timeframe")
    ).agg(
        F.sum("n").alias("row_count"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
    )
    return rows.orderBy(F.col("row_count").desc(), "instrument", "timeframe")


def tick_stats(ticks: DataFrame) -> DataFrame:
    """Tick counts in total and per instrument, with ranges."""
    rows = _folded(ticks, "instrument")
    rolled = rows.rollup("instrument").agg(
        F.sum("n").alias("row_count"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
    )
    return rolled.orderBy(F.col("row_count").desc(), "instrument")


def lake_summary(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """One row: counts, distinct instruments, ordered timeframes and range over both tables."""
    bar_series = _folded(bars, "instrument", "timeframe")
    tick_series = _folded(ticks, "instrument").withColumn("timeframe", F.lit(TICK))
    series = bar_series.unionByName(tick_series)
    is_tick = F.col("timeframe") == TICK
    counted = series.agg(
        F.coalesce(F.sum(F.when(~is_tick, F.col("n"))), F.lit(0)).alias("bar_rows"),
        F.coalesce(F.sum(F.when(is_tick, F.col("n"))), F.lit(0)).alias("tick_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_distinct("instrument").alias("instruments"),
        F.sort_array(
            F.collect_set(F.struct(display_rank("timeframe").alias("rank"), F.col("timeframe")))
        ).alias("ranked"),
        F.min("min_date").alias("start"),
        F.max("max_date").alias("end"),
    )
    return counted.withColumn("timeframes", F.col("ranked.timeframe")).drop("ranked")


def instruments(table: DataFrame) -> DataFrame:
    return table.select("instrument").distinct().orderBy("instrument")


def all_instruments(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    return instruments(bars.select("instrument").union(ticks.select("instrument")))


def timeframes(bars: DataFrame, ticks: DataFrame, instrument: str | None = None) -> DataFrame:
    """Timeframes with data, in chronological order; TICK is listed where ticks exist."""
    if instrument is not None:
        wanted = F.col("instrument") == check_instrument(instrument)
        bars, ticks = bars.where(wanted), ticks.where(wanted)
    found = bars.select("timeframe").distinct().unionByName(ticks.limit(1).select(F.lit(TICK).alias("timeframe")))
    return found.orderBy(display_rank("timeframe"), "timeframe")
