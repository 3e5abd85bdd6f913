"""One row per key: latest of a batch, and earliest of offset-stamped duplicates.

All picks are aggregations, so copies of a hot key collapse on the map side and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import with_bucket_start
from barlake.schema import BARS, PRICES, TICK_KEY, as_bars, as_ticks

# Fixed value: the timeframes that vendors stamp at differing hours.
OFFSET_TIMEFRAMES = ("D1", "H4", "W1", "MN1")
CANONICAL = ("M1", "M5", "M15", "M30", "H1", "H4", "D1", "W1", "MN1")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the last row by `order`, then by its values: the same row for any order of the input."""
    values = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *values)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


def snapped_bars(df: DataFrame) -> DataFrame:
    """Bars stamped with their canonical bucket; the original stamp stays as `stamp`."""
    return with_bucket_start(df.withColumnRenamed("timestamp", "stamp"), "timestamp", "stamp")


def latest_bars(df: DataFrame, source: str = "raw", order: list[str] | None = None) -> DataFrame:
    """Snap, then keep for each key the last bar by `order`, where `stamp` is the original time (the default order).

    Of bars that are equal in it the one with the greatest prices counts, open first.
    """
    order = order or ["stamp"]
    bars = snapped_bars(df).select("instrument", "timeframe", "timestamp", *order, *PRICES)
    return as_bars(last_per_key(bars, ["instrument", "timeframe", "timestamp"], order).withColumn("source", F.lit(source)))


def latest_ticks(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One tick per key: the last by `order`, else the greatest by (price, volume, bid, ask)."""
    if order:
        return last_per_key(as_ticks(df, *order), TICK_KEY, order)
    # columns that are absent don't tell ticks apart, so they aren't sorted along
    values = [c for c in ("price", "volume", "bid", "ask") if c in df.columns]
    return as_ticks(df.groupBy(*TICK_KEY).agg(F.max(F.struct(*values)).alias("tick")).select(*TICK_KEY, "tick.*"))


def collapse_offset_bars(bars: DataFrame, timeframes: tuple[str, ...] = OFFSET_TIMEFRAMES) -> DataFrame:
    """Per bucket keep the bar stamped closest to the bucket start, re-stamped to it; other timeframes stay."""
    _check(timeframes)
    chosen = snapped_bars(bars.where(F.col("timeframe").isin(*timeframes)))
    first = F.min(F.struct("stamp", *PRICES, "source")).alias("first")
    collapsed = chosen.groupBy("instrument", "timeframe", "timestamp").agg(first)
    collapsed = collapsed.select("instrument", "timeframe", "timestamp", *[F.col(f"first.{c}").alias(c) for c in (*PRICES, "source")])
    return collapsed.unionByName(bars.where(~F.col("timeframe").isin(*timeframes)).select(*BARS.names))


def collapse_report(bars: DataFrame, timeframes: tuple[str, ...] = OFFSET_TIMEFRAMES) -> DataFrame:
    """Rows before and after a collapse, per series: buckets are counted in two steps rather than distinct in one."""
    _check(timeframes)
    chosen = with_bucket_start(bars.where(F.col("timeframe").isin(*timeframes)), "bucket")
    per_bucket = chosen.groupBy("instrument", "timeframe", "bucket").agg(F.count("*").alias("n"))
    return per_bucket.groupBy("instrument", "timeframe").agg(
        F.sum("n").alias("rows_before"),
        F.count("*").alias("rows_after"),
        (F.sum("n") - F.count("*")).alias("rows_removed"),
    )


def _check(timeframes: tuple[str, ...]) -> None:
    unknown = [tf for tf in timeframes if tf not in CANONICAL]
    if unknown:
        raise ValueError(f"no bucket rule for timeframes: {unknown}")
