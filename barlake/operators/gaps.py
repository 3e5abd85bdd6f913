"""Gaps between consecutive bars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.timeframe import SECONDS
from barlake.functions.timestamps import ntz

# A weekend gap starts on Friday or Saturday (Monday = 0) and lasts 36 to 75 hours.
WEEKEND_DAYS = (4, 5)
WEEKEND_SECONDS = (36 * 3600, 75 * 3600)
TOP_DEFAULT = 100
TOP_MAX = 1000

SERIES = ["instrument", "timeframe"]


def find_gaps(
    bars: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    min_gap_seconds: int | None = None,
) -> DataFrame:
    """Gaps longer than the threshold (default twice the bar length) in every series; start counts, end does not.

    No task sorts the whole history of a series: bars are compared within one day (at most 1,440 of them), and the
    last bar of a day with the first of the next day that has any. Both parts read the same shuffled rows.
    """
    rows = bars.where(F.col("timeframe").isin(*SECONDS)).select(*SERIES, "timestamp")
    if start is not None:
        rows = rows.where(F.col("timestamp") >= ntz(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") < ntz(end))
    day = [*SERIES, "date"]
    rows = rows.withColumn("date", F.col("timestamp").cast("date")).repartition(*day)
    within = rows.select(
        *SERIES,
        F.lag("timestamp").over(Window.partitionBy(*day).orderBy("timestamp")).alias("gap_start"),
        F.col("timestamp").alias("gap_end"),
    )
    edges = rows.groupBy(*day).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    between = edges.select(
        *SERIES,
        F.lag("last").over(Window.partitionBy(*SERIES).orderBy("date")).alias("gap_start"),
        F.col("first").alias("gap_end"),
    )
    length = _length()
    threshold = F.lit(min_gap_seconds) if min_gap_seconds is not None else length * 2
    found = within.unionByName(between).where(F.col("gap_start").isNotNull())
    micros = F.call_function(
        "div", F.col("gap_end") - F.col("gap_start"), F.expr("INTERVAL '0.000001' SECOND")
    )
    return (
        found.withColumn("micros", micros)
        .where(F.col("micros") > threshold.cast("bigint") * 1_000_000)
        .select(*SERIES, "gap_start", "gap_end", F.expr("micros div 1000000").alias("duration_seconds"))
    )


def describe_gaps(gaps: DataFrame) -> DataFrame:
    """Add the number of missing bars and the weekend flag."""
    missing = F.greatest(F.lit(0).cast("bigint"), F.call_function("div", F.col("duration_seconds"), _length()) - 1)
    weekend = F.weekday("gap_start").isin(*WEEKEND_DAYS) & F.col("duration_seconds").between(*WEEKEND_SECONDS)
    return gaps.withColumns({"missing_bars": missing, "is_weekend": weekend})


def top_gaps(gaps: DataFrame, limit: int = TOP_DEFAULT) -> DataFrame:
    """The longest gaps; ties are ordered by start and series."""
    if not 1 <= limit <= TOP_MAX:
        raise ValueError(f"limit must be 1 to {TOP_MAX}")
    return gaps.orderBy(F.col("duration_seconds").desc(), "gap_start", *SERIES).limit(limit)


def _length():
    length = F.lit(None).cast("bigint")
    for timeframe, seconds in SECONDS.items():
        length = F.when(F.col("timeframe") == timeframe, F.lit(seconds).cast("bigint")).otherwise(length)
    return length
