"""Range queries, keyset pages, JSON rows and the replay schedule."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.timeframe import check_instrument, check_timeframe
from barlake.functions.timestamps import iso_text, ntz
from barlake.schema import PRICES

# Columns of a query result, page sizes.
BAR_ROW = ["instrument", "timeframe", "timestamp", *PRICES]
TICK_ROW = ["timestamp", "price", "volume", "bid", "ask"]
BAR_PAGE, BAR_PAGE_MAX = 20, 10_000
TICK_PAGE, TICK_PAGE_MAX = 10_000, 100_000
BAR_PAGE_KEY = ["timestamp", "instrument", "timeframe"]

Moment = datetime | str


def select_range(
    df: DataFrame,
    instrument: str | None = None,
    timeframe: str | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
) -> DataFrame:
    """Rows of a series and time range, both ends included; every predicate reaches the Parquet scan."""
    if instrument is not None:
        df = df.where(F.col("instrument") == check_instrument(instrument))
    if timeframe is not None:
        df = df.where(F.col("timeframe") == check_timeframe(timeframe))
    if start is not None:
        df = df.where(F.col("timestamp") >= ntz(start))
    if end is not None:
        df = df.where(F.col("timestamp") <= ntz(end))
    return df


def query_bars(bars: DataFrame, ordered: bool = True, **where) -> DataFrame:
    rows = select_range(bars, **where).select(*BAR_ROW)
    return rows.orderBy(*BAR_PAGE_KEY) if ordered else rows


def query_ticks(
    ticks: DataFrame, instrument: str, start: Moment | None = None, end: Moment | None = None, ordered: bool = True
) -> DataFrame:
    rows = select_range(ticks, instrument=instrument, start=start, end=end).select(*TICK_ROW)
    return rows.orderBy("timestamp") if ordered else rows


def page_bars(
    bars: DataFrame, limit: int = BAR_PAGE, after: dict | None = None, start: Moment | None = None, **where
) -> DataFrame:
    """One page in (timestamp, instrument, timeframe) order, with `has_more` on every row.

    `after` is the key of the last row of the page before, as a dict of those three; it takes the place of `start`.
    """
    rows = select_range(bars, start=None if after else start, **where).select(*BAR_ROW)
    return _page(rows, BAR_PAGE_KEY, after, limit, BAR_PAGE_MAX)


def page_ticks(
    ticks: DataFrame,
    instrument: str,
    limit: int = TICK_PAGE,
    after: dict | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
) -> DataFrame:
    rows = select_range(ticks, instrument=instrument, start=None if after else start, end=end).select(*TICK_ROW)
    return _page(rows, ["timestamp"], after, limit, TICK_PAGE_MAX)


def _page(rows: DataFrame, key: list[str], after: dict | None, limit: int, most: int) -> DataFrame:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    if after:
        rows = rows.where(_beyond(key, after))
    # The page plus one row, at most `most` + 1 rows, is all that the window below sees.
    fetched = rows.orderBy(*key).limit(limit + 1)
    page = Window.orderBy(*key)
    numbered = fetched.withColumns(
        {"position": F.row_number().over(page), "has_more": F.count("*").over(Window.partitionBy()) > limit}
    )
    return numbered.where(F.col("position") <= limit).drop("position")


def _beyond(key: list[str], after: dict) -> Column:
    """Row-wise (k1, k2, ...) > (v1, v2, ...), with k1 >= v1 spelled out for the scan."""
    values = [ntz(after[k]) if k == "timestamp" else F.lit(after[k]) for k in key]
    steps = [
        reduce(Column.__and__, [F.col(key[j]) == values[j] for j in range(i)], F.col(key[i]) > values[i])
        for i in range(len(key))
    ]
    return (F.col(key[0]) >= values[0]) & reduce(Column.__or__, steps)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row: ISO timestamp, nulls written out."""
    fields = [iso_text(c).alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def replay_schedule(
    df: DataFrame, keys: list[str], speed: float = 1.0, max_delay: float = 10.0, slice_width: str = "1 hour"
) -> DataFrame:
    """When each stored row is due in a replay of its series: seconds after the row before, and from the start.

    The wait is the time since the row before, divided by `speed` and capped at `max_delay`. Rows are ordered within
    slices of time; the slices of a series are linked by their last timestamp and by the sum of waits before them,
    so the order is exact although no task sees a whole series.
    """
    part = [*keys, "slice"]
    rows = df.withColumn("slice", F.window("timestamp", slice_width).start)
    lasts = rows.groupBy(*part).agg(F.max("timestamp").alias("last"))
    in_order = Window.partitionBy(*keys).orderBy("slice")
    carried = lasts.select(*part, F.lag("last").over(in_order).alias("carry"))
    within = Window.partitionBy(*part).orderBy("timestamp")
    linked = rows.join(carried, part)
    previous = F.coalesce(F.lag("timestamp").over(within), F.col("carry"))
    waited = linked.withColumn("wait_seconds", _wait(previous, speed, max_delay))
    sums = waited.groupBy(*part).agg(F.sum("wait_seconds").alias("total"))
    before = sums.select(
        *part, F.sum("total").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("offset")
    )
    running = F.sum("wait_seconds").over(within.rowsBetween(Window.unboundedPreceding, 0))
    due = F.coalesce(F.col("offset"), F.lit(0.0)) + running
    return waited.join(before, part).withColumn("due_seconds", due).drop("slice", "carry", "offset")


def _wait(previous: Column, speed: float, max_delay: float) -> Column:
    if speed <= 0 or max_delay <= 0:
        return F.lit(0.0)
    micros = F.call_function("div", F.col("timestamp") - previous, F.expr("INTERVAL '0.000001' SECOND"))
    seconds = micros / F.lit(1_000_000.0) / F.lit(float(speed))
    return F.coalesce(F.least(F.greatest(seconds, F.lit(0.0)), F.lit(float(max_delay))), F.lit(0.0))
