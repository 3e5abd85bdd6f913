"""Timeframes: lengths, ladder targets, order, validity and bucket starts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bar lengths in seconds, ladder targets, display order, accepted spellings.
SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400}
LADDER = ("M5", "M15", "M30", "H1", "H4", "D1")
DISPLAY_ORDER = {"M1": 0, "M5": 1, "M15": 2, "M30": 3, "H1": 4, "H4": 5, "D1": 6, "W1": 7, "MN1": 8, "TICK": 99}
DISPLAY_OTHER = 50
INSTRUMENT_PATTERN = r"^[A-Za-z0-9_\-&]+$"
INSTRUMENT_MAX = 50
TIMEFRAME_PATTERN = r"(?i)^((M|H|D|W|MN)\d+|\d+(m|h|d|w)|TICK)$"
TIMEFRAME_MAX = 10
SNAP_PATTERN = r"^(M|H|D)(\d+)?$"
WEEK_PATTERN = r"^W\d*$"
MONTH_PATTERN = r"^MN\d*$"
UNIT_SECONDS = {"M": 60, "H": 3600, "D": 86400}

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def derivation_targets(source: str) -> list[str]:
    """Ladder timeframes that are longer than the source and a whole multiple of it."""
    length = SECONDS.get(source.upper())
    if length is None:
        return []
    return [tf for tf in LADDER if SECONDS[tf] > length and SECONDS[tf] % length == 0]


def tick_targets() -> list[str]:
    return ["M1", *LADDER]


def width(timeframe: str) -> str:
    return f"{SECONDS[timeframe]} seconds"


def valid_instrument(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(
        c.rlike(INSTRUMENT_PATTERN) & F.length(c).between(1, INSTRUMENT_MAX) & ~c.contains(".."), F.lit(False)
    )


def valid_timeframe(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(TIMEFRAME_PATTERN) & (F.length(c) <= TIMEFRAME_MAX), F.lit(False))


def check_instrument(name: str) -> str:
    if not name or len(name) > INSTRUMENT_MAX or ".." in name or not re.match(INSTRUMENT_PATTERN, name):
        raise ValueError(f"invalid instrument: {name!r}")
    return name


def check_timeframe(name: str) -> str:
    if not name or len(name) > TIMEFRAME_MAX or not re.match(TIMEFRAME_PATTERN, name):
        raise ValueError(f"invalid timeframe: {name!r}")
    return name.upper()


def display_rank(col: Column | str) -> Column:
    """Chronological position of a timeframe; unknown ones come after MN1, TICK last."""
    c = F.col(col) if isinstance(col, str) else col
    rank = F.lit(DISPLAY_OTHER)
    for name, position in DISPLAY_ORDER.items():
        rank = F.when(c == name, F.lit(position)).otherwise(rank)
    return rank


def with_bucket(df: DataFrame, timeframe: str, name: str, timestamp: str = "timestamp") -> DataFrame:
    """Add the start of the UTC bucket of one fixed timeframe.

    `window` floors on the raw microseconds, so it is zone-free and stays inside generated code.
    """
    return df.withColumn(name, F.window(timestamp, width(timeframe)).start)


def with_bucket_start(df: DataFrame, name: str, timestamp: str = "timestamp", timeframe: str = "timeframe") -> DataFrame:
    """Add the canonical bucket start for a timeframe held in a column.

    Minutes, hours and days floor from the epoch with any multiple, weeks start on Monday, months on the first;
    any other timeframe leaves the timestamp as it is. The width is a column of its own, so it is computed once.
    """
    tf, ts, width_micros = F.upper(F.col(timeframe)), F.col(timestamp), F.col("_width")
    known = F.create_map(*[F.lit(v) for tf_, s in SECONDS.items() for v in (tf_, s * 1_000_000)])
    since_epoch = F.call_function("div", ts - F.expr(EPOCH), F.expr("INTERVAL '0.000001' SECOND"))
    day = ts.cast("date")
    week = F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    month = F.trunc(day, "MM").cast("timestamp_ntz")
    start = (
        F.when(width_micros.isNotNull(), F.timestamp_add("MICROSECOND", -F.pmod(since_epoch, width_micros), ts))
        .when(tf.rlike(WEEK_PATTERN), week)
        .when(tf.rlike(MONTH_PATTERN), month)
        .otherwise(ts)
    )
    # The usual timeframes are looked up; only others are taken apart.
    found = F.coalesce(F.try_element_at(known, tf).cast("bigint"), _other_micros(tf))
    columns = [c for c in df.columns if c != name]
    return df.withColumn("_width", found).select(*columns, start.alias(name))


def _other_micros(tf: Column) -> Column:
    """Width of a bucket of any whole number of minutes, hours or days; null for other timeframes."""
    unit, digits = F.regexp_extract(tf, SNAP_PATTERN, 1), F.regexp_extract(tf, SNAP_PATTERN, 2)
    n = F.when(digits == "", F.lit(1)).otherwise(digits.try_cast("bigint"))
    micros = F.lit(None).cast("bigint")
    for name, seconds in UNIT_SECONDS.items():
        micros = F.when(unit == name, F.lit(seconds * 1_000_000).cast("bigint")).otherwise(micros)
    return F.nullif(F.try_multiply(n, micros), F.lit(0).cast("bigint"))
