"""Cleaning and validation of incoming bars and ticks.

Every rule is a column expression; `judged_*` keeps all rows and adds `reason` (null for a good row), so that a
caller can raise, split or count in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import valid_instrument, valid_timeframe
from barlake.functions.timestamps import instant_utc, parse_utc
from barlake.schema import PRICES

# Required columns, vendor columns that bars never keep, spellings of infinity.
BAR_COLUMNS = ["timestamp", *PRICES]
TICK_COLUMNS = ["timestamp", "price"]
VENDOR_COLUMNS = ["tickvol", "vol", "spread", "volume"]
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

BAD_TIMESTAMP = "invalid timestamp"
BAD_PRICE = "invalid price"
BAD_NAME = "invalid instrument or timeframe"
BAD_ROW = "surplus fields"


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def map_columns(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    return df.withColumnsRenamed(mapping) if mapping else df


def drop_vendor_columns(df: DataFrame) -> DataFrame:
    return df.drop(*VENDOR_COLUMNS)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE, null where it is not a number (NaN counts as null)."""
    col = F.col(name)
    if dict(df.dtypes)[name] != "string":
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    # A number ends in a digit or a point. The JVM would also read NaN and a trailing type letter ("1.5d").
    last = F.substring(F.rtrim(col), -1, 1)
    infinite = F.lower(F.trim(col)).isin(*INFINITE)
    return F.when(last.between(".", "9") | infinite, col.try_cast("double"))


def with_utc(df: DataFrame, day_first: bool = False) -> DataFrame:
    """The `timestamp` column as naive UTC, whichever type it came in."""
    kind = dict(df.dtypes)["timestamp"]
    if kind == "timestamp_ntz":
        return df
    if kind == "timestamp":
        return df.withColumn("timestamp", instant_utc(F.col("timestamp")))
    return parse_utc(df, "timestamp", day_first)


def with_mid_price(df: DataFrame) -> DataFrame:
    """Add price = (bid + ask) / 2 only where the input has no price column."""
    if "price" in df.columns:
        return df
    if not {"bid", "ask"} <= set(df.columns):
        raise ValueError("no price column, and no bid and ask to compute it from")
    return df.withColumn("price", (number(df, "bid") + number(df, "ask")) / 2)


def judged_bars(df: DataFrame, column_map: dict[str, str] | None = None, day_first: bool = False) -> DataFrame:
    df = drop_vendor_columns(map_columns(normalise_names(df), column_map))
    require(df, BAR_COLUMNS)
    cleaned = with_utc(df, day_first).withColumns({c: number(df, c) for c in PRICES})
    no_price = F.greatest(*[F.col(c).isNull() for c in PRICES])
    reason = F.when(F.col("timestamp").isNull(), BAD_TIMESTAMP).when(no_price, BAD_PRICE)
    return cleaned.withColumn("reason", reason)


def judged_ticks(df: DataFrame, day_first: bool = False) -> DataFrame:
    df = with_mid_price(normalise_names(df))
    require(df, TICK_COLUMNS)
    numbers = {c: number(df, c) for c in ("price", "volume", "bid", "ask") if c in df.columns}
    cleaned = with_utc(df, day_first).withColumns(numbers)
    no_price = F.col("price").isNull() | (F.col("price") <= 0)
    reason = F.when(F.col("timestamp").isNull(), BAD_TIMESTAMP).when(no_price, BAD_PRICE)
    return cleaned.withColumn("reason", reason)


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").drop("reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL")


def reject_counts(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by).agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col("reason") == BAD_TIMESTAMP).alias("bad_timestamps"),
        F.count_if(F.col("reason") == BAD_PRICE).alias("bad_prices"),
        F.count_if(F.col("reason") == BAD_ROW).alias("bad_rows"),
    )


def judge_names(judged: DataFrame) -> DataFrame:
    named = valid_instrument("instrument") & valid_timeframe("timeframe")
    return judged.withColumn("reason", F.when(~named, BAD_NAME).otherwise(F.col("reason")))


def strict(judged: DataFrame, *fatal: str) -> DataFrame:
    """The good rows, or ValueError with the counts if any row has a fatal reason (one aggregation job)."""
    counts = judged.agg(*[F.count_if(F.col("reason") == reason).alias(reason) for reason in fatal]).first()
    problems = [f"{counts[reason]} rows with {reason}" for reason in fatal if counts[reason]]
    if problems:
        raise ValueError("; ".join(problems))
    return accepted(judged)


def strict_bars(judged: DataFrame) -> DataFrame:
    """A bad timestamp or name rejects the batch; a row with a bad price is left out."""
    return strict(judged, BAD_NAME, BAD_TIMESTAMP)


def strict_ticks(judged: DataFrame) -> DataFrame:
    """A bad timestamp, name or price rejects the batch."""
    return strict(judged, BAD_NAME, BAD_TIMESTAMP, BAD_PRICE)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Identical rows collapse to one; copies collapse on the map side before the shuffle."""
    return df.dropDuplicates()
