"""Table schemas: the contract of every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("timeframe", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("open", T.DoubleType(), False),
        T.StructField("high", T.DoubleType(), False),
        T.StructField("low", T.DoubleType(), False),
        T.StructField("close", T.DoubleType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("price", T.DoubleType(), False),
        T.StructField("volume", T.DoubleType(), True),
        T.StructField("bid", T.DoubleType(), True),
        T.StructField("ask", T.DoubleType(), True),
    ]
)

BAR_KEY = ["instrument", "timeframe", "timestamp"]
TICK_KEY = ["instrument", "timestamp"]
PRICES = ["open", "high", "low", "close"]
RAW = "raw"
DERIVED = "derived"


def as_bars(df: DataFrame, source: str = RAW) -> DataFrame:
    """Bars in schema order; a missing or null source becomes `source`."""
    src = F.coalesce(F.col("source"), F.lit(source)) if "source" in df.columns else F.lit(source)
    return df.select(*BAR_KEY, *PRICES, src.alias("source"))


def as_ticks(df: DataFrame, *keep: str) -> DataFrame:
    """Ticks in schema order, then `keep`; absent volume becomes 0.0, absent bid and ask become null."""
    fill = {"volume": F.lit(0.0), "bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double")}
    optional = [F.col(c) if c in df.columns else fill[c].alias(c) for c in fill]
    return df.select(*TICK_KEY, "price", *optional, *keep)
