"""Ticks and bars mapped from the given tables, and the same mapping as SQL for the cross-check.

The tables hold no prices, so events become ticks (instrument = event type), line items become a second, larger set
of ticks (instrument = supplier) and orders become bars and ticks with many rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.timeframe import LADDER, SECONDS
from barlake.operators import ladder, quality
from barlake.schema import RAW, as_bars, as_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(
        table(spark, sf_dir, "events")
        .where("value > 0")
        .selectExpr(
            "event_type AS instrument",
            "ts AS timestamp",
            "value AS price",
            "CAST(event_id % 10 AS DOUBLE) AS volume",
            "value - 0.01D AS bid",
            "value + 0.01D AS ask",
        )
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ticks may share a key here; there is no bid and no ask."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('SUP_', l_suppkey) AS instrument",
        "l_shipdate + make_dt_interval(0, 0, l_partkey % 1440, l_orderkey % 60) AS timestamp",
        "l_extendedprice AS price",
        "l_quantity AS volume",
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one hour, several per key, with `o_orderkey` as their order of arrival."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('ORD_', o_orderstatus) AS instrument",
        "'H1' AS timeframe",
        "o_orderdate + make_dt_interval(0, o_orderkey % 24, o_custkey % 60) AS timestamp",
        "o_totalprice AS open",
        "o_totalprice + 2 AS high",
        "o_totalprice - 2 AS low",
        "o_totalprice + 1 AS close",
        "o_orderkey",
    )


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 bars of the event ticks, taken as original bars."""
    return as_bars(ladder.ticks_to_bars(event_ticks(spark, sf_dir), "M1").drop("source"), RAW)


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original M1 bars and the ladder derived from them."""
    minutes = minute_bars(spark, sf_dir)
    return minutes.unionByName(ladder.ladder_from_bars(minutes, "M1"))


def offset_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 and D1 bars each stamped at the start of the bucket and one and two hours later; D1 bars also as W1, MN1."""
    ticks = event_ticks(spark, sf_dir)
    four, day = ladder.ticks_to_bars(ticks, "H4"), ladder.ticks_to_bars(ticks, "D1")
    late = four.unionByName(day)
    variants = [
        late.withColumns(
            {
                "timestamp": F.expr(f"timestamp + make_dt_interval(0, {hours})"),
                **{c: F.col(c) + float(hours) for c in ("open", "high", "low", "close")},
            }
        )
        for hours in (0, 1, 2)
    ]
    named = [day.withColumn("timeframe", F.lit(tf)) for tf in ("W1", "MN1")]
    result = variants[0]
    for other in (*variants[1:], *named):
        result = result.unionByName(other)
    return result


def priced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bars of text, some fields of which are not numbers."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_partkey",
        "l_shipdate AS timestamp",
        "CASE WHEN l_discount = 0.05D THEN 'n/a' ELSE CAST(l_extendedprice AS STRING) END AS open",
        "CASE WHEN l_tax = 0.02D THEN 'NaN' ELSE concat(' ', CAST(l_extendedprice + 1 AS STRING)) END AS high",
        "CAST(l_extendedprice - 1 AS STRING) AS low",
        "CASE WHEN l_quantity = 7 THEN '1.5d' ELSE CAST(l_extendedprice AS STRING) END AS close",
        "'9' AS tickvol",
    )


def good(judged: DataFrame) -> DataFrame:
    return quality.accepted(judged)


# -- the same as SQL ----------------------------------------------------------------------------------------------

TICKS = """ticks AS (
  SELECT event_type AS instrument, ts AS timestamp, value AS price, CAST(event_id % 10 AS DOUBLE) AS volume,
         value - 0.01::DOUBLE AS bid, value + 0.01::DOUBLE AS ask
  FROM events WHERE value > 0)"""

LINES = """lines AS (
  SELECT instrument, timestamp, price, volume FROM (
    SELECT 'SUP_' || l_suppkey AS instrument,
           l_shipdate + to_minutes(CAST(l_partkey % 1440 AS INT)) + to_seconds(l_orderkey % 60) AS timestamp,
           l_extendedprice AS price, l_quantity AS volume FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY instrument, timestamp ORDER BY price DESC, volume DESC) = 1)"""

ORDER_ROWS = """order_rows AS (
  SELECT 'ORD_' || o_orderstatus AS instrument, 'H1' AS timeframe,
         o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_custkey % 60) AS timestamp,
         o_totalprice AS open, o_totalprice + 2 AS high, o_totalprice - 2 AS low, o_totalprice + 1 AS close, o_orderkey
  FROM orders)"""


def bucket(timeframe: str, column: str = "timestamp") -> str:
    return f"time_bucket(INTERVAL '{SECONDS[timeframe]} seconds', {column})"


def fold_ticks(timeframe: str, source: str = "ticks", label: str = "derived") -> str:
    return (
        f"SELECT instrument, '{timeframe}' AS timeframe, {bucket(timeframe)} AS timestamp, "
        f"arg_min(price, timestamp) AS open, max(price) AS high, min(price) AS low, "
        f"arg_max(price, timestamp) AS close, '{label}' AS source FROM {source} GROUP BY ALL"
    )


def fold_bars(target: str, source: str = "minutes") -> str:
    return (
        f"SELECT instrument, '{target}' AS timeframe, {bucket(target)} AS timestamp, "
        f"arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, "
        f"arg_max(close, timestamp) AS close, 'derived' AS source FROM {source} GROUP BY ALL"
    )


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({part})" for part in parts)


MINUTES = f"minutes AS ({fold_ticks('M1', label='raw')})"
BARS = f"bars AS (SELECT * FROM minutes UNION ALL {union_all([fold_bars(tf) for tf in LADDER])})"
OFFSET = f"""offset_bars AS (
  SELECT instrument, timeframe, timestamp + to_hours(h) AS timestamp, open + h AS open, high + h AS high,
         low + h AS low, close + h AS close, source
  FROM ({fold_ticks('H4')} UNION ALL {fold_ticks('D1')}), (VALUES (0), (1), (2)) AS v(h)
  UNION ALL
  SELECT instrument, tf, timestamp, open, high, low, close, source
  FROM ({fold_ticks('D1')}), (VALUES ('W1'), ('MN1')) AS w(tf))"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
