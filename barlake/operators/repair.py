"""Shift of stored wall-clock times to UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timestamps import local_to_utc
from barlake.schema import PRICES, TICKS


def shift_bars(bars: DataFrame, zone: str) -> DataFrame:
    """Bars whose times were local to `zone`, in UTC. Of rows that meet, the latest original time counts."""
    shifted = bars.withColumn("utc", local_to_utc("timestamp", zone))
    last = F.max(F.struct("timestamp", *PRICES, "source")).alias("last")
    picked = shifted.groupBy("instrument", "timeframe", "utc").agg(last)
    fields = [F.col(f"last.{c}").alias(c) for c in (*PRICES, "source")]
    return picked.select("instrument", "timeframe", F.col("utc").alias("timestamp"), *fields)


def shift_ticks(ticks: DataFrame, zone: str) -> DataFrame:
    """Ticks whose times were local to `zone`, in UTC; each field is the latest value that is not null."""
    shifted = ticks.withColumn("utc", local_to_utc("timestamp", zone))
    fields = ["price", "volume", "bid", "ask"]
    # A null field must not win, so it gets a null rank, which max_by passes over.
    picked = shifted.groupBy("instrument", "utc").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("timestamp"))).alias(c) for c in fields]
    )
    return picked.withColumnRenamed("utc", "timestamp").select(*TICKS.names)


def shift_report(bars: DataFrame, ticks: DataFrame, zone: str) -> DataFrame:
    """Rows before, after and lost to meeting times, per table, without computing the shifted rows themselves."""

    def counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        per_key = df.groupBy(*keys, local_to_utc("timestamp", zone).alias("utc")).agg(F.count("*").alias("n"))
        return per_key.agg(
            F.lit(name).alias("table"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
            F.count("*").alias("rows_after"),
            (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("rows_deduplicated"),
        )

    return counts(bars, ["instrument", "timeframe"], "bars").unionByName(counts(ticks, ["instrument"], "ticks"))
