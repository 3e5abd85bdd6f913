"""Upsert of a key-unique batch into a table, and the new-versus-matched counts of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.schema import BAR_KEY, TICK_KEY, as_bars, as_ticks


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows with their key; both sides hold a key at most once.

    The join is on the full key, timestamp included, so no join key repeats and none can be hot.
    """
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return incoming.unionByName(kept)


def upsert_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(as_bars(existing), as_bars(incoming), BAR_KEY)


def upsert_ticks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(as_ticks(existing), as_ticks(incoming), TICK_KEY)


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per series: keys in the batch, of which new, of which matched, and the time range of the batch."""
    marked = existing.select(*keys, F.lit(True).alias("found"))
    return (
        incoming.select(*keys)
        .join(marked, keys, "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("rows_in_batch"),
            F.count_if(F.col("found").isNull()).alias("rows_new"),
            F.count("found").alias("rows_matched"),
            F.min("timestamp").alias("first_timestamp"),
            F.max("timestamp").alias("last_timestamp"),
        )
    )
