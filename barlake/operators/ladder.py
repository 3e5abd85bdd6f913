"""OHLC bars from ticks and from finer bars, one level or the whole ladder."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.timeframe import LADDER, SECONDS, derivation_targets, tick_targets, width, with_bucket
from barlake.functions.timestamps import naive_utc, ntz
from barlake.schema import BAR_KEY, DERIVED, PRICES, RAW, as_bars


def _folds() -> dict[str, Column]:
    """Open and close by time, high and low. All buffers are of fixed width, so these stay hash aggregates."""
    return {
        "open": F.min_by("open", "timestamp"),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", "timestamp"),
    }


def _fold() -> list[Column]:
    return [folded.alias(price) for price, folded in _folds().items()]


def ticks_to_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of one timeframe from ticks. One shuffle of partial aggregates, however hot a bucket is."""
    folded = with_bucket(ticks, timeframe, "bucket").groupBy("instrument", "bucket").agg(
        F.min_by("price", "timestamp").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "timestamp").alias("close"),
    )
    return _as_derived(folded.withColumn("timeframe", F.lit(timeframe)), F.col("bucket"))


def bars_to_bars(bars: DataFrame, source: str, target: str) -> DataFrame:
    """Bars of one target timeframe from the bars of one source timeframe."""
    if target not in derivation_targets(source):
        raise ValueError(f"{target} cannot be derived from {source}")
    series = bars.where(F.col("timeframe") == source)
    folded = series.groupBy("instrument", F.window("timestamp", width(target)).alias("bucket")).agg(*_fold())
    return _as_derived(folded.withColumn("timeframe", F.lit(target)), F.col("bucket.start"))


def ladder_from_bars(bars: DataFrame, source: str) -> DataFrame:
    """All targets of one source timeframe in one scan and one shuffle.

    Each bar is fanned out to the buckets it belongs to and folded on the map side. Stored files are ordered by
    time, so a task folds nearly everything before the shuffle.
    """
    return _fold_levels(bars.where(F.col("timeframe") == source), derivation_targets(source))


def ladder_from_ticks(ticks: DataFrame) -> DataFrame:
    """M1 and all ladder timeframes from ticks in one scan.

    Ticks are folded to M1 first, with partial aggregates, so a hot minute or day never meets in one task. What is
    left is at most 1,440 bars per instrument and day; these are brought together and sorted once, and all levels are
    folded as the days pass by.
    """
    minutes = ticks_to_bars(ticks, "M1").drop("timeframe").withColumn("date", F.col("timestamp").cast("date"))
    return _fold_days(minutes.repartition("instrument", "date"))


def ladder_mixed(bars: DataFrame) -> DataFrame:
    """Targets of every source timeframe present; where several sources give the same bar, the finest one counts."""
    sources = [tf for tf in SECONDS if derivation_targets(tf)]
    known = bars.where(F.col("timeframe").isin(*sources))
    fanned = _fan_out(known.withColumnRenamed("timeframe", "origin"), list(LADDER), ["origin"])
    length = F.lit(None).cast("int")
    for tf in sources:
        length = F.when(F.col("origin") == tf, F.lit(SECONDS[tf])).otherwise(length)
    allowed = F.lit(False)
    for tf in sources:
        allowed = F.when(F.col("origin") == tf, F.col("timeframe").isin(*derivation_targets(tf))).otherwise(allowed)
    folded = (
        fanned.where(allowed)
        .groupBy("instrument", "timeframe", "bucket", length.alias("origin_seconds"))
        .agg(*_fold())
    )
    finest = folded.groupBy("instrument", "timeframe", "bucket").agg(
        *[F.min_by(c, "origin_seconds").alias(c) for c in PRICES]
    )
    return _as_derived(finest, F.col("bucket"))


def protect_raw(derived: DataFrame, *stored: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Leave out derived bars whose key is held by a raw bar; only raw bars of the target timeframes are read."""
    for bars in stored:
        relevant = F.col("timeframe").isin(*(targets or tick_targets()))
        raw_keys = bars.where(relevant & (F.col("source") == RAW)).select(*BAR_KEY)
        derived = derived.join(raw_keys, BAR_KEY, "left_anti")
    return derived


def in_buckets_of(derived: DataFrame, rows: DataFrame) -> DataFrame:
    """Derived bars whose bucket holds one of `rows` (ticks or bars): of a few late rows there are a few on each level."""
    held = rows.select("instrument", "timestamp")
    for target in tick_targets():
        held = with_bucket(held, target, target)
    levels = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.col(t).alias("timestamp")) for t in tick_targets()])
    return derived.join(held.select("instrument", F.inline(levels)).distinct(), BAR_KEY, "left_semi")


def pad_window(start: datetime | str, end: datetime | str) -> tuple[datetime, datetime]:
    """[start, end] widened to whole UTC days: from midnight of the first to midnight after the last."""
    first, last = (naive_utc(t).replace(hour=0, minute=0, second=0, microsecond=0) for t in (start, end))
    return first, last + timedelta(days=1)


def in_window(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return df.where((F.col("timestamp") >= ntz(start)) & (F.col("timestamp") < ntz(end)))


def derived_counts(bars: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """All derived bars in the padded window per instrument and timeframe, whichever run wrote them."""
    window = in_window(bars.where(F.col("source") == DERIVED), *pad_window(start, end))
    return window.groupBy("instrument", "timeframe").agg(F.count("*").alias("bars"))


def _fan_out(bars: DataFrame, targets: list[str], keep: list[str]) -> DataFrame:
    """One row per bar and target, with the bucket it belongs to. `inline` leaves the partitioning as it is."""
    for target in targets:
        bars = with_bucket(bars, target, target)
    levels = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.col(t).alias("bucket")) for t in targets])
    return bars.select("instrument", *keep, "timestamp", *PRICES, F.inline(levels))


def _fold_levels(bars: DataFrame, targets: list[str]) -> DataFrame:
    if not targets:
        return as_bars(bars.limit(0))
    fanned = _fan_out(bars.drop("timeframe"), targets, [])
    return _as_derived(fanned.groupBy("instrument", "timeframe", "bucket").agg(*_fold()), F.col("bucket"))


def _fold_days(minutes: DataFrame) -> DataFrame:
    """M1 bars, one per minute and each day whole in a partition, with all levels above them.

    Each level's buckets lie inside those of the next, so one sort puts all of them in order; a task then holds one
    day, not the bars of all levels. The first bar of a bucket brings the bucket's bar along.
    """
    nested = ["instrument", "date", *[tf for tf in reversed(LADDER) if tf != "D1"]]
    for target in LADDER:
        minutes = with_bucket(minutes, target, target)
    days = minutes.sortWithinPartitions(*nested)
    bars = [F.struct(F.lit("M1").alias("timeframe"), F.col("timestamp").alias("bucket"), *PRICES)]
    for target in LADDER:
        bucket = Window.partitionBy(*nested[: nested.index("date" if target == "D1" else target) + 1])
        folds = {"first": F.min("timestamp"), **_folds()}
        days = days.select("*", *[fold.over(bucket).alias(f"{target}_{name}") for name, fold in folds.items()])
        prices = [F.col(f"{target}_{p}").alias(p) for p in PRICES]
        bar = F.struct(F.lit(target).alias("timeframe"), F.col(target).alias("bucket"), *prices)
        bars.append(F.when(F.col(f"{target}_first") == F.col("timestamp"), bar))
    levels = days.select("instrument", F.inline(F.array(*bars))).where(F.col("timeframe").isNotNull())
    return _as_derived(levels, F.col("bucket"))


def _as_derived(folded: DataFrame, start) -> DataFrame:
    return as_bars(folded.withColumn("timestamp", start).withColumn("source", F.lit(DERIVED)))

