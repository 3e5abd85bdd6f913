"""Ingest: clean, upsert and derive in one go, for frames, for folders of files and for stored windows.

A run parses its input once and writes the changed partitions of both tables beside them. They become valid by one
commit, so a run that died leaves the store as it was or is completed by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import LADDER, SECONDS, check_timeframe, derivation_targets
from barlake.functions.timestamps import naive_utc, ntz
from barlake.operators import dedupe, ladder, merge, quality
from barlake.schema import BAR_KEY, DERIVED, RAW, TICK_KEY
from barlake.session import together
from barlake.sources import files
from barlake.sources.store import Days, Pending, Store

REFRESH_DAYS = (1, 365)
SOURCES = {timeframe for timeframe in SECONDS if derivation_targets(timeframe)}


@dataclass
class Report:
    """`series`: counts per instrument (and timeframe). `derived`: derived bars in the window per instrument and
    timeframe. `files`: outcome per file where files were read. `instruments`: outcome of a refresh per instrument."""

    series: DataFrame
    derived: DataFrame | None
    files: DataFrame | None = None
    instruments: DataFrame | None = None


def ingest_bars(
    store: Store,
    bars: DataFrame,
    instrument: str | None = None,
    timeframe: str | None = None,
    derive: bool = True,
    column_map: dict[str, str] | None = None,
    scope: str = "window",
    deltas: bool = False,
) -> Report:
    """Bars of a frame. A bad timestamp rejects all, rows with a bad price are left out.

    With `deltas` a small batch is kept beside the partitions until `Store.compact`, and its days are derived again.
    """
    with store.workspace() as stage:
        judged = stage(_named(quality.judged_bars(bars, column_map), instrument, timeframe), "judged")
        rows = quality.strict_bars(judged)
        return _append_bars(store, stage, rows, derive) if deltas else _merge_bars(store, stage, rows, derive, scope)


def ingest_ticks(
    store: Store,
    ticks: DataFrame,
    instrument: str | None = None,
    derive: bool = True,
    order: list[str] | None = None,
    scope: str = "window",
    deltas: bool = False,
) -> Report:
    """Ticks of a frame. A bad timestamp or price rejects all; of one key the last by `order` counts.

    With `deltas` a small batch is kept beside the partitions until `Store.compact`, and its days are derived again.
    """
    with store.workspace() as stage:
        judged = stage(_named(quality.judged_ticks(ticks), instrument, "TICK"), "judged")
        rows = quality.strict_ticks(judged)
        return _append_ticks(store, stage, rows, derive, order) if deltas else _merge_ticks(store, stage, rows, derive, order, scope)


def ingest_bar_files(store: Store, folder: str, derive: bool = True, **given) -> Report:
    """All bar files of a folder. A bad file is reported and left out; a later file name outranks an earlier one."""
    batch = files.read_bar_files(store.spark, folder, **given)
    with store.workspace() as stage:
        rows, outcome = _good_files(store, stage, batch, (quality.BAD_TIMESTAMP, quality.BAD_ROW))
        report = _merge_bars(store, stage, rows, derive, "window", _file_order(outcome))
        return Report(report.series, report.derived, outcome)


def ingest_tick_files(store: Store, folder: str, derive: bool = True, **given) -> Report:
    """All tick files of a folder. A bad file is reported and left out; a later file name outranks an earlier one."""
    batch = files.read_tick_files(store.spark, folder, **given)
    with store.workspace() as stage:
        rows, outcome = _good_files(store, stage, batch, (quality.BAD_TIMESTAMP, quality.BAD_PRICE, quality.BAD_ROW))
        report = _merge_ticks(store, stage, rows, derive, ["name"], "window")
        return Report(report.series, report.derived, outcome)


def refresh(
    store: Store, folder: str, days: int = 7, now: datetime | str | None = None, instruments: list[str] | None = None
) -> Report:
    """Landed M1 files of the last days: upsert and derive, for the instruments in the store unless some are given.

    The report has a row for each instrument in scope: the rows of the window that were taken, the first and last of their
    times, and an error if one of its files was rejected. Fails only if every file was.
    """
    if not REFRESH_DAYS[0] <= days <= REFRESH_DAYS[1]:
        raise ValueError(f"days must be {REFRESH_DAYS[0]} to {REFRESH_DAYS[1]}")
    end = naive_utc(now or datetime.now(timezone.utc))
    scope = _listed(store, instruments) if instruments else store.bars().select("instrument").distinct()
    with store.workspace() as stage:
        known = stage(scope, "scope")
        batch = files.read_bar_files(
            store.spark, folder, wanted=lambda listed: refresh_scope(listed.where(F.col("timeframe") == "M1"), known)
        )
        rows, outcome = _good_files(store, stage, batch, (quality.BAD_TIMESTAMP, quality.BAD_ROW))
        if outcome.where("status = 'error'").limit(1).count() and not outcome.where("status = 'ok'").limit(1).count():
            raise ValueError(f"every instrument failed, for example: {outcome.first()['error']}")
        recent = rows.where(
            (F.col("timestamp") >= ntz(end - timedelta(days=days))) & (F.col("timestamp") <= ntz(end))
        )
        report = _merge_bars(store, stage, recent, True, "window", _file_order(outcome))
        instruments = store.stage(_outcome_of_scope(known, report.series, outcome), "report")
        return Report(report.series, report.derived, outcome, instruments)


def _outcome_of_scope(known: DataFrame, series: DataFrame, outcome: DataFrame) -> DataFrame:
    taken = series.select("instrument", F.col("rows_in_batch").alias("rows"), "first_timestamp", "last_timestamp")
    errors = outcome.where("error IS NOT NULL").groupBy("instrument").agg(F.min("error").alias("error"))
    found = known.distinct().join(taken, "instrument", "left").join(errors, "instrument", "left")
    return found.withColumn("rows", F.coalesce("rows", F.lit(0)))


def refresh_scope(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of instruments that the catalog already knows."""
    return rows.join(catalog.select("instrument").distinct(), "instrument", "left_semi")


def derive_stored_bars(
    store: Store, timeframe: str, start: datetime | str, end: datetime | str, instruments: list[str] | None = None
) -> DataFrame:
    """Rebuild the ladder of one stored source timeframe over a window; returns derived bars per target."""
    source = check_timeframe(timeframe)
    first, last = ladder.pad_window(start, end)
    rows = _of(store.bars(first, last), instruments).where(F.col("timeframe") == source)
    targets = derivation_targets(source)
    with store.workspace() as stage:
        fresh = ladder.ladder_from_bars(ladder.in_window(rows, first, last), source)
        stored = _of(store.bars(first, last), instruments).where(F.col("timeframe").isin(*targets))
        if targets:
            store.merge_bars(stage(ladder.protect_raw(fresh, stored, targets=targets), "derived"))
    counts = ladder.derived_counts(_of(store.bars(first, last), instruments), start, end)
    return store.stage(counts.where(F.col("timeframe").isin(*targets)), "report")


def derive_stored_ticks(
    store: Store, start: datetime | str, end: datetime | str, instruments: list[str] | None = None
) -> DataFrame:
    """Rebuild M1 and the ladder from stored ticks over a window; returns derived bars per target."""
    first, last = ladder.pad_window(start, end)
    with store.workspace() as stage:
        ticks = ladder.in_window(_of(store.ticks(first, last), instruments), first, last)
        fresh = ladder.ladder_from_ticks(ticks)
        store.merge_bars(stage(ladder.protect_raw(fresh, _of(store.bars(first, last), instruments)), "derived"))
    return store.stage(ladder.derived_counts(_of(store.bars(first, last), instruments), start, end), "report")


# -- shared steps ------------------------------------------------------------------------------------------------


def _merge_bars(store: Store, stage, rows: DataFrame, derive: bool, scope: str, order: list[str] | None = None) -> Report:
    store.compact()
    rows = rows.withColumn("timeframe", F.upper("timeframe"))
    incoming = stage(dedupe.latest_bars(rows, RAW, order), "bars")
    by = ["instrument", "timeframe"]
    read = rows.groupBy(*by).agg(F.count("*").alias("rows_in_file"))
    names = store.partitions("bars", incoming)
    if not (names and derive):
        return Report(_merge_plain(store, "bars", incoming, names, by, read), None if not derive else _none_derived(store))
    # derived bars are written with the given ones, so growth can't tell new ones here
    counts = merge.upsert_counts(store.touched("bars", incoming, names), incoming, BAR_KEY, by)
    series = store.stage(counts.join(read, by), "report")
    sources = sorted({name.split("/")[1] for name in names} & SOURCES)
    days, derived = _ladder_of(store, stage, incoming, sources, scope)
    with store.pending() as pending:
        pending.merge("bars", incoming.unionByName(derived))
        (report,) = pending.publish(lambda: _derived_now(store, days.per_instrument(), pending))
    return Report(series, report)


def _ladder_of(store: Store, stage, incoming: DataFrame, sources: list[str], scope: str) -> tuple[Days, DataFrame]:
    """The days of the series of `sources` in a batch, and the bars derived from them as they will be with the batch."""
    by = ["instrument", "timeframe"]
    ladder_rows = incoming.where(F.col("timeframe").isin(*SOURCES))
    days = Days.of(_days(ladder_rows, by, scope), by, stage)
    base = merge.upsert_bars(store.on_days("bars", days), ladder_rows)
    fresh = ladder.ladder_from_bars(base, sources[0]) if len(sources) == 1 else ladder.ladder_mixed(base)
    held = store.on_days("bars", days.per_instrument())
    return days, stage(ladder.protect_raw(fresh, held, incoming, targets=list(LADDER)), "derived")


def _append_bars(store: Store, stage, rows: DataFrame, derive: bool) -> Report:
    """As `_merge_bars`, but no partition is written: the batch and the bars whose buckets it touches are one delta."""
    store.recover()
    by = ["instrument", "timeframe"]
    rows = rows.withColumn("timeframe", F.upper("timeframe"))
    incoming = stage(dedupe.latest_bars(rows, RAW), "bars")
    read = rows.groupBy(*by).agg(F.count("*").alias("rows_in_file"))
    days = Days.of(_days(incoming, by, "days"), by, stage)
    counts = merge.upsert_counts(store.on_days("bars", days), incoming, BAR_KEY, by)
    series = store.stage(counts.join(read, by), "report")
    if not (days.count and derive):
        if days.count:
            store.append_all({"bars": incoming})
        return Report(series, None if not derive else _none_derived(store))
    present = {row[0] for row in days.frame.select("timeframe").distinct().collect()}
    days, derived = _ladder_of(store, stage, incoming, sorted(present & SOURCES), "days")
    touched = ladder.in_buckets_of(derived, incoming)
    with store.pending(deltas=True) as pending:
        pending.append("bars", incoming.unionByName(touched))
        (report,) = pending.publish(lambda: _derived_now(store, days.per_instrument(), pending))
    return Report(series, report)


def _append_ticks(store: Store, stage, rows: DataFrame, derive: bool, order: list[str] | None) -> Report:
    """As `_merge_ticks`, but no partition is written: the batch and the bars whose buckets it touches are deltas."""
    store.recover()
    by = ["instrument"]
    incoming = stage(dedupe.latest_ticks(rows, order), "ticks")
    read = quality.distinct_rows(rows.select("instrument", "timestamp", *_values(rows))).groupBy(*by).agg(F.count("*").alias("rows_in_file"))
    days = Days.of(_days(incoming, by, "days"), by, stage)
    series = store.stage(merge.upsert_counts(store.on_days("ticks", days), incoming, TICK_KEY, by).join(read, by), "report")
    if not (days.count and derive):
        if days.count:
            store.append_all({"ticks": incoming})
        return Report(series, None if not derive else _none_derived(store))
    with store.pending(deltas=True) as pending:
        pending.append("ticks", incoming)
        fresh = ladder.in_buckets_of(ladder.ladder_from_ticks(store.on_days("ticks", days, pending)), incoming)
        pending.append("bars", stage(ladder.protect_raw(fresh, store.on_days("bars", days)), "derived"))
        (report,) = pending.publish(lambda: _derived_now(store, days, pending))
    return Report(series, report)


def _merge_ticks(store: Store, stage, rows: DataFrame, derive: bool, order: list[str] | None, scope: str) -> Report:
    incoming = stage(dedupe.latest_ticks(rows, order), "ticks")
    read = quality.distinct_rows(rows.select("instrument", "timestamp", *_values(rows)))
    read = read.groupBy("instrument").agg(F.count("*").alias("rows_in_file"))
    names = store.partitions("ticks", incoming)
    if not (names and derive):
        return Report(_merge_plain(store, "ticks", incoming, names, ["instrument"], read), None if not derive else _none_derived(store))
    days = Days.of(_days(incoming, ["instrument"], scope), ["instrument"], stage)

    def derived(pending: Pending) -> None:
        # the days are read as they will be, from the partitions just written
        fresh = ladder.ladder_from_ticks(store.on_days("ticks", days, pending))
        pending.merge("bars", stage(ladder.protect_raw(fresh, store.on_days("bars", days)), "derived"))

    def counted(pending: Pending) -> DataFrame:
        return store.stage(_merge_counts(pending, "ticks", incoming, ["instrument"]).join(read, "instrument"), "report")

    with store.pending() as pending:
        pending.merge("ticks", incoming, names)
        _, series = together(lambda: derived(pending), lambda: counted(pending))
        (report,) = pending.publish(lambda: _derived_now(store, days, pending))
    return Report(series, report)


def _merge_plain(store: Store, table: str, incoming: DataFrame, names: list[str], by: list[str], read: DataFrame) -> DataFrame:
    """Merges the batch alone and returns its counts per series."""
    with store.pending() as pending:
        if names:
            pending.merge(table, incoming, names)
        series = store.stage(_merge_counts(pending, table, incoming, by).join(read, by), "report")
        if names:
            pending.publish()
    return series


def _merge_counts(pending: Pending, table: str, incoming: DataFrame, by: list[str]) -> DataFrame:
    """Per series: keys in the batch, of which new, of which matched, and the time range of the batch.

    New keys are those by which the rows of the touched partitions have grown, so no key is looked up a second time.
    """
    batch = incoming.groupBy(*by).agg(
        F.count("*").alias("rows_in_batch"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")
    )
    before = pending.former_partials(table).select(*by, (-F.col("rows")).alias("rows"))
    grown = pending.partials(table).select(*by, "rows").unionByName(before).groupBy(*by).agg(F.sum("rows").alias("rows_new"))
    matched = F.col("rows_in_batch") - F.col("rows_new")
    return batch.join(grown, by).select(*by, "rows_in_batch", "rows_new", matched.alias("rows_matched"), "first_timestamp", "last_timestamp")


def _days(rows: DataFrame, by: list[str], scope: str) -> DataFrame:
    """Whole UTC days to derive again: every day from the first to the last of a series, or only days with rows."""
    day = F.col("timestamp").cast("date")
    if scope == "days":
        return rows.select(*by, day.alias("date")).distinct()
    if scope != "window":
        raise ValueError(f"unknown scope: {scope!r}")
    spans = rows.groupBy(*by).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return spans.select(*by, F.explode(F.sequence("first", "last")).alias("date"))


def _derived_now(store: Store, days: Days, pending: Pending) -> DataFrame:
    """Derived bars of the days that were derived again, as they are after this run; staged, so that it stays as it is."""
    bars = store.on_days("bars", days, pending).where(F.col("source") == DERIVED)
    return store.stage(bars.groupBy("instrument", "timeframe").agg(F.count("*").alias("bars")), "report")


def _none_derived(store: Store) -> DataFrame:
    return store.spark.createDataFrame([], "instrument string, timeframe string, bars bigint")


def _good_files(store: Store, stage, batch: files.FileBatch, fatal: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that are good as a whole, and one outcome row per file."""
    parsed = stage(batch.rows, "parsed")
    counts = quality.reject_counts(parsed, "file")
    columns = {quality.BAD_TIMESTAMP: "bad_timestamps", quality.BAD_PRICE: "bad_prices", quality.BAD_ROW: "bad_rows"}
    error = F.col("error")
    for reason in fatal:
        bad = F.coalesce(F.col(columns[reason]), F.lit(0))
        error = F.coalesce(error, F.when(bad > 0, F.concat(bad.cast("string"), F.lit(f" rows with {reason}"))))
    outcome = batch.files.join(counts, "file", "left").withColumn("error", error)
    outcome = outcome.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).select(
        "file",
        "name",
        "instrument",
        "timeframe",
        "status",
        "error",
        F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        F.coalesce("bad_timestamps", F.lit(0)).alias("bad_timestamps"),
        F.coalesce("bad_prices", F.lit(0)).alias("bad_prices"),
        F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"),
    )
    outcome = store.stage(outcome, "files")
    failed = outcome.where("status = 'error'").select("file")
    return quality.accepted(parsed).join(failed, "file", "left_anti"), outcome


def _file_order(outcome: DataFrame) -> list[str]:
    """Later files outrank earlier ones. Where no series has two files the time alone decides, in a hash aggregate."""
    several = outcome.where("status = 'ok'").groupBy("instrument", "timeframe").count().where("count > 1")
    return ["name", "stamp"] if several.limit(1).count() else ["stamp"]


def _named(rows: DataFrame, instrument: str | None, timeframe: str | None) -> DataFrame:
    given = {"instrument": instrument, "timeframe": timeframe}
    rows = rows.withColumns({name: F.lit(value) for name, value in given.items() if value})
    return quality.judge_names(quality.require(rows, list(given)))


def _values(rows: DataFrame) -> list[str]:
    return [c for c in ("price", "volume", "bid", "ask") if c in rows.columns]


def _of(rows: DataFrame, instruments: list[str] | None) -> DataFrame:
    return rows.where(F.col("instrument").isin(*instruments)) if instruments else rows


def _listed(store: Store, instruments: list[str]) -> DataFrame:
    return store.spark.createDataFrame([(i,) for i in instruments], "instrument string")


__all__ = [
    "Report",
    "derive_stored_bars",
    "derive_stored_ticks",
    "ingest_bar_files",
    "ingest_bars",
    "ingest_tick_files",
    "ingest_ticks",
    "refresh",
    "refresh_scope",
]
