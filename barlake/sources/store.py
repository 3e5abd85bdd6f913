"""The two stored tables, as partitioned Parquet.

bars/instrument=/timeframe=/period=/ with the year as period for M1 and M5, and 0 (all time) for other timeframes, whose
whole history is small; ticks/instrument=/date=/ with the first day of the tick period. Both come from the timestamp
and are not part of a result; they bound how much an upsert rewrites and how much a range query reads. Files are
sorted by time, so row groups outside a time range are skipped as well.

Beside each table stand its partials: rows, first and last time of every partition (and source). They are replaced in the
commit that changes the partitions, so summaries, reports and pages read them and not the prices.

A small batch can be kept as a delta: its rows alone are written, under a batch number, whatever partitions they belong to.
Reading lays the deltas over the partitions (of one key the highest batch counts, deltas before partitions); `compact` merges
them into the partitions, and so does every write that replaces partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.timestamps import naive_utc, ntz
from barlake.schema import BAR_KEY, BARS, TICK_KEY, TICKS
from barlake.session import empty, stage, together, work_dir
from barlake.sources import commit, hadoop

# Days of up to this many series are broadcast (a few MB); more are joined with a shuffle. The rows read are the same.
BROADCAST_DAYS = 100_000

PARTS = {"bars": ["instrument", "timeframe", "period"], "ticks": ["instrument", "date"]}
COLUMNS = {"bars": BARS.names, "ticks": TICKS.names}
STORED = {
    "bars": T.StructType([*BARS.fields, T.StructField("period", T.IntegerType())]),
    "ticks": T.StructType([*TICKS.fields, T.StructField("date", T.DateType())]),
}
#: What a partial tells of: a partition, and for bars a source.
PARTIAL_BY = {"bars": ["instrument", "timeframe", "period", "source"], "ticks": ["instrument", "date"]}
PARTIALS = {
    table: T.StructType(
        [
            *(STORED[table][c] for c in by),
            T.StructField("rows", T.LongType()),
            T.StructField("first", T.TimestampNTZType()),
            T.StructField("last", T.TimestampNTZType()),
        ]
    )
    for table, by in PARTIAL_BY.items()
}
KEYS = {"bars": BAR_KEY, "ticks": TICK_KEY}
BATCH = "batch"
YEARLY = ("M1", "M5")
TICK_PERIODS = {"day": None, "month": "MM", "year": "YY"}
LAYOUT = "layout.json"
#: Folders that are listed at the same time.
LISTERS = 16


@dataclass
class Days:
    """Whole UTC days of instruments, or of (instrument, timeframe) series, to read again.

    `frame` is staged; `count`, `first` and `last` describe it.
    """

    frame: DataFrame
    by: list[str]
    count: int
    first: date | None
    last: date | None
    _spans: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)

    def spans(self, table: str, start: Column) -> set[tuple[str, ...]]:
        """The series of these days, each with the begin of the table's partitions that they fall into."""
        if table not in self._spans:
            self._spans[table] = {tuple(map(str, row)) for row in self.frame.select(*self.by, start.alias("period")).distinct().collect()}
        return self._spans[table]

    @staticmethod
    def of(frame: DataFrame, by: list[str], stage: Callable[[DataFrame, str], DataFrame]) -> Days:
        frame = stage(frame.select(*by, "date"), "days")
        count, first, last = frame.agg(F.count("*"), F.min("date"), F.max("date")).first()
        return Days(frame, by, count, first, last)

    def per_instrument(self) -> Days:
        """The same days of all timeframes of their instruments."""
        return Days(self.frame.select("instrument", "date").distinct(), ["instrument"], self.count, self.first, self.last)


class Workspace:
    """Stages frames under a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, self.folder, label)


class Store:
    """Bars and ticks under one root folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, tick_period: str | None = None):
        """`tick_period` (day, month or year) sets the span of a tick partition: shorter for denser ticks.

        It is fixed for a root with its first write (month unless given) and need not be told again.
        """
        if tick_period is not None and tick_period not in TICK_PERIODS:
            raise ValueError(f"tick_period must be one of {list(TICK_PERIODS)}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.staging = work_dir(spark, fallback=f"{self.root}/_staging")
        known = hadoop.read_text(spark, f"{self.root}/{LAYOUT}")
        self._fixed = known is not None
        held = json.loads(known)["tick_period"] if known else None
        if held and tick_period and held != tick_period:
            raise ValueError(f"store at {self.root} has layout {known}")
        self.tick_period = held or tick_period or "month"
        self.recover()

    def _fix_layout(self) -> None:
        """Rows in a partition of another span would not be found by an upsert, so a root keeps its layout."""
        if not self._fixed:
            hadoop.write_text(self.spark, f"{self.root}/{LAYOUT}", json.dumps({"tick_period": self.tick_period}))
            self._fixed = True

    # -- reading -----------------------------------------------------------------------------------------------

    def bars(self, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
        """Stored bars, optionally from `start` to `end` inclusive; add equality filters on instrument and timeframe."""
        rows = self._table("bars")
        if start is not None:
            year = naive_utc(start).year
            rows = rows.where(F.col("period").isin(0) | (F.col("period") >= year)).where(F.col("timestamp") >= ntz(start))
        if end is not None:
            rows = rows.where((F.col("period") <= naive_utc(end).year) & (F.col("timestamp") <= ntz(end)))
        return rows.select(*BARS.names)

    def ticks(self, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
        rows = self._table("ticks")
        if start is not None:
            rows = rows.where((F.col("date") >= self._tick_period_start(ntz(start))) & (F.col("timestamp") >= ntz(start)))
        if end is not None:
            rows = rows.where((F.col("date") <= self._tick_period_start(ntz(end))) & (F.col("timestamp") <= ntz(end)))
        return rows.select(*TICKS.names)

    def partitions(self, table: str, changes: DataFrame) -> list[str]:
        """Names (values joined by /) of the partitions that `changes` falls into, as many as a write of it touches."""
        wanted = self._with_period(table, changes).select(*PARTS[table]).distinct()
        return sorted("/".join(str(value) for value in row) for row in wanted.collect())

    def touched(self, table: str, changes: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Rows of the partitions that `changes` falls into, without deltas: call `compact` before."""
        names = self.partitions(table, changes) if names is None else names
        return self._in_partitions(table, names).select(*COLUMNS[table])

    def on_days(self, table: str, days: Days, pending: Pending | None = None) -> DataFrame:
        """Stored rows of the given days, as they will be after `pending`; only the partitions that hold them are read."""
        if not days.count:
            return empty(self.spark, STORED[table]).select(*COLUMNS[table])
        start = F.year("date") if table == "bars" else self._tick_period_start(F.col("date"))
        spans = days.spans(table, start)
        series = {span[:-1] for span in spans}
        held = self._held(table, sorted({span[0] for span in spans}))
        held = sorted({*held, *(pending.names(table) if pending else ())})
        named = [name for name in held if self._covers(table, name.split("/"), len(days.by), spans, series)]
        rows = pending.rows(table, named) if pending else self._in_partitions(table, named, held)
        bounds = ntz(str(days.first)), ntz(f"{days.last} 23:59:59.999999")
        rows, changes = _between(rows, *bounds), self._deltas(table, pending)
        if changes is not None:
            rows = _overlay(table, rows, _between(changes, *bounds))
        rows = rows.select(*COLUMNS[table]).withColumn("date", F.col("timestamp").cast("date"))
        # Few days are broadcast, so a day that holds much of the data is not sent to one task.
        wanted = F.broadcast(days.frame) if days.count <= BROADCAST_DAYS else days.frame
        return rows.join(wanted, [*days.by, "date"], "left_semi").drop("date")

    @staticmethod
    def _covers(table: str, values: list[str], by: int, spans: set[tuple[str, ...]], series: set[tuple[str, ...]]) -> bool:
        """Whether a partition can hold rows of the spans (series and year, or instrument and tick period)."""
        own = tuple(values[:by])
        return own in series if table == "bars" and values[-1] == "0" else (*own, values[-1]) in spans

    def partials(self, table: str) -> DataFrame:
        """rows, first and last time of each partition (and source of bars), without reading a price.

        A table whose partials are missing, as in a store of an earlier layout, is read as a whole. Partitions that deltas
        fall into are counted anew, from their keys (and sources).
        """
        stored, changes = self.merged_partials(table), self._deltas(table)
        if changes is None:
            return stored
        parts = changes.select(*PARTS[table]).distinct()
        names = ["/".join(map(str, row)) for row in parts.collect()]
        return stored.join(parts, PARTS[table], "left_anti").unionByName(
            _fold(table, _overlay(table, self._in_partitions(table, names), changes))
        )

    def merged_partials(self, table: str) -> DataFrame:
        """The partials without deltas."""
        try:
            return self.spark.read.schema(PARTIALS[table]).parquet(f"{self.root}/{_partials(table)}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return _fold(table, self._merged(table))

    def _table(self, table: str) -> DataFrame:
        """All rows with their partition columns, deltas included."""
        changes = self._deltas(table)
        return self._merged(table) if changes is None else _overlay(table, self._merged(table), changes)

    def _merged(self, table: str) -> DataFrame:
        """All rows of the partitions; the fixed schema keeps a name like 600519 a string."""
        try:
            return self.spark.read.schema(STORED[table]).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, STORED[table])

    def batches(self, table: str) -> list[int]:
        """Numbers of the deltas that wait to be merged into the partitions."""
        found = hadoop.matching(self.spark, f"{self.root}/{_delta(table)}/{BATCH}=*")
        return sorted(int(path.rsplit("=", 1)[1]) for path in found)

    def _deltas(self, table: str, pending: Pending | None = None) -> DataFrame | None:
        """Rows of all deltas with their batch number, with those that `pending` has appended; None where there are none."""
        folders = [self.root] if self.batches(table) else []
        if pending and _delta(table) in pending.commit.names:
            folders.append(pending.commit.folder)
        schema = T.StructType([*STORED[table].fields, T.StructField(BATCH, T.LongType())])
        found = [self.spark.read.schema(schema).parquet(f"{folder}/{_delta(table)}") for folder in folders]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else None

    def _held(self, table: str, instruments: list[str]) -> list[str]:
        """Names of the stored partitions of these instruments; other instruments are not listed."""
        levels = "/*" * (len(PARTS[table]) - 1)
        folders = [f"{self.root}/{table}/instrument={instrument}" for instrument in instruments]
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [path for paths in pool.map(lambda folder: hadoop.matching(self.spark, folder + levels), folders) for path in paths]
        depth = len(PARTS[table])
        return ["/".join(level.split("=", 1)[1] for level in path.split("/")[-depth:]) for path in found]

    def _in_partitions(self, table: str, names: list[str], held: list[str] | None = None) -> DataFrame:
        """Stored rows of exactly these partitions: their folders alone are listed and opened."""
        held = self._held(table, sorted({name.split("/")[0] for name in names})) if held is None else held
        there = sorted(set(names) & set(held))
        if not there:
            return empty(self.spark, STORED[table])
        return self._read(table, f"{self.root}/{table}", there)

    def _read(self, table: str, base: str, names: list[str]) -> DataFrame:
        reader = self.spark.read.schema(STORED[table]).option("basePath", base)
        return reader.parquet(*(f"{base}/{_folder(table, name)}" for name in names))

    # -- writing -----------------------------------------------------------------------------------------------

    @contextmanager
    def pending(self, deltas: bool = False) -> Iterator[Pending]:
        """A commit of this store. What is merged into it becomes valid as a whole when it is published, or not at all.

        Deltas are merged into the partitions first, unless the commit is to append (or merge) `deltas` itself.
        """
        if deltas:
            self.recover()
        else:
            self.compact()
        self._fix_layout()
        found = Pending(self)
        try:
            yield found
        finally:
            found.commit.discard()

    def merge_bars(self, changes: DataFrame, names: list[str] | None = None) -> None:
        self.merge_all({"bars": changes}, {"bars": names})

    def merge_ticks(self, changes: DataFrame, names: list[str] | None = None) -> None:
        self.merge_all({"ticks": changes}, {"ticks": names})

    def merge_all(self, changes: dict[str, DataFrame], names: dict[str, list[str] | None] | None = None) -> None:
        """Replace or add the changed rows of the tables by one commit. Each frame holds a key at most once and should be
        staged, as it is read more than once here; `names` are its partitions, where the caller has them."""
        with self.pending() as pending:
            for table, rows in changes.items():
                pending.merge(table, rows, (names or {}).get(table))
            pending.publish()

    def append_all(self, changes: dict[str, DataFrame]) -> None:
        """Keep the changed rows of the tables as deltas, by one commit. Each frame holds a key at most once."""
        with self.pending(deltas=True) as pending:
            for table, rows in changes.items():
                pending.append(table, rows)
            pending.publish()

    def compact(self) -> None:
        """Merge all deltas into the partitions by one commit; rows stay as they are read. Does nothing where there are none."""
        self.recover()
        waiting = {table: numbers for table in PARTS if (numbers := self.batches(table))}
        if not waiting:
            return
        with self.workspace() as stage, self.pending(deltas=True) as pending:
            for table, numbers in waiting.items():
                pending.merge(table, stage(_latest(table, self._deltas(table)), "deltas"))
                pending.commit.gone[_delta(table)] = [f"{BATCH}={number}" for number in numbers]
            pending.publish()

    def recover(self) -> None:
        """Complete a commit that was left half done, if there is one."""
        commit.complete(self.spark, self.root)

    def overwrite(self, table: str, rows: DataFrame, names: list[str] | None = None) -> None:
        """Replace the partitions that `rows`, a staged frame, falls into (and `names`); the other ones stay as they are."""
        with self.pending() as pending:
            pending.replace(table, rows, names if names is not None else self.partitions(table, rows))
            pending.publish()

    def _with_period(self, table: str, rows: DataFrame) -> DataFrame:
        if table == "ticks":
            return rows.withColumn("date", self._tick_period_start(F.col("timestamp")))
        return rows.withColumn(
            "period", F.when(F.col("timeframe").isin(*YEARLY), F.year("timestamp")).otherwise(F.lit(0))
        )

    def _tick_period_start(self, moment):
        day, unit = moment.cast("date"), TICK_PERIODS[self.tick_period]
        return F.trunc(day, unit) if unit else day

    # -- staged results ----------------------------------------------------------------------------------------

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, self.staging, label)

    @contextmanager
    def workspace(self) -> Iterator[Workspace]:
        """A stage function whose files are removed when the block ends; results read from them must not leave it."""
        self.recover()
        folder = f"{self.staging}/work-{uuid.uuid4().hex}"
        try:
            yield Workspace(folder)
        finally:
            hadoop.remove(self.spark, folder)


class Pending:
    """The tables as they will be once `publish` is called; until then nobody else sees the changes."""

    def __init__(self, store: Store):
        self.store = store
        self.commit = commit.Commit(store.spark, store.root, PARTS)
        self.touched: dict[str, list[str]] = {}
        self._folded: dict[str, DataFrame] = {}

    def merge(self, table: str, changes: DataFrame, names: list[str] | None = None) -> None:
        """Replace or add the changed rows. The partitions they touch are read once, and written anew with all their rows."""
        store = self.store
        names = store.partitions(table, changes) if names is None else names
        changes = store._with_period(table, changes.select(*COLUMNS[table]))
        self._write(table, _over(table, store._in_partitions(table, names), changes), names)

    def append(self, table: str, changes: DataFrame) -> None:
        """Keep the changed rows as one delta: no partition is read or written."""
        number = max(self.store.batches(table), default=0) + 1
        rows = self.store._with_period(table, changes.select(*COLUMNS[table])).select(*STORED[table].names)
        self.commit.add(_delta(table), f"{BATCH}={number}", rows)

    def replace(self, table: str, rows: DataFrame, names: list[str]) -> None:
        """Rows in place of all that the partitions `names` hold; partitions that get none will be gone."""
        self._write(table, self.store._with_period(table, rows.select(*COLUMNS[table])), names)

    def replace_all(self, table: str, rows: DataFrame) -> None:
        held = hadoop.matching(self.store.spark, f"{self.store.root}/{table}" + "/*=*" * len(PARTS[table]))
        depth = len(PARTS[table])
        names = ["/".join(level.split("=", 1)[1] for level in path.split("/")[-depth:]) for path in held]
        self.replace(table, rows, names)

    def mark(self, name: str, text: str) -> None:
        """A text file of the store that is written with the commit."""
        self.commit.marks[name] = text

    def _write(self, table: str, rows: DataFrame, names: list[str]) -> None:
        self.commit.write(table, rows.select(*STORED[table].names), [_folder(table, name) for name in names])
        self.touched[table] = sorted({*names, *self.names(table)})

    def names(self, table: str) -> list[str]:
        """The partitions that this commit has written."""
        return [_name(folder) for folder in self.commit.names.get(table, ())]

    def rows(self, table: str, names: list[str]) -> DataFrame:
        """The rows of these partitions as they will be: those that this commit has written, and the other ones as stored."""
        written = sorted(set(names) & set(self.names(table)))
        others = sorted(set(names) - set(self.touched.get(table, ())))
        parts = [self.store._read(table, self.commit.path(table), written)] if written else []
        if others or not parts:
            parts.append(self.store._in_partitions(table, others))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def partials(self, table: str) -> DataFrame:
        """The partials of the partitions that this commit has written, from a scan of times (and sources) alone."""
        if table not in self._folded:
            names = self.names(table)
            found = self.store._read(table, self.commit.path(table), names) if names else empty(self.store.spark, STORED[table])
            self._folded[table] = stage(_fold(table, found), self.commit.folder, "partials")
        return self._folded[table]

    def former_partials(self, table: str) -> DataFrame:
        """The partials of the same partitions as they are stored."""
        return self._only_touched(table, self.store.merged_partials(table), "left_semi")

    def _only_touched(self, table: str, partials: DataFrame, how: str) -> DataFrame:
        """Partitions of this commit or (left_anti) all others; their names are as many as its folders."""
        schema = T.StructType([STORED[table][c] for c in PARTS[table]])
        texts = [tuple(name.split("/")) for name in self.touched.get(table, ())]
        frame = self.store.spark.createDataFrame(texts, ", ".join(f"{c} string" for c in PARTS[table]))
        return partials.join(frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)), PARTS[table], how)

    def write_partials(self, table: str) -> None:
        """The partials of the whole table as they will be."""
        others = self._only_touched(table, self.store.merged_partials(table), "left_anti")
        self.commit.write_whole(_partials(table), others.unionByName(self.partials(table)))

    def publish(self, *steps: Callable[[], object]) -> list:
        """Makes the commit valid; `steps` read it as it will be, and run while the partials are written."""
        found = together(*steps, *(lambda table=table: self.write_partials(table) for table in self.touched)) if self.touched or steps else []
        self.commit.publish()
        return found[: len(steps)]


def _partials(table: str) -> str:
    return f"_partials/{table}"


def _delta(table: str) -> str:
    return f"_deltas/{table}"


def _latest(table: str, changes: DataFrame) -> DataFrame:
    """Of the rows of one key in several deltas that of the last one."""
    on = _on(table)
    last = F.max(F.struct(BATCH, *(c for c in STORED[table].names if c not in on))).alias("last")
    return changes.groupBy(*on).agg(last).select(*on, "last.*").drop(BATCH)


def _overlay(table: str, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of partitions with deltas laid over them. Only the deltas are grouped; the partitions are not, so that they need
    no shuffle as long as the keys of the deltas are few enough for the optimizer to broadcast."""
    return _over(table, rows, _latest(table, changes))


def _over(table: str, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """`changes` and the rows whose keys they lack."""
    on = _on(table)
    return changes.select(*STORED[table].names).unionByName(rows.join(changes.select(*on), on, "left_anti"))


def _on(table: str) -> list[str]:
    return list(dict.fromkeys([*PARTS[table], *KEYS[table]]))


def _fold(table: str, rows: DataFrame) -> DataFrame:
    found = rows.groupBy(*PARTIAL_BY[table]).agg(
        F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    return found.select(*PARTIALS[table].names)


def _folder(table: str, name: str) -> str:
    return "/".join(f"{part}={value}" for part, value in zip(PARTS[table], name.split("/"), strict=True))


def _name(folder: str) -> str:
    return "/".join(level.split("=", 1)[1] for level in folder.split("/"))


def _between(rows: DataFrame, first, last) -> DataFrame:
    return rows.where((F.col("timestamp") >= first) & (F.col("timestamp") <= last))
