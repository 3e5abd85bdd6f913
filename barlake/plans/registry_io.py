"""Operators that read files, write a store or run a stream, as queries over the given tables.

Each writes what it needs from the tables into a fresh folder under the shared working folder and gives back what it
finds there afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.timeframe import LADDER, tick_targets
from barlake.operators import ladder, profile, quality, query
from barlake.plans import ingest, pages, views
from barlake.plans import repair as repair_plans
from barlake.plans.registry import AFTER, ALL_BARS, BAR_COVERAGE, IN_RANGE, LAKE_SUMMARY, RANGE, TICK_COVERAGE, page_sql, register
from barlake.plans.views import MINUTES, TICKS, with_
from barlake.schema import BARS as BAR_SCHEMA
from barlake.schema import PRICES
from barlake.schema import TICKS as TICK_SCHEMA
from barlake.session import work_dir
from barlake.sources import files, snapshot
from barlake.sources.store import Store
from barlake.streaming.bars import live_bars, live_ladder
from barlake.streaming.ingest import ingest_bar_stream, ingest_tick_stream, landed_parquet

ROW = "instrument, timeframe, timestamp, open, high, low, close"


def fresh(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/run-{uuid.uuid4().hex}"


def write_named(rows: DataFrame, folder: str, label: str, **options) -> str:
    """CSV files named INSTRUMENT_label_n.csv from rows with an `instrument` column."""
    spark = rows.sparkSession
    rows.write.partitionBy("instrument").options(header=True, **options).csv(f"{folder}/parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = f"{folder}/named"
    system.mkdirs(path(target))
    for part in system.listStatus(path(f"{folder}/parts")):
        if not part.isDirectory():
            continue
        instrument = part.getPath().getName().split("=", 1)[1]
        for n, entry in enumerate(f for f in system.listStatus(part.getPath()) if f.getPath().getName().endswith(".csv")):
            system.rename(entry.getPath(), path(f"{target}/{instrument}_{label}_{n}.csv"))
    return target


def _minutes_text(spark, sf) -> DataFrame:
    return views.minute_bars(spark, sf).drop("timeframe", "source").withColumn("timestamp", F.col("timestamp").cast("string"))


def _read_bars(spark, folder) -> DataFrame:
    rows = quality.accepted(files.read_bar_files(spark, folder).rows)
    return rows.select("instrument", "timeframe", "timestamp", *PRICES)


def _read_ticks(spark, folder) -> DataFrame:
    return quality.accepted(files.read_tick_files(spark, folder).rows).select(*TICK_SCHEMA.names)


MINUTE_ROWS = with_(TICKS, MINUTES) + f"SELECT {ROW} FROM minutes"


@register("files_plain_bars", MINUTE_ROWS)
def _(spark, sf):
    text = _minutes_text(spark, sf).toDF("instrument", " Timestamp", "Open", "HIGH", "low", "Close ")
    return _read_bars(spark, write_named(text.withColumn("TickVol", F.lit(1)), fresh(spark), "M1"))


@register("files_terminal_bars", MINUTE_ROWS)
def _(spark, sf):
    text = _minutes_text(spark, sf).select(
        "instrument",
        F.translate(F.substring("timestamp", 1, 10), "-", ".").alias("<DATE>"),
        F.substring("timestamp", 12, 8).alias("<TIME>"),
        *[F.col(c).alias(f"<{c.upper()}>") for c in PRICES],
        *[F.lit(3).alias(f"<{c}>") for c in ("TICKVOL", "VOL", "SPREAD")],
    )
    return _read_bars(spark, write_named(text, fresh(spark), "m1_202401", sep="\t"))


def _ticks_text(spark, sf) -> DataFrame:
    return views.event_ticks(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))


def _terminal_ticks(text: DataFrame) -> DataFrame:
    return text.select(
        "instrument",
        F.translate(F.substring("timestamp", 1, 10), "-", ".").alias("<DATE>"),
        F.substring("timestamp", 12, 20).alias("<TIME>"),
        F.col("bid").alias("<BID>"),
        F.col("ask").alias("<ASK>"),
        F.col("price").alias("<LAST>"),
        F.col("volume").alias("<VOLUME>"),
    )


@register("files_terminal_ticks", with_(TICKS) + "SELECT * FROM ticks")
def _(spark, sf):
    return _read_ticks(spark, write_named(_terminal_ticks(_ticks_text(spark, sf)), fresh(spark), "TICK", sep="\t"))


def _gmt_ticks(text: DataFrame) -> DataFrame:
    """Day first, milliseconds, no price."""
    stamp = [F.substring("timestamp", p, n) for p, n in ((9, 2), (6, 2), (1, 4), (12, 12))]
    return text.select(
        "instrument",
        F.format_string("%s.%s.%s %s", *stamp).alias("Gmt time"),
        F.col("bid").alias("Bid"),
        F.col("ask").alias("Ask"),
        F.col("volume").alias("Volume"),
    )


@register(
    "files_gmt_ticks",
    with_(TICKS)
    + """SELECT instrument, date_trunc('millisecond', timestamp) AS timestamp, (bid + ask) / 2 AS price, volume, bid, ask
    FROM ticks""",
)
def _(spark, sf):
    return _read_ticks(spark, write_named(_gmt_ticks(_ticks_text(spark, sf)), fresh(spark), "TICK"))


@register("files_plain_ticks", with_(TICKS) + "SELECT instrument, timestamp, price, volume, bid, NULL::DOUBLE AS ask FROM ticks")
def _(spark, sf):
    return _read_ticks(spark, write_named(_ticks_text(spark, sf).drop("ask"), fresh(spark), "tick"))


@register("files_utf16_ticks", with_(TICKS) + "SELECT * FROM ticks")
def _(spark, sf):
    return _read_ticks(spark, write_named(_ticks_text(spark, sf), fresh(spark), "TICK", encoding="UTF-16"))


@register(
    "folder_of_mixed_layouts",
    with_(TICKS)
    + """SELECT instrument, CASE WHEN instrument = 'click' THEN date_trunc('millisecond', timestamp) ELSE timestamp END
      AS timestamp, CASE WHEN instrument = 'click' THEN (bid + ask) / 2 ELSE price END AS price, volume, bid, ask
    FROM ticks""",
)
def _(spark, sf):
    """One folder: day-first quotes for clicks, a terminal export for views, plain text for the others."""
    folder, text = fresh(spark), _ticks_text(spark, sf)
    write_named(_gmt_ticks(text.where("instrument = 'click'")), folder + "/gmt", "TICK_gmt")
    write_named(_terminal_ticks(text.where("instrument = 'view'")), folder + "/terminal", "TICK_terminal", sep="\t")
    write_named(text.where("instrument NOT IN ('click', 'view')"), folder + "/plain", "TICK_plain")
    return _read_ticks(spark, f"{folder}/*/named")


@register(
    "folder_outcomes",
    """SELECT event_type AS instrument, CASE WHEN min(value - 0.02::DOUBLE) <= 0 THEN 'error' ELSE 'ok' END AS status,
      count(*) AS rows_read, count(*) FILTER (WHERE value - 0.02::DOUBLE <= 0) AS bad_prices
    FROM events GROUP BY event_type""",
)
def _(spark, sf):
    """A price that is not positive rejects its file; the other files go on."""
    text = views.table(spark, sf, "events").selectExpr(
        "event_type AS instrument", "CAST(ts AS STRING) AS timestamp", "value - 0.02D AS price"
    )
    store = Store(spark, fresh(spark))
    outcome = ingest.ingest_tick_files(store, write_named(text, fresh(spark), "TICK"), derive=False).files
    # an instrument has a file for each task that wrote some of its rows; one bad file counts
    return outcome.groupBy("instrument").agg(
        F.min("status").alias("status"), F.sum("rows_read").alias("rows_read"), F.sum("bad_prices").alias("bad_prices")
    )


@register(
    "folder_missing_column",
    "SELECT DISTINCT event_type AS instrument, 'error' AS status, 'missing required columns: [''close'']' AS error, 0::BIGINT AS rows_read FROM events",
)
def _(spark, sf):
    """Bar files without one of the columns: each is reported, none stops the batch."""
    folder = write_named(_minutes_text(spark, sf).drop("close"), fresh(spark), "M1")
    outcome = ingest.ingest_bar_files(Store(spark, fresh(spark)), folder, derive=False).files
    return outcome.select("instrument", "status", "error", "rows_read").distinct()


@register("files_column_map", MINUTE_ROWS)
def _(spark, sf):
    """Vendor names of columns, mapped by the caller."""
    text = _minutes_text(spark, sf).toDF("instrument", "When", "First", "Top", "Bottom", "Last")
    names = {"when": "timestamp", "first": "open", "top": "high", "bottom": "low", "last": "close"}
    rows = quality.accepted(files.read_bar_files(spark, write_named(text, fresh(spark), "M1"), column_map=names).rows)
    return rows.select("instrument", "timeframe", "timestamp", *PRICES)


# -- store ----------------------------------------------------------------------------------------------------------


def _two_batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The ticks up to the 19th, and those from the 10th on with a price of one more."""
    ticks = views.event_ticks(spark, sf)
    later = ticks.where("timestamp >= TIMESTAMP_NTZ'2024-01-10 00:00:00'").withColumn("price", F.col("price") + 1)
    return ticks.where("timestamp < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), later


MERGED = """merged AS (SELECT instrument, timestamp, CASE WHEN timestamp >= TIMESTAMP '2024-01-10' THEN price + 1
  ELSE price END AS price, volume, bid, ask FROM ticks)"""
MERGED_LADDER = views.union_all([views.fold_ticks(tf, "merged") for tf in tick_targets()])


def _loaded(spark, sf) -> Store:
    store = Store(spark, fresh(spark))
    for batch in _two_batches(spark, sf):
        ingest.ingest_ticks(store, batch)
    return store


@register("store_bars_after_ticks", with_(TICKS, MERGED) + MERGED_LADDER)
def _(spark, sf):
    return _loaded(spark, sf).bars()


@register("store_ticks_after_ticks", with_(TICKS, MERGED) + "SELECT * FROM merged")
def _(spark, sf):
    return _loaded(spark, sf).ticks()


@register(
    "store_range_of_series",
    with_(TICKS, MERGED) + f"SELECT * FROM ({MERGED_LADDER}) WHERE instrument = 'view' AND timeframe = 'H1' AND {IN_RANGE}",
)
def _(spark, sf):
    stored = _loaded(spark, sf).bars(RANGE["start"], RANGE["end"])
    return query.select_range(stored, instrument="view", timeframe="H1")


@register(
    "ingest_report",
    with_(TICKS)
    + """SELECT instrument, count(*) AS rows_in_file, count(*) AS rows_in_batch,
      count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-20') AS rows_new,
      count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-20') AS rows_matched,
      min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
    FROM ticks WHERE timestamp >= TIMESTAMP '2024-01-10' GROUP BY instrument""",
)
def _(spark, sf):
    store = Store(spark, fresh(spark))
    first, second = _two_batches(spark, sf)
    ingest.ingest_ticks(store, first, derive=False)
    return ingest.ingest_ticks(store, second.unionByName(second), derive=False).series


# Hourly bars of weekdays are original; the minutes that arrive later derive the rest of the ladder around them.
HELD = f"held AS (SELECT * FROM ({views.fold_ticks('H1', label='raw')}) WHERE isodow(timestamp) <= 5)"


@register(
    "store_bars_after_bars",
    with_(TICKS, MINUTES, HELD)
    + f"""SELECT * FROM minutes UNION ALL SELECT * FROM held UNION ALL
    SELECT d.* FROM ({views.union_all([views.fold_bars(tf) for tf in LADDER])}) d WHERE NOT EXISTS (
      SELECT 1 FROM held e WHERE e.instrument = d.instrument AND e.timeframe = d.timeframe AND e.timestamp = d.timestamp)""",
)
def _(spark, sf):
    store = Store(spark, fresh(spark))
    hours = ladder.ticks_to_bars(views.event_ticks(spark, sf), "H1").where(F.weekday("timestamp") < 5)
    ingest.ingest_bars(store, hours, derive=False)
    minutes = views.minute_bars(spark, sf)
    ingest.ingest_bars(store, minutes.where("timestamp >= TIMESTAMP_NTZ'2024-01-12 10:30:00'"))
    ingest.ingest_bars(store, minutes.where("timestamp < TIMESTAMP_NTZ'2024-01-18 05:00:00'"))
    return store.bars()


@register(
    "derive_job",
    with_(TICKS)
    + f"""SELECT instrument, timeframe, count(*) AS bars
    FROM ({views.union_all([views.fold_ticks(tf) for tf in tick_targets()])}) GROUP BY instrument, timeframe""",
)
def _(spark, sf):
    """Ticks stored without a ladder, which is then derived over the whole window."""
    store = Store(spark, fresh(spark))
    ingest.ingest_ticks(store, views.event_ticks(spark, sf), derive=False)
    return ingest.derive_stored_ticks(store, "2024-01-01 05:00:00", "2024-01-31")


@register(
    "ingest_report_derived",
    with_(TICKS, "late AS (SELECT * FROM ticks WHERE day(timestamp) IN (3, 17))")
    + f"""SELECT instrument, timeframe, count(*) AS bars
    FROM ({views.union_all([views.fold_ticks(tf, "late") for tf in tick_targets()])}) GROUP BY instrument, timeframe""",
)
def _(spark, sf):
    """Two days arrive after the others: the report counts the derived bars of these days only."""
    store, ticks = Store(spark, fresh(spark)), views.event_ticks(spark, sf)
    late = F.dayofmonth("timestamp").isin(3, 17)
    ingest.ingest_ticks(store, ticks.where(~late))
    return ingest.ingest_ticks(store, ticks.where(late), scope="days").derived


@register(
    "derive_job_from_bars",
    with_(TICKS, MINUTES)
    + f"""SELECT instrument, timeframe, count(*) AS bars
    FROM ({views.union_all([views.fold_bars(tf) for tf in LADDER])}) GROUP BY instrument, timeframe""",
)
def _(spark, sf):
    """Minute bars stored without a ladder, which is then derived over the whole window."""
    store = Store(spark, fresh(spark))
    ingest.ingest_bars(store, views.minute_bars(spark, sf), derive=False)
    return ingest.derive_stored_bars(store, "M1", "2024-01-01 05:00:00", "2024-01-31")


@register(
    "refresh_job",
    with_(TICKS, MINUTES, "recent AS (SELECT * FROM minutes WHERE timestamp >= TIMESTAMP '2024-01-21 12:00:00' "
          "AND instrument <> 'click')")
    + f"""SELECT * FROM recent UNION ALL ({views.union_all([views.fold_bars(tf, "recent") for tf in LADDER])})
    UNION ALL {views.fold_ticks('D1', "(SELECT * FROM ticks WHERE instrument <> 'click' AND timestamp < TIMESTAMP '2024-01-05')", 'raw')}""",
)
def _(spark, sf):
    """Ten days of landed minutes for the instruments that the store knows, which are all but one."""
    store = Store(spark, fresh(spark))
    early = views.event_ticks(spark, sf).where("instrument <> 'click' AND timestamp < TIMESTAMP_NTZ'2024-01-05 00:00:00'")
    ingest.ingest_bars(store, ladder.ticks_to_bars(early, "D1"), derive=False)
    landed = write_named(_minutes_text(spark, sf), fresh(spark), "M1")
    ingest.refresh(store, landed, days=10, now="2024-01-31 12:00:00")
    return store.bars()


STORED = with_(TICKS, MERGED, f"bars AS ({MERGED_LADDER})")


@register("store_coverage", STORED + f"{BAR_COVERAGE} UNION ALL {TICK_COVERAGE}")
def _(spark, sf):
    """What the store's partials say after two batches, without a scan of its prices."""
    store = _loaded(spark, sf)
    found = profile.coverage_catalog(store.partials("bars"), store.partials("ticks"))
    return found.withColumn("sources", F.array_join("sources", ","))


@register("store_summary", STORED + LAKE_SUMMARY)
def _(spark, sf):
    store = _loaded(spark, sf)
    found = profile.lake_summary(store.partials("bars"), store.partials("ticks"))
    return found.withColumn("timeframes", F.array_join("timeframes", ","))


@register(
    "store_page_of_bars",
    with_(
        TICKS,
        MERGED,
        f"""found AS (SELECT {ROW} FROM ({MERGED_LADDER}) WHERE (timestamp, instrument, timeframe)
          > (TIMESTAMP '2024-01-10', 'error', 'H4') AND timestamp <= TIMESTAMP '2024-01-21 12:00:00')""",
    )
    + page_sql("timestamp, instrument, timeframe", 500),
)
def _(spark, sf):
    return pages.page_bars(_loaded(spark, sf), 500, after=AFTER, **RANGE)


@register(
    "store_page_of_ticks",
    with_(
        TICKS,
        MERGED,
        """found AS (SELECT timestamp, price, volume, bid, ask FROM merged
          WHERE instrument = 'click' AND timestamp > TIMESTAMP '2024-01-03 04:05:06')""",
    )
    + page_sql("timestamp", 300),
)
def _(spark, sf):
    """Ticks are stored by day here, so the page opens a few of them."""
    store = Store(spark, fresh(spark), tick_period="day")
    for batch in _two_batches(spark, sf):
        ingest.ingest_ticks(store, batch, derive=False)
    return pages.page_ticks(store, "click", 300, after=dict(timestamp="2024-01-03 04:05:06"))


@register(
    "refresh_report",
    with_(TICKS, MINUTES)
    + """SELECT instrument, count(*) FILTER (WHERE taken) AS rows, min(timestamp) FILTER (WHERE taken) AS first_timestamp,
      max(timestamp) FILTER (WHERE taken) AS last_timestamp, instrument = 'signup' AS failed
    FROM (SELECT *, timestamp >= TIMESTAMP '2024-01-21 12:00:00' AND instrument <> 'signup' AS taken FROM minutes)
    WHERE instrument <> 'click' GROUP BY instrument""",
)
def _(spark, sf):
    """The outcome for each instrument in scope; the files of one of them have times that are none."""
    store = Store(spark, fresh(spark))
    early = views.event_ticks(spark, sf).where("instrument <> 'click' AND timestamp < TIMESTAMP_NTZ'2024-01-05 00:00:00'")
    ingest.ingest_bars(store, ladder.ticks_to_bars(early, "D1"), derive=False)
    text = _minutes_text(spark, sf)
    text = text.withColumn("timestamp", F.when(F.col("instrument") == "signup", "no time").otherwise(F.col("timestamp")))
    found = ingest.refresh(store, write_named(text, fresh(spark), "M1"), days=10, now="2024-01-31 12:00:00").instruments
    return found.select("instrument", "rows", "first_timestamp", "last_timestamp", F.col("error").isNotNull().alias("failed"))


# -- snapshots and downloads ----------------------------------------------------------------------------------------


@register(
    "snapshot_round_trip",
    with_(TICKS, MERGED)
    + f"""SELECT instrument, timeframe, timestamp, open, high, low, close, source FROM ({MERGED_LADDER})
    UNION ALL SELECT instrument, 'TICK', timestamp, price, volume, bid, ask, 'raw' FROM merged""",
)
def _(spark, sf):
    """Exported from one store, restored twice into another that already holds the older half."""
    folder, source, target = fresh(spark), _loaded(spark, sf), Store(spark, fresh(spark))
    ingest.ingest_ticks(target, _two_batches(spark, sf)[0])
    snapshot.export_snapshot(source, folder)
    for _ in range(2):
        snapshot.restore_snapshot(target, folder)
    ticks = target.ticks().selectExpr(
        "instrument", "'TICK' AS timeframe", "timestamp", "price AS open", "volume AS high", "bid AS low",
        "ask AS close", "'raw' AS source",
    )
    return target.bars().unionByName(ticks)


@register(
    "csv_download",
    ALL_BARS + f"SELECT {ROW} FROM bars WHERE instrument = 'view' AND timeframe = 'M5' AND {IN_RANGE}",
)
def _(spark, sf):
    folder = fresh(spark)
    bars = views.all_bars(spark, sf)
    snapshot.write_csv(query.query_bars(bars, ordered=False, instrument="view", timeframe="M5", **RANGE), folder)
    schema = "instrument string, timeframe string, timestamp timestamp_ntz, open double, high double, low double, close double"
    return spark.read.schema(schema).option("header", True).csv(folder)


@register("csv_download_ticks", with_(TICKS) + f"SELECT * EXCLUDE (instrument) FROM ticks WHERE instrument = 'view' AND {IN_RANGE}")
def _(spark, sf):
    folder = fresh(spark)
    snapshot.write_csv(query.query_ticks(views.event_ticks(spark, sf), "view", ordered=False, **RANGE), folder)
    schema = "timestamp timestamp_ntz, price double, volume double, bid double, ask double"
    return spark.read.schema(schema).option("header", True).csv(folder)


@register(
    "snapshot_manifest",
    with_(TICKS, MERGED)
    + f"""SELECT 'ohlc' AS part, count(*) AS row_count, 'instrument,timeframe' AS partition_by FROM ({MERGED_LADDER})
    UNION ALL SELECT 'ticks', count(*), 'instrument' FROM merged""",
)
def _(spark, sf):
    """What the manifest of an export says, read back from its file."""
    folder, store = fresh(spark), _loaded(spark, sf)
    snapshot.export_snapshot(store, folder)
    manifest = snapshot.read_manifest(store, folder)
    rows = [(part, manifest[part]["row_count"], ",".join(manifest[part]["partition_by"])) for part in ("ohlc", "ticks")]
    return spark.createDataFrame(rows, "part string, row_count bigint, partition_by string")


# -- repairs of a store ---------------------------------------------------------------------------------------------


@register(
    "store_shifted",
    with_(TICKS, MINUTES)
    + """SELECT instrument, timeframe, timestamp - INTERVAL 1 HOUR AS timestamp, open, high, low, close, source FROM minutes
    UNION ALL SELECT instrument, 'TICK', timestamp - INTERVAL 1 HOUR, price, volume, bid, ask, 'raw' FROM ticks""",
)
def _(spark, sf):
    """January in Berlin is one hour ahead."""
    store = Store(spark, fresh(spark))
    ingest.ingest_bars(store, views.minute_bars(spark, sf), derive=False)
    ingest.ingest_ticks(store, views.event_ticks(spark, sf), derive=False)
    repair_plans.shift_store(store, "Europe/Berlin")
    ticks = store.ticks().selectExpr(
        "instrument", "'TICK' AS timeframe", "timestamp", "price AS open", "volume AS high", "bid AS low",
        "ask AS close", "'raw' AS source",
    )
    return store.bars().unionByName(ticks)


@register(
    "store_collapsed",
    with_(TICKS, MINUTES)
    + f"""SELECT * FROM minutes UNION ALL SELECT * FROM ({views.fold_ticks('D1', label='raw')})""",
)
def _(spark, sf):
    """Daily bars are there twice, at midnight and two hours later; the ones at midnight stay, minutes are left alone."""
    store = Store(spark, fresh(spark))
    days = ladder.ticks_to_bars(views.event_ticks(spark, sf), "D1").withColumn("source", F.lit("raw"))
    late = days.withColumn("timestamp", F.expr("timestamp + INTERVAL 2 HOURS")).withColumn("open", F.col("open") + 1)
    store.merge_bars(days.unionByName(late).unionByName(views.minute_bars(spark, sf)))
    repair_plans.collapse_store(store)
    return store.bars()


# -- streams --------------------------------------------------------------------------------------------------------


def _landed(spark, sf) -> str:
    """Ticks as Parquet files in the wrong order of time: the last third first."""
    folder, ticks = fresh(spark), views.event_ticks(spark, sf)
    cuts = ["2024-01-20 00:00:00", "2024-01-10 12:00:00", "2023-01-01 00:00:00"]
    until = None
    for start in cuts:
        part = ticks.where(f"timestamp >= TIMESTAMP_NTZ'{start}'")
        if until:
            part = part.where(f"timestamp < TIMESTAMP_NTZ'{until}'")
        part.write.mode("append").parquet(folder)
        until = start
    return folder


@register("stream_into_store", with_(TICKS) + views.union_all([views.fold_ticks(tf) for tf in tick_targets()]))
def _(spark, sf):
    store = Store(spark, fresh(spark))
    stream = landed_parquet(spark, _landed(spark, sf), TICK_SCHEMA, max_files=2)
    ingest_tick_stream(store, stream, fresh(spark)).awaitTermination()
    return store.bars()


def _with_deltas(spark, sf) -> Store:
    """The ticks from the tenth on, with their ladder, and over them the corrected or late ones of three days as deltas."""
    store, ticks = Store(spark, fresh(spark)), views.event_ticks(spark, sf)
    ingest.ingest_ticks(store, ticks.where("timestamp >= TIMESTAMP_NTZ'2024-01-10 00:00:00'"))
    late = ticks.where(F.dayofmonth("timestamp").isin(3, 11)).withColumn("price", F.col("price") + 1)
    ingest.ingest_ticks(store, late.unionByName(ticks.where("day(timestamp) = 4")), deltas=True)
    ingest.ingest_ticks(store, ticks.where("day(timestamp) = 3"), deltas=True)
    return store


WITH_DELTAS = """overlaid AS (
  SELECT instrument, timestamp, CASE WHEN day(timestamp) = 11 THEN price + 1 ELSE price END AS price, volume, bid, ask FROM ticks
  WHERE timestamp >= TIMESTAMP '2024-01-10' OR day(timestamp) IN (3, 4))"""
OVERLAID = with_(TICKS, WITH_DELTAS) + views.union_all([views.fold_ticks(tf, "overlaid") for tf in tick_targets()])


@register("store_with_deltas", OVERLAID)
def _(spark, sf):
    return _with_deltas(spark, sf).bars()


@register("store_compacted", OVERLAID)
def _(spark, sf):
    store = _with_deltas(spark, sf)
    store.compact()
    return store.bars()


@register(
    "store_coverage_with_deltas",
    with_(TICKS, WITH_DELTAS)
    + """SELECT instrument, count(*) AS n, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
    FROM overlaid GROUP BY instrument""",
)
def _(spark, sf):
    """What the partials say while deltas lie over the partitions."""
    parts = _with_deltas(spark, sf).partials("ticks").groupBy("instrument")
    return parts.agg(F.sum("rows").alias("n"), F.min("first").alias("first_timestamp"), F.max("last").alias("last_timestamp"))


@register(
    "stream_live_bars",
    with_(TICKS)
    + f"""SELECT * FROM ({views.fold_ticks("M15")})
    WHERE timestamp + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    """Bars appended to files once the watermark has passed them; those after the last watermark are still open."""
    return _appended(spark, sf, lambda ticks: live_bars(ticks, "M15"))


@register(
    "stream_live_ladder",
    with_(TICKS)
    + f"""SELECT * FROM ({views.union_all([views.fold_ticks(tf) for tf in tick_targets()])})
    WHERE date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    """All levels of the days that the watermark has passed, from one state."""
    return _appended(spark, sf, live_ladder)


def _appended(spark, sf, bars) -> DataFrame:
    landed, folder = _landed(spark, sf), fresh(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        found = bars(landed_parquet(spark, landed, TICK_SCHEMA))
        writer = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", fresh(spark))
        writer.trigger(availableNow=True).start(folder).awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.parquet(folder)


@register(
    "stream_bars_into_store",
    with_(TICKS, MINUTES)
    + f"SELECT * FROM minutes UNION ALL ({views.union_all([views.fold_bars(tf) for tf in LADDER])})",
)
def _(spark, sf):
    folder, store = fresh(spark), Store(spark, fresh(spark))
    views.minute_bars(spark, sf).write.parquet(folder)
    ingest_bar_stream(store, landed_parquet(spark, folder, BAR_SCHEMA), fresh(spark)).awaitTermination()
    return store.bars()
