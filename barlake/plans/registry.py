"""Every operator as a query over the given tables, each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.timeframe import (
    LADDER,
    SECONDS,
    display_rank,
    tick_targets,
    valid_instrument,
    valid_timeframe,
    with_bucket_start,
)
from barlake.functions.timestamps import parse_utc
from barlake.operators import dedupe, gaps, ladder, merge, profile, quality, query, repair
from barlake.plans import ingest, views
from barlake.plans.views import BARS, LINES, MINUTES, OFFSET, ORDER_ROWS, TICKS, with_
from barlake.schema import BAR_KEY, PRICES, RAW, TICK_KEY, as_ticks
from barlake.sources.snapshot import restored_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


ALL_BARS = with_(TICKS, MINUTES, BARS)
ALL_MINUTES = with_(TICKS, MINUTES)

# -- bars from ticks and bars ---------------------------------------------------------------------------------------

for _tf in tick_targets():
    register(f"ticks_to_{_tf.lower()}", with_(TICKS) + views.fold_ticks(_tf))(
        lambda spark, sf, tf=_tf: ladder.ticks_to_bars(views.event_ticks(spark, sf), tf)
    )

for _tf in LADDER:
    register(f"bars_m1_to_{_tf.lower()}", ALL_MINUTES + views.fold_bars(_tf))(
        lambda spark, sf, tf=_tf: ladder.bars_to_bars(views.minute_bars(spark, sf), "M1", tf)
    )


@register("bars_h4_to_d1", with_(TICKS, f"four AS ({views.fold_ticks('H4')})") + views.fold_bars("D1", "four"))
def _(spark, sf):
    return ladder.bars_to_bars(ladder.ticks_to_bars(views.event_ticks(spark, sf), "H4"), "H4", "D1")


@register("ladder_from_ticks", with_(TICKS) + views.union_all([views.fold_ticks(tf) for tf in tick_targets()]))
def _(spark, sf):
    return ladder.ladder_from_ticks(views.event_ticks(spark, sf))


@register("ladder_from_bars", ALL_MINUTES + views.union_all([views.fold_bars(tf) for tf in LADDER]))
def _(spark, sf):
    return ladder.ladder_from_bars(views.minute_bars(spark, sf), "M1")


@register("ladder_from_line_ticks", with_(LINES) + views.union_all([views.fold_ticks(t, "lines") for t in tick_targets()]))
def _(spark, sf):
    return ladder.ladder_from_ticks(dedupe.latest_ticks(views.line_ticks(spark, sf)))


@register(
    "ladder_mixed_sources",
    # M15 bars start another ladder; where both give a bar, the one from M1 counts.
    with_(TICKS, MINUTES, f"fifteen AS ({views.fold_ticks('M15')})")
    + views.union_all([views.fold_bars(tf) for tf in LADDER]),
)
def _(spark, sf):
    fifteen = ladder.ticks_to_bars(views.event_ticks(spark, sf), "M15")
    doubled = fifteen.withColumns({c: F.col(c) * 2 for c in PRICES})
    return ladder.ladder_mixed(views.minute_bars(spark, sf).unionByName(doubled))


WINDOW = ("2024-01-10 13:45:00", "2024-01-20 00:00:00")
PADDED = "timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-21'"


@register(
    "ladder_padded_window",
    with_(TICKS, MINUTES, f"inside AS (SELECT * FROM minutes WHERE {PADDED})")
    + views.union_all([views.fold_bars(tf, "inside") for tf in LADDER]),
)
def _(spark, sf):
    return ladder.ladder_from_bars(ladder.in_window(views.minute_bars(spark, sf), *ladder.pad_window(*WINDOW)), "M1")


WEEKDAY_RAW = f"""held AS (SELECT * FROM ({views.fold_ticks('H1', label='raw')}) WHERE isodow(timestamp) <= 5)"""


@register(
    "ladder_raw_protected",
    with_(TICKS, WEEKDAY_RAW)
    + f"""SELECT d.* FROM ({views.union_all([views.fold_ticks(tf) for tf in tick_targets()])}) d
    WHERE NOT EXISTS (SELECT 1 FROM held e WHERE e.instrument = d.instrument AND e.timeframe = d.timeframe
                      AND e.timestamp = d.timestamp AND e.source = 'raw')""",
)
def _(spark, sf):
    """Original hourly bars exist from Monday to Friday."""
    ticks = views.event_ticks(spark, sf)
    held = ladder.ticks_to_bars(ticks, "H1").withColumn("source", F.lit(RAW)).where(F.weekday("timestamp") < 5)
    return ladder.protect_raw(ladder.ladder_from_ticks(ticks), held)


@register(
    "derived_counts",
    ALL_BARS
    + f"""SELECT instrument, timeframe, count(*) AS bars FROM bars
    WHERE source = 'derived' AND {PADDED} GROUP BY ALL""",
)
def _(spark, sf):
    return ladder.derived_counts(views.all_bars(spark, sf), *WINDOW)


# -- coverage, counts, lists ----------------------------------------------------------------------------------------


def _text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(name, ","))


BAR_COVERAGE = """SELECT instrument, timeframe, min(timestamp) AS min_date, max(timestamp) AS max_date,
  count(*) AS record_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
  FROM bars GROUP BY instrument, timeframe"""
TICK_COVERAGE = """SELECT instrument, 'TICK' AS timeframe, min(timestamp) AS min_date, max(timestamp) AS max_date,
  count(*) AS record_count, 'raw' AS sources FROM ticks GROUP BY instrument"""


@register("bar_coverage", ALL_BARS + BAR_COVERAGE)
def _(spark, sf):
    return _text(profile.bar_coverage(views.all_bars(spark, sf)), "sources")


@register("tick_coverage", with_(TICKS) + TICK_COVERAGE)
def _(spark, sf):
    return _text(profile.tick_coverage(views.event_ticks(spark, sf)), "sources")


@register("coverage_catalog", ALL_BARS + f"{BAR_COVERAGE} UNION ALL {TICK_COVERAGE}")
def _(spark, sf):
    return _text(profile.coverage_catalog(views.all_bars(spark, sf), views.event_ticks(spark, sf)), "sources")


@register(
    "bar_stats",
    ALL_BARS
    + """SELECT instrument, timeframe, count(*) AS row_count, min(timestamp) AS min_date, max(timestamp) AS max_date
    FROM bars GROUP BY GROUPING SETS ((instrument), (timeframe), ())""",
)
def _(spark, sf):
    return profile.bar_stats(views.all_bars(spark, sf))


@register(
    "tick_stats",
    with_(TICKS)
    + """SELECT instrument, count(*) AS row_count, min(timestamp) AS min_date, max(timestamp) AS max_date
    FROM ticks GROUP BY ROLLUP (instrument)""",
)
def _(spark, sf):
    return profile.tick_stats(views.event_ticks(spark, sf))


RANK = """CASE timeframe WHEN 'M1' THEN 0 WHEN 'M5' THEN 1 WHEN 'M15' THEN 2 WHEN 'M30' THEN 3 WHEN 'H1' THEN 4
  WHEN 'H4' THEN 5 WHEN 'D1' THEN 6 WHEN 'W1' THEN 7 WHEN 'MN1' THEN 8 WHEN 'TICK' THEN 99 ELSE 50 END"""


LAKE_SUMMARY = f"""SELECT (SELECT count(*) FROM bars) AS bar_rows, (SELECT count(*) FROM ticks) AS tick_rows,
    (SELECT count(*) FROM bars) + (SELECT count(*) FROM ticks) AS total_rows,
    (SELECT count(DISTINCT instrument) FROM (SELECT instrument FROM bars UNION SELECT instrument FROM ticks))
      AS instruments,
    (SELECT string_agg(timeframe, ',' ORDER BY {RANK}) FROM (SELECT DISTINCT timeframe FROM bars
      UNION SELECT 'TICK' FROM ticks)) AS timeframes,
    least((SELECT min(timestamp) FROM bars), (SELECT min(timestamp) FROM ticks)) AS start,
    greatest((SELECT max(timestamp) FROM bars), (SELECT max(timestamp) FROM ticks)) AS end"""


@register("lake_summary", ALL_BARS + LAKE_SUMMARY)
def _(spark, sf):
    return _text(profile.lake_summary(views.all_bars(spark, sf), views.event_ticks(spark, sf)), "timeframes")


@register("bar_instruments", with_(TICKS, MINUTES) + "SELECT DISTINCT instrument FROM minutes ORDER BY 1")
def _(spark, sf):
    return profile.instruments(views.minute_bars(spark, sf))


@register("tick_instruments", with_(LINES) + "SELECT DISTINCT instrument FROM lines ORDER BY 1")
def _(spark, sf):
    return profile.instruments(views.line_ticks(spark, sf))


@register(
    "all_instruments",
    with_(TICKS, MINUTES, LINES) + "SELECT instrument FROM minutes UNION SELECT instrument FROM lines ORDER BY 1",
)
def _(spark, sf):
    return profile.all_instruments(views.minute_bars(spark, sf), views.line_ticks(spark, sf))


@register("timeframes", ALL_BARS + "SELECT DISTINCT timeframe FROM bars UNION SELECT 'TICK' FROM ticks")
def _(spark, sf):
    return profile.timeframes(views.all_bars(spark, sf), views.event_ticks(spark, sf))


@register(
    "timeframes_of_instrument",
    ALL_BARS
    + """SELECT DISTINCT timeframe FROM bars WHERE instrument = 'click'
    UNION SELECT 'TICK' FROM ticks WHERE instrument = 'click'""",
)
def _(spark, sf):
    return profile.timeframes(views.all_bars(spark, sf), views.event_ticks(spark, sf), "click")


@register(
    "timeframe_order",
    with_(TICKS, MINUTES, BARS, OFFSET)
    + f"""SELECT timeframe, CAST({RANK} AS INT) AS rank FROM (
    SELECT timeframe FROM bars UNION SELECT timeframe FROM offset_bars UNION SELECT 'TICK' FROM ticks
    UNION SELECT 'M' || CAST(2 + event_id % 3 AS VARCHAR) FROM events) ORDER BY 2, 1""",
)
def _(spark, sf):
    found = views.all_bars(spark, sf).select("timeframe").union(views.offset_bars(spark, sf).select("timeframe"))
    found = found.union(views.event_ticks(spark, sf).select(F.lit("TICK")))
    found = found.union(views.table(spark, sf, "events").selectExpr("concat('M', 2 + event_id % 3)"))
    ranked = found.distinct().withColumn("rank", display_rank("timeframe"))
    return ranked.orderBy("rank", "timeframe")


# -- gaps -----------------------------------------------------------------------------------------------------------

LENGTH = f"CASE timeframe {' '.join(f"WHEN '{tf}' THEN {s}::BIGINT" for tf, s in SECONDS.items())} END"


def _gaps_sql(where: str = "TRUE", threshold: str = f"2 * ({LENGTH})", columns: str = "") -> str:
    return f"""SELECT instrument, timeframe, gap_start, gap_end,
      CAST(trunc(epoch_us(gap_end) / 1000000 - epoch_us(gap_start) / 1000000) AS BIGINT) AS duration_seconds{columns}
    FROM (SELECT instrument, timeframe, timestamp AS gap_end,
            lag(timestamp) OVER (PARTITION BY instrument, timeframe ORDER BY timestamp) AS gap_start
          FROM bars WHERE {where})
    WHERE gap_start IS NOT NULL AND (epoch_us(gap_end) - epoch_us(gap_start)) > 1000000::BIGINT * ({threshold})"""


@register("gaps", ALL_BARS + _gaps_sql())
def _(spark, sf):
    return gaps.find_gaps(views.all_bars(spark, sf))


@register(
    "gaps_in_range",
    ALL_BARS
    + _gaps_sql("timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp < TIMESTAMP '2024-01-25'", "3600"),
)
def _(spark, sf):
    return gaps.find_gaps(views.all_bars(spark, sf), "2024-01-05 06:00:00", "2024-01-25", 3600)


DESCRIBED = f"""SELECT *, CAST(greatest(0, duration_seconds // ({LENGTH}) - 1) AS BIGINT) AS missing_bars,
  (isodow(gap_start) IN (5, 6) AND duration_seconds BETWEEN 36 * 3600 AND 75 * 3600) AS is_weekend"""


def _closed_weekends(spark, sf):
    """Bars without those from Saturday 00:00 to Sunday 22:00, so that weekend gaps occur."""
    bars = views.all_bars(spark, sf)
    closed = (F.weekday("timestamp") == 5) | ((F.weekday("timestamp") == 6) & (F.expr("hour(timestamp)") < 22))
    return bars.where(~closed)


@register(
    "gap_attributes",
    ALL_BARS
    + f"{DESCRIBED} FROM ("
    + _gaps_sql("NOT (isodow(timestamp) = 6 OR (isodow(timestamp) = 7 AND hour(timestamp) < 22))")
    + ")",
)
def _(spark, sf):
    return gaps.describe_gaps(gaps.find_gaps(_closed_weekends(spark, sf)))


@register(
    "top_gaps",
    ALL_BARS
    + f"""{DESCRIBED} FROM ({_gaps_sql()})
    ORDER BY duration_seconds DESC, gap_start, instrument, timeframe LIMIT 50""",
)
def _(spark, sf):
    return gaps.describe_gaps(gaps.top_gaps(gaps.find_gaps(views.all_bars(spark, sf)), 50))


# -- offset duplicates, snap, one row per key -----------------------------------------------------------------------

SNAP = f"""CASE timeframe {' '.join(f"WHEN '{tf}' THEN {views.bucket(tf)}" for tf in SECONDS)}
  WHEN 'W1' THEN date_trunc('week', timestamp) WHEN 'MN1' THEN date_trunc('month', timestamp) ELSE timestamp END"""


@register(
    "collapse_offset_bars",
    with_(TICKS, OFFSET)
    + f"""SELECT instrument, timeframe, bucket AS timestamp, open, high, low, close, source
    FROM (SELECT *, {SNAP} AS bucket FROM offset_bars)
    QUALIFY row_number() OVER (PARTITION BY instrument, timeframe, bucket ORDER BY timestamp) = 1""",
)
def _(spark, sf):
    return dedupe.collapse_offset_bars(views.offset_bars(spark, sf))


@register(
    "collapse_report",
    with_(TICKS, OFFSET)
    + f"""SELECT instrument, timeframe, count(*) AS rows_before, count(DISTINCT {SNAP}) AS rows_after,
    count(*) - count(DISTINCT {SNAP}) AS rows_removed FROM offset_bars GROUP BY instrument, timeframe""",
)
def _(spark, sf):
    return dedupe.collapse_report(views.offset_bars(spark, sf))


@register(
    "snap_bucket",
    """SELECT event_id, timeframe, CASE timeframe
      WHEN 'M5' THEN time_bucket(INTERVAL '5 minutes', ts) WHEN 'h4' THEN time_bucket(INTERVAL '4 hours', ts)
      WHEN 'D1' THEN time_bucket(INTERVAL '1 day', ts)
      WHEN 'D3' THEN make_timestamp(epoch_us(ts) - epoch_us(ts) % 259200000000)
      WHEN 'M7' THEN make_timestamp(epoch_us(ts) - epoch_us(ts) % 420000000)
      WHEN 'W1' THEN date_trunc('week', ts) WHEN 'MN1' THEN date_trunc('month', ts) ELSE ts END AS bucket
    FROM (SELECT event_id, ts, ['M5', 'h4', 'D1', 'D3', 'M7', 'W1', 'MN1', 'WEIRD9'][1 + event_id % 8] AS timeframe
          FROM events)""",
)
def _(spark, sf):
    names = "array('M5', 'h4', 'D1', 'D3', 'M7', 'W1', 'MN1', 'WEIRD9')"
    rows = views.table(spark, sf, "events").selectExpr(
        "event_id", "ts", f"element_at({names}, CAST(1 + event_id % 8 AS INT)) AS timeframe"
    )
    return with_bucket_start(rows, "bucket", "ts").select("event_id", "timeframe", "bucket")


@register(
    "latest_bar_per_bucket",
    with_(ORDER_ROWS)
    + """SELECT instrument, timeframe, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, open, high, low, close,
      'raw' AS source FROM order_rows
    QUALIFY row_number() OVER (PARTITION BY instrument, timeframe, time_bucket(INTERVAL '1 hour', timestamp)
                               ORDER BY order_rows.timestamp DESC, o_orderkey DESC) = 1""",
)
def _(spark, sf):
    return dedupe.latest_bars(views.order_rows(spark, sf), order=["stamp", "o_orderkey"])


@register(
    "latest_bar_ties",
    with_(ORDER_ROWS)
    + """SELECT instrument, timeframe, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, open, high, low, close,
      'raw' AS source FROM order_rows
    QUALIFY row_number() OVER (PARTITION BY instrument, timeframe, time_bucket(INTERVAL '1 hour', timestamp)
      ORDER BY order_rows.timestamp DESC, open DESC, high DESC, low DESC, close DESC) = 1""",
)
def _(spark, sf):
    """Bars of equal times: the greatest prices count, in whatever order the rows come."""
    return dedupe.latest_bars(views.order_rows(spark, sf).orderBy(F.xxhash64("o_orderkey")))


@register("latest_tick_per_key", with_(LINES) + "SELECT *, NULL::DOUBLE AS bid, NULL::DOUBLE AS ask FROM lines")
def _(spark, sf):
    return dedupe.latest_ticks(views.line_ticks(spark, sf))


# -- upsert ---------------------------------------------------------------------------------------------------------

STORED = f"stored AS (SELECT * FROM ({views.fold_ticks('H1', label='raw')}) WHERE timestamp < TIMESTAMP '2024-01-20')"
ARRIVED = f"""arrived AS (SELECT instrument, timeframe, timestamp, open + 1 AS open, high + 1 AS high, low + 1 AS low,
  close + 1 AS close, 'raw' AS source FROM ({views.fold_ticks('H1', label='raw')})
  WHERE timestamp >= TIMESTAMP '2024-01-10')"""


def _hours(spark, sf):
    hours = ladder.ticks_to_bars(views.event_ticks(spark, sf), "H1").withColumn("source", F.lit(RAW))
    stored = hours.where("timestamp < TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    arrived = hours.where("timestamp >= TIMESTAMP_NTZ'2024-01-10 00:00:00'")
    return stored, arrived.withColumns({c: F.col(c) + 1 for c in PRICES})


@register(
    "upsert_bars",
    with_(TICKS, STORED, ARRIVED)
    + "SELECT * FROM arrived UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM arrived a "
    "WHERE a.instrument = s.instrument AND a.timeframe = s.timeframe AND a.timestamp = s.timestamp)",
)
def _(spark, sf):
    return merge.upsert_bars(*_hours(spark, sf))


@register(
    "upsert_ticks",
    with_(TICKS)
    + """SELECT instrument, timestamp, CASE WHEN timestamp >= TIMESTAMP '2024-01-10' THEN price + 1 ELSE price END
      AS price, CASE WHEN timestamp >= TIMESTAMP '2024-01-10' THEN 0.0::DOUBLE ELSE volume END AS volume,
      CASE WHEN timestamp < TIMESTAMP '2024-01-10' THEN bid END AS bid,
      CASE WHEN timestamp < TIMESTAMP '2024-01-10' THEN ask END AS ask FROM ticks""",
)
def _(spark, sf):
    """The batch brings no volume, bid or ask, so these fall back to their defaults."""
    ticks = views.event_ticks(spark, sf)
    stored = ticks.where("timestamp < TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    arrived = ticks.where("timestamp >= TIMESTAMP_NTZ'2024-01-10 00:00:00'").selectExpr(
        "instrument", "timestamp", "price + 1 AS price"
    )
    return merge.upsert_ticks(stored, dedupe.latest_ticks(arrived))


@register(
    "upsert_counts",
    with_(TICKS, STORED, ARRIVED)
    + """SELECT a.instrument, count(*) AS rows_in_batch, count(*) - count(s.timestamp) AS rows_new,
    count(s.timestamp) AS rows_matched, min(a.timestamp) AS first_timestamp, max(a.timestamp) AS last_timestamp
    FROM arrived a LEFT JOIN stored s ON a.instrument = s.instrument AND a.timeframe = s.timeframe
      AND a.timestamp = s.timestamp GROUP BY a.instrument""",
)
def _(spark, sf):
    stored, arrived = _hours(spark, sf)
    return merge.upsert_counts(stored, arrived, BAR_KEY, ["instrument"])


@register(
    "restore_merge",
    with_(TICKS)
    + """SELECT instrument, timestamp, price, CASE WHEN timestamp < TIMESTAMP '2024-01-15' AND volume < 3 THEN 0.0::DOUBLE
      ELSE volume END AS volume, bid, ask FROM ticks""",
)
def _(spark, sf):
    """An older snapshot of the first half, with missing volumes, restored over the ticks."""
    ticks = views.event_ticks(spark, sf)
    older = ticks.where("timestamp < TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    older = older.withColumn("volume", F.when(F.col("volume") >= 3, F.col("volume")))
    return merge.upsert(ticks, restored_rows(older, "ticks"), TICK_KEY)


@register(
    "refresh_scope",
    with_(TICKS, MINUTES, LINES)
    + """SELECT * FROM minutes WHERE instrument IN (SELECT event_type FROM events WHERE value > 250)""",
)
def _(spark, sf):
    known = views.table(spark, sf, "events").where("value > 250").selectExpr("event_type AS instrument")
    return ingest.refresh_scope(views.minute_bars(spark, sf), known)


# -- cleaning -------------------------------------------------------------------------------------------------------


@register(
    "timestamp_coercion",
    """SELECT event_id, CASE event_id % 11 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 2 HOUR
      WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', ts) + INTERVAL 330 MINUTE
      WHEN 5 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('second', ts) WHEN 7 THEN date_trunc('minute', ts)
      WHEN 8 THEN date_trunc('minute', ts) WHEN 9 THEN date_trunc('minute', ts) END AS timestamp,
      CASE WHEN event_id % 11 = 10 THEN 'invalid timestamp' END AS reason FROM events""",
)
def _(spark, sf):
    """The event times written in eleven ways, the last of which is not a time."""
    text = """CASE event_id % 11 WHEN 0 THEN CAST(ts AS STRING) WHEN 1 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')
      WHEN 2 THEN concat(CAST(ts AS STRING), '+02:00') WHEN 3 THEN replace(substring(CAST(ts AS STRING), 1, 19), '-', '.')
      WHEN 4 THEN concat(substring(CAST(ts AS STRING), 1, 16), '-0530')
      WHEN 5 THEN replace(substring(CAST(ts AS STRING), 1, 10), '-', '') WHEN 6 THEN date_format(ts, 'yyyyMMdd HHmmss')
      WHEN 7 THEN date_format(ts, 'M/d/yyyy h:mm a') WHEN 8 THEN date_format(ts, 'd MMM yyyy HH:mm')
      WHEN 9 THEN concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HHmm'), 'Z') ELSE event_type END AS text"""
    rows = views.table(spark, sf, "events").selectExpr("event_id", text)
    parsed = parse_utc(rows, "text").withColumnRenamed("text", "timestamp")
    return parsed.withColumn("reason", F.when(F.col("timestamp").isNull(), quality.BAD_TIMESTAMP))


@register("zoned_input_overlap", "SELECT event_id, ts + INTERVAL 290 DAY AS timestamp FROM events")
def _(spark, sf):
    """Instants around the hour of November 3 that New York's clocks run twice, read by a session of that zone."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts + INTERVAL 290 DAY)"
    rows = views.table(session, sf, "events").selectExpr("event_id", f"timestamp_micros({micros}) AS timestamp")
    return quality.with_utc(rows)


@register(
    "bar_number_coercion",
    """SELECT l_orderkey, l_partkey, l_shipdate AS timestamp, l_extendedprice AS open, l_extendedprice + 1 AS high,
      l_extendedprice - 1 AS low, l_extendedprice AS close FROM lineitem
    WHERE l_discount <> 0.05::DOUBLE AND l_tax <> 0.02::DOUBLE AND l_quantity <> 7""",
)
def _(spark, sf):
    kept = quality.accepted(quality.judged_bars(views.priced_text(spark, sf)))
    return kept.select("l_orderkey", "l_partkey", "timestamp", *PRICES)


@register(
    "bar_reject_counts",
    """SELECT l_orderkey % 100 AS file, count(*) AS rows_read, 0::BIGINT AS bad_timestamps,
      count(*) FILTER (WHERE l_discount = 0.05::DOUBLE OR l_tax = 0.02::DOUBLE OR l_quantity = 7) AS bad_prices, 0::BIGINT AS bad_rows
    FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    judged = quality.judged_bars(views.priced_text(spark, sf)).withColumn("file", F.expr("l_orderkey % 100"))
    return quality.reject_counts(judged, "file")


@register(
    "mid_price",
    with_(TICKS) + "SELECT instrument, timestamp, volume, bid, ask, (bid + ask) / 2 AS price FROM ticks",
)
def _(spark, sf):
    return quality.with_mid_price(views.event_ticks(spark, sf).drop("price"))


@register(
    "tick_price_rule",
    """SELECT event_type AS instrument, count(*) AS rows_read, 0::BIGINT AS bad_timestamps,
      count(*) FILTER (WHERE value - 5 <= 0 OR event_id % 11 = 0 OR event_id % 13 = 0) AS bad_prices, 0::BIGINT AS bad_rows
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    """Prices that are too low, NaN or missing."""
    price = "CASE WHEN event_id % 11 = 0 THEN double('NaN') WHEN event_id % 13 != 0 THEN value - 5 END AS price"
    rows = views.table(spark, sf, "events").selectExpr("event_type AS instrument", "ts AS timestamp", price)
    return quality.reject_counts(quality.judged_ticks(rows), "instrument")


@register(
    "tick_optional_fields",
    """SELECT event_type AS instrument, ts AS timestamp, value AS price, 0.0::DOUBLE AS volume,
      CASE WHEN event_id % 3 > 0 THEN value - 1 END AS bid, NULL::DOUBLE AS ask FROM events WHERE value > 0""",
)
def _(spark, sf):
    """No volume and no ask; some bids are not numbers."""
    rows = views.table(spark, sf, "events").selectExpr(
        "event_type AS instrument",
        "ts AS timestamp",
        "value AS price",
        "CASE WHEN event_id % 3 > 0 THEN CAST(value - 1 AS STRING) ELSE 'none' END AS bid",
    )
    return as_ticks(quality.accepted(quality.judged_ticks(rows)))


@register("distinct_rows", with_(TICKS) + "SELECT * FROM ticks UNION SELECT * FROM ticks")
def _(spark, sf):
    ticks = views.event_ticks(spark, sf)
    return quality.distinct_rows(ticks.unionByName(ticks))


@register(
    "valid_instruments",
    """SELECT o_orderkey AS id, name, coalesce(regexp_full_match(name, '[A-Za-z0-9_\\-&]{1,50}'), FALSE) AS valid
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'S&P-' || o_custkey
      WHEN 2 THEN repeat('X', o_orderkey % 100) ELSE o_orderpriority || '/..' END AS name FROM orders)""",
)
def _(spark, sf):
    name = """CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN concat('S&P-', o_custkey)
      WHEN 2 THEN repeat('X', CAST(o_orderkey % 100 AS INT)) ELSE concat(o_orderpriority, '/..') END AS name"""
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS id", name)
    return rows.withColumn("valid", valid_instrument("name"))


@register(
    "valid_timeframes",
    """SELECT event_id, upper(name) AS timeframe,
      regexp_full_match(upper(name), '(M|H|D|W|MN)[0-9]+|[0-9]+(M|H|D|W)|TICK') AND length(name) <= 10 AS valid
    FROM (SELECT event_id, ['M', 'h', 'MN', 'tick', 'W', '', 'x', 'D'][1 + event_id % 8]
      || CASE WHEN event_id % 8 = 3 AND event_id % 3 = 0 THEN '' ELSE CAST(event_id // 8 AS VARCHAR) END
      || CASE WHEN event_id % 8 = 5 THEN 'd' WHEN event_id % 5 = 0 THEN '000000000' ELSE '' END AS name FROM events)""",
)
def _(spark, sf):
    name = """concat(element_at(array('M', 'h', 'MN', 'tick', 'W', '', 'x', 'D'), CAST(1 + event_id % 8 AS INT)),
      CASE WHEN event_id % 8 = 3 AND event_id % 3 = 0 THEN '' ELSE CAST(event_id div 8 AS STRING) END,
      CASE WHEN event_id % 8 = 5 THEN 'd' WHEN event_id % 5 = 0 THEN '000000000' ELSE '' END) AS name"""
    rows = views.table(spark, sf, "events").selectExpr("event_id", name)
    return rows.select("event_id", F.upper("name").alias("timeframe"), valid_timeframe("name").alias("valid"))


# -- range queries, pages, output -----------------------------------------------------------------------------------

RANGE = dict(start="2024-01-08", end="2024-01-21 12:00:00")
IN_RANGE = "timestamp >= TIMESTAMP '2024-01-08' AND timestamp <= TIMESTAMP '2024-01-21 12:00:00'"
ROW = "instrument, timeframe, timestamp, open, high, low, close"


@register("scan_pruned", with_(TICKS) + f"SELECT * FROM ticks WHERE instrument = 'purchase' AND {IN_RANGE}")
def _(spark, sf):
    return query.select_range(views.event_ticks(spark, sf), instrument="purchase", **RANGE)


@register("range_bars", ALL_BARS + f"SELECT {ROW} FROM bars WHERE {IN_RANGE} ORDER BY timestamp")
def _(spark, sf):
    return query.query_bars(views.all_bars(spark, sf), **RANGE)


@register(
    "range_bars_of_series",
    ALL_BARS + f"SELECT {ROW} FROM bars WHERE instrument = 'view' AND timeframe = 'M30' AND {IN_RANGE} ORDER BY 3",
)
def _(spark, sf):
    return query.query_bars(views.all_bars(spark, sf), instrument="view", timeframe="m30", **RANGE)


@register(
    "range_ticks",
    with_(TICKS)
    + f"SELECT timestamp, price, volume, bid, ask FROM ticks WHERE instrument = 'purchase' AND {IN_RANGE} ORDER BY 1",
)
def _(spark, sf):
    return query.query_ticks(views.event_ticks(spark, sf), "purchase", **RANGE)


def page_sql(key: str, limit: int) -> str:
    return f"""SELECT * EXCLUDE (position), (SELECT count(*) FROM found) > {limit} AS has_more
    FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS position FROM found) WHERE position <= {limit}"""


@register(
    "first_page_of_bars",
    with_(TICKS, MINUTES, BARS, f"found AS (SELECT {ROW} FROM bars)")
    + page_sql("timestamp, instrument, timeframe", 20),
)
def _(spark, sf):
    return query.page_bars(views.all_bars(spark, sf))


AFTER = dict(timestamp="2024-01-10 00:00:00", instrument="error", timeframe="H4")


@register(
    "next_page_of_bars",
    with_(
        TICKS,
        MINUTES,
        BARS,
        f"""found AS (SELECT {ROW} FROM bars WHERE (timestamp, instrument, timeframe)
          > (TIMESTAMP '2024-01-10', 'error', 'H4') AND timestamp <= TIMESTAMP '2024-01-21 12:00:00')""",
    )
    + page_sql("timestamp, instrument, timeframe", 5000),
)
def _(spark, sf):
    return query.page_bars(views.all_bars(spark, sf), 5000, after=AFTER, **RANGE)


@register(
    "page_of_ticks",
    with_(
        TICKS,
        """found AS (SELECT timestamp, price, volume, bid, ask FROM ticks
          WHERE instrument = 'click' AND timestamp > TIMESTAMP '2024-01-03 04:05:06')""",
    )
    + page_sql("timestamp", 1000),
)
def _(spark, sf):
    after = dict(timestamp="2024-01-03 04:05:06")
    return query.page_ticks(views.event_ticks(spark, sf), "click", 1000, after=after)


ISO = """strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END"""


@register(
    "json_bars",
    ALL_BARS
    + f"""SELECT '{{"instrument":"' || instrument || '","timeframe":"' || timeframe || '","timestamp":"' || {ISO}
    || '","open":' || open || ',"high":' || high || ',"low":' || low || ',"close":' || close || '}}' AS json FROM bars""",
)
def _(spark, sf):
    return query.json_rows(query.query_bars(views.all_bars(spark, sf), ordered=False))


@register(
    "json_ticks",
    with_(TICKS)
    + f"""SELECT '{{"instrument":"' || instrument || '","timestamp":"' || {ISO} || '","price":' || price
    || ',"volume":' || volume || ',"bid":' || coalesce(CAST(bid AS VARCHAR), 'null') || ',"ask":'
    || coalesce(CAST(ask AS VARCHAR), 'null') || '}}' AS json FROM ticks""",
)
def _(spark, sf):
    return query.json_rows(views.event_ticks(spark, sf))


@register(
    "replay_schedule",
    with_(TICKS)
    + """, steps AS (SELECT instrument, timestamp, price, (epoch_us(timestamp) - lag(epoch_us(timestamp))
      OVER (PARTITION BY instrument ORDER BY timestamp)) / 1000000.0::DOUBLE / 60.0::DOUBLE AS s FROM ticks),
      waits AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE least(s, 10.0::DOUBLE) END AS w FROM steps)
    SELECT instrument, timestamp, price, round(w, 4) AS wait_seconds,
      round(sum(w) OVER (PARTITION BY instrument ORDER BY timestamp), 4) AS due_seconds FROM waits""",
)
def _(spark, sf):
    ticks = views.event_ticks(spark, sf).select("instrument", "timestamp", "price")
    due = query.replay_schedule(ticks, ["instrument"], speed=60.0, max_delay=10.0)
    return due.withColumns({c: F.round(c, 4) for c in ("wait_seconds", "due_seconds")})


# -- time shift -----------------------------------------------------------------------------------------------------

SHIFT = "CAST(timestamp AT TIME ZONE '{0}' AT TIME ZONE 'UTC' AS TIMESTAMP)"
UNIQUE_ORDERS = """unique_orders AS (SELECT instrument, timeframe, timestamp, open, high, low, close, 'raw' AS source
  FROM order_rows QUALIFY row_number() OVER (PARTITION BY instrument, timeframe, timestamp ORDER BY o_orderkey DESC) = 1)"""


def _unique_orders(spark, sf):
    picked = dedupe.last_per_key(views.order_rows(spark, sf), BAR_KEY, ["o_orderkey"])
    return picked.withColumn("source", F.lit(RAW))


def _shift_bars_sql(zone: str) -> str:
    columns = ", ".join(f"arg_max({c}, timestamp) AS {c}" for c in (*PRICES, "source"))
    return (
        with_(ORDER_ROWS, UNIQUE_ORDERS)
        + f"""SELECT instrument, timeframe, utc AS timestamp, {columns}
        FROM (SELECT *, {SHIFT.format(zone)} AS utc FROM unique_orders) GROUP BY instrument, timeframe, utc"""
    )


for _zone in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe"):
    register(f"shift_bars_{_zone.split('/')[1].lower()}", _shift_bars_sql(_zone))(
        lambda spark, sf, zone=_zone: repair.shift_bars(_unique_orders(spark, sf), zone)
    )

ORDER_TICKS = """order_ticks AS (SELECT instrument, timestamp, open AS price, 0.5::DOUBLE AS volume,
  CASE WHEN instrument <> 'ORD_P' THEN low END AS bid, CASE WHEN open > 200000 THEN high END AS ask FROM unique_orders)"""


@register(
    "shift_ticks",
    with_(ORDER_ROWS, UNIQUE_ORDERS, ORDER_TICKS)
    + f"""SELECT instrument, utc AS timestamp, arg_max(price, timestamp) AS price, arg_max(volume, timestamp) AS volume,
      arg_max(bid, timestamp) AS bid, arg_max(ask, timestamp) AS ask
    FROM (SELECT *, {SHIFT.format('America/New_York')} AS utc FROM order_ticks) GROUP BY instrument, utc""",
)
def _(spark, sf):
    return repair.shift_ticks(_order_ticks(spark, sf), "America/New_York")


def _order_ticks(spark, sf):
    return _unique_orders(spark, sf).selectExpr(
        "instrument",
        "timestamp",
        "open AS price",
        "0.5D AS volume",
        "CASE WHEN instrument <> 'ORD_P' THEN low END AS bid",
        "CASE WHEN open > 200000 THEN high END AS ask",
    )


@register(
    "shift_report",
    with_(ORDER_ROWS, UNIQUE_ORDERS, ORDER_TICKS)
    + f"""SELECT 'bars' AS table, count(*) AS rows_before,
      count(DISTINCT (instrument, timeframe, {SHIFT.format('Europe/Berlin')})) AS rows_after,
      count(*) - count(DISTINCT (instrument, timeframe, {SHIFT.format('Europe/Berlin')})) AS rows_deduplicated
    FROM unique_orders UNION ALL SELECT 'ticks', count(*), count(DISTINCT (instrument, {SHIFT.format('Europe/Berlin')})),
      count(*) - count(DISTINCT (instrument, {SHIFT.format('Europe/Berlin')})) FROM order_ticks""",
)
def _(spark, sf):
    return repair.shift_report(_unique_orders(spark, sf), _order_ticks(spark, sf), "Europe/Berlin")
