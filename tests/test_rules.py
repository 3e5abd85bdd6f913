"""Names, buckets, order of timeframes, cleaning rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlake.functions import timeframe as tf
from barlake.functions.timestamps import parse_utc
from barlake.operators import dedupe, quality
from barlake.schema import as_ticks
from helpers import bars, final_plan, minute_rows

GOOD = ["EURUSD", "XAU_USD", "S&P-500", "a", "US30", "X" * 50, "600519", "BTC-USD"]
BAD = [
    "", "../etc", "a/b", "a\\b", "a..b", "X" * 51, "EUR USD", "a;DROP TABLE x", "a'b", 'a"b', "a.b", "a,b", "a:b", "a@b",
    "a#b", "a$b", "a%b", "a^b", "a*b", "a(b", "a)b", "a+b", "a=b", "a|b", "a<b", "a>b", "a?b", "a!b", "a~b", "a`b", "ä",
]


def test_instruments(spark):
    rows = spark.createDataFrame([(n,) for n in GOOD + BAD], "name string")
    found = {r.name: r.ok for r in rows.select("name", tf.valid_instrument("name").alias("ok")).collect()}
    assert found == {**{n: True for n in GOOD}, **{n: False for n in BAD}}
    for name in GOOD:
        assert tf.check_instrument(name) == name
    for name in BAD:
        with pytest.raises(ValueError):
            tf.check_instrument(name)


GOOD_FRAMES = ["M1", "M5", "M15", "M30", "H1", "H4", "D1", "W1", "MN1", "m1", "h4", "mn1", "1m", "5m", "1h", "1d", "1w",
               "1M", "1H", "1D", "1W", "TICK", "tick", "M240"]
BAD_FRAMES = ["", "minute1", "HOUR1", "1", "M", "MN", "M-1", "1mn", "M1 ", "M1/", "..", "M1\\", "X1", "M12345678901"]


def test_timeframes(spark):
    rows = spark.createDataFrame([(n,) for n in GOOD_FRAMES + BAD_FRAMES], "name string")
    found = {r.name: r.ok for r in rows.select("name", tf.valid_timeframe("name").alias("ok")).collect()}
    assert found == {**{n: True for n in GOOD_FRAMES}, **{n: False for n in BAD_FRAMES}}
    for name in GOOD_FRAMES:
        assert tf.check_timeframe(name) == name.upper()
    for name in BAD_FRAMES:
        with pytest.raises(ValueError):
            tf.check_timeframe(name)


UNITS = {"M": 60, "H": 3600, "D": 86400}


def floor_of(timeframe, at):
    """The begin of a bucket: weeks begin on Monday, months on the first, all else counts from 1970; unknown names have none."""
    name = timeframe.upper()
    if name == "MN1":
        return at.replace(day=1, hour=0, minute=0, second=0)
    if name[0] == "W" and name[1:].isdigit():
        return at.replace(hour=0, minute=0, second=0) - timedelta(days=at.weekday())
    if name[0] not in UNITS or not name[1:].isdigit():
        return at
    return at - (at - datetime(1970, 1, 1)) % timedelta(seconds=UNITS[name[0]] * int(name[1:]))


def test_buckets(spark):
    draw = random.Random(17)
    names = ["M1", "M5", "M15", "M30", "H1", "H4", "h4", "D1", "d1", "D3", "W1", "W4", "MN1", "QUEER3", "5M"]
    instants = [datetime(1950, 1, 1) + timedelta(seconds=draw.randrange(3 * 10**9)) for _ in range(40)]
    instants += [datetime(2031, 6, 1), datetime(2031, 5, 31, 23, 59, 59), datetime(2032, 2, 29, 12), datetime(1969, 12, 31, 23)]
    rows = spark.createDataFrame([(n, at) for n in names for at in instants], "tf string, ts timestamp_ntz")
    for r in tf.with_bucket_start(rows, "got", "ts", "tf").collect():
        assert r.got == floor_of(r.tf, r.ts), (r.tf, r.ts)


def test_display_order(spark):
    names = ["TICK", "D1", "M1", "XX", "MN1", "H4", "M30", "W1", "H1", "M15", "M5"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = [r.name for r in rows.orderBy(tf.display_rank("name")).collect()]
    assert found == ["M1", "M5", "M15", "M30", "H1", "H4", "D1", "W1", "MN1", "XX", "TICK"]


TEXTS = {
    "2024-01-01 09:00:00": "2024-01-01 09:00:00",
    "2024-01-01T09:00:00Z": "2024-01-01 09:00:00",
    "2024-01-01T09:00:00+02:00": "2024-01-01 07:00:00",
    "2024-01-01 09:00:00 -0530": "2024-01-01 14:30:00",
    "2024-03-10 02:30:00": "2024-03-10 02:30:00",
    "2024.01.02 03:04": "2024-01-02 03:04:00",
    "2024/01/02": "2024-01-02 00:00:00",
    "20240102": "2024-01-02 00:00:00",
    "01/02/2024 05:00": "2024-01-02 05:00:00",
    "not-a-date": "None",
    "2024-13-01": "None",
    "2024-02-30": "None",
    "": "None",
    "12:00": "None",
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_texts_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t, t) for t in TEXTS], "text string, at string")
        found = parse_utc(rows, "at").withColumn("at", F.col("at").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r.text: str(r["at"]) for r in found} == TEXTS


def test_day_first(spark):
    rows = spark.createDataFrame([("13.02.2024 10:00:00.123",), ("01.02.2024 00:00:00",)], "at string")
    found = [str(r["at"]) for r in parse_utc(rows, "at", day_first=True).collect()]
    assert found == ["2024-02-13 10:00:00.123000", "2024-02-01 00:00:00"]


def text_bars(spark, rows, names="Timestamp, OPEN ,high,low,close,TickVol"):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names.split(",")))


def test_bars_are_cleaned(spark):
    raw = text_bars(
        spark,
        [
            ("2024-01-01 00:00", "1", "2", "0.5", "1.5", "9"),
            ("2024-01-01 00:01", "x", "2", "0.5", "1.5", "9"),
            ("2024-01-01 00:02", "1", "NaN", "0.5", "1.5", "9"),
            ("2024-01-01 00:03", "1", "2", "3", "1.5d", "9"),
            ("2024-01-01 00:04", "1", "2", "3", None, "9"),
        ],
    )
    judged = quality.judged_bars(raw)
    assert "tickvol" not in judged.columns
    assert quality.accepted(judged).count() == 1
    assert quality.reject_counts(judged).first().bad_prices == 4


def test_high_below_low_is_not_checked(spark):
    raw = text_bars(spark, [("2024-01-01", "1", "0", "5", "1", "9")])
    assert quality.strict_bars(quality.judged_bars(raw).withColumns(
        {"instrument": F.lit("A"), "timeframe": F.lit("M1")})).count() == 1


def test_bad_time_rejects_all_bars(spark):
    raw = text_bars(spark, [("2024-01-01", "1", "2", "0", "1", "9"), ("nope", "1", "2", "0", "1", "9")])
    with pytest.raises(ValueError, match="1 rows with invalid timestamp"):
        quality.strict_bars(quality.judged_bars(raw))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        quality.judged_bars(text_bars(spark, [("2024-01-01", "1", "2", "0", "1", "9")], "timestamp,open,high,low,c,v"))
    with pytest.raises(ValueError, match="timestamp"):
        quality.judged_ticks(spark.createDataFrame([("1",)], "price string"))
    with pytest.raises(ValueError, match="bid and ask"):
        quality.judged_ticks(spark.createDataFrame([("1", "2")], "timestamp string, bid string"))


def test_column_map(spark):
    raw = text_bars(spark, [("2024-01-01", "1", "2", "0", "1", "9")], "Time,o,h,l,c,v")
    names = {"time": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close"}
    assert quality.accepted(quality.judged_bars(raw, names)).count() == 1


def tick_text(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, price double, volume string")


@pytest.mark.parametrize("price", [float("nan"), -100.0, 0.0, None])
def test_bad_price_rejects_all_ticks(spark, price):
    raw = tick_text(spark, [("2024-01-01", 1.0, "1"), ("2024-01-01", price, "1")])
    with pytest.raises(ValueError, match="1 rows with invalid price"):
        quality.strict_ticks(quality.judged_ticks(raw))


def test_mid_price_only_without_a_price(spark):
    quotes = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "timestamp string, bid double, ask double")
    assert quality.judged_ticks(quotes).first().price == 1.5
    priced = quotes.withColumn("price", F.lit(7.0))
    assert quality.judged_ticks(priced).first().price == 7.0


def test_optional_fields(spark):
    raw = tick_text(spark, [("2024-01-01", 1.0, "abc")])
    assert quality.judged_ticks(raw).first().volume is None
    row = as_ticks(spark.sql("SELECT 'A' instrument, timestamp_ntz'2024-01-01 00:00:00' timestamp, 1D price")).first()
    assert (row.volume, row.bid, row.ask) == (0.0, None, None)


def test_copies_collapse(spark):
    raw = tick_text(spark, [("2024-01-01", 1.0, "1")] * 3 + [("2024-01-01", 1.0, "2")])
    assert quality.distinct_rows(quality.accepted(quality.judged_ticks(raw))).count() == 2


def test_latest_original_time_wins_in_a_bucket(spark):
    rows = [(*r[:3], float(i), float(i), float(i), float(i), "raw") for i, r in enumerate(minute_rows("2018-01-02", 3, timeframe="D1", step=3600))]
    found = dedupe.latest_bars(bars(spark, list(reversed(rows)))).collect()
    assert [(r.timestamp, r.open) for r in found] == [(datetime(2018, 1, 2), 2.0)]


def test_earliest_original_time_wins_in_a_collapse(spark):
    rows = [(*r[:3], float(i), float(i), float(i), float(i), "derived") for i, r in enumerate(minute_rows("2018-01-02", 3, timeframe="D1", step=3600))]
    found = dedupe.collapse_offset_bars(bars(spark, rows)).collect()
    assert [(r.timestamp, r.open, r.source) for r in found] == [(datetime(2018, 1, 2), 0.0, "derived")]
    report = dedupe.collapse_report(bars(spark, rows)).first()
    assert (report.rows_before, report.rows_after, report.rows_removed) == (3, 1, 2)
    with pytest.raises(ValueError):
        dedupe.collapse_report(bars(spark, rows), ("D1", "M7"))


def test_last_tick_of_a_key(spark):
    rows = spark.sql(
        "SELECT 'A' instrument, timestamp_ntz'2024-01-01 00:00:00' timestamp, CAST(p AS DOUBLE) price, n "
        "FROM VALUES (5, 1), (3, 3), (4, 2) t(p, n)"
    )
    assert dedupe.latest_ticks(rows, ["n"]).first().price == 3.0
    assert dedupe.latest_ticks(rows).first().price == 5.0


def test_hot_key_collapses_without_a_big_group(spark):
    """A third of the rows are copies of one key."""
    rows = spark.range(90_000).selectExpr(
        "'A' AS instrument",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, IF(id % 3 = 0, 0, id)) AS timestamp",
        "CAST(id AS DOUBLE) AS price",
        "id AS n",
    )
    found = dedupe.latest_ticks(rows, ["n"])
    assert found.count() == 60_001
    assert found.where("timestamp = timestamp_ntz'2024-01-01 00:00:00'").first().price == 89_997.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(" in plan and "Window" not in plan


def test_absent_columns_are_not_sorted_along(spark):
    rows = spark.sql("SELECT 'X' AS instrument, timestamp_ntz'2024-01-02 09:00:00' AS timestamp, CAST(id AS DOUBLE) AS price FROM range(5)")
    found = dedupe.latest_ticks(rows)
    assert [tuple(r)[2:] for r in found.collect()] == [(4.0, 0.0, None, None)]
    assert "partial_max(struct(price" in (plan := final_plan(found)) and "bid, null" not in plan
