from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barlake.functions.timeframe import derivation_targets, tick_targets
from barlake.operators import ladder
from helpers import bars, final_plan, minute_rows, same, second_ticks, ticks


def test_targets_are_longer_whole_multiples():
    assert derivation_targets("M1") == ["M5", "M15", "M30", "H1", "H4", "D1"]
    assert derivation_targets("m30") == ["H1", "H4", "D1"]
    assert derivation_targets("H4") == ["D1"]
    for none in ("D1", "W1", "MN1", "TICK", "M7", "1M"):
        assert derivation_targets(none) == []
    assert tick_targets() == ["M1", "M5", "M15", "M30", "H1", "H4", "D1"]


def test_five_minutes_make_one_bar(spark):
    prices = [(7.0, 9.0, 6.5, 8.0), (8.0, 8.25, 7.75, 7.75), (7.75, 11.0, 7.5, 10.0), (10.0, 10.5, 5.25, 6.0), (6.0, 6.5, 6.0, 6.25)]
    rows = [("X", "M1", datetime(2019, 7, 9, 14, 35 + k), *p, "raw") for k, p in enumerate(prices)]
    found = ladder.bars_to_bars(bars(spark, rows[::-1]), "M1", "M5").collect()
    assert [tuple(r) for r in found] == [("X", "M5", datetime(2019, 7, 9, 14, 35), 7.0, 11.0, 5.25, 6.25, "derived")]


def test_ladder_counts(spark):
    rows = minute_rows("2019-07-09 21:10:00", 250, "X")
    found = ladder.ladder_from_bars(bars(spark, rows), "M1")
    counts = {r.timeframe: r["count"] for r in found.groupBy("timeframe").count().collect()}
    times = [row[2] for row in rows]
    starts = {"M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440}
    assert counts == {tf: len({(t - datetime(1970, 1, 1)) // timedelta(minutes=n) for t in times}) for tf, n in starts.items()}


def test_impossible_target_is_an_error(spark):
    with pytest.raises(ValueError):
        ladder.bars_to_bars(bars(spark, []), "H1", "M5")
    assert ladder.ladder_from_bars(bars(spark, minute_rows("2024-01-02", 3, timeframe="W1")), "W1").count() == 0


def test_ticks_make_all_levels(spark):
    found = ladder.ladder_from_ticks(ticks(spark, second_ticks("2024-01-02 09:00:00", 120)))
    by = {r.timeframe: r for r in found.where("timeframe != 'M1'").collect()}
    assert set(by) == {"M5", "M15", "M30", "H1", "H4", "D1"}
    assert by["H4"].timestamp == datetime(2024, 1, 2, 8)
    assert found.where("timeframe = 'M1'").count() == 2


def test_single_levels_equal_the_ladder(spark):
    data = ticks(spark, second_ticks("2024-01-02 23:50:00", 1500) + second_ticks("1969-12-31 22:58:20", 300, "OLD"))
    whole = ladder.ladder_from_ticks(data)
    for timeframe in tick_targets():
        assert same(whole.where(F.col("timeframe") == timeframe), ladder.ticks_to_bars(data, timeframe))
    minutes = ladder.ticks_to_bars(data, "M1")
    assert same(whole.where("timeframe != 'M1'"), ladder.ladder_from_bars(minutes, "M1"))
    five = ladder.bars_to_bars(minutes, "M1", "M5")
    assert same(ladder.ladder_from_bars(five, "M5"), whole.where("timeframe NOT IN ('M1', 'M5')"))


def test_raw_bar_is_kept(spark):
    hour = bars(spark, minute_rows("2024-01-02 00:00:00", 1, timeframe="H1", flat=999.0))
    derived = ladder.ladder_from_bars(bars(spark, minute_rows("2024-01-02 00:00:00", 120)), "M1")
    kept = ladder.protect_raw(derived, hour).where("timeframe = 'H1'").collect()
    assert [r.timestamp for r in kept] == [datetime(2024, 1, 2, 1)]
    older = hour.withColumn("source", F.lit("derived"))
    assert ladder.protect_raw(derived, older).where("timeframe = 'H1'").count() == 2


def test_window_is_padded_to_days():
    day = datetime(2024, 1, 2)
    assert ladder.pad_window(day + timedelta(hours=5), day + timedelta(hours=6)) == (day, day + timedelta(days=1))
    assert ladder.pad_window(day, day) == (day, day + timedelta(days=1))
    east = timezone(timedelta(hours=2))
    assert ladder.pad_window(datetime(2024, 1, 2, 1, tzinfo=east), "2024-01-02T03:00:00+00:00") == (
        datetime(2024, 1, 1),
        datetime(2024, 1, 3),
    )


def test_finest_source_counts_in_a_mixed_batch(spark):
    minutes = minute_rows("2024-01-02 00:00:00", 30)
    five = minute_rows("2024-01-02 00:00:00", 24, timeframe="M5", step=300, flat=500.0)
    found = ladder.ladder_mixed(bars(spark, minutes + five))
    assert found.where("timeframe = 'M5'").count() == 6
    quarter = {r.timestamp.minute + 60 * r.timestamp.hour: r.open for r in found.where("timeframe = 'M15'").collect()}
    assert quarter[0] == 100.0 and quarter[30] == 500.0 and len(quarter) == 8


def test_ladder_reads_once_and_shuffles_twice(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark, second_ticks("2024-01-02 09:00:00", 5000)).write.parquet(path)
    plan = final_plan(ladder.ladder_from_ticks(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan


def test_hot_minute_is_folded_before_the_shuffle(spark, tmp_path):
    """A third of all ticks in one minute of one instrument: what is shuffled is one row per task and minute."""
    path = str(tmp_path / "ticks")
    hot = spark.range(0, 60_000, 1, 8).selectExpr(
        "'HOT' AS instrument",
        "timestamp_ntz'2024-01-02 09:00:00' + make_dt_interval(0, 0, 0, id / 1000) AS timestamp",
        "CAST(id AS DOUBLE) AS price",
    )
    hot.write.parquet(path)
    found = ladder.ticks_to_bars(spark.read.parquet(path), "M1")
    assert [(r.open, r.close) for r in found.collect()] == [(0.0, 59_999.0)]
    metrics = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in metrics and "HashAggregate" in metrics


def test_a_task_holds_days_and_not_the_bars_of_all_levels(spark):
    """One minute a day, so that no level has fewer bars: the rows are sorted once and nothing is hashed after that."""
    days = [("X" if k % 2 else "Y", datetime(2024, 1, 1, 23, 59) - timedelta(days=k), float(k)) for k in range(300)]
    data = ticks(spark, [(i, t + timedelta(seconds=s), p + s) for i, t, p in days for s in (0, 30)])
    found = ladder.ladder_from_ticks(data)
    assert found.count() == 300 * 7
    for timeframe in tick_targets():
        assert same(found.where(F.col("timeframe") == timeframe), ladder.ticks_to_bars(data, timeframe))
    above = final_plan(found).split("REPARTITION_BY_COL")[0]
    assert "HashAggregate" not in above and above.count(" Sort [") == 1 and above.index("Generate") < above.index("Window")
