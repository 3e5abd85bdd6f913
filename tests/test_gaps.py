from datetime import datetime

import pytest

from barlake.operators import gaps
from helpers import bars, final_plan, minute_rows


def holes(spark, minutes):
    after = datetime(2024, 1, 2, 9, 10 + minutes) if minutes < 50 else datetime(2024, 1, 2, 10, 0)
    return bars(
        spark,
        minute_rows("2024-01-02 09:00:00", 10, flat=1.0) + minute_rows(after.isoformat(" "), 10, flat=1.0),
    )


def test_thirty_missing_minutes(spark):
    row = gaps.describe_gaps(gaps.find_gaps(holes(spark, 30))).collect()
    assert [(r.duration_seconds, r.missing_bars, r.is_weekend) for r in row] == [(1860, 30, False)]


def test_threshold(spark):
    assert gaps.find_gaps(holes(spark, 2)).first().duration_seconds == 180
    assert gaps.find_gaps(holes(spark, 2), min_gap_seconds=600).count() == 0
    assert gaps.find_gaps(holes(spark, 2), min_gap_seconds=180).count() == 0


def test_no_gap(spark):
    assert gaps.find_gaps(bars(spark, minute_rows("2024-01-02 00:00:00", 60))).count() == 0


def test_weekend(spark):
    data = minute_rows("2024-01-05 20:58:00", 2) + minute_rows("2024-01-07 22:00:00", 2)
    row = gaps.describe_gaps(gaps.find_gaps(bars(spark, data))).collect()
    assert [(r.is_weekend, r.gap_start) for r in row] == [(True, datetime(2024, 1, 5, 20, 59))]


def test_end_is_exclusive_and_start_inclusive(spark):
    data = holes(spark, 30)
    assert gaps.find_gaps(data, start="2024-01-02 09:09:00").count() == 1
    assert gaps.find_gaps(data, start="2024-01-02 09:10:00").count() == 0
    assert gaps.find_gaps(data, end="2024-01-02 09:40:00").count() == 0
    assert gaps.find_gaps(data, end="2024-01-02 09:41:00").count() == 1


@pytest.mark.parametrize("timeframe", ["W1", "MN1", "TICK", "M7"])
def test_timeframes_without_a_length(spark, timeframe):
    data = minute_rows("2024-01-02 00:00:00", 2, timeframe=timeframe, step=8_000_000)
    assert gaps.find_gaps(bars(spark, data)).count() == 0


def test_gap_across_many_empty_days(spark):
    data = minute_rows("2024-01-02 23:59:00", 1) + minute_rows("2024-01-20 00:00:00", 1)
    assert gaps.find_gaps(bars(spark, data)).first().duration_seconds == 17 * 86400 + 60


def test_top_needs_a_valid_limit(spark):
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            gaps.top_gaps(gaps.find_gaps(holes(spark, 30)), limit)


def test_both_parts_read_the_same_shuffle(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars(spark, minute_rows("2024-01-02 00:00:00", 3000)).write.parquet(path)
    plan = final_plan(gaps.find_gaps(spark.read.parquet(path)))
    assert plan.count("ReusedExchange") == 1
    assert "PushedFilters" in plan
