import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlake.operators import merge, profile, query
from barlake.plans.ingest import refresh_scope
from helpers import bars, minute_rows, second_ticks, ticks


def three_ticks(spark):
    return ticks(spark, [(*row[:3], 1.0, 99.0, 101.0) for row in second_ticks("2024-01-02 09:00:00", 3)])


def test_both_ends_of_a_tick_range_count(spark):
    found = query.query_ticks(three_ticks(spark), "EURUSD", "2024-01-02T09:00:01", "2024-01-02T09:00:02")
    assert found.columns == ["timestamp", "price", "volume", "bid", "ask"]
    assert [r.timestamp.second for r in found.collect()] == [1, 2]


def test_bar_range(spark):
    data = bars(spark, minute_rows("2024-01-02 09:00:00", 3, timeframe="M5", step=300))
    found = query.query_bars(data, instrument="EURUSD", timeframe="m5", start="2024-01-02T09:05:00+00:00")
    assert found.columns == ["instrument", "timeframe", "timestamp", "open", "high", "low", "close"]
    assert [r.timestamp.minute for r in found.collect()] == [5, 10]
    with pytest.raises(ValueError):
        query.query_bars(data, instrument="../x")


def test_pages_cover_rows_with_equal_times(spark):
    """Three series share every timestamp; pages of four cut through them."""
    rows = [r for name in ("A", "B", "C") for r in minute_rows("2024-01-02 09:00:00", 5, name)]
    data, seen, after = bars(spark, rows), [], None
    for _ in range(10):
        page = query.page_bars(data, 4, after=after).orderBy("timestamp", "instrument").collect()
        seen += [(r.timestamp, r.instrument) for r in page]
        if not page[-1].has_more:
            break
        after = page[-1].asDict()
    assert len(seen) == 15 and seen == sorted(seen) and len(set(seen)) == 15


def test_page_sizes(spark):
    data = three_ticks(spark)
    first = query.page_ticks(data, "EURUSD", 2).collect()
    assert len(first) == 2 and all(r.has_more for r in first)
    rest = query.page_ticks(data, "EURUSD", 2, after=first[-1].asDict(), start="2024-01-02 09:00:00").collect()
    assert len(rest) == 1 and not rest[0].has_more
    assert len(query.page_ticks(data, "EURUSD", 3).collect()) == 3
    for bad in (0, 100_001):
        with pytest.raises(ValueError):
            query.page_ticks(data, "EURUSD", bad)
    with pytest.raises(ValueError):
        query.page_bars(bars(spark, []), 10_001)


def test_json_rows(spark):
    at = datetime(2024, 1, 2, 9)
    data = ticks(spark, [("A", at, 1.5, 0.0, None, 2.0), ("A", at.replace(microsecond=250), 1.0, 0.0, None, None)])
    found = [json.loads(r.json) for r in query.json_rows(query.query_ticks(data, "A")).collect()]
    assert found[0] == {"timestamp": "2024-01-02T09:00:00", "price": 1.5, "volume": 0.0, "bid": None, "ask": 2.0}
    assert found[1]["timestamp"] == "2024-01-02T09:00:00.000250"


def waits(spark, rows, **options):
    found = query.replay_schedule(ticks(spark, rows), ["instrument"], **options).orderBy("timestamp").collect()
    return [(r.wait_seconds, r.due_seconds) for r in found]


def test_replay(spark):
    def at(hour, second):
        return ("A", datetime(2024, 1, 2, hour, 0, second), 1.0, 0.0, None, None)

    rows = [at(9, 0), at(9, 4), at(9, 5), at(13, 0)]
    assert waits(spark, rows) == [(0.0, 0.0), (4.0, 4.0), (1.0, 5.0), (10.0, 15.0)]
    assert waits(spark, rows, speed=2.0) == [(0.0, 0.0), (2.0, 2.0), (0.5, 2.5), (10.0, 12.5)]
    assert waits(spark, rows, max_delay=3.0) == [(0.0, 0.0), (3.0, 3.0), (1.0, 4.0), (3.0, 7.0)]
    assert waits(spark, rows, max_delay=0) == [(0.0, 0.0)] * 4
    assert waits(spark, rows, slice_width="1 second") == waits(spark, rows, slice_width="1 day")


def test_profile(spark):
    data = bars(spark, minute_rows("2024-01-02 00:00:00", 5) + minute_rows("2024-01-03 00:00:00", 3, "GBPUSD"))
    marked = data.unionByName(bars(spark, minute_rows("2024-01-02", 1, timeframe="H1", source="derived")))
    found = three_ticks(spark).withColumn("instrument", F.lit("XAUUSD"))
    row = profile.lake_summary(marked, found).first()
    assert (row.bar_rows, row.tick_rows, row.total_rows, row.instruments) == (9, 3, 12, 3)
    assert row.timeframes == ["M1", "H1", "TICK"]
    assert (row.start, row.end) == (datetime(2024, 1, 2), datetime(2024, 1, 3, 0, 2))
    cover = {(r.instrument, r.timeframe): (r.record_count, r.sources) for r in profile.coverage_catalog(marked, found).collect()}
    assert cover == {
        ("EURUSD", "M1"): (5, ["raw"]),
        ("EURUSD", "H1"): (1, ["derived"]),
        ("GBPUSD", "M1"): (3, ["raw"]),
        ("XAUUSD", "TICK"): (3, ["raw"]),
    }
    assert [r.instrument for r in profile.all_instruments(marked, found).collect()] == ["EURUSD", "GBPUSD", "XAUUSD"]
    assert [r.timeframe for r in profile.timeframes(marked, found).collect()] == ["M1", "H1", "TICK"]
    assert [r.timeframe for r in profile.timeframes(marked, found, "GBPUSD").collect()] == ["M1"]
    stats = {(r.instrument, r.timeframe): r.row_count for r in profile.bar_stats(marked).collect()}
    assert stats[(None, None)] == 9 and stats[("EURUSD", None)] == 6 and stats[(None, "M1")] == 8
    assert [r.row_count for r in profile.tick_stats(found).collect()] == [3, 3]


def test_upsert_of_an_empty_side(spark):
    data = bars(spark, minute_rows("2024-01-02", 3))
    none = bars(spark, [])
    assert merge.upsert_bars(none, data).count() == merge.upsert_bars(data, none).count() == 3


def test_refresh_scope(spark):
    data = bars(spark, minute_rows("2024-01-02", 3) + minute_rows("2024-01-02", 3, "NEW"))
    assert refresh_scope(data, bars(spark, minute_rows("2023-01-02", 9))).count() == 3
