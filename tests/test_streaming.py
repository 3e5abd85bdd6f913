import uuid

import pytest

from barlake.operators import ladder
from barlake.plans import ingest
from barlake.schema import BARS, TICKS
from barlake.sources.store import Store
from barlake.streaming.bars import ladder_into_store, live_bars, live_ladder
from barlake.streaming.ingest import TICK_TEXT, ingest_bar_stream, ingest_tick_stream, landed_csv, landed_parquet
from helpers import bars, minute_rows, same, second_ticks, ticks


def land(spark, folder, *parts):
    for part in parts:
        ticks(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, tmp_path):
    """The middle comes last, so that batch is late for its day."""
    parts = [second_ticks(f"2024-01-02 {t}", 50) for t in ("09:00:00", "23:59:30", "09:00:30")]
    folder = land(spark, str(tmp_path / "landed"), *parts)
    store, batch = Store(spark, str(tmp_path / "stream")), Store(spark, str(tmp_path / "batch"))
    for run in ("first", "again"):
        stream = landed_parquet(spark, folder, TICKS, max_files=1)
        ingest_tick_stream(store, stream, str(tmp_path / run)).awaitTermination()
    for part in parts:
        ingest.ingest_ticks(batch, ticks(spark, part))
    assert store.ticks().count() == batch.ticks().count() > 100
    keys = ["instrument", "timeframe", "timestamp"]
    assert same(store.bars().select(*keys), batch.bars().select(*keys))
    assert same(store.bars(), ladder.ladder_from_ticks(store.ticks()))


def test_bars_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "landed")
    bars(spark, minute_rows("2024-01-02 00:00:00", 60)).write.parquet(folder)
    store = Store(spark, str(tmp_path / "store"))
    ingest_bar_stream(store, landed_parquet(spark, folder, BARS), str(tmp_path / "mark")).awaitTermination()
    assert store.bars().where("timeframe = 'M5'").count() == 12


def test_bad_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "A_TICK_1.csv").write_text(
        "timestamp,price,volume,bid,ask\n2024-01-02T09:00:00Z,1.5,1,,\nnope,1,1,,\n2024-01-02 09:00:01,-1,1,,\n"
    )
    store = Store(spark, str(tmp_path / "store"))
    stream = landed_csv(spark, str(tmp_path), TICK_TEXT)
    rejects = str(tmp_path / "rejects")
    ingest_tick_stream(store, stream, str(tmp_path / "mark"), rejects).awaitTermination()
    assert [(r.instrument, r.price) for r in store.ticks().collect()] == [("A", 1.5)]
    assert {r.reason for r in spark.read.parquet(rejects).collect()} == {"invalid timestamp", "invalid price"}


def run_live(spark, folder, timeframe, mode, checkpoint):
    name = f"live_{uuid.uuid4().hex}"
    bars_out = live_bars(landed_parquet(spark, folder, TICKS), timeframe)
    writer = bars_out.writeStream.format("memory").queryName(name).outputMode(mode)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("timeframe", ["M1", "H1"])
def test_live_bars_equal_batch_bars(spark, tmp_path, timeframe):
    rows = second_ticks("2024-01-02 09:59:30", 200)
    folder = land(spark, str(tmp_path / "landed"), rows[100:], rows[:100])
    found = run_live(spark, folder, timeframe, "complete", str(tmp_path / "mark"))
    assert same(found, ladder.ticks_to_bars(ticks(spark, rows), timeframe))


def test_appended_bars_are_final(spark, tmp_path):
    """Bars come out once the watermark has passed them, as they are in the batch result."""
    rows = second_ticks("2024-01-02 09:00:00", 1800)
    folder = land(spark, str(tmp_path / "landed"), rows)
    found = run_live(spark, folder, "M1", "append", str(tmp_path / "mark"))
    batch = ladder.ticks_to_bars(ticks(spark, rows), "M1")
    assert 0 < found.count() < 30
    assert found.exceptAll(batch).count() == 0


def test_live_ladder_of_closed_days(spark, tmp_path):
    """In append mode the whole ladder of a day comes out once, when the watermark has passed the day."""
    rows = second_ticks("2024-01-02 23:50:00", 660) + second_ticks("2024-01-03 00:20:00", 5) + second_ticks("2024-01-02 08:00:00", 70, "GBPUSD")
    folder, name = land(spark, str(tmp_path / "landed"), rows), f"live_{uuid.uuid4().hex}"
    writer = live_ladder(landed_parquet(spark, folder, TICKS)).writeStream.format("memory").queryName(name).outputMode("append")
    writer.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    batch = ladder.ladder_from_ticks(ticks(spark, rows))
    assert same(spark.table(name), batch.where("timestamp < TIMESTAMP_NTZ'2024-01-03 00:00:00'"))


def test_live_ladder_into_a_store(spark, tmp_path):
    """Every level follows each batch; an original bar stays, and a replay from the start changes nothing."""
    rows = second_ticks("2024-01-02 09:00:00", 320)
    parts = [rows[:50], rows[270:], rows[50:100]]
    folder = land(spark, str(tmp_path / "landed"), *parts)
    store = Store(spark, str(tmp_path / "store"))
    hour = bars(spark, minute_rows("2024-01-02 09:00:00", 1, timeframe="H1", flat=999.0))
    ingest.ingest_bars(store, hour, derive=False)
    wanted = ladder.ladder_from_ticks(ticks(spark, sum(parts, []))).where("timeframe <> 'H1'").unionByName(hour)
    for mark in ("first", "again"):
        stream = landed_parquet(spark, folder, TICKS, max_files=1)
        ladder_into_store(store, stream, str(tmp_path / mark), compact_after=2).awaitTermination()
        assert store.batches("bars") == [1]
        assert same(store.bars(), wanted)
        store.compact()


def test_live_bars_need_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            live_bars(ticks(spark, []), "M1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
