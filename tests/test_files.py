import pytest

from barlake.operators import quality
from barlake.plans import ingest
from barlake.sources import files
from barlake.sources.store import Store

BARS = "Timestamp,Open,High,Low,Close,Volume\n2024-01-02 00:00:00,1,2,0.5,1.5,7\n2024-01-02 00:01:00,1.5,2,1,1.2,7\n"
TERMINAL = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2024.01.02\t00:00:00\t1\t2\t0.5\t1.5\t9\t0\t3\n"
DAILY = "<DATE> <OPEN> <HIGH> <LOW> <CLOSE>\r\n2024.01.02   1 2 0.5 1.5\r\n\r\n2024.01.03 1 2 0.5 x\r\n"
TICKS = "timestamp,price,volume\n2024-01-01 09:00:00,31.25,1.0\n"
GMT = "Gmt time,Bid,Ask,Volume\n01.02.2024 09:00:00.250,31.125,31.375,1.0\n"
QUOTES = "time,bid,ask\n2024-01-01 09:00:00,1.0,3.0\n"
TERMINAL_TICKS = "<DATE> <TIME> <BID> <ASK> <LAST> <VOLUME>\n2021.06.07 13:14:15.5 31.125 31.375 31.25 1.0\n"
TERMINAL_QUOTES = "<DATE> <TIME> <BID> <ASK>\n2024.01.01 09:00:00 1 3\n"


def folder(tmp_path, **contents):
    for name, text in contents.items():
        data = text if isinstance(text, bytes) else text.encode()
        (tmp_path / f"{name}.csv").write_bytes(data)
    return str(tmp_path)


def good(batch):
    return quality.accepted(batch.rows)


def outcome(batch):
    return {r["name"]: r.error for r in batch.files.collect()}


def test_bar_layouts_in_one_folder(spark, tmp_path):
    where = folder(tmp_path, EURUSD_M1_1=BARS, GBPUSD_M1_x=TERMINAL, XAUUSD_d1_y=DAILY)
    batch = files.read_bar_files(spark, where)
    found = {(r.instrument, r.timeframe, str(r.timestamp), r.open, r.close) for r in good(batch).collect()}
    assert found == {
        ("EURUSD", "M1", "2024-01-02 00:00:00", 1.0, 1.5),
        ("EURUSD", "M1", "2024-01-02 00:01:00", 1.5, 1.2),
        ("GBPUSD", "M1", "2024-01-02 00:00:00", 1.0, 1.5),
        ("XAUUSD", "D1", "2024-01-02 00:00:00", 1.0, 1.5),
    }
    assert set(outcome(batch).values()) == {None}


def test_tick_layouts_in_one_folder(spark, tmp_path):
    where = folder(
        tmp_path,
        A_TICK_1=TICKS,
        B_tick_1=GMT,
        C_TICK_1=TERMINAL_TICKS,
        D_TICK_1=TERMINAL_QUOTES,
        E_TICK_1=QUOTES,
        F_TICK_1=TICKS.encode("utf-16"),
        G_M1_1=BARS,
    )
    batch = files.read_tick_files(spark, where)
    found = {r.instrument: (str(r.timestamp), r.price, r.volume, r.bid, r.ask) for r in good(batch).collect()}
    assert found == {
        "A": ("2024-01-01 09:00:00", 31.25, 1.0, None, None),
        "B": ("2024-02-01 09:00:00.250000", 31.25, 1.0, 31.125, 31.375),
        "C": ("2021-06-07 13:14:15.500000", 31.25, 1.0, 31.125, 31.375),
        "D": ("2024-01-01 09:00:00", 2.0, 0.0, 1.0, 3.0),
        "E": ("2024-01-01 09:00:00", 2.0, 0.0, 1.0, 3.0),
        "F": ("2024-01-01 09:00:00", 31.25, 1.0, None, None),
    }


def test_same_columns_in_another_order(spark, tmp_path):
    other = "close,low,high,open,timestamp\n4,1,5,2,2024-01-02 00:00:00\n"
    found = good(files.read_bar_files(spark, folder(tmp_path, A_M1_1=BARS, B_M1_1=other)))
    row = found.where("instrument = 'B'").first()
    assert (row.open, row.high, row.low, row.close) == (2.0, 5.0, 1.0, 4.0)


def test_given_name_and_column_map(spark, tmp_path):
    text = BARS.replace("Timestamp", "When")
    batch = files.read_bar_files(spark, folder(tmp_path, data=text), "EURUSD", "m5", {"when": "timestamp"})
    assert {(r.instrument, r.timeframe) for r in good(batch).collect()} == {("EURUSD", "M5")}


def test_bad_files_do_not_stop_the_batch(spark, tmp_path):
    where = folder(
        tmp_path,
        A_M1_1=BARS,
        B_M1_1=BARS + "nope,1,2,3,4,5\n",
        C_M1_1="timestamp,open\n2024-01-01,1\n",
        single=BARS,
        **{"D D_M1_1": BARS, "H_M1_two words %20": BARS, "E_XX_1": BARS, "F_TICK_1": TICKS, "G_M1_1": BARS + "2024-01-02 00:02:00,x,2,3,4,5\n"},
    )
    store = Store(spark, str(tmp_path / "store"))
    report = ingest.ingest_bar_files(store, where, derive=False)
    found = {r["name"][:-4]: (r.status, r.error) for r in report.files.collect()}
    assert found["A_M1_1"] == ("ok", None)
    assert found["G_M1_1"] == ("ok", None)
    assert found["H_M1_two words %20"] == ("ok", None)
    assert found["B_M1_1"] == ("error", "1 rows with invalid timestamp")
    assert found["C_M1_1"][0] == "error" and "high" in found["C_M1_1"][1]
    assert found["D D_M1_1"] == ("error", "invalid instrument")
    assert found["E_XX_1"] == ("error", "invalid timeframe")
    assert found["F_TICK_1"][0] == "error" and "open" in found["F_TICK_1"][1]
    assert found["single"][0] == "error"
    assert {(r.instrument, r["count"]) for r in store.bars().groupBy("instrument").count().collect()} == {("A", 2), ("G", 2), ("H", 2)}


def test_later_file_outranks_an_earlier_one(spark, tmp_path):
    where = folder(tmp_path, A_M1_1=BARS, A_M1_2=BARS.replace("1.5,2,1,1.2", "8,9,7,8"))
    store = Store(spark, str(tmp_path / "store"))
    report = ingest.ingest_bar_files(store, where)
    rows = {str(r.timestamp)[11:16]: r.open for r in store.bars().where("timeframe = 'M1'").collect()}
    assert rows == {"00:00": 1.0, "00:01": 8.0}
    counts = report.series.first()
    assert (counts.rows_in_file, counts.rows_in_batch, counts.rows_new, counts.rows_matched) == (4, 2, 2, 0)


def test_a_bad_price_rejects_a_tick_file(spark, tmp_path):
    where = folder(tmp_path, A_TICK_1=TICKS, B_TICK_1=TICKS + "2024-01-01 09:00:01,-1,1\n")
    store = Store(spark, str(tmp_path / "store"))
    report = ingest.ingest_tick_files(store, where)
    assert {r.instrument: r.status for r in report.files.collect()} == {"A": "ok", "B": "error"}
    assert [r.instrument for r in store.ticks().collect()] == ["A"]
    assert store.bars().count() == 7


def test_empty_folder(spark, tmp_path):
    batch = files.read_tick_files(spark, folder(tmp_path))
    assert batch.rows.count() == 0 and batch.files.count() == 0


def test_refresh(spark, tmp_path):
    import datetime as dt

    store = Store(spark, str(tmp_path / "store"))
    known = tmp_path / "known"
    known.mkdir()
    ingest.ingest_bar_files(store, folder(known, EURUSD_M1_0=BARS), derive=False)
    landed = tmp_path / "landed"
    landed.mkdir()
    newer = BARS.replace("2024-01-02", "2024-02-02")
    where = folder(landed, EURUSD_M1_1=newer + "2024-01-20 00:00:00,1,1,1,1,1\n", NEW_M1_1=newer)
    now = dt.datetime(2024, 2, 3)
    report = ingest.refresh(store, where, days=7, now=now)
    assert {r.instrument for r in report.files.collect()} == {"EURUSD"}
    assert store.bars().where("timeframe = 'M1' AND timestamp > timestamp_ntz'2024-01-10 00:00:00'").count() == 2
    assert store.bars().where("timeframe = 'D1'").count() == 1
    ingest.refresh(store, where, days=7, now=now, instruments=["NEW"])
    assert store.bars().where("instrument = 'NEW' AND timeframe = 'M1'").count() == 2
    with pytest.raises(ValueError):
        ingest.refresh(store, where, days=0)
    bad = tmp_path / "bad"
    bad.mkdir()
    with pytest.raises(ValueError, match="every instrument failed"):
        ingest.refresh(store, folder(bad, EURUSD_M1_1=BARS + "nope,1,1,1,1,1\n"), now=now)


def test_rows_of_files_are_joined_with_nothing(spark, tmp_path):
    where = folder(tmp_path, A_M1_1=BARS, B_M1_1=TERMINAL, **{"C_M1_a+b %2B": BARS})
    found = good(files.read_bar_files(spark, where))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.name for r in found.collect()} == {"A_M1_1.csv", "B_M1_1.csv", "C_M1_a+b %2B.csv"}


def test_a_header_of_any_length(spark, tmp_path):
    wide = ",".join(["timestamp", "open", "high", "low", *(f"column_{k}" for k in range(9000)), "close"])
    row = ",".join(["2024-01-02 00:00:00", "1", "2", "0.5", *["x"] * 9000, "1.5"])
    assert good(files.read_bar_files(spark, folder(tmp_path, A_M1_1=f"{wide}\n{row}\n"))).first().close == 1.5


def test_surplus_fields_reject_a_file(spark, tmp_path):
    where = folder(tmp_path, A_M1_1=BARS, B_M1_1=BARS + "2024-01-02 00:02:00,1,2,0.5,1.5,7,8\n", C_M1_1=BARS + "2024-01-02 00:02:00,1,2,0.5,1.5\n")
    store = Store(spark, str(tmp_path / "store"))
    report = ingest.ingest_bar_files(store, where, derive=False)
    assert {r.instrument: (r.status, r.bad_rows) for r in report.files.collect()} == {"A": ("ok", 0), "B": ("error", 1), "C": ("ok", 0)}
    assert {r.instrument: r["count"] for r in store.bars().groupBy("instrument").count().collect()} == {"A": 2, "C": 3}


def test_a_second_header_rejects_a_terminal_export(spark, tmp_path):
    where = folder(tmp_path, A_M1_1=TERMINAL, B_M1_1=TERMINAL + TERMINAL)
    report = ingest.ingest_bar_files(Store(spark, str(tmp_path / "store")), where, derive=False)
    assert {r.instrument: r.status for r in report.files.collect()} == {"A": "ok", "B": "error"}


def test_wide_terminal_exports(spark, tmp_path):
    where = folder(tmp_path, A_M1_1=TERMINAL.encode("utf-16"), B_M1_1=TERMINAL.replace("\n", "\r\n").encode("utf-16"))
    found = good(files.read_bar_files(spark, where)).collect()
    assert sorted((r.instrument, str(r.timestamp), r.close) for r in found) == [(i, "2024-01-02 00:00:00", 1.5) for i in "AB"]


def test_a_file_that_cannot_be_opened_is_reported(spark, tmp_path, monkeypatch):
    where = folder(tmp_path, A_M1_1=BARS, B_M1_1=BARS)
    listed = files.list_files

    def with_a_lost_file(*given):
        rows = listed(*given)
        return rows.withColumn("path", files.F.when(rows.name == "B_M1_1.csv", "file:/nowhere/B_M1_1.csv").otherwise(rows.path))

    monkeypatch.setattr(files, "list_files", with_a_lost_file)
    batch = files.read_bar_files(spark, where)
    assert outcome(batch)["A_M1_1.csv"] is None and "cannot be opened" in outcome(batch)["B_M1_1.csv"]
    assert {r.instrument for r in good(batch).collect()} == {"A"}


def test_refresh_opens_wanted_files_only(spark, tmp_path):
    where = folder(tmp_path, EURUSD_M1_1=BARS, EURUSD_H1_1=BARS, OTHER_M1_1=BARS)
    batch = files.read_bar_files(spark, where, wanted=lambda f: f.where("timeframe = 'M1' AND instrument = 'EURUSD'"))
    assert [f.rsplit("/", 1)[1] for f in batch.rows.inputFiles()] == ["EURUSD_M1_1.csv"]
