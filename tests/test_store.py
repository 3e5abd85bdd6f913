import json
import pathlib
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlake.operators import profile, query, repair
from barlake.plans import ingest, pages
from barlake.plans import repair as repair_plans
from barlake.sources import commit, hadoop, snapshot
from barlake.sources.store import Days, Store
from helpers import bars, minute_rows, same, second_ticks, ticks


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def fill(spark, store, minutes=30):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", minutes)))
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-03 09:00:00", 30)))


def test_empty_store(store):
    assert store.bars().count() == 0 and store.ticks().count() == 0
    row = profile.lake_summary(store.bars(), store.ticks()).first()
    assert (row.total_rows, row.instruments, row.timeframes, row.start) == (0, 0, [], None)


def test_ingest_and_derive(spark, store):
    report = ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 60)))
    counts = {r.timeframe: r["count"] for r in store.bars().groupBy("timeframe").count().collect()}
    assert counts == {"M1": 60, "M5": 12, "M15": 4, "M30": 2, "H1": 1, "H4": 1, "D1": 1}
    assert {r.timeframe: r.bars for r in report.derived.collect()} == {k: v for k, v in counts.items() if k != "M1"}


def test_twice_is_once(spark, store):
    data = bars(spark, minute_rows("2024-01-02 23:00:00", 120))
    ingest.ingest_bars(store, data)
    first = store.bars().collect()
    report = ingest.ingest_bars(store, data)
    assert sorted(map(repr, store.bars().collect())) == sorted(map(repr, first))
    row = report.series.first()
    assert (row.rows_in_batch, row.rows_new, row.rows_matched) == (120, 0, 120)


def test_raw_bar_survives_later_minutes(spark, store):
    hour = bars(spark, minute_rows("2024-01-02 00:00:00", 1, timeframe="H1", flat=999.0))
    ingest.ingest_bars(store, hour, derive=False)
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 60)))
    row = store.bars().where("timeframe = 'H1'").collect()
    assert [(r.open, r.source) for r in row] == [(999.0, "raw")]


def test_raw_bar_replaces_a_derived_one(spark, store):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 60)))
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 1, timeframe="H1", flat=999.0)))
    kept = {r.timeframe: (r.open, r.source) for r in store.bars().where("timeframe IN ('H1', 'H4')").collect()}
    assert kept == {"H1": (999.0, "raw"), "H4": (999.0, "derived")}


def test_late_rows_complete_the_day(spark, store):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 12:00:00", 60, flat=5.0)))
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 60, flat=1.0)))
    day = store.bars().where("timeframe = 'D1'").collect()
    assert [(r.open, r.close) for r in day] == [(1.0, 5.1)]


def test_tick_upsert_replaces_all_fields(spark, store):
    at = datetime(2024, 1, 1, 9)
    ingest.ingest_ticks(store, ticks(spark, [("A", at, 100.0, 5.0, 99.0, 101.0)]), derive=False)
    later = spark.createDataFrame([("A", at, 200.0)], "instrument string, timestamp timestamp_ntz, price double")
    ingest.ingest_ticks(store, later, derive=False)
    assert [tuple(r) for r in store.ticks().collect()] == [("A", at, 200.0, 0.0, None, None)]


def test_bad_batches_leave_the_store_as_it_was(spark, store):
    fill(spark, store)
    before = sorted(map(repr, store.bars().collect() + store.ticks().collect()))
    bad = ticks(spark, second_ticks("2024-01-04 09:00:00", 5)).withColumn("price", F.col("price") - 100.0)
    with pytest.raises(ValueError, match="price"):
        ingest.ingest_ticks(store, bad)
    with pytest.raises(ValueError, match="instrument"):
        ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 2, instrument="A/B")))
    with pytest.raises(ValueError, match="timeframe"):
        ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 2, timeframe="XX")))
    assert sorted(map(repr, store.bars().collect() + store.ticks().collect())) == before


def test_a_batch_without_good_rows_changes_nothing(spark, store):
    fill(spark, store)
    before = sorted(map(repr, store.bars().collect()))
    none = bars(spark, minute_rows("2024-01-02 00:00:00", 5)).withColumn("close", F.lit(float("nan")))
    report = ingest.ingest_bars(store, none)
    assert report.series.count() == 0 and report.derived.count() == 0
    ingest.ingest_ticks(store, ticks(spark, []))
    assert sorted(map(repr, store.bars().collect())) == before


def test_ladder_for_touched_days_only(spark, store):
    """Two far-apart days in one batch: the days between are not derived again."""
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-03 00:00:00", 10)), derive=False)
    data = bars(spark, minute_rows("2024-01-02 00:00:00", 10) + minute_rows("2024-01-05 00:00:00", 10))
    ingest.ingest_bars(store, data, scope="days")
    days = [r.timestamp.day for r in store.bars().where("timeframe = 'D1'").orderBy("timestamp").collect()]
    assert days == [2, 5]
    ingest.ingest_bars(store, data)
    days = [r.timestamp.day for r in store.bars().where("timeframe = 'D1'").orderBy("timestamp").collect()]
    assert days == [2, 3, 5]


def test_a_failed_ladder_writes_nothing(spark, store, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest.ladder, "ladder_from_ticks", fail)
    with pytest.raises(RuntimeError):
        ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-03 09:00:00", 30)))
    assert store.ticks().count() == 0 and store.bars().count() == 0


def everything(store):
    return sorted(map(repr, store.bars().collect())) + sorted(map(repr, store.ticks().collect()))


def left_over(store):
    root = pathlib.Path(store.root)
    return [p for p in (root / "commit.json", root / "commit.json.next") if p.exists()] + list((root / "_commit").glob("*"))


@pytest.mark.parametrize("moves", [0, 3])
def test_a_commit_that_died_between_its_moves_is_completed(spark, store, tmp_path, monkeypatch, moves):
    """Whatever a driver had moved when it died, and although the next partition was deleted already, no row is lost."""
    first, second = second_ticks("2024-01-31 23:59:00", 100), second_ticks("2024-01-31 23:59:50", 20) + second_ticks("2024-03-01 10:00:00", 5)
    ingest.ingest_ticks(store, ticks(spark, first))
    whole = Store(spark, str(tmp_path / "whole"))
    for batch in (first, second):
        ingest.ingest_ticks(whole, ticks(spark, batch))
    replace, done = hadoop.replace, []

    def dies(spark, source, target):
        if len(done) == moves:
            hadoop.remove(spark, target)
            raise RuntimeError("lost")
        done.append(target)
        replace(spark, source, target)

    monkeypatch.setattr(commit, "MOVERS", 1)
    monkeypatch.setattr(hadoop, "replace", dies)
    with pytest.raises(RuntimeError):
        ingest.ingest_ticks(store, ticks(spark, second))
    assert len(done) == moves
    monkeypatch.setattr(hadoop, "replace", replace)
    again = Store(spark, store.root)
    assert everything(again) == everything(whole)
    assert same_partials(again) and not left_over(again)
    assert everything(Store(spark, store.root)) == everything(whole)


def test_a_commit_that_died_before_its_journal_changes_nothing(spark, store, monkeypatch):
    fill(spark, store)
    before = everything(store)

    def dies(self):
        raise RuntimeError("lost")

    monkeypatch.setattr(commit.Commit, "publish", dies)
    for lost in (lambda: ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 3, flat=7.0))), lambda: repair_plans.shift_store(store, "Europe/Berlin")):
        with pytest.raises(RuntimeError):
            lost()
        assert everything(Store(spark, store.root)) == before and not left_over(store)


def test_a_journal_that_is_none_is_passed_over(spark, store):
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-03 09:00:00", 3)), derive=False)
    before = everything(store)
    for text in ("", "{", "null"):
        (pathlib.Path(store.root) / "commit.json").write_text(text)
        again = Store(spark, store.root)
        assert everything(again) == before and not left_over(again)


def test_small_texts_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    name = str(tmp_path / "text")
    assert hadoop.read_text(spark, name) is None
    hadoop.write_text(spark, name, "one")
    rename = hadoop._rename
    for dies_at in (1, 2):
        calls = []

        def dies(system, source, target, calls=calls, dies_at=dies_at):
            calls.append(target)
            if len(calls) == dies_at:
                raise OSError("lost")
            rename(system, source, target)

        monkeypatch.setattr(hadoop, "_rename", dies)
        with pytest.raises(OSError):
            hadoop.write_text(spark, name, "two")
        monkeypatch.setattr(hadoop, "_rename", rename)
        # before the new text is complete the old one is found, then the new one
        assert hadoop.read_text(spark, name) == ("one" if dies_at == 1 else "two")
    hadoop.write_text(spark, name, "three")
    assert hadoop.read_text(spark, name) == "three"
    hadoop.remove_text(spark, name)
    assert hadoop.read_text(spark, name) is None


def same_partials(store):
    """Whether the partials beside the tables say the same as a scan of the tables."""
    return all(
        same(found(*(store.partials(t) for t in tables)), found(*(getattr(store, t)() for t in tables)))
        for found, tables in (
            (profile.bar_coverage, ["bars"]),
            (profile.tick_coverage, ["ticks"]),
            (profile.bar_stats, ["bars"]),
            (profile.tick_stats, ["ticks"]),
            (profile.coverage_catalog, ["bars", "ticks"]),
            (profile.lake_summary, ["bars", "ticks"]),
            (profile.all_instruments, ["bars", "ticks"]),
            (profile.timeframes, ["bars", "ticks"]),
        )
    )


def test_partials_follow_every_change(spark, store, tmp_path):
    assert same_partials(store)
    fill(spark, store)
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:10:00", 40, "GBPUSD") + minute_rows("2018-01-02", 3, timeframe="W1", step=86400)))
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-03-31 03:00:00", 5, "GBPUSD")), derive=False)
    assert same_partials(store)
    snapshot.export_snapshot(store, str(tmp_path / "snap"))
    repair_plans.collapse_store(store)
    assert same_partials(store)
    repair_plans.shift_store(store, "Europe/Berlin")
    assert same_partials(store)
    snapshot.restore_snapshot(store, str(tmp_path / "snap"))
    assert same_partials(store)
    # a store of an earlier layout has none and is read
    hadoop.remove(spark, f"{store.root}/_partials")
    assert same_partials(store)


def test_summaries_read_no_prices(spark, store):
    fill(spark, store)
    for frame in (profile.lake_summary(store.partials("bars"), store.partials("ticks")), profile.bar_coverage(store.partials("bars"))):
        assert all("/_partials/" in path for path in frame.inputFiles())


def test_touched_partitions_are_read_once(spark, store, monkeypatch):
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-02 09:00:00", 50)), derive=False)
    scans, write = [], commit.Commit.write

    def counted(self, table, rows, replaces=()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # stored rows come with their partition's date, the staged batch has none
        scans.append(sum("Relation" in line and "date#" in line for line in plan.splitlines()))
        write(self, table, rows, replaces)

    monkeypatch.setattr(commit.Commit, "write", counted)
    report = ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-02 09:00:40", 20)), derive=False)
    assert scans == [1]
    row = report.series.first()
    assert (row.rows_in_file, row.rows_in_batch, row.rows_new, row.rows_matched) == (20, 20, 10, 10)


@pytest.mark.parametrize("limit", [25, 500])
def test_pages_of_a_store(spark, store, limit):
    """Pages follow each other over partitions and equal times; each opens the first partitions that are left only."""
    months = [row for month in range(1, 7) for name in ("A", "B") for row in second_ticks(f"2024-0{month}-28 23:59:50", 20, name)]
    ingest.ingest_ticks(store, ticks(spark, months), derive=False)
    ingest.ingest_bars(store, bars(spark, [row for year in (2021, 2022, 2023) for name in ("A", "B") for row in minute_rows(f"{year}-12-31 23:50:00", 20, name)]))
    for page, rows, key in (
        (lambda after: pages.page_ticks(store, "A", limit, after), store.ticks().where("instrument = 'A'").orderBy("timestamp"), ["timestamp"]),
        (lambda after: pages.page_bars(store, limit, after), store.bars().orderBy(*query.BAR_PAGE_KEY), query.BAR_PAGE_KEY),
    ):
        found, after, more = [], None, True
        while more and len(found) < 120:
            own = sorted(page(after).collect(), key=lambda r: tuple(r[k] for k in key))
            found += own
            more, after = own[-1].has_more, {k: own[-1][k] for k in key}
        wanted = [tuple(r[k] for k in key) for r in rows.collect()]
        assert [tuple(r[k] for k in key) for r in found] == wanted[: len(found)]
        assert len(found) >= min(len(wanted), 120)


def test_a_page_opens_the_first_partitions_only(spark, store):
    years = [row for year in range(2015, 2025) for row in minute_rows(f"{year}-06-01", 30)]
    ingest.ingest_bars(store, bars(spark, years), derive=False)
    ingest.ingest_ticks(store, ticks(spark, [row for month in range(1, 10) for row in second_ticks(f"2024-0{month}-05", 30)]), derive=False)
    opened = lambda frame: set(re.findall("(?:period|date)=([0-9-]+)", files_read(frame)))
    assert opened(pages.page_bars(store, 20)) == {"2015"}
    assert opened(pages.page_bars(store, 20, start="2020-01-01")) == {"2020"}
    assert opened(pages.page_ticks(store, "EURUSD", 40, start="2024-03-02")) == {"2024-03-01", "2024-04-01"}
    assert pages.page_bars(store, 20, start="2030-01-01").count() == 0


def files_read(frame):
    """What a plan says of the files that it opens, after partitions have been pruned."""
    frame.collect()
    found, todo = "", [frame._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif name.startswith("Scan"):
            partitions = plan.selectedPartitions()
            listed = partitions.filePartitionIterator()
            while listed.hasNext():
                found += listed.next().files().mkString(" ")
        else:
            children = plan.children()
            todo += [children.apply(k) for k in range(children.size())]
            if name.endswith("QueryStage"):
                todo.append(plan.plan())
    return found


def test_names_given_with_the_call(spark, store):
    data = spark.sql("SELECT '2024-01-02T02:00:00+02:00' timestamp, 1 open, 2 high, 0 low, 1 close, 5 volume")
    ingest.ingest_bars(store, data, "600519", "h1")
    row = store.bars().where("timeframe = 'H1'").first()
    assert (row.instrument, row.timestamp, row.source) == ("600519", datetime(2024, 1, 2), "raw")
    with pytest.raises(ValueError, match="instrument"):
        ingest.ingest_bars(store, data)


def test_other_partitions_are_left_alone(spark, store, tmp_path):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 5) + minute_rows("2025-01-02", 5)), derive=False)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "bars").rglob("*.parquet") if "period=2024" in str(f)}
    ingest.ingest_bars(store, bars(spark, minute_rows("2025-01-02", 5, flat=3.0)), derive=False)
    assert files and all(f.exists() and f.stat().st_mtime_ns == t for f, t in files.items())
    assert store.bars().count() == 10


def test_range_scan_is_pruned(spark, store):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 5) + minute_rows("2025-01-02", 5)), derive=False)
    found = query.select_range(store.bars("2025-01-01", "2025-12-31"), instrument="EURUSD", timeframe="M1")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert found.count() == 5
    assert "GreaterThanOrEqual(timestamp" in plan.split("PushedFilters")[1].split("\n")[0]
    partitions = plan.split("PartitionFilters")[1].split("\n")[0]
    assert all(name in partitions for name in ("period", "instrument", "timeframe"))


def test_layout_is_kept(spark, tmp_path):
    Store(spark, str(tmp_path))
    assert not list(tmp_path.iterdir()), "opening a store writes nothing"
    ingest.ingest_ticks(Store(spark, str(tmp_path), tick_period="day"), ticks(spark, second_ticks("2024-01-03", 3)))
    assert Store(spark, str(tmp_path)).tick_period == "day"
    assert Store(spark, str(tmp_path)).ticks().count() == 3
    with pytest.raises(ValueError, match="layout"):
        Store(spark, str(tmp_path), tick_period="month")


def test_work_files_are_removed(spark, store):
    fill(spark, store)
    assert not list(pathlib.Path(store.staging).glob("work-*"))


def read_partitions(frame):
    found = {"/".join(p.split("=", 1)[1] for p in f.split("/")[-4:-1] if "=" in p) for f in frame.inputFiles()}
    return found - {""}  # the staged list of days


@pytest.mark.parametrize("bound", [100_000, 0])
def test_only_partitions_of_the_days_are_read(spark, store, monkeypatch, bound):
    """The same rows, partitions and report whether the list of days is broadcast or not."""
    monkeypatch.setattr("barlake.sources.store.BROADCAST_DAYS", bound)
    years = [f"{year}-01-02" for year in range(2019, 2025)]
    data = [row for day in years for row in minute_rows(day, 5)] + minute_rows("2024-01-02", 5, "GBPUSD")
    ingest.ingest_bars(store, bars(spark, data), scope="days")
    two = bars(spark, minute_rows("2020-01-02", 5, flat=2.0) + minute_rows("2023-01-02", 5, flat=3.0))
    report = ingest.ingest_bars(store, two, scope="days")
    assert {r.bars for r in report.derived.collect()} == {2}
    days = Days.of(two.selectExpr("instrument", "timeframe", "CAST(timestamp AS DATE) date").distinct(), ["instrument", "timeframe"], store.stage)
    found = store.on_days("bars", days)
    assert found.count() == 10
    assert read_partitions(found) == {"EURUSD/M1/2020", "EURUSD/M1/2023"}
    touched = store.touched("bars", two)
    assert read_partitions(touched) == {"EURUSD/M1/2020", "EURUSD/M1/2023"}
    wide = read_partitions(store.on_days("bars", days.per_instrument()))
    assert {p for p in wide if "/M1/" in p or "/M5/" in p} == {f"EURUSD/{t}/{y}" for t in ("M1", "M5") for y in (2020, 2023)}
    assert not any(p.startswith("GBPUSD") for p in wide)


def test_a_report_does_not_follow_later_runs(spark, store):
    report = ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02", 5)))
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 06:00:00", 60)))
    assert {r.timeframe: r.bars for r in report.derived.collect()}["M5"] == 1


def test_ticks_across_periods(spark, store):
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-31 23:59:50", 20) + second_ticks("2024-03-01", 20)))
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-31 23:59:50", 20)))
    assert store.ticks().count() == 40
    assert store.bars().groupBy("instrument", "timeframe", "timestamp").count().where("count > 1").count() == 0


def test_derive_jobs(spark, store):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 00:00:00", 60)), derive=False)
    found = ingest.derive_stored_bars(store, "m1", "2024-01-02 00:10:00", "2024-01-02 00:20:00")
    assert {r.timeframe: r.bars for r in found.collect()} == {"M5": 12, "M15": 4, "M30": 2, "H1": 1, "H4": 1, "D1": 1}
    assert ingest.derive_stored_bars(store, "D1", "2024-01-02", "2024-01-02").count() == 0


def test_snapshot_round_trip(spark, store, tmp_path):
    fill(spark, store)
    folder = str(tmp_path / "snap")
    manifest = snapshot.export_snapshot(store, folder)
    assert manifest["schema_version"] == 1
    assert manifest["ohlc"]["row_count"] == store.bars().count()
    assert manifest["ticks"] == {"path": f"{folder}/ticks", "row_count": 30, "partition_by": ["instrument"]}
    assert (tmp_path / "snap" / "ohlc" / "instrument=EURUSD" / "timeframe=M1").is_dir()
    target = Store(spark, str(tmp_path / "other"))
    ingest.ingest_bars(target, bars(spark, minute_rows("2024-01-02 00:00:00", 3, "OTHER")), derive=False)
    for _ in range(2):
        done = snapshot.restore_snapshot(target, folder)
        assert done["ticks_rows_restored"] == 30
    assert same(target.bars().where("instrument != 'OTHER'"), store.bars())
    assert target.bars().where("instrument = 'OTHER'").count() == 3
    assert same(target.ticks(), store.ticks())


def test_snapshot_of_an_empty_store(spark, store, tmp_path):
    folder = str(tmp_path / "snap")
    assert snapshot.export_snapshot(store, folder)["ohlc"]["row_count"] == 0
    assert not list((tmp_path / "snap" / "ohlc").rglob("*.parquet"))
    assert snapshot.restore_snapshot(store, folder) == {"ohlc_rows_restored": 0, "ticks_rows_restored": 0}


def test_snapshot_replaces_an_older_one(spark, store, tmp_path):
    folder = str(tmp_path / "snap")
    fill(spark, store)
    snapshot.export_snapshot(store, folder)
    empty = Store(spark, str(tmp_path / "empty"))
    snapshot.export_snapshot(empty, folder)
    assert snapshot.restore_snapshot(empty, folder)["ohlc_rows_restored"] == 0 and empty.bars().count() == 0


def test_bad_manifests(spark, store, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshot.restore_snapshot(store, str(tmp_path / "nothing"))
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 999}, indent=1))
    with pytest.raises(ValueError, match="999"):
        snapshot.restore_snapshot(store, str(tmp_path))


def test_older_snapshots_get_defaults(spark):
    old = spark.sql("SELECT 'A' instrument, CAST(NULL AS STRING) source, CAST(NULL AS DOUBLE) volume")
    assert snapshot.restored_rows(old, "bars").first().source == "raw"
    assert snapshot.restored_rows(old, "ticks").first().volume == 0.0


def test_csv_download(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 4, 5)
    rows = ticks(spark, [("A", at.replace(microsecond=500), 1.5, 0.0, None, 2.0), ("A", at, 1.0, 0.0, 1.0, None)])
    snapshot.write_csv(query.query_ticks(rows, "A", ordered=False), str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*.csv"))
    lines = [line for part in parts for line in part.read_text().splitlines()]
    body = [line for line in lines if not line.startswith("timestamp")]
    assert lines[0] == "timestamp,price,volume,bid,ask"
    assert body == ["2024-01-02 03:04:05,1.0,0.0,1.0,", "2024-01-02 03:04:05.000500,1.5,0.0,,2.0"]


def test_shift_of_a_store(spark, store):
    rows = [
        ("A", datetime(2024, 3, 31, 2, 30), 1.0, 1.0, 7.0, None),  # does not exist in Berlin, is 01:30 UTC
        ("A", datetime(2024, 3, 31, 3, 30), 2.0, 2.0, None, 8.0),  # is 01:30 UTC
        ("A", datetime(2024, 10, 27, 2, 30), 3.0, 1.0, 1.0, 1.0),  # occurs twice, the later is 01:30 UTC
    ]
    ingest.ingest_ticks(store, ticks(spark, rows), derive=False)
    report = {r.table: (r.rows_before, r.rows_after, r.rows_deduplicated) for r in repair_plans.shift_store(store, "Europe/Berlin").collect()}
    assert report == {"bars": (0, 0, 0), "ticks": (3, 2, 1)}
    assert sorted(tuple(r) for r in store.ticks().collect()) == [
        ("A", datetime(2024, 3, 31, 1, 30), 2.0, 2.0, 7.0, 8.0),
        ("A", datetime(2024, 10, 27, 1, 30), 3.0, 1.0, 1.0, 1.0),
    ]
    with pytest.raises(ValueError, match="zone"):
        repair.shift_ticks(store.ticks(), "Mars/Olympus")
    with pytest.raises(ValueError, match="has been shifted"):
        repair_plans.shift_store(store, "Europe/Berlin")
    assert store.ticks().count() == 2


@pytest.mark.parametrize("moves", [1])
def test_a_shift_that_died_is_completed(spark, store, monkeypatch, moves):
    ingest.ingest_bars(store, bars(spark, minute_rows("2024-01-02 10:00:00", 3)), derive=False)
    ingest.ingest_ticks(store, ticks(spark, second_ticks("2024-01-02 10:00:00", 3)), derive=False)
    replace, done = hadoop.replace, []

    def dies(*place):
        if len(done) == moves:
            raise RuntimeError("lost")
        done.append(place)
        replace(*place)

    monkeypatch.setattr(commit, "MOVERS", 1)
    monkeypatch.setattr(hadoop, "replace", dies)
    with pytest.raises(RuntimeError):
        repair_plans.shift_store(store, "Europe/Berlin")
    monkeypatch.setattr(hadoop, "replace", replace)
    with pytest.raises(ValueError, match="has been shifted"):
        repair_plans.shift_store(Store(spark, store.root), "Europe/Berlin")
    assert {r.h for r in store.bars().select(F.hour("timestamp").alias("h")).collect()} == {9}
    assert {r.h for r in store.ticks().select(F.hour("timestamp").alias("h")).collect()} == {9}


def test_any_source_is_kept(spark, store):
    rows = minute_rows("2024-01-02 10:00:00", 2, source="vendor") + minute_rows("2018-01-02", 2, timeframe="W1", source="vendor")
    store.merge_bars(bars(spark, rows))
    repair_plans.collapse_store(store)
    repair_plans.shift_store(store, "Europe/Berlin")
    assert {r.source for r in store.bars().collect()} == {"vendor"}


def test_a_collapse_rewrites_changed_partitions_only(spark, store, tmp_path):
    store.merge_bars(bars(spark, minute_rows("2018-01-02", 2, timeframe="D1", step=3600) + minute_rows("2018-01-02", 1, "GBPUSD", "D1") + minute_rows("2018-01-02", 3)))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "bars").rglob("*.parquet")}
    repair_plans.collapse_store(store)
    gone = [f for f, t in files.items() if not f.exists() or f.stat().st_mtime_ns != t]
    assert len(gone) == 1 and "instrument=EURUSD/timeframe=D1" in str(gone[0])
    assert store.bars().count() == 5


def test_bars_of_equal_times_in_any_order(spark):
    from barlake.operators import dedupe

    rows = [("A", "M1", datetime(2024, 1, 2), price, price, price, price, "raw") for price in (1.0, 3.0, 2.0)]
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert dedupe.latest_bars(bars(spark, given)).first().open == 3.0


def test_collapse_of_a_store(spark, store):
    rows = minute_rows("2018-01-02 00:00:00", 3, timeframe="W1", step=86400) + minute_rows("2018-01-02", 2, timeframe="H1", step=60)
    store.merge_bars(bars(spark, rows))
    assert repair_plans.collapse_store(store, dry_run=True).first().rows_removed == 2
    assert store.bars().count() == 5
    repair_plans.collapse_store(store)
    kept = store.bars().where("timeframe = 'W1'").collect()
    assert [(r.timestamp, r.open) for r in kept] == [(datetime(2018, 1, 1), 100.0)]
    assert store.bars().where("timeframe = 'H1'").count() == 2



def test_a_dense_day_is_not_brought_into_one_task(spark, store):
    fill(spark, store)
    wanted = store.ticks().select("instrument", F.col("timestamp").cast("date").alias("date")).distinct()
    days = Days.of(wanted, ["instrument"], store.stage)
    found = store.on_days("ticks", days)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30
