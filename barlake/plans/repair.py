"""Repairs applied to a store; both can be run again after a failure."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import with_bucket_start
from barlake.operators import dedupe, repair
from barlake.sources import hadoop
from barlake.sources.store import Store

SHIFT_MARK = "shift.json"


def shift_store(store: Store, zone: str) -> DataFrame:
    """Take all stored times as local to `zone` and move them to UTC; returns the counts of what was to do.

    Both tables and the mark that the store has been shifted are one commit, so a run that died has shifted nothing or is
    completed by the next one. A store that has been shifted is refused.
    """
    if mark := hadoop.read_text(store.spark, f"{store.root}/{SHIFT_MARK}"):
        raise ValueError(f"the store has been shifted from {json.loads(mark)['zone']}")
    report = store.stage(repair.shift_report(store.bars(), store.ticks(), zone), "report")
    with store.pending() as pending:
        pending.replace_all("bars", repair.shift_bars(store.bars(), zone))
        pending.replace_all("ticks", repair.shift_ticks(store.ticks(), zone))
        pending.mark(SHIFT_MARK, json.dumps({"zone": zone}))
        pending.publish()
    return report


def collapse_store(
    store: Store, timeframes: tuple[str, ...] = dedupe.OFFSET_TIMEFRAMES, dry_run: bool = False
) -> DataFrame:
    """Collapse offset-stamped duplicates; with `dry_run` only report what would go.

    Only partitions that hold a bar off its bucket are rewritten, by one write; a second run finds none.
    """
    if not dry_run:
        store.compact()
    report = store.stage(dedupe.collapse_report(store.bars(), timeframes), "report")
    if not dry_run:
        chosen = store.bars().where(F.col("timeframe").isin(*timeframes))
        off = with_bucket_start(chosen, "bucket").where("bucket <> timestamp").drop("bucket")
        with store.workspace() as stage:
            names = store.partitions("bars", stage(off, "off"))
            held = store.touched("bars", off, names)
            if names:
                store.overwrite("bars", dedupe.collapse_offset_bars(held, timeframes), names)
    return report
