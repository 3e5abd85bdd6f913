"""Snapshot export with a manifest, restore, and CSV download."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timestamps import iso_text
from barlake.schema import BARS, RAW, TICKS
from barlake.sources import hadoop
from barlake.sources.store import Store

# Manifest version and names, folder names and partitioning of a snapshot.
SCHEMA_VERSION = 1
MANIFEST = "manifest.json"
FOLDERS = {"bars": "ohlc", "ticks": "ticks"}
PARTITION_BY = {"bars": ["instrument", "timeframe"], "ticks": ["instrument"]}


def export_snapshot(store: Store, folder: str) -> dict:
    """Write both tables partitioned by series, replacing an earlier export in `folder`, and a manifest."""
    manifest = {
        "schema_version": SCHEMA_VERSION,
        "exported_at": datetime.now(timezone.utc).isoformat(),
        "output_dir": folder,
    }
    for table, sub in FOLDERS.items():
        rows = store.bars() if table == "bars" else store.ticks()
        path = f"{folder}/{sub}"
        parts = PARTITION_BY[table]
        # The static overwrite wipes an earlier export; an empty table leaves no data file behind.
        (
            rows.hint("rebalance", *parts)
            .sortWithinPartitions(*parts, "timestamp")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*parts)
            .parquet(path)
        )
        manifest[FOLDERS[table]] = {
            "path": path,
            "row_count": _snapshot_rows(store, path, table).count(),
            "partition_by": parts,
        }
    hadoop.write_text(store.spark, f"{folder}/{MANIFEST}", json.dumps(manifest, indent=2))
    return manifest


def read_manifest(store: Store, folder: str) -> dict:
    text = hadoop.read_text(store.spark, f"{folder}/{MANIFEST}")
    if text is None:
        raise FileNotFoundError(f"no manifest in {folder}")
    manifest = json.loads(text)
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"unsupported schema_version {manifest.get('schema_version')}; expected {SCHEMA_VERSION}")
    return manifest


def restore_snapshot(store: Store, folder: str) -> dict:
    """Merge a snapshot into the store by one commit: its rows win, rows it lacks stay. Running it twice changes nothing."""
    manifest = read_manifest(store, folder)
    counts = {table: manifest[sub]["row_count"] for table, sub in FOLDERS.items()}
    with store.workspace() as stage:
        rows = {
            table: stage(restored_rows(_snapshot_rows(store, manifest[FOLDERS[table]]["path"], table), table), table)
            for table, count in counts.items()
            if count
        }
        if rows:
            store.merge_all(rows)
    return {f"{FOLDERS[table]}_rows_restored": count for table, count in counts.items()}


def restored_rows(rows: DataFrame, table: str) -> DataFrame:
    """Snapshot rows with the defaults of older snapshots filled in."""
    if table == "bars":
        return rows.withColumn("source", F.coalesce("source", F.lit(RAW)))
    return rows.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def _snapshot_rows(store: Store, path: str, table: str) -> DataFrame:
    schema = BARS if table == "bars" else TICKS
    return store.spark.read.schema(schema).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, in order of timestamp: the files follow each other in time, none is one task's whole."""
    text = [iso_text(c, " ").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes]
    rows.orderBy("timestamp").select(*text).write.mode("overwrite").csv(path, header=True)
