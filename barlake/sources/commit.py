"""Commits of whole partitions: written beside the tables, named in a journal, then moved into place one by one.

A commit becomes valid when its journal gets its name. Until then the tables are as they were, and what was written is
left over; from then on whoever opens the store moves the partitions that are still to be moved. Moving is idempotent, so it
doesn't matter where a driver died. The journal also holds texts (marks) that become valid with the partitions.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from barlake.sources import hadoop

JOURNAL = "commit.json"
FOLDER = "_commit"
#: Partitions that are moved at the same time.
MOVERS = 16


class Commit:
    """New content for partitions of the tables under `root`; nothing is visible before `publish`."""

    def __init__(self, spark: SparkSession, root: str, parts: dict[str, list[str]]):
        self.spark = spark
        self.root = root
        self.parts = parts
        self.folder = f"{root}/{FOLDER}/{uuid.uuid4().hex}"
        self.names: dict[str, list[str]] = {}
        self.gone: dict[str, list[str]] = {}
        self.whole: list[str] = []
        self.marks: dict[str, str] = {}

    def write(self, table: str, rows: DataFrame, replaces: list[str] = ()) -> None:
        """All rows of the partitions they fall into; those of `replaces` that get no rows will be gone.

        `rebalance` splits a partition too large for one task and joins small ones; files are sorted by time.
        """
        if table in self.names:
            raise ValueError(f"{table} has been written in this commit")
        parts = self.parts[table]
        ordered = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, "timestamp")
        ordered.write.partitionBy(*parts).parquet(self.path(table))
        found = hadoop.matching(self.spark, self.path(table) + "/*=*" * len(parts))
        self.names[table] = sorted("/".join(path.split("/")[-len(parts) :]) for path in found)
        self.gone[table] = sorted(set(replaces) - set(self.names[table]))

    def add(self, table: str, name: str, rows: DataFrame) -> None:
        """Rows in a folder of their own, in as few files as their size allows."""
        rows.hint("rebalance").sortWithinPartitions("timestamp").write.parquet(f"{self.path(table)}/{name}")
        self.names.setdefault(table, []).append(name)

    def write_whole(self, table: str, rows: DataFrame) -> None:
        """A small table that is replaced as a whole."""
        rows.coalesce(1).write.parquet(self.path(table))
        self.whole.append(table)

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def publish(self) -> None:
        journal = {"folder": self.folder, "names": self.names, "gone": self.gone, "whole": self.whole, "marks": self.marks}
        hadoop.write_text(self.spark, f"{self.root}/{JOURNAL}", json.dumps(journal))
        complete(self.spark, self.root)

    def discard(self) -> None:
        """Removes what was written, unless the commit is valid and only its moves are missing."""
        if read_journal(self.spark, self.root) is None:
            hadoop.remove(self.spark, self.folder)


def read_journal(spark: SparkSession, root: str) -> dict | None:
    """The journal of a commit that is still to be completed; a text that is none was never valid."""
    if not any(hadoop.exists(spark, f"{root}/{JOURNAL}{end}") for end in ("", hadoop.NEXT)):
        return None
    try:
        return json.loads(hadoop.read_text(spark, f"{root}/{JOURNAL}") or "null")
    except json.JSONDecodeError:
        return None


def complete(spark: SparkSession, root: str) -> bool:
    """Moves the partitions of a valid commit that are still beside the tables; tells whether there was such a commit."""
    journal = read_journal(spark, root)
    if journal is None:
        hadoop.remove_text(spark, f"{root}/{JOURNAL}")
        return False
    moves = [f"{table}/{name}" for table, names in journal["names"].items() for name in names]
    gone = [f"{table}/{name}" for table, names in journal["gone"].items() for name in names]
    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(lambda place: hadoop.remove(spark, f"{root}/{place}"), gone))
        list(pool.map(lambda place: hadoop.replace(spark, f"{journal['folder']}/{place}", f"{root}/{place}"), moves))
    for table in journal["whole"]:
        hadoop.replace(spark, f"{journal['folder']}/{table}", f"{root}/{table}")
    for name, text in journal["marks"].items():
        hadoop.write_text(spark, f"{root}/{name}", text)
    hadoop.remove_text(spark, f"{root}/{JOURNAL}")
    hadoop.remove(spark, journal["folder"])
    return True
