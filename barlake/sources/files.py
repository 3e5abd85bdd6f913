"""Price files: bars and ticks in several vendor layouts, routed by their header line.

All files of one layout and header are read by one scan; a folder is one union of a few scans. Instrument and
timeframe come from the file name (INSTRUMENT_TIMEFRAME_...csv) unless they are given.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.timeframe import valid_instrument, valid_timeframe
from barlake.functions.timestamps import parse_terminal
from barlake.operators import quality
from barlake.schema import PRICES
from barlake.session import empty
from barlake.sources import hadoop

# Header marks and column names of the vendor layouts.
DATE, TIME = "<DATE>", "<TIME>"
TERMINAL_BARS = {"<OPEN>": "open", "<HIGH>": "high", "<LOW>": "low", "<CLOSE>": "close"}
TERMINAL_TICKS = {"<BID>": "bid", "<ASK>": "ask", "<LAST>": "price", "<VOLUME>": "volume"}
GMT_TIME = "gmt time"
TICK_NAME = "_TICK_"
TICK_FIELDS = ["timestamp", "price", "volume", "bid", "ask"]

TERMINAL, GMT, PLAIN = "terminal", "gmt", "plain"
SURPLUS = "_surplus"
LISTED = ["file", "name", "instrument", "timeframe", "layout", "error"]
# Files whose first line the driver reads at the same time.
OPEN_AT_ONCE = 16


@dataclass
class FileBatch:
    """`rows`: parsed rows of all readable files with `file`, `name`, `instrument`, `timeframe` and `reason` (null = good).
    `files`: one row per file with `error` (null = readable)."""

    rows: DataFrame
    files: DataFrame


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder; only names are read, as the content column is pruned.

    `file` is the name that the scans report for their rows, in which special characters are escaped; `path` opens it.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return found.select(F.col("_metadata.file_path").alias("file"), "path", name)


def with_headers(spark: SparkSession, files: list[Row]) -> list[dict]:
    """The files with the first line and the text encoding of each, or why it can't be opened, as `error`.

    The file system of the cluster opens them, with its credentials; the driver lists the files anyway and reads one line
    of each, several at a time.
    """

    def described(row: Row) -> dict:
        found = {**row.asDict(), "header": "", "encoding": "UTF-8"}
        if found["error"] is None:
            try:
                found["header"], found["encoding"] = _decoded(hadoop.first_line(spark, found["path"]))
            except Py4JJavaError as problem:
                found["error"] = f"cannot be opened: {problem.java_exception.getMessage()}"
        return found

    with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
        return list(pool.map(described, files))


def _decoded(start: bytes) -> tuple[str, str]:
    """The first line and its encoding: UTF-8 unless the bytes say otherwise."""
    try:
        return start.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r"), "UTF-8"
    except UnicodeDecodeError:
        text = start[: len(start) // 2 * 2].decode("utf-16", "replace")
        return text.split("\n", 1)[0].rstrip("\r"), "UTF-16"


def bar_layout(header: str) -> str:
    return TERMINAL if DATE in header else PLAIN


def tick_layout(header: str) -> str:
    low = header.lower()
    if DATE in header and ("<BID>" in header or "<LAST>" in header):
        return TERMINAL
    quotes = "bid" in low and "ask" in low and "open" not in low
    return GMT if GMT_TIME in low or quotes else PLAIN


def read_bar_files(
    spark: SparkSession,
    folder: str,
    instrument: str | None = None,
    timeframe: str | None = None,
    column_map: dict[str, str] | None = None,
    wanted: Callable[[DataFrame], DataFrame] | None = None,
) -> FileBatch:
    """Bar files of a folder; `wanted` picks from the listing (name, instrument, timeframe) before any file is opened."""
    files = _described(list_files(spark, folder), instrument, timeframe)
    given = (instrument, timeframe and timeframe.upper())
    return _read(spark, wanted(files) if wanted else files, bar_layout, _bar_frame, [*PRICES], column_map, given)


def read_tick_files(spark: SparkSession, folder: str, instrument: str | None = None) -> FileBatch:
    """Tick files of a folder; without a given instrument only files named INSTRUMENT_TICK_... are taken."""
    listed = list_files(spark, folder)
    if instrument is None:
        listed = listed.where(F.upper("name").contains(TICK_NAME))
    files = _described(listed, instrument, "TICK")
    return _read(spark, files, tick_layout, _tick_frame, TICK_FIELDS[1:], None, (instrument, "TICK"))


def _series(name: Column, instrument: str | None, timeframe: str | None) -> tuple[Column, Column, Column]:
    """Instrument and timeframe of a file name, unless they are given, and the parts of the name."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return F.lit(instrument) if instrument else F.get(parts, 0), F.upper(F.lit(timeframe) if timeframe else F.get(parts, 1)), parts


def _described(files: DataFrame, instrument: str | None, timeframe: str | None) -> DataFrame:
    """Instrument and timeframe of each file, and why it cannot be used, if so."""
    own_instrument, own_timeframe, parts = _series(F.col("name"), instrument, timeframe)
    unnamed = (F.size(parts) < 2) if instrument is None or timeframe is None else F.lit(False)
    described = files.withColumns({"instrument": own_instrument, "timeframe": own_timeframe})
    error = (
        F.when(unnamed, "file name does not match INSTRUMENT_TIMEFRAME_*")
        .when(~valid_instrument("instrument"), "invalid instrument")
        .when(~valid_timeframe("timeframe"), "invalid timeframe")
    )
    return described.withColumn("error", error)


def _read(spark: SparkSession, files: DataFrame, layout_of, frame, values: list[str], column_map, given) -> FileBatch:
    """One scan per (layout, header, encoding); the driver sees one line per file, never its rows.

    Rows tell their file by its name, from which instrument and timeframe follow, so they are joined with nothing.
    """
    described = with_headers(spark, sorted(files.collect(), key=lambda row: row["name"]))
    groups = defaultdict(list)
    for row in described:
        row["layout"] = layout_of(row["header"])
        if row["error"] is None:
            groups[row["layout"], row["header"], row["encoding"]].append(row)
    scans = []
    for (layout, header, encoding), members in groups.items():
        try:
            scans.append(frame(spark, layout, header, encoding, [m["path"] for m in members], column_map))
        except ValueError as problem:
            for member in members:
                member["error"] = str(problem)
    columns = ["file", "timestamp", *values, "reason"]
    fields = [T.StructField(c, T.DoubleType() if c in values else T.StringType()) for c in columns]
    fields[1] = T.StructField("timestamp", T.TimestampNTZType())
    rows = empty(spark, T.StructType(fields))
    for scan in scans:
        rows = rows.unionByName(_conform(scan, rows.schema))
    # the scan reports names with special characters escaped; a plus sign stands for itself there
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    instrument, timeframe, _ = _series(F.col("name"), *given)
    rows = rows.withColumn("name", name).withColumns({"instrument": instrument, "timeframe": timeframe})
    listed = ", ".join(f"{c} string" for c in LISTED)
    return FileBatch(rows, spark.createDataFrame([tuple(row[c] for c in LISTED) for row in described], listed))


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    absent = {"volume": F.lit(0.0)}
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else absent.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _bar_frame(spark, layout, header, encoding, paths, column_map) -> DataFrame:
    if layout == TERMINAL:
        return quality.judged_bars(_terminal(spark, header, encoding, paths, TERMINAL_BARS))
    return _without_surplus(quality.judged_bars(_comma(spark, header, encoding, paths), column_map))


def _tick_frame(spark, layout, header, encoding, paths, _) -> DataFrame:
    if layout == TERMINAL:
        return quality.judged_ticks(_terminal(spark, header, encoding, paths, TERMINAL_TICKS))
    raw = _comma(spark, header, encoding, paths)
    if layout == GMT:
        stamp = next((c for c in raw.columns if "gmt" in c or "time" in c), None)
        raw = raw.withColumnRenamed(stamp, "timestamp") if stamp else raw
        raw = raw.select("file", SURPLUS, *[c for c in raw.columns if c in TICK_FIELDS])
    return _without_surplus(quality.judged_ticks(raw, day_first=layout == GMT))


def _without_surplus(judged: DataFrame) -> DataFrame:
    """A row with more fields than the header has is bad, whatever its fields say."""
    reason = F.when(F.col(SURPLUS), quality.BAD_ROW).otherwise(F.col("reason"))
    return judged.withColumn("reason", reason).drop(SURPLUS)


def _wide(reader, encoding: str):
    """Wider characters: without this the reader looks for one-byte line ends and corrupts the rows."""
    return reader.option("encoding", encoding).option("multiLine", encoding != "UTF-8")


def _comma(spark: SparkSession, header: str, encoding: str, paths: list[str]) -> DataFrame:
    """Comma-separated text with a header; every field stays text, named by the header in lower case."""
    names, seen = [], set()
    for position, name in enumerate(next(csv.reader([header]))):
        plain = name.strip().lower()
        names.append(plain if plain and plain not in seen else f"_field{position}")
        seen.add(plain)
    # all fields are parsed, as a reader of some columns would not notice surplus ones
    reader = _wide(spark.read.option("header", True), encoding).option("columnNameOfCorruptRecord", "_odd").option("columnPruning", False)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_odd"])
    rows = reader.schema(schema).csv(paths).withColumn("file", F.col("_metadata.file_path"))
    # the reader sets odd rows aside as text: those with too few fields, which are null then, and those with too many
    found = F.size(F.split(F.regexp_replace("_odd", '"[^"]*"', ""), ","))
    return rows.withColumn(SURPLUS, F.coalesce(found > len(names), F.lit(False))).drop("_odd")


def _terminal(spark: SparkSession, header: str, encoding: str, paths: list[str], names: dict[str, str]) -> DataFrame:
    """Whitespace-separated text with <DATE>, optional <TIME> and bracketed value names.

    Each line is read as one field, so that the reader takes the header off the begin of each file and nowhere else: a
    second header within a file is a row without a time.
    """
    fields = header.split()
    reader = _wide(spark.read.option("header", True).option("sep", "\u0001").option("quote", ""), encoding)
    lines = reader.schema("value string").csv(paths).withColumn("file", F.col("_metadata.file_path"))
    lines = lines.where(F.trim("value") != "")
    # The split is a column of its own, so that it is made once for all fields of a line.
    lines = lines.select("file", F.split(F.trim("value"), r"\s+").alias("parts"))
    time = F.get("parts", F.lit(fields.index(TIME))) if TIME in fields else None
    values = {new: F.get("parts", F.lit(fields.index(old))) for old, new in names.items() if old in fields}
    return lines.select(
        "file",
        parse_terminal(F.get("parts", F.lit(fields.index(DATE))), time).alias("timestamp"),
        *[col.alias(name) for name, col in values.items()],
    )
