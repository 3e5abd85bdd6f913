"""Continuous ingest of landed files: each micro-batch is upserted and its days are derived again.

Late rows need no watermark: they change the days they belong to. A batch that is run twice changes nothing. With
`compact_after` a micro-batch is kept as a delta, so a late row writes itself and the bars of its buckets, not its partitions;
once that many deltas wait they are merged into the partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barlake.operators import quality
from barlake.plans import ingest
from barlake.schema import BARS, TICKS
from barlake.sources.store import Store

TICK_TEXT = "timestamp string, price string, volume string, bid string, ask string"
BAR_TEXT = "timestamp string, open string, high string, low string, close string"


def landed_parquet(spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files as they land; `max_files` bounds one micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def landed_csv(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """Comma-separated files of one header, named INSTRUMENT_TIMEFRAME_... ; every field stays text."""
    reader = spark.readStream.schema(columns).option("header", True).option("pathGlobFilter", "*.csv")
    parts = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), "_")
    rows = reader.csv(folder)
    return rows.withColumns({"instrument": F.get(parts, 0), "timeframe": F.upper(F.get(parts, 1))})


def ingest_tick_stream(
    store: Store, stream: DataFrame, checkpoint: str, rejects: str | None = None, compact_after: int | None = None
) -> StreamingQuery:
    """Ticks of a stream into the store, with the ladder of every touched instrument and day."""

    def load(batch: DataFrame) -> None:
        ingest.ingest_ticks(store, batch.select(*TICKS.names), scope="days", deltas=compact_after is not None)
        _compact(store, "ticks", compact_after)

    return _run(store, stream, checkpoint, quality.judged_ticks, load, rejects)


def ingest_bar_stream(
    store: Store, stream: DataFrame, checkpoint: str, rejects: str | None = None, compact_after: int | None = None
) -> StreamingQuery:
    """Bars of a stream into the store, with the ladder of every touched series and day."""

    def load(batch: DataFrame) -> None:
        ingest.ingest_bars(store, batch.select(*BARS.names[:-1]), scope="days", deltas=compact_after is not None)
        _compact(store, "bars", compact_after)

    return _run(store, stream, checkpoint, quality.judged_bars, load, rejects)


def _compact(store: Store, table: str, after: int | None) -> None:
    if after is not None and len(store.batches(table)) >= after:
        store.compact()


def _run(
    store: Store,
    stream: DataFrame,
    checkpoint: str,
    judge: Callable[[DataFrame], DataFrame],
    load: Callable[[DataFrame], None],
    rejects: str | None,
) -> StreamingQuery:
    """With a `rejects` folder bad rows are set aside there, one folder per batch; without one they fail the batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if rejects is None:
            load(batch)
            return
        with store.workspace() as stage:
            judged = stage(quality.judge_names(judge(batch)), "stream")
            quality.rejected(judged).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            load(quality.accepted(judged))

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
