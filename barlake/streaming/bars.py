"""Live bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlake.functions.timeframe import tick_targets, width, with_bucket
from barlake.operators import ladder
from barlake.schema import DERIVED, as_bars
from barlake.sources.store import Days, Store


def live_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of one timeframe over a stream of ticks, with late ticks counted up to `delay`.

    Watermarks need the zoned timestamp type, so the stream is taken as instants and the bar start is given back as
    naive UTC. In append mode a bar comes out when the watermark has passed it, in update mode with every change.
    """
    folded = (
        _instants(ticks, delay)
        .groupBy("instrument", F.window("timestamp", width(timeframe)).alias("bucket"))
        .agg(*_fold())
    )
    start = F.col("bucket.start").cast("timestamp_ntz")
    return as_bars(
        folded.withColumns({"timestamp": start, "timeframe": F.lit(timeframe), "source": F.lit(DERIVED)})
    )


def live_ladder(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bars of all seven levels over a stream of ticks, in one scan with one watermark and one state.

    The state holds the bars of the days that the watermark has not passed, at most 1,903 for each instrument and day; ticks
    are folded before they are shuffled to it. In update mode the bars of every level come out whenever they change, in
    append mode all bars of a day come out when the watermark has passed it.
    """
    rows = _instants(ticks, delay).withColumn("day", F.window("timestamp", width("D1")))
    for target in tick_targets():
        rows = with_bucket(rows, target, target)
    levels = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.col(t).alias("bucket")) for t in tick_targets()])
    fanned = rows.select("instrument", "day", "timestamp", "price", F.inline(levels))
    folded = fanned.groupBy("instrument", "day", "timeframe", "bucket").agg(*_fold())
    return as_bars(folded.withColumns({"timestamp": F.col("bucket").cast("timestamp_ntz"), "source": F.lit(DERIVED)}))


def ladder_into_store(
    store: Store, ticks: DataFrame, checkpoint: str, delay: str = "10 minutes", compact_after: int = 20
) -> StreamingQuery:
    """Writes the live ladder into a store, whose original bars stay; the ticks themselves are not kept.

    Each micro-batch appends the bars that it has changed as a delta; `compact_after` of them are merged into the partitions.
    A batch that is run twice changes nothing. Bars that the store holds already of a day of this stream are replaced.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with store.workspace() as stage:
            changed = stage(batch, "live")
            days = Days.of(changed.select("instrument", F.col("timestamp").cast("date").alias("date")).distinct(), ["instrument"], stage)
            if days.count:
                store.append_all({"bars": ladder.protect_raw(changed, store.on_days("bars", days))})
        if len(store.batches("bars")) >= compact_after:
            store.compact()

    writer = live_ladder(ticks, delay).writeStream.foreachBatch(step).outputMode("update")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _instants(ticks: DataFrame, delay: str) -> DataFrame:
    if ticks.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError("live bars need spark.sql.session.timeZone=UTC")
    return ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def _fold() -> list:
    return [
        F.min_by("price", "timestamp").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "timestamp").alias("close"),
    ]
