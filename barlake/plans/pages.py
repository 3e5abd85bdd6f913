"""Pages of a store that open only the partitions a page can come from.

The partials tell how many rows a partition has and when its last one is. Partitions that begin behind the page's key, taken
in the order of their ends until they fill the page, bound the time of its last row; nothing later is read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timeframe import check_instrument, check_timeframe
from barlake.functions.timestamps import naive_utc, ntz
from barlake.operators import query
from barlake.sources.store import Store

Moment = datetime | str


def page_bars(
    store: Store,
    limit: int = query.BAR_PAGE,
    after: dict | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
    instrument: str | None = None,
    timeframe: str | None = None,
) -> DataFrame:
    """A page of stored bars; see `query.page_bars`."""
    where = {"instrument": instrument and check_instrument(instrument), "timeframe": timeframe and check_timeframe(timeframe)}
    first = after["timestamp"] if after else start
    last = _last_needed(store, "bars", limit, first, end, where)
    return query.page_bars(store.bars(first, last), limit, after, start, end=end, instrument=instrument, timeframe=timeframe)


def page_ticks(
    store: Store, instrument: str, limit: int = query.TICK_PAGE, after: dict | None = None, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """A page of the stored ticks of an instrument; see `query.page_ticks`."""
    first = after["timestamp"] if after else start
    last = _last_needed(store, "ticks", limit, first, end, {"instrument": check_instrument(instrument)})
    return query.page_ticks(store.ticks(first, last), instrument, limit, after, start, end)


def _last_needed(store: Store, table: str, limit: int, first: Moment | None, end: Moment | None, where: dict) -> datetime | None:
    """A time up to which the page and one row more are found, or `end`.

    A partition has a row at least, so those that end first, one for each row, are enough to look at.
    """
    parts = store.partials(table)
    for column, value in where.items():
        parts = parts.where(F.col(column) == value) if value else parts
    if first is not None:
        parts = parts.where(F.col("first") > ntz(first))
    if end is not None:
        parts = parts.where(F.col("last") <= ntz(end))
    found = 0
    for part in parts.select("rows", "last").orderBy("last").limit(limit + 1).collect():
        found += part["rows"]
        if found > limit:
            return part["last"]
    return None if end is None else naive_utc(end)
