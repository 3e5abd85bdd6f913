"""Text timestamps to naive UTC, and local wall-clock times to UTC."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted date spellings and their ISO order; a zone at the end of the text.
YEAR_FIRST = (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
COMPACT = (r"^(\d{4})(\d{2})(\d{2})(?=$|[ T])", "$1-$2-$3")
DAY_FIRST = (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})", "$3-$2-$1")
MONTH_FIRST = (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})", "$3-$1-$2")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NAMED_MONTH = r"^(?i)(?:(\d{1,2})[ -]*([a-z]{3})[a-z]*\.?,?[ -]*(\d{4})|([a-z]{3})[a-z]*\.? *(\d{1,2}),? +(\d{4}))(?=$|[ T,])"
COMPACT_TIME = r"^(\d{4}-\d{1,2}-\d{1,2})[ T]+(\d{2})(\d{2})(?:(\d{2})(\.\d+)?)?$"
HALF_DAY = r"(?i)^(\d{4}-\d{1,2}-\d{1,2})[ T]+(0?[1-9]|1[0-2])(?::(\d{2}))?(:\d{2}(?:\.\d+)?)? *([ap])\.?m\.?$"
ZONE = r"\s*(Z|z|UTC|GMT|(?<=[:T][0-9.]{2,12}\s{0,3})[+-]\d{2}:?(?:\d{2})?)$"
FULL_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
PLAIN = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:[0-9:.]+)?$"


def parse_utc(df: DataFrame, name: str = "timestamp", day_first: bool = False) -> DataFrame:
    """Turn a text column into naive UTC timestamps; null where it is not a date and time.

    A text with an offset is converted to UTC, one without is taken as UTC. Nothing depends on the session zone.
    Each step is a column of its own, so it is computed once, and plain ISO text takes none of the rewriting steps.
    """
    kept = df.columns
    plain, text, iso, zone = F.col("_plain"), F.col("_text"), F.col("_odd.iso"), F.col("_odd.zone")
    digits = F.translate(zone, ":", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(
        F.substring(digits, 4, 2).try_cast("int"), F.lit(0)
    )
    odd = F.when(iso.rlike(FULL_DATE), iso.try_cast("timestamp_ntz"))
    return (
        df.withColumn("_text", F.trim(F.col(name).cast("string")))
        .withColumn("_plain", F.coalesce(text.rlike(PLAIN), F.lit(False)))
        .withColumn("_odd", F.when(~plain, _once(text, lambda t: _rewritten(t, day_first))))
        .withColumn("_wall", F.when(plain, text.try_cast("timestamp_ntz")).otherwise(odd))
        .withColumn(
            name,
            F.when(zone.startswith("+"), F.timestamp_add("MINUTE", -minutes, F.col("_wall")))
            .when(zone.startswith("-"), F.timestamp_add("MINUTE", minutes, F.col("_wall")))
            .otherwise(F.col("_wall")),
        )
        .select(*kept)
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. Its steps stay out of the generated code, so they don't swell it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rewritten(text: Column, day_first: bool) -> Column:
    """A text of any accepted spelling as ISO date and time, and the zone that it names."""

    def in_order(dated: Column) -> Column:
        for pattern, order in (YEAR_FIRST, COMPACT, DAY_FIRST if day_first else MONTH_FIRST):
            dated = F.regexp_replace(dated, pattern, order)
        return dated

    def parts(ordered: Column) -> Column:
        iso = _once(F.regexp_replace(ordered, ZONE, ""), _full_time)
        return F.struct(iso.alias("iso"), F.regexp_extract(ordered, ZONE, 1).alias("zone"))

    return _once(in_order(_numbered_month(text)), parts)


def _numbered_month(text: Column) -> Column:
    """A date with the name of its month, before or after the day, as an ISO date; any other text as it is."""
    part = lambda a, b: F.concat(F.regexp_extract(text, NAMED_MONTH, a), F.regexp_extract(text, NAMED_MONTH, b))
    place = F.instr(F.lit(MONTHS), F.lower(part(2, 4)))
    month = F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0")
    rest = F.regexp_replace(text, NAMED_MONTH, "")
    known = text.rlike(NAMED_MONTH) & (place % 3 == 1)
    return F.when(known, F.concat(part(3, 6), F.lit("-"), month, F.lit("-"), F.lpad(part(1, 5), 2, "0"), rest)).otherwise(text)


def _full_time(iso: Column) -> Column:
    """A time without colons, or of twelve hours, as one of twenty-four hours with colons; any other text as it is."""
    part = lambda k: F.regexp_extract(iso, HALF_DAY, k)
    hour = part(2).cast("int") % 12 + F.when(F.lower(part(5)) == "p", 12).otherwise(0)
    minute = F.when(part(3) == "", "00").otherwise(part(3))
    clock = F.concat(part(1), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, part(4))
    compact = lambda k: F.regexp_extract(iso, COMPACT_TIME, k)
    second = F.when(compact(4) == "", "00").otherwise(compact(4))
    spread = F.concat(compact(1), F.lit(" "), compact(2), F.lit(":"), compact(3), F.lit(":"), second, compact(5))
    return F.when(iso.rlike(HALF_DAY), clock).when(iso.rlike(COMPACT_TIME), spread).otherwise(iso)


def instant_utc(instant: Column) -> Column:
    """A zoned timestamp as naive UTC, from its microseconds since 1970, so the session zone has no part in it."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def parse_terminal(date: Column, time: Column | None = None) -> Column:
    """Naive UTC timestamp of separate `yyyy.MM.dd` and `HH:mm[:ss[.SSS]]` fields."""
    day = F.translate(date, "./", "--")
    text = day if time is None else F.concat_ws(" ", day, time)
    return F.when(day.rlike(FULL_DATE), text.try_cast("timestamp_ntz"))


def check_zone(name: str) -> str:
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError) as error:
        raise ValueError(f"unknown time zone: {name!r}") from error
    return name


def local_to_utc(local: Column | str, zone: str) -> Column:
    """UTC of a wall-clock time in `zone`.

    In an hour that the clock runs twice, the later instant is taken: the offset valid one day later is tried
    first and kept if it leads back to the same wall clock.
    """
    z = F.lit(check_zone(zone))
    utc = F.lit("UTC")
    ts = F.col(local) if isinstance(local, str) else local
    next_day = ts + F.expr("INTERVAL '1' DAY")
    candidate = ts + (F.convert_timezone(z, utc, next_day) - next_day)
    earlier = F.convert_timezone(z, utc, ts)
    return F.when(F.convert_timezone(utc, z, candidate) == ts, candidate).otherwise(earlier)


def naive_utc(value: datetime | str) -> datetime:
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment if moment.tzinfo is None else moment.astimezone(timezone.utc).replace(tzinfo=None)


def ntz(value: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal, so that comparisons with it reach the Parquet scan unchanged."""
    return F.expr(f"TIMESTAMP_NTZ'{naive_utc(value).isoformat(sep=' ')}'")


def iso_text(timestamp: Column | str, separator: str = "T") -> Column:
    """ISO text with six fraction digits only where the fraction is not zero."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    text = F.translate(ts.cast("string"), " ", separator)
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
