from datetime import datetime, timedelta

from barlake.schema import BARS, TICKS


def minute_rows(start, count, instrument="EURUSD", timeframe="M1", step=60, flat=None, source="raw"):
    first = datetime.fromisoformat(start)
    rows = []
    for i in range(count):
        base = flat if flat is not None else 100 + 0.01 * i
        prices = (base, base + 0.5, base - 0.5, base + 0.1)
        rows.append((instrument, timeframe, first + timedelta(seconds=step * i), *prices, source))
    return rows


def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def ticks(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) if len(r) < 6 else r for r in rows], TICKS)


def second_ticks(start, count, instrument="EURUSD"):
    first = datetime.fromisoformat(start)
    return [(instrument, first + timedelta(seconds=i), 100 + 0.01 * i, 1.0, None, None) for i in range(count)]


def same(a, b):
    columns = sorted(a.columns)
    key = lambda rows: sorted(map(repr, rows))
    return key(map(tuple, a.select(*columns).collect())) == key(map(tuple, b.select(*columns).collect()))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
