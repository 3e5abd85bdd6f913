"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, however often `body` uses it and wherever it is inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str) -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """The stretches of the text without white space, in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def ratio(part: Column, base: Column) -> Column:
    """part / base, 0 where the base is 0."""
    return F.when(base > 0, part.cast("double") / base).otherwise(F.lit(0.0))


def unused(name: str, df: DataFrame) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
