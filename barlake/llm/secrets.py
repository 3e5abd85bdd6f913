"""Secrets in texts, found by one automaton for all rules; every text is read once, byte by byte.

Spark deals the rows; a task receives the texts as UTF-8 and returns only the spans. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.automaton import Automaton, Rule, compile_rules
from barlake.llm.columns import unused

# The rules of the base contract, in the order in which their kinds are listed.
BASE_RULES = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
# What follows the BEGIN line of a key. Header lines, base64 of 16 characters or more with gaps between (the
# first piece is long or has a digit), a shorter last piece at the end of its line or before the END line, the END line.
# Nothing but these parts is taken, so prose between the names of the two lines stays.
GAP = r"""(?:(?!-----(?:BEGIN|END) )(?:[\s"',>|#*-]|\\[nrt]|\+(?=\s)))"""
END = r"-----END [A-Z ]*PRIVATE KEY-----"
KEY_REST = (
    rf"(?:(?:{GAP}*+[A-Z][A-Za-z-]+: [^\r\n\\]*+)*+{GAP}*+(?=[A-Za-z0-9+/]{{40}}|[A-Za-z]*[0-9+/])[A-Za-z0-9+/]{{16,}}+={{0,2}}"
    rf"(?:{GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"(?:{GAP}++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=\s*(?:[\r\n]|\Z)|\\n|{GAP}*+{END})))?)?(?:{GAP}*+{END})?"
)
# Formats that services publish for their own keys.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 8),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-", 1, KEY_REST),
)
RULES = BASE_RULES + MORE_RULES

CONTINUATION = bytes(range(0x80, 0xC0))
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def text_spans(automaton: Automaton, data: bytes) -> list[dict]:
    """Spans of one text in code points, by start and then by the order of the rules."""
    found = sorted((start, rule, end) for rule, start, end in automaton.spans(data))
    spans, place, points = [], 0, 0
    for start, rule, end in found:
        points += len(data[place:start].translate(None, CONTINUATION))
        place = start
        length = len(data[start:end].translate(None, CONTINUATION))
        spans.append({"kind": automaton.rules[rule].kind, "start": points, "end": points + length})
    return spans


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Adds `into`: the spans (kind, start, end; code points, end exclusive) of all rules in the whole text.

    A null or empty text has none. Rows and other columns stay as they are; a column that is already named `into` is
    replaced. Matches of one kind don't overlap, those of different kinds may.
    """
    automaton = compile_rules(rules)
    carried = unused("__secret_text", docs)
    columns = [c for c in docs.columns if c.lower() != into.lower()]
    schema = docs.select(*(f"`{c}`" for c in columns)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [text_spans(automaton, data.as_py() or b"") for data in batch.column(carried)]
            kept = {c: batch.column(c) for c in columns}
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(spans, kind)], names=[*kept, into])

    given = docs.select(*(f"`{c}`" for c in columns), F.col(text).cast("binary").alias(carried))
    return given.mapInArrow(scan, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{into}` {SPAN}")


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> F.Column:
    """`kind:start:end` of the spans (of the given kinds), comma-joined."""
    column = F.col(spans)
    if kinds:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by `[kind]`; texts without secrets are untouched.

    Where spans overlap, the one that starts first (then the longest) names the whole stretch. A null text stays null.
    """
    spans = unused("__secret_spans", docs)
    found = find_secrets(docs, text, rules, into=spans)

    def shorten(acc: F.Column, span: F.Column) -> F.Column:
        joins = span["start"] < acc["end"]
        return F.struct(
            F.greatest(acc["end"], span["end"]).alias("end"),
            F.when(joins, acc["text"])
            .otherwise(F.concat(acc["text"], _cut(F.col(text), acc["end"], span["start"]), F.concat(F.lit("["), span["kind"], F.lit("]"))))
            .alias("text"),
        )

    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text"))
    cleaned = F.aggregate(
        spans, start, shorten, lambda acc: F.concat(acc["text"], _cut(F.col(text), acc["end"], F.length(text).cast("long")))
    )
    changed = F.when(F.size(spans) > 0, cleaned).otherwise(F.col(text))
    return found.withColumn(text, changed).select(*(f"`{c}`" for c in docs.columns))


def _cut(text: F.Column, start: F.Column, end: F.Column) -> F.Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
