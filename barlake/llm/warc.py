"""WARC archives with one Zstandard frame for each record and a dictionary, trained on the records, in a leading frame.

Spark writes the files: a row of the written frame is one compressed record, the separator between rows is an empty
skippable frame, which readers of Zstandard pass over. So archives go to any file system that Spark reaches, and are
committed with its protocol.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.columns import whole
from barlake.session import stage

# Skippable frames, an empty one (all ASCII) between records and the kind that holds a dictionary.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
DICTIONARY_MAGIC = 0x184D2A5D
ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, archive string"


@dataclass(frozen=True)
class Settings:
    """`sample_bytes` bounds the records, taken from the head of an archive, that its dictionary is trained on.

    A dictionary has a 64th of their bytes, and `dictionary_bytes` at most, so that a small archive has a small one.
    """

    dictionary_bytes: int = 64 * 1024
    sample_bytes: int = 4 * 1024 * 1024
    level: int = 6
    archive_bytes: int = 32 * 1024 * 1024
    broadcast_groups: int = 500_000


def base32(hexadecimal: F.Column) -> F.Column:
    """Bare upper-case base32 of a hexadecimal string whose length is a multiple of ten."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def newest_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digest and largest page_id of each payload of at least `least_bytes` bytes that several rows share."""
    rows = pages.select("page_id", whole("html").cast("binary").alias("payload"))
    rows = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    return groups.where("n > 1").drop("n")


def plan_records(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to, deal of each row; the digest is the SHA-1 of the payload.

    Of the rows with the payload of one of `groups` those with the largest page_id are responses, the others revisit it.
    Rows that repeat this page_id are all responses; a null page_id is smaller than any other, and rows are all responses
    where no page_id is known.
    """
    # rows without an id are dealt by their place in the input, which a task that is run again reads in the same order
    deal = F.xxhash64("page_id", "url", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()))
    rows = pages.select("page_id", "url", whole("html").cast("binary").alias("payload"), deal.alias("deal")).withColumn("digest", F.sha1("payload"))
    revisit = F.coalesce(F.col("newest") > F.coalesce("page_id", F.col("newest") - 1), F.lit(False))
    return rows.join(groups, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        base32(F.col("digest")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
        "deal",
    )


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip(" \t")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = lambda number: f"<urn:page:{'none' if number is None else number}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *(
            [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: {name(refers_to)}",
            ]
            if kind == "revisit"
            else []
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], settings: Settings) -> bytes:
    """A trained dictionary; where there are too few records to train on, the records' own bytes (none for no records)."""
    size = min(settings.dictionary_bytes, max(512, sum(map(len, samples)) // 64))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 16 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_archives(records: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """One archive for each partition of `records` (of `plan_records`), as text files without line ends under `path`."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(row.values()) for batch in batches for row in _rows(batch))
        made = (_record(*row) for row in rows)
        head, size = [], 0
        for record in made:
            head.append(record)
            size += len(record)
            if size >= settings.sample_bytes:
                break
        if not head:
            return
        content = _dictionary(head, settings)
        yield _column([struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content])
        own = zstandard.ZstdCompressor(level=settings.level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        for record in _chain(head, made):
            yield _column([own.compress(record)])

    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    written = records.select(*columns).mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    written.write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for start in range(0, batch.num_rows, 64):
        yield from batch.slice(start, 64).to_pylist()


def _chain(head: list[bytes], rest: Iterator[bytes]) -> Iterator[bytes]:
    while head:
        yield head.pop(0)
    yield from rest


def _column(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["frame"])


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    if not content:
        return
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size]) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 16)
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield headers, block


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, archive.

    Length and digest of a response are taken from its payload and must agree with its headers; a revisit has no payload,
    so its headers tell them.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                archive = batch.column(0)[place].as_py()
                rows = []
                for headers, block in records_of(batch.column(1)[place].as_py()):
                    told = (int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"))
                    if headers["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        found = (len(payload), base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode())
                        if found != told:
                            raise ValueError(f"{headers['warc-record-id']} in {archive} is damaged")
                    refers_to = _page(headers.get("warc-refers-to"))
                    rows.append((_page(headers["warc-record-id"]), *told, headers["warc-type"], refers_to, headers.get("warc-target-uri"), archive))
                if rows:
                    names = [field.split()[0] for field in ROW.split(", ")]
                    kinds = [pa.int64() if " bigint" in field else pa.string() for field in ROW.split(", ")]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, ROW)


def archive_pages(pages: DataFrame, folder: str, settings: Settings = Settings(), least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes a record for each row of `pages` and returns what the archives hold (see `read_archives`) and their path.

    Rows are dealt by a hash of page_id and url (by their place in the input without page_id) to as many archives as their
    bytes ask for, so neither a site nor a group of copies decides an archive's size. Up to `broadcast_groups` payloads with
    copies are broadcast, more are joined with a shuffle before. Null payloads are empty, null urls are left out.
    """
    groups = stage(newest_copies(pages, least_bytes), folder, "groups")
    path = f"{folder}/archives-{uuid.uuid4().hex}"
    size = pages.agg(F.sum(F.octet_length(whole("html")) + 512)).first()[0] or 0
    archives = max(1, -(-size // settings.archive_bytes))
    records = plan_records(pages, F.broadcast(groups) if groups.count() <= settings.broadcast_groups else groups)
    records = records.repartition(archives, "deal")
    write_archives(records, path, settings)
    return read_archives(pages.sparkSession, path), path
