import base64
import hashlib
import struct

import zstandard
from helpers_llm import folder

from barlake.llm import warc


def archived(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS payload")
    return warc.archive_pages(pages, folder(spark), **more)


def test_copies_nulls_and_long_pages(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, "http://c", "same"), (None, "http://d", "same")]
    rows += [(10, None, None), (11, "u\r\nWARC-Type: evil", ""), (12, "", "é" * 400_000), (13, "x", "\r\n\r\nWARC/1.1\r\n"), (13, "x", "\r\n\r\nWARC/1.1\r\n")]
    held, _ = archived(spark, rows)
    got = held.collect()
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    told = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    newest = {"same": 5, "": 11}
    wanted = []
    for i, _, html in rows:
        top = newest.get(html or "", i)
        kind = "response" if i == top else "revisit"
        wanted.append((repr(i), len((html or "").encode()), digest(html), kind, None if i == top else top))
    assert told == sorted(wanted, key=lambda x: (x[0], x[1:4]))
    assert archived(spark, [])[0].count() == 0


def test_small_payloads_are_never_revisits(spark):
    held, _ = archived(spark, [(1, "a", "ab"), (2, "b", "ab"), (3, "c", "abcdef"), (4, "d", "abcdef")], least_bytes=3)
    assert {r.page_id: r.record_type for r in held.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_are_frames_behind_a_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held, path = warc.archive_pages(pages, folder(spark), warc.Settings(archive_bytes=300_000))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 2
    records = 0
    for file in files:
        magic, size = struct.unpack_from("<II", file.content)
        assert magic == warc.DICTIONARY_MAGIC and size
        dictionary = zstandard.ZstdCompressionDict(file.content[8 : 8 + size])
        # each record is a frame of its own that the dictionary opens
        place = 8 + size
        content = file.content
        while place < len(content):
            if content[place : place + 8] == warc.SEPARATOR.encode():
                place += 8
                continue
            opened = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            assert opened.decompress(content[place:]).startswith(b"WARC/1.1\r\n")
            place = len(content) - len(opened.unused_data)
            records += 1
    assert records == held.count() == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    texts = {warc._page(h["warc-record-id"]): b.split(b"\r\n\r\n", 1)[1].decode() for f in files for h, b in warc.records_of(f.content)}
    assert texts == html
    assert sum(f.length for f in files) < 0.5 * sum(len(x) for x in html.values())


def sizes_of(spark, path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    return sorted(f.length for f in files)


def test_archive_sizes_do_not_depend_on_the_join(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 100000", "url", "html"))
    told = {}
    for groups in (500_000, 0):
        held, path = warc.archive_pages(pages, folder(spark), warc.Settings(archive_bytes=100_000, broadcast_groups=groups))
        told[groups] = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in held.collect())
        sizes = sizes_of(spark, path)
        assert len(sizes) > 10 and max(sizes) < 100_000
    assert told[0] == told[500_000]


def test_rows_without_ids_are_dealt_to_all_archives(spark):
    rows = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS page_id", "CAST(NULL AS STRING) AS url", "repeat('same page ', 40) AS html")
    held, path = warc.archive_pages(rows.repartition(4), folder(spark), warc.Settings(archive_bytes=100_000))
    sizes = sizes_of(spark, path)
    assert len(sizes) >= 12 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert held.count() == 3000 and held.where("record_type = 'response'").count() == 3000
