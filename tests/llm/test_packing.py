import random
import zlib
from array import array

import pytest
import tokenizers
from pyspark.sql import functions as F

from barlake.llm import packing, queries
from helpers_llm import folder

MADE = tokenizers.Tokenizer.from_file(queries.TOKENIZER)


def ids_of(text):
    return [*MADE.encode(text or "", add_special_tokens=False).ids, 0]


def little(ids):
    return array("I", ids).tobytes()


def check_cut(rows, documents, size=1024):
    """`documents`: list of ids; every piece is a slice of one of them, each id lies in one piece, only the last window is not full."""
    wanted = sorted((len(ids), little(ids)) for ids in documents)
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    # documents stand behind each other, so pieces in order of their place give them back
    built, found = b"", []
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length > 0
        assert r.start == len(built) // 4
        built += bytes(r.ids)
        if len(built) == 4 * r.doc_tokens:
            found.append((r.doc_tokens, built))
            built = b""
    assert built == b""
    assert sorted(found) == wanted
    place = 0
    for r in pieces:
        assert (r.sequence_id, r.offset) == divmod(place, size)
        place += r.length


def test_query_against_the_tokenizer(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_concatenate_cut(spark, sf_dir).collect()
    for r in rows:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(little(ids[r.start : r.start + r.length]))
    covered = {i: sorted((r.start, r.length) for r in rows if r.doc_id == i) for i in docs}
    for i, pieces in covered.items():
        assert [start for start, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == len(docs[i])
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in fill.items():
        pieces.sort()
        assert [offset for offset, _ in pieces] == [sum(n for _, n in pieces[:j]) for j in range(len(pieces))]
        assert sum(n for _, n in pieces) == 1024 or k == max(fill)
    assert sorted(fill) == list(range(max(fill) + 1))


TEXTS = [
    None,
    "",
    "   ",
    "\n\n  two words\t\tand more   space  ",
    "a!\x1c\x1d!b 'll don't we've  it's",
    "<|endoftext|> within <|endoftext|>",
    "Größe 東京 123 １２３ ½ ²  é 😀😀",
    "word " * 4000,
    "x" * 30_000,
    "\r\n\r\n \r\n.",
    "\x85next line ​ zero",
]


def test_stretches_give_the_ids_of_whole_texts(monkeypatch):
    """Texts of all kinds of characters, in any order and put together from few parts, so that stretches meet again."""
    draw = random.Random(21)
    parts = ["a", "Word", "it's", "'ll", "don't", " ", "  ", "\n", "\r\n", "\t", ".", ",", "...", "!?", "-", "(", "12", "½", "é", "ß", "×", "東京", "😀", "\u0301", "\xa0", "\u2003", "\x1c", "\x00", "\x85", "<|endoftext|>", "ǅ", "Ⅷ"]
    for joined in (1, 3, 2000):
        monkeypatch.setattr(packing, "JOINED", joined)
        encoder = packing.Encoder(open(queries.TOKENIZER, encoding="utf-8").read())
        for _ in range(60):
            texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(20)]
            assert encoder.encode(texts) == [little(ids_of(text)[:-1]) for text in texts]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_odd_rows_are_packed_whole(spark, partitions):
    rows = [(k, text, f"b{k}", k) for k, text in enumerate(TEXTS)] + [(None, "no id", "x", 0), (3, "again", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string, ids int").repartition(partitions)
    found = packing.pack(docs, queries.TOKENIZER, folder(spark)).collect()
    check_cut(found, [ids_of(row[1]) for row in rows])
    assert sum(r.doc_id is None for r in found if r.start == 0) == 1


def test_windows_of_another_size(spark):
    docs = spark.createDataFrame([(k, "some words here " * k) for k in range(30)], "doc_id int, text string")
    check_cut(packing.pack(docs, queries.TOKENIZER, folder(spark), size=7).collect(), [ids_of("some words here " * k) for k in range(30)], 7)


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id bigint, text string")
    pieces = packing.pack(docs.coalesce(1), queries.TOKENIZER, folder(spark), size=4)
    whole = ids_of("one two three") + ids_of("four") + ids_of("")
    found = {r.sequence_id: r for r in packing.sequences(pieces, size=4, padding_id=9).collect()}
    assert [i for k in sorted(found) for i in found[k].ids] == whole + [9] * (-len(whole) % 4)
    assert found[0].records[0] == (1, 0, 0, 4)
    assert sum(found[k].length for k in found) == len(whole)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    pieces = packing.pack(docs, queries.TOKENIZER, folder(spark))
    assert pieces.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() == 0
    assert packing.sequences(pieces).count() == 0


def test_offsets_of_many_partitions(spark):
    tokens = spark.range(5000).select(F.col("id").cast("int").alias("block"), (F.col("id") % 7).alias("doc_tokens"))
    found = {r.block: r.block_offset for r in packing.partition_offsets(tokens, folder(spark)).collect()}
    place = 0
    for block in range(5000):
        assert found[block] == place
        place += block % 7
