"""Packing: documents are concatenated and cut into sequences of one length.

Pass one tokenizes each partition and gives every document its place in the partition; prefix sums over the partitions'
totals make that a place in the whole. Pass two cuts the documents at the borders of fixed windows, without a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.columns import whole
from barlake.session import stage

#: A worker forgets its stretches of text beyond so many (about 300 MB).
KNOWN_STRETCHES = 1_000_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000
#: Up to so many partitions' places (about 100 MB as a hash table) are broadcast; more are joined with a shuffle.
BROADCAST_BLOCKS = 1_000_000
#: The id that ends every document.
END_ID = 0

#: A stretch is white space and the word behind it; letters also end before these marks. Byte-level BPE joins neither.
STRETCH = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?\s])|\s*\S+|\s+")
#: So many new stretches are encoded as one text.
JOINED = 2_000
#: Control characters that are white space to this pattern but not to the tokenizer's.
CONTROLS = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of `encode(..., add_special_tokens=False)`.

    With a byte-level pre-tokenizer the ids of a text are those of its stretches one after the other, so a stretch is encoded
    once for each worker, and new ones together as one text: the bytes of its ids tell where each of them ends. Texts with
    special tokens or control characters, and other tokenizers, are encoded as a whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.made = tokenizers.Tokenizer.from_str(definition)
        kind = self.made.pre_tokenizer
        self.by_stretch = isinstance(kind, tokenizers.pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.made.normalizer is None
        self.whole_texts = (*CONTROLS, *(token.content for token in self.made.get_added_tokens_decoder().values()))
        self.known: dict[str, bytes] = {}
        vocabulary = self.made.get_vocab()
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = (array("I", one.ids) for one in self.made.encode_batch_fast(texts, add_special_tokens=False))
        return [_little(ids).tobytes() for ids in found]

    def _learn(self, stretches: list[str]) -> None:
        """Encodes new stretches. White space that follows a word begins a token, so stretches that begin with some can stand
        behind each other; others are parted by line ends, which are tokens of their own there."""
        kinds: dict[str, list[str]] = {"": [], "\n": []}
        alone = []
        for one in stretches:
            if one[-1].isspace():
                alone.append(one)
            else:
                kinds["" if one[0].isspace() else "\n"].append(one)
        self.known.update(zip(alone, self._ids(alone), strict=True))
        for end, own in kinds.items():
            groups = [own[k : k + JOINED] for k in range(0, len(own), JOINED)]
            for group, ids in zip(groups, self._ids([end.join(group) for group in groups]), strict=True):
                # the bytes before each id; a stretch is the ids between its first byte and its last one
                places = np.concatenate([[0], np.cumsum(self.widths[np.frombuffer(ids, "<u4")])])
                lengths = np.array([len(one.encode()) for one in group])
                firsts = np.cumsum(lengths + len(end)) - lengths - len(end)
                begins, ends = np.searchsorted(places, firsts), np.searchsorted(places, firsts + lengths)
                if places[-1] != firsts[-1] + lengths[-1] or (places[begins] != firsts).any() or (places[ends] != firsts + lengths).any():
                    self.known.update(zip(group, self._ids(group), strict=True))
                    continue
                self.known.update((one, ids[4 * a : 4 * b]) for one, a, b in zip(group, begins.tolist(), ends.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        by_stretch = [self.by_stretch and not any(one in text for one in self.whole_texts) for text in texts]
        others = iter(self._ids([text for text, split in zip(texts, by_stretch, strict=True) if not split]))
        if len(self.known) > KNOWN_STRETCHES:
            self.known.clear()
        stretches = [STRETCH.findall(text) if split else [] for text, split in zip(texts, by_stretch, strict=True)]
        # each stretch is looked up once; only those that are not known are visited one by one
        found = [list(map(self.known.get, own)) for own in stretches]
        missing = [list(_places_of_none(ids)) for ids in found]
        self._learn(list({own[k] for own, places in zip(stretches, missing, strict=True) for k in places}))
        for own, ids, places in zip(stretches, found, missing, strict=True):
            for k in places:
                ids[k] = self.known[own[k]]
        return [b"".join(ids) if split else next(others) for ids, split in zip(found, by_stretch, strict=True)]


def _places_of_none(values: list) -> Iterator[int]:
    place = -1
    try:
        while True:
            place = values.index(None, place + 1)
            yield place
    except ValueError:
        return


def _little(ids: array) -> array:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids


def encoder_of(definition: str) -> Encoder:
    """One encoder for each Python process, which keeps its stretches from task to task.

    The functions of this folder arrive with each task anew, so the encoder is held by a module of its own.
    """
    held = vars(sys.modules.setdefault("barlake_llm_packing", types.ModuleType("barlake_llm_packing")))
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in held:
        held[key] = Encoder(definition)
    return held[key]


def tokens_by_partition(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, place, doc_tokens, ids): a partition's number, and the ids of each document with the end id behind
    them; `place` counts the ids before the document in its partition. The driver reads the tokenizer, it travels with the job.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    end = _little(array("I", [END_ID])).tobytes()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        block, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                ids = [found + end for found in encoder.encode(texts)]
                counts = [len(one) // 4 for one in ids]
                places = []
                for count in counts:
                    places.append(total)
                    total += count
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(ids), pa.int32()),
                        batch.column(0).slice(first, len(ids)),
                        pa.array(places, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["block", "doc_id", "place", "doc_tokens", "ids"],
                )

    given = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(tokenized, f"block int, doc_id {kind}, place bigint, doc_tokens bigint, ids binary")


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for place, value in enumerate(column):
        text = value.as_py()
        if texts and size + len(text) > GROUP_CHARS:
            yield first, texts
            first, texts, size = place, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def partition_offsets(tokens: DataFrame, folder: str) -> DataFrame:
    """(block, block_offset): the ids in the partitions before each one; the sums run over one row a partition."""
    totals = tokens.groupBy("block").agg(F.sum("doc_tokens").alias("total"))
    # sums over groups of 1,024 partitions, then within each group: no window holds more than these
    totals = stage(totals.withColumn("part", F.expr("block div 1024")), folder, "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("total").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_offset"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.select("part", "block", F.coalesce(F.sum("total").over(within), F.lit(0)).alias("before"))
    return stage(within.join(parts, "part").select("block", (F.col("part_offset") + F.col("before")).alias("block_offset")), folder, "offsets")


def _cut(size: int) -> Column:
    """The pieces of a document that stands at `begin` in the whole, one for each window that it reaches into."""
    end = F.col("begin") + F.col("doc_tokens")
    windows = F.sequence(F.expr(f"begin div {size}"), F.expr(f"(begin + doc_tokens - 1) div {size}"))

    def piece(window: Column) -> Column:
        low, high = F.greatest(window * size, F.col("begin")), F.least((window + 1) * size, end)
        start, length = low - F.col("begin"), high - low
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            window.alias("sequence_id"),
            (low - window * size).alias("offset"),
            F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        )

    return F.transform(windows, piece)


def pack(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and the end id 0. All documents stand behind each other, in the order of the input's partitions;
    sequences are windows of `size` ids over the whole, so only the last one is not full (see `sequences` for its padding).
    `start` counts a document's ids before a piece, `offset` those before it in the sequence.

    - A null or empty text is the end id alone. Rows without doc_id and rows that repeat one are documents of their own.
      A text of any length is cut into as many pieces as it reaches windows. Other columns are not read.
    - No rows give no pieces. Which documents meet in a sequence depends on how Spark splits the input; the ids are written
      to `folder` once and read from there, so that lost tasks don't change it.
    """
    found = tokens_by_partition(docs, tokenizer_path, doc_id, text)
    path = f"{folder}/tokens-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(path)
    tokens = docs.sparkSession.read.schema(found.schema).parquet(path)
    offsets = partition_offsets(tokens, folder)
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_BLOCKS else offsets
    placed = tokens.join(offsets, "block").withColumn("begin", F.col("block_offset") + F.col("place"))
    pieces = placed.select("doc_id", "doc_tokens", F.explode(_cut(size)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, size: int = 1024, padding_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, length, records) of pieces: `length` ids and then padding up to `size`.

    `records` tell where documents begin and end: doc_id, start, offset and length of each piece, by offset. A sequence holds
    `size` pieces at most, as each has an id.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(one["ids"] for one in held) for held in batch.column(1).to_pylist()]
            lengths = [len(one) // 4 for one in ids]
            filled = [np.concatenate([np.frombuffer(one, "<u4").astype(np.int64), np.full(size - n, padding_id)]) for one, n in zip(ids, lengths, strict=True)]
            columns = [batch.column(0), pa.array(filled, pa.list_(pa.int64())), pa.array(lengths, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["sequence_id", "ids", "length", "records"])

    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    records = F.transform("held", lambda h: F.struct(h["doc_id"], h["start"], h["offset"], h["length"]))
    rows = pieces.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", "held", records.alias("records"))
    kind = rows.schema["records"].dataType.simpleString()
    return rows.mapInArrow(joined, f"sequence_id bigint, ids array<bigint>, length bigint, records {kind}")
