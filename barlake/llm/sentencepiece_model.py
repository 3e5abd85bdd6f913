"""A SentencePiece model rebuilt for the tokenizers library from its protobuf, and encoding and decoding of whole texts.

Spark deals the texts; a task encodes an Arrow batch in pieces, with the library's threads.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import types
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import unused

# Fixed values of the format: the character for a space, and the kinds of pieces and models.
META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Texts of a batch are encoded together up to so many bytes; a longer text is encoded alone.
PIECE_BYTES = 1024 * 1024
#: A worker keeps the ids of about so many words (some 100 MB).
KNOWN_WORDS = 500_000
#: So many new words are encoded as one text.
JOINED_WORDS = 200
BYTE_PIECE = re.compile("<0x[0-9A-Fa-f]{2}>")
WORD = re.compile(f"{META}+[^{META}]*|[^{META}]+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; 32- and 64-bit values stay bytes."""
    place = 0

    def varint() -> int:
        nonlocal place
        value = shift = 0
        while True:
            byte = data[place]
            place += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while place < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[place : place + size]
            place += size
        else:
            raise ValueError(f"field type {kind} isn't supported")
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    """What a model file says; the defaults are those of the format."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_spaces: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, settings = [], {}
        trainer = {3: ("kind", int), 24: ("suffix_spaces", bool), 35: ("byte_fallback", bool)}
        normalizer = {2: ("charsmap", bytes), 3: ("add_dummy_prefix", bool), 4: ("remove_extra_spaces", bool), 5: ("escape_spaces", bool)}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number in (2, 3):
                for inner, given in fields(value):
                    name, convert = (trainer if number == 2 else normalizer).get(inner, (None, None))
                    if name:
                        settings[name] = convert(given)
        return cls(tuple(pieces), **settings)


def rebuild(model: Model) -> tokenizers.Tokenizer:
    """The same model for the tokenizers library: normaliser, space marker, scores and byte fallback.

    A unigram model keeps the scores of its pieces. The scores of a BPE model are the order of its merges: each piece
    stands for the merge of any two pieces that make it up, best score first.
    """
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = tokenizers.models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        numbers = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [
            (-score, numbers[left], numbers[right], left, right)
            for piece, score in usable.items()
            for cut in range(1, len(piece))
            if (left := piece[:cut]) in usable and (right := piece[cut:]) in usable
        ]
        core = tokenizers.models.BPE(
            vocab=numbers,
            merges=[(left, right) for *_, left, right in sorted(merges)],
            unk_token=None if unknown is None else model.pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.suffix_spaces:
        raise ValueError("models with the space marker at the end of words can't be rebuilt")
    made = tokenizers.Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(tokenizers.normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [tokenizers.normalizers.Strip(), tokenizers.normalizers.Replace(tokenizers.Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(tokenizers.normalizers.Prepend(META if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(tokenizers.normalizers.Replace(" ", META))
    made.normalizer = tokenizers.normalizers.Sequence(steps)
    if not any(META in piece.lstrip(META) for piece, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        # no piece crosses the begin of a word, so words can be looked up one by one
        made.pre_tokenizer = tokenizers.pre_tokenizers.Split(tokenizers.Regex(WORD.pattern), "isolated")
    strip = [tokenizers.decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    made.decoder = tokenizers.decoders.Sequence(
        [tokenizers.decoders.ByteFallback(), tokenizers.decoders.Fuse(), tokenizers.decoders.Replace(META, " "), *strip]
    )
    return made


class Encoder:
    """The rebuilt model with the ids of words that it has met.

    Where no piece crosses the begin of a word, a text's ids are those of its words one after the other. So only words that
    are not known yet are encoded, in one batch with the library's threads. Words are found and told apart in the texts'
    bytes; strings are made of distinct words only.
    """

    def __init__(self, data: bytes, threads: int = 1):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = Model.parse(data)
        self.made = rebuild(self.model)
        self.by_word = self.made.pre_tokenizer is not None
        self.core = rebuild(self.model)
        self.core.normalizer = None
        self.core.pre_tokenizer = None
        self.core.decoder = tokenizers.decoders.Sequence([tokenizers.decoders.ByteFallback(), tokenizers.decoders.Fuse()])
        self.plain = not (self.model.charsmap or self.model.remove_extra_spaces) and self.model.escape_spaces
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known: dict[str, bytes] = {}
        # how many bytes of text a piece stands for, where each byte of a text is in a piece or is a piece
        self.widths = None
        if self.model.kind == BPE and self.model.byte_fallback:
            self.widths = np.array([1 if kind == BYTE else len(piece.encode()) for piece, _, kind in self.model.pieces])
        # what each piece stands for; the library tells byte pieces by their form, not their kind
        self.bytes_of = None
        if all(BYTE_PIECE.fullmatch(piece) if kind == BYTE else not piece.startswith("<0x") for piece, _, kind in self.model.pieces):
            made = [bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.encode() for piece, _, kind in self.model.pieces]
            self.bytes_of = pa.array(made, pa.large_binary())

    def normal(self, text: str) -> str:
        """The text as the model sees it."""
        if not self.plain:
            return self.made.normalizer.normalize_str(text)
        marked = text.replace(" ", META)
        return META + marked if marked and self.model.add_dummy_prefix else marked

    def plain_text(self, text: str) -> str:
        """What decoding should give back: the normalised text; the marker itself is read as a space."""
        shown = self.normal(text).replace(META, " ")
        return shown.removeprefix(" ") if self.model.add_dummy_prefix else shown

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        if not self.by_word:
            return [array("i", found.ids).tobytes() for found in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        if not texts:
            return []
        given = pa.array([self.normal(text) for text in texts], pa.large_string())
        starts, ends = _words(given)
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), given.buffers()[2]).dictionary_encode()
        places = words.indices.to_numpy()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        distinct = words.dictionary.to_pylist()
        packed = list(map(self.known.get, distinct))
        if new := [word for word, found in zip(distinct, packed) if found is None]:
            self.known.update(self._of_new(new))
            packed = [self.known[word] if found is None else found for word, found in zip(distinct, packed)]
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        ids = lists.take(pa.array(places)).flatten().to_numpy()
        stops = np.append(0, np.cumsum(sizes[places]))[np.searchsorted(starts, ends)]
        return [ids[first:stop].tobytes() for first, stop in zip(stops[:-1], stops[1:])]

    def _of_new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The words with their ids. Where the model allows it, many are encoded as one text.

        Merges on the two sides of a place that no merge has crossed don't depend on each other, so ids that part where
        the words part are those of the words. If any don't, all of these words are encoded alone.
        """
        alone = words
        if self.widths is not None:
            joined = [word for word in words if word[0] == META and word[-1] != META]
            texts = ["".join(joined[k : k + JOINED_WORDS]) for k in range(0, len(joined), JOINED_WORDS)]
            found = self.core.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter((i for one in found for i in one.ids), np.int32)
            ends = np.append(0, np.cumsum(self.widths[ids]))
            stops = np.cumsum([0, *(len(word.encode()) for word in joined)])
            places = np.searchsorted(ends, stops)
            if ends[-1] == stops[-1] and (ends[places] == stops).all():
                alone = [word for word in words if word[0] != META or word[-1] == META]
                packed, places = ids.tobytes(), (4 * places).tolist()
                yield from ((word, packed[a:b]) for word, a, b in zip(joined, places[:-1], places[1:]))
        for word, found in zip(alone, self.core.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield word, array("i", found.ids).tobytes()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The same as the rebuilt model's own decoder, with the marker replaced after the pieces are joined.

        Where the bytes of all pieces make up valid text, so do those of each run of byte pieces, and joining is all there
        is to do; the other texts are left to the library.
        """
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        if self.bytes_of is None or (len(flat) and not 0 <= flat.min() <= flat.max() < len(self.bytes_of)):
            joined = self.core.decode_batch(ids, skip_special_tokens=False)
        else:
            found = self.bytes_of.take(pa.array(flat))
            stops = np.frombuffer(found.buffers()[1], np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
            data = found.buffers()[2].to_pybytes() if stops[-1] else b""
            joined = [self._text(data[a:b], own) for a, b, own in zip(stops[:-1], stops[1:], ids, strict=True)]
        texts = (text.replace(META, " ") for text in joined)
        return [text.removeprefix(" ") if self.model.add_dummy_prefix else text for text in texts]

    def _text(self, data: bytes, ids: list[int]) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.core.decode(ids, skip_special_tokens=False)


def _words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin, as WORD finds them, and the end of the last; and where the texts begin and end."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    lead, middle, last = META.encode()
    marks = np.flatnonzero(data == lead)
    marks = marks[marks < len(data) - 2]
    marks = marks[(data[marks + 1] == middle) & (data[marks + 2] == last)]
    begins = np.zeros(len(data) + 1, bool)
    begins[marks[np.diff(marks, prepend=-4) != 3]] = True
    begins[ends] = True
    return np.flatnonzero(begins), ends


def encoder_of(data: bytes, threads: int = 1) -> Encoder:
    """One encoder for each Python process: Spark gives a worker one task after the other, and it keeps its words.

    The functions of this folder arrive with each task anew, so the encoder is held by a module of its own.
    """
    held = vars(sys.modules.setdefault("barlake_llm_encoders", types.ModuleType("barlake_llm_encoders")))
    key = f"{hashlib.sha256(data).hexdigest()}-{threads}"
    if key not in held:
        held[key] = Encoder(data, threads)
    return held[key]


def tokenize(docs: DataFrame, model_path: str, text: str = "text", into: str = "tokens", verify: bool = True, threads: int = 2) -> DataFrame:
    """Adds `into`, a struct of the ids of the whole text and the outcome of two checks.

    `round_trip`: decoding the ids gives the normalised text. `parity`: the library that the model was made for gives the
    same ids (null unless `verify`). A null text counts as empty and has no ids. Rows and other columns stay; a column
    that is already named `into` is replaced. `model_path` is read by the driver, the model travels with the job.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    Model.parse(data)
    columns = [c for c in docs.columns if c.lower() != into.lower()]
    carried = unused("__token_text", docs)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()), ("parity", pa.bool_())])
    broadcast = docs.sparkSession.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(broadcast.value, threads)
        for batch in batches:
            for first, texts in _pieces(batch.column(carried)):
                packed = encoder.encode(texts)
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                ids = [np.frombuffer(p, np.int32).tolist() for p in packed]
                trips = [back == encoder.plain_text(text) for back, text in zip(encoder.decode(ids), texts, strict=True)]
                same = [None] * len(ids)
                if verify:
                    same = [a == b for a, b in zip(ids, encoder.reference.encode(texts, num_threads=threads), strict=True)]
                tokens = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(trips, pa.bool_()), pa.array(same, pa.bool_())],
                    fields=list(kind),
                )
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), tokens], names=[*columns, into])

    given = docs.select(*(f"`{c}`" for c in columns), F.coalesce(text, F.lit("")).alias(carried))
    schema = docs.select(*(f"`{c}`" for c in columns)).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return given.mapInArrow(encode, f"{ddl}, `{into}` struct<ids: array<int>, round_trip: boolean, parity: boolean>")


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for place, value in enumerate(column):
        text = value.as_py()
        if texts and size + len(text) > PIECE_BYTES:
            yield first, texts
            first, texts, size = place, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids as `into`; null ids count as none, unknown numbers are left out."""
    with open(model_path, "rb") as file:
        data = file.read()

    @F.pandas_udf("string")
    def text_of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(data)
        size = len(encoder.model.pieces)
        for column in columns:
            lists = [[int(i) for i in (() if x is None else x) if 0 <= i < size] for x in column]
            yield pd.Series(encoder.decode(lists))

    return tokens.withColumn(into, text_of(F.col(ids)))
