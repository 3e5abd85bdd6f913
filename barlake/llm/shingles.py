"""Word shingles of many texts at once: hashes over the bytes of an Arrow batch, with numpy and without loops over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in pieces of a batch of about so many bytes, which bounds a task's memory; a longer text is one piece.
PIECE_BYTES = 1_000_000

_random = np.random.default_rng(20240607)
_ODD = np.uint64(1)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _ODD
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + _ODD


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Weights of the first bytes of a word; those of longer words are computed when they are met.
_SEED = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64) * _SEED) | _ODD


def _weights(places: np.ndarray) -> np.ndarray:
    """An odd number for each place of a byte in its word, without a pattern that words could follow."""
    found = _WEIGHTS[np.minimum(places, 255)]
    far = np.flatnonzero(places > 255)
    if len(far):
        found[far] = mix((places[far] + 1).astype(np.uint64) * _SEED) | _ODD
    return found


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows with about `piece_bytes` bytes; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (bytes without white space, A-Z in lower case), and how many words each text has."""
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) if len(data) else space
    after = np.concatenate([space[1:], [True]]) if len(data) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    lengths = ends - starts
    inner = np.flatnonzero(~space)
    places = np.arange(len(inner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data[inner]] * _weights(places), dtype=np.uint64)])
    last = np.cumsum(lengths)
    return mix(sums[last] - sums[last - lengths]), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of `size` words of each text as sorted 64-bit hashes, and how many each text has.

    A text with fewer words has its whole sequence as its only shingle, one without words has none.
    """
    words, counts = word_hashes(data, offsets)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, dtype=np.int64)
    texts = np.arange(len(counts))
    owner = np.repeat(texts, counts)
    left = np.repeat(firsts + counts, counts) - np.arange(len(words))
    full = np.flatnonzero(left >= size)
    total = np.zeros(len(full), dtype=np.uint64)
    for k in range(size):
        total += words[full + k] * _PLACE[k]
    found, owners = [mix(total)], [owner[full]]
    for short in range(1, size):
        own = np.flatnonzero(counts == short)
        total = np.full(len(own), _PLACE[32 + short], dtype=np.uint64)
        for k in range(short):
            total += words[firsts[own] + k] * _PLACE[k]
        found.append(mix(total))
        owners.append(own)
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))
