"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, deepest first.

Sequences of turns are sorted over all partitions. Within a partition the neighbours' common prefixes (LCPs) are edges; taken
in descending depth, every edge that merges two components makes a branching node, or joins one of its depth. Nodes that
contain neither the first nor the last sequence of a partition can't go on in another one and are finished there. What
hangs on these two outer paths is contracted to a few rows, and the forests of neighbouring partitions are merged across their
boundaries in the same way, with the contracted rows as sequences, until one forest is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.columns import whole
from barlake.session import stage

#: Conversations whose ids leave the same multiple of SIBLINGS share their first turns, of which there are up to SHARED - 1.
SIBLINGS, SHARED = 5, 9
#: Bytes of a turn in a path.
TURN_BYTES = 16
#: Ids of one row in the lists of conversations that end at a node.
CHUNK_IDS = 8_192
#: Sequences and bytes of paths of one task; forests of so many partitions are merged by one task.
TASK_SEQUENCES, TASK_BYTES, GROUP_PARTITIONS = 20_000, 64_000_000, 64
#: Rows that are sent on at once.
OUT_ROWS = 10_000
#: Up to so many merged nodes (about 60 MB as a hash table) are broadcast to name the parents of others.
BROADCAST_NODES = 300_000

SEQUENCE = "path binary, sizes array<bigint>, low bigint, n bigint, children bigint, leaves bigint, saved bigint, ends binary"
NODE = "node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_at binary"
#: A row of a forest is a finished node or, with a path, a contracted part of an outer path.
FOREST = f"block int, {NODE}, {SEQUENCE}"
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
NAMES = [column.split(" ")[0] for column in FOREST.split(", ")]
TYPES = [KINDS[column.split(" ")[1]] for column in FOREST.split(", ")]
NODE_COLUMNS, SEQUENCE_COLUMNS = len(NODE.split(", ")), len(SEQUENCE.split(", "))
PARENT, PARENT_CONV = 1, 4


@dataclass
class Component:
    """Sequences that have the first `depth` turns of `path` in common, which are a node.

    `n` members, the smallest of them (`low`), finished children of the node, leaves and savings below it, and `ends` of the
    members that end there. Children that are not finished are not counted. `waiting` are finished children without a parent.
    """

    path: bytes
    sizes: np.ndarray
    depth: int
    low: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bytes | None = None
    open: bool = False
    waiting: list[list] = field(default_factory=list)

    def key(self) -> bytes:
        return hashlib.md5(self.path[: self.depth * TURN_BYTES], usedforsecurity=False).digest()

    def join(self, other: Component) -> None:
        """Takes in a component with the same node."""
        self.low = min((low for low in (self.low, other.low) if low is not None), default=None)
        self.n += other.n
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.open |= other.open
        few, many = sorted((self.waiting, other.waiting), key=len)
        many.extend(few)
        self.waiting = many


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common from their begin."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN_BYTES : middle * TURN_BYTES] == b[low * TURN_BYTES : middle * TURN_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """The trie of sorted sequences: `nodes` are finished; `contracted` holds what hangs on the outer paths if those are open."""

    def __init__(self, is_open: bool, keyed: bool):
        self.is_open = is_open
        self.keyed = keyed
        self.nodes: list[list] = []
        self.contracted: list[list] = []

    def grow(self, held: list[Component]) -> Iterator[None]:
        """Merges the sequences, and stops now and then so that finished nodes can be taken away."""
        if not held:
            return
        if self.is_open:
            first = 0
            while first + 1 < len(held) and held[first + 1].path.startswith(held[first].path):
                first += 1
            held[first].open = held[-1].open = True
        depths = [common_turns(a.path, b.path) for a, b in zip(held, held[1:], strict=False)]
        above = list(range(len(held)))

        def find(place: int) -> int:
            while above[place] != place:
                above[place] = above[above[place]]
                place = above[place]
            return place

        for edge in sorted(range(len(depths)), key=depths.__getitem__, reverse=True):
            a, b = find(edge), find(edge + 1)
            merged = self._raise(held[a], depths[edge])
            merged.join(self._raise(held[b], depths[edge]))
            held[a], held[b], above[b] = merged, None, a
            if len(self.nodes) > OUT_ROWS:
                yield
        top = self._raise(held[find(0)], 0)
        if self.is_open:
            self._contract(top)
        else:
            self._finish(top, None)

    def _raise(self, part: Component, depth: int) -> Component:
        """The component with the node at `depth` as its own; what begins deeper becomes a child of that node."""
        if part.depth == depth:
            return part
        parent = Component(part.path, part.sizes, depth, open=part.open)
        if part.open:
            self._contract(part)
        else:
            self._finish(part, parent)
        return parent

    def _contract(self, part: Component) -> None:
        """Only what hangs on the node directly is kept, as a sequence that ends there; more may come from other partitions."""
        if part.n:
            key = part.key()
            for row in part.waiting:
                row[PARENT] = key
            self.nodes += part.waiting
            sizes = part.sizes[: part.depth]
            self.contracted.append([part.path[: part.depth * TURN_BYTES], sizes, part.low, part.n, part.children, part.leaves, part.saved, part.ends])

    def _finish(self, part: Component, parent: Component | None) -> None:
        """The nodes from the component's own one up to the child of `parent`, or up to the root."""
        for row in part.waiting:
            row[PARENT_CONV] = part.low
        self.nodes += part.waiting
        key = part.key() if self.keyed else None
        saved, children, ends = part.saved, part.children, part.ends
        leaves = part.leaves if children else 1
        top = parent.depth + 1 if parent else 0
        for depth in range(part.depth, top - 1, -1):
            saved += (part.n - 1) * int(part.sizes[depth - 1]) if depth else 0
            row = [key, None, part.low, depth, part.low if depth > top else None, part.n, children, leaves, saved, ends]
            if depth > top or not parent:
                self.nodes.append(row)
            key, children, ends = None, 1, None
        if parent:
            parent.join(Component(parent.path, parent.sizes, parent.depth, part.low, part.n, 1, leaves, saved, waiting=[row]))

    def take(self, block: int) -> pa.RecordBatch:
        nodes, self.nodes = self.nodes, []
        contracted, self.contracted = self.contracted, []
        rows = [[block, *row, *[None] * SEQUENCE_COLUMNS] for row in nodes] + [[block, *[None] * NODE_COLUMNS, *row] for row in contracted]
        columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def _components(batch: pa.RecordBatch | pa.Table) -> list[Component]:
    """The rows of sequences, in the column order of SEQUENCE."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
        columns = [column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column for column in batch.columns]
    else:
        columns = batch.columns
    flat = columns[1].flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *columns[1].value_lengths().to_pylist()])
    others = zip(*(column.to_pylist() for column in (columns[0], *columns[2:])), strict=True)
    return [
        Component(path, flat[ends[k] : ends[k + 1]], len(path) // TURN_BYTES, low, n, children, leaves, saved, at)
        for k, (path, low, n, children, leaves, saved, at) in enumerate(others)
    ]


def _grown(held: list[Component], block: int, is_open: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    forest = Forest(is_open, keyed)
    for _ in forest.grow(held):
        yield forest.take(block)
    yield forest.take(block)


def partition_forests(sequences: DataFrame, partitions: int) -> DataFrame:
    """The forest of each partition of the sorted sequences."""

    def forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [part for batch in batches for part in _components(batch)]
        yield from _grown(held, TaskContext.get().partitionId(), True, False)

    columns = [column.split(" ")[0] for column in SEQUENCE.split(", ")]
    ranges = sequences.select(*columns).repartitionByRange(partitions, "path").sortWithinPartitions("path")
    return ranges.mapInArrow(forests, FOREST)


def merged_forests(contracted: DataFrame, is_open: bool) -> DataFrame:
    """The forests of groups of neighbouring partitions from their contracted rows, which are few for each partition."""
    columns = [column.split(" ")[0] for column in SEQUENCE.split(", ")]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        held = sorted(_components(table.select(columns)), key=lambda part: part.path)
        return pa.Table.from_batches(list(_grown(held, key[0].as_py(), is_open, True)))

    return contracted.groupBy("group").applyInArrow(merge, FOREST)


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each as a hash of role and text and the bytes of its text.

    The hash is cut from SHA-256, so a turn has 16 bytes here, whatever its text is.
    """
    role, text = whole("role"), whole("text")
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN_BYTES)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of the conversation's first sibling, then its own turns after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    heads = lists.where(f"conv_id % {SIBLINGS} = 0").select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    first = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    joined = lists.withColumn("first", first).join(heads, "first", "left").withColumn("h", h)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    joined = joined.select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.size").alias("sizes"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """Each sequence once (see SEQUENCE), with its members, the smallest of them, and the hash of their ids in order.

    Ids are put together in chunks of neighbouring ids before those of one sequence meet; a task then hashes them one after
    the other and holds one batch of chunks, however many members a sequence has.
    """
    named = sequences.select("conv_id", F.md5("path").alias("name"))
    chunks = named.groupBy("name", F.expr(f"conv_id div {CHUNK_IDS}").alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    chunks = chunks.select("name", "chunk", F.col("ids")[0].alias("low"), F.size("ids").cast("long").alias("n"), joined.cast("binary").alias("ids"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(state: list) -> tuple:
            return *state[:3], state[3].digest()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "low", "n", "ends"])

        state, rows = None, []
        for batch in batches:
            for name, low, n, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if state and state[0] == name:
                    state[2] += n
                    state[3].update(b"," + ids)
                    continue
                if state:
                    rows.append(row(state))
                state = [name, low, n, hashlib.sha256(ids)]
            if rows:
                yield out(rows)
                rows = []
        if state:
            yield out([row(state)])

    ordered = chunks.repartition("name").sortWithinPartitions("name", "chunk").select("name", "low", "n", "ids")
    ends = ordered.mapInArrow(hashed, "name string, low bigint, n bigint, ends binary")
    none = F.lit(0).cast("long")
    return ends.join(sequences, F.col("low") == F.col("conv_id")).select(
        "path", "sizes", "low", "n", none.alias("children"), none.alias("leaves"), none.alias("saved"), "ends"
    )


def trie(sequences: DataFrame, folder: str) -> DataFrame:
    """The nodes of the trie of `sequences`, a staged frame with columns conv_id, path and sizes; see `prefix_trie`."""
    distinct = stage(distinct_sequences(sequences), folder, "distinct")
    count, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    blocks = max(1, -(-count // TASK_SEQUENCES), -(-size // TASK_BYTES))
    forests = [stage(partition_forests(distinct, blocks), folder, "forests")]
    while True:
        contracted = forests[-1].where("path is not null")
        blocks = -(-blocks // GROUP_PARTITIONS)
        grouped = contracted.withColumn("group", F.expr(f"block div {GROUP_PARTITIONS}").cast("int"))
        forests.append(stage(merged_forests(grouped, blocks > 1), folder, "forests"))
        if blocks == 1:
            break
    nodes = forests[0].where("path is null")
    merged = forests[1].where("path is null")
    for forest in forests[2:]:
        merged = merged.unionByName(forest.where("path is null"))
    names = stage(merged.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("named")), folder, "names")
    every = nodes.unionByName(merged)
    every = every.join(F.broadcast(names) if names.count() <= BROADCAST_NODES else names, "parent", "left")
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.lower(F.coalesce(F.hex("ends_at"), F.sha2(F.lit(b""), 256))).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, folder: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A conversation's turns are ordered by `turn`, null first. It is rebuilt from the first h turns of the conversation whose id
    is the next multiple of 5 towards 0, and its own turns after its first h; h follows from its id. Each distinct sequence of
    first turns (role and text) is a node, named by its smallest member and its depth; the root has depth 0. `saved_tokens`
    counts the bytes of text that the members of a subtree's nodes need not repeat, `ends_sha256` tells the members that end.

    - A null role or text is empty. Rows without conv_id are left out. Turns of a conversation with the same number, also
      null ones, are ordered by a hash of role and text; repeated rows are turns of their own. Empty texts are turns.
    - A conversation with nothing left after rebuilding is a member of the root, where it ends. No rows give no nodes.
    - Turns are told apart by 128 bits of SHA-256. Other columns are not read.
    - A conversation's turns meet in one row of 16 + 8 bytes each, whatever their texts are; members of one node, equal
      conversations included, never do.
    """
    lists = stage(turn_lists(turns.select("conv_id", "turn", "role", "text")), folder, "turns")
    return trie(stage(rebuilt(lists), folder, "sequences"), folder)
