import math
import zlib
from collections import Counter

import xxhash
from helpers_llm import folder

from barlake.llm import queries, sharding
from barlake.llm.sharding import Node, tree_of


def brute(key, node, path=""):
    if node.shard is not None:
        return node.shard
    path = f"{path}/{node.name}"

    def draw(child):
        seed = xxhash.xxh64_intdigest(f"{path}/{child.name}".encode(), 42)
        bits = xxhash.xxh64_intdigest(key.encode(), seed) >> 11
        return -math.log((bits + 0.5) / 2**53) / child.weight

    children = [c for c in node.children if c.weight > 0]
    return brute(key, min(children, key=draw), path)


def shards(spark, ids, tree):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.s for r in rows.select("doc_id", sharding.descend(rows.doc_id.cast("string"), tree).alias("s")).collect()}


def test_same_as_brute_force(spark):
    for tree in (tree_of(8), tree_of(9), tree_of(3)):
        got = shards(spark, range(500), tree)
        assert got == {i: brute(str(i), tree) for i in range(500)}


def test_law_of_keys(spark):
    for count in (8, 9, 12):
        before, after = shards(spark, range(4000), tree_of(count)), shards(spark, range(4000), tree_of(count + 1))
        moved = {i for i in before if before[i] != after[i]}
        assert {after[i] for i in moved} == {count}
        assert 0.6 < len(moved) * (count + 1) / 4000 < 1.4


def weighted(a, b, c):
    racks = lambda name, weights: Node(name, tuple(Node(f"{name}{k}", shard=10 * ord(name) + k, own_weight=w) for k, w in enumerate(weights)))
    return Node("root", (Node("one", (racks("a", a), racks("b", b))), Node("two", (racks("c", c),))))


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    before, after = shards(spark, range(4000), weighted((1, 1), (1, 1), (2,))), shards(spark, range(4000), weighted((1, 1), (1, 3), (2,)))
    region = lambda s: s // 10 != ord("c")
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved
    # the region of the heavier rack only takes keys; keys of its other rack only move to the heavier rack, where they are
    # drawn anew, and those of the heavier rack only to the heavier shard
    assert all(region(new) for _, new in moved)
    assert {new for old, new in moved if old // 10 == ord("a")} == {10 * ord("b"), 10 * ord("b") + 1}
    assert {new for old, new in moved if old // 10 == ord("b")} == {10 * ord("b") + 1}
    counts = Counter(after.values())
    assert 0.8 < counts[10 * ord("b") + 1] / (4000 * 3 / 8) < 1.2


def test_nodes_without_weight_get_nothing(spark):
    assert set(shards(spark, range(200), weighted((1, 0), (0, 0), (0,))).values()) == {10 * ord("a")}


def test_rows_and_slots(spark):
    rows = [(i % 97, f"té{i % 5}", "x") for i in range(700)] + [(None, None, None), (None, "", "y"), (5, "z" * 200_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_rows(docs, tree_of(8), tree_of(9), folder(spark)).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(docs.limit(0), tree_of(8), tree_of(9), folder(spark)).count() == 0


def test_query(spark):
    got = queries.op7_hash_tree_shards(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and {r.shard for r in got} == set(range(8)) and {r.law for r in got} == {"key"}
    assert all(r.grown_shard in (r.shard, 8) for r in got)
