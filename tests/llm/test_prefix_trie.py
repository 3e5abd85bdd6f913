import hashlib
import random
import zlib

import pytest

from barlake.llm import prefix_trie, queries
from helpers_llm import folder

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    conversations = {}
    for c, turn, role, text in rows:
        if c is not None:
            conversations.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in conversations.items()}
    shared = {c: zlib.crc32(str(c).encode()) % 9 for c in lists}
    return {c: tuple(lists.get(c - c % 5, [])[: shared[c]] + turns[shared[c] :]) for c, turns in lists.items()}


def brute(sequences):
    """The nodes by their prefixes; `sequences` maps ids to tuples of (role, text)."""
    members, children = {}, {}
    for c, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members.setdefault(turns[:depth], []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    return sorted(
        (
            min(own),
            len(path),
            min(members[path[:-1]]) if path else None,
            len(own),
            len(children.get(path, [])),
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, sorted(c for c in own if sequences[c] == path))).encode()).hexdigest(),
        )
        for path, own in members.items()
    )


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("sequences, group", [(20_000, 64), (5, 2), (1, 2)])
def test_query_against_brute_force(spark, monkeypatch, sequences, group):
    monkeypatch.setattr(prefix_trie, "TASK_SEQUENCES", sequences)
    monkeypatch.setattr(prefix_trie, "GROUP_PARTITIONS", group)
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(queries.op13_prefix_trie(spark, "/root/testdata/sf0.001")) == brute(rebuilt(rows))


@pytest.mark.parametrize("seed", range(6))
def test_random_tries_over_partition_borders(spark, monkeypatch, seed):
    random.seed(seed)
    monkeypatch.setattr(prefix_trie, "TASK_SEQUENCES", random.choice([1, 3, 10]))
    monkeypatch.setattr(prefix_trie, "GROUP_PARTITIONS", random.choice([2, 3]))
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    depth, letters = random.choice([(4, 2), (12, 2), (3, 9)])
    sequences = {c: tuple(("u", random.choice("abcdefghi"[:letters]) * 3) for _ in range(random.randint(0, depth))) for c in random.sample(range(-50, 400), 90)}
    # a third of all are equal, others go on behind it
    hot = (("u", "aaa"),) * 3
    sequences |= {c: hot for c in range(500, 560)} | {c: hot + (("u", str(c)),) for c in range(600, 630)}
    rows = []
    for c, turns in sequences.items():
        path = b"".join(hashlib.sha256(f"{r}:{t}".encode()).digest()[:16] for r, t in turns)
        rows.append((c, path, [len(t.encode()) for _, t in turns]))
    frame = spark.createDataFrame(rows, "conv_id bigint, path binary, sizes array<bigint>").repartition(5)
    assert found(prefix_trie.trie(frame, folder(spark))) == brute(sequences)


def test_forests_finish_what_lies_within():
    path = lambda text: b"".join(c.encode() * 16 for c in text)
    part = lambda text, low: prefix_trie.Component(path(text), [1] * len(text), len(text), low, 1)
    forest = prefix_trie.Forest(True, False)
    for _ in forest.grow([part("aa", 1), part("ab", 2), part("b", 3), part("bc", 4), part("bd", 5)]):
        pass
    # the outer paths are aa and bd, so a, aa, b, bd and the root stay open; ab and bc are finished
    assert sorted((row[2], row[3], row[5]) for row in forest.nodes) == [(2, 2, 1), (4, 2, 1)]
    assert sorted((len(row[0]) // 16, row[2], row[3], row[4]) for row in forest.contracted) == [(1, 2, 1, 1), (1, 3, 2, 1), (2, 1, 1, 0), (2, 5, 1, 0)]


def test_odd_rows(spark):
    rows = [(c, t, r, x) for c in (0, 1, 2, 5, 7, -3, -8, 12) for t, r, x in ((None, "a", "first"), (1, None, None), (2, "user", "ü" * 9), (2**40, "user", ""))]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (3, 1, "only", "one"), (20, 1, "user", "x" * 300_000), (21, 1, "user", "x" * 300_000)]
    rows += [(22, t, "user", f"turn {t}") for t in range(300)] + [(23, t, "user", f"turn {t}") for t in range(300)] + [(20, t, "user", f"turn {t}") for t in range(2, 30)]
    # the divisor's sign follows the number's here, as in SQL
    negative = lambda c: c - (c % 5 if c >= 0 else -((-c) % 5))
    frame = spark.createDataFrame([(*row, "clash", b"p") for row in rows], SCHEMA + ", turns string, path binary")
    sequences = rebuilt([row for row in rows if row[0] is None or row[0] >= 0])
    assert found(prefix_trie.prefix_trie(frame.where("conv_id is null or conv_id >= 0"), folder(spark))) == brute(sequences)
    assert {r.conv_id for r in prefix_trie.rebuilt(prefix_trie.turn_lists(frame)).collect()} == {row[0] for row in rows if row[0] is not None}
    assert negative(-3) == 0


def test_ties_and_repeated_rows(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, "user", "z"), (0, None, "user", "y")]
    one = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), folder(spark)))
    other = found(prefix_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), folder(spark)))
    assert one == other
    assert max(node[1] for node in one) == 5


def test_a_conversation_that_loses_all_turns_ends_at_the_root(spark):
    lost = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    frame = spark.createDataFrame([(lost, 1, "user", "gone")], SCHEMA)
    assert found(prefix_trie.prefix_trie(frame, folder(spark))) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_no_rows(spark):
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), folder(spark))) == []
