import random

import numpy as np
import pyarrow as pa
from helpers_llm import folder, near_components, shingles

from barlake.llm import near_dup, queries
from barlake.llm import shingles as shingles_of
from barlake.llm.components import components
from barlake.llm.shingles import pieces, shingle_sets


def judged(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS digest")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, folder(spark), **more).collect()}


def expected(rows, size=4):
    return {i: (n, c, i == c) for i, (n, c) in near_components(rows, size).items()}


def edited(draw, base, edits):
    text = list(base)
    for _ in range(edits):
        text[draw.randrange(len(text))] = f"w{draw.randrange(10**6)}"
    return " ".join(text)


def test_shingles_of_a_batch():
    texts = ["a b c d e", "A  b\tC\x0bd", "", None, "a b", "a b c", " \n ", "é É x y", "a b c d a b c d", "ab c"]
    for size in (4, 5):
        found = []
        for _, _, data, offsets in pieces(pa.array([t and t.encode() for t in texts], pa.binary()).slice(0), 7):
            hashes, counts = shingle_sets(data, offsets, size)
            ends = np.cumsum(counts)
            found += [frozenset(hashes[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True)]
        wanted = [shingles(t, size) for t in texts]
        assert [len(f) for f in found] == [len(w) for w in wanted]
        for a in range(len(texts)):
            for b in range(len(texts)):
                assert len(found[a] & found[b]) == len(wanted[a] & wanted[b]), (texts[a], texts[b])


def test_words_that_fool_polynomials_have_hashes_of_their_own():
    # a Thue-Morse word and its complement agree in every polynomial modulo 2**64 from 1,024 letters on
    for size in (1024, 4096):
        signs = [bin(k).count("1") % 2 for k in range(size)]
        pair = ["".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)]
        data = " ".join([*pair, "x" * size, "x" * (size + 1)]).encode()
        hashes, counts = shingles_of.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert counts.tolist() == [4] and len(set(hashes.tolist())) == 4


def test_same_as_brute_force(spark):
    draw = random.Random(3)
    rows, number = [], 0
    for family in range(12):
        base = [f"f{family}x{draw.randrange(400)}" for _ in range(draw.choice([6, 30, 120]))]
        for _ in range(draw.choice([1, 4, 25])):
            rows.append((number, edited(draw, base, draw.choice([0, 0, 1, 2, 4, 8]))))
            number += 1
    draw.shuffle(rows)
    assert judged(spark, rows) == expected(rows)
    assert judged(spark, rows, tables=near_dup.Tables(size=5)) == expected(rows, 5)


def test_large_family_with_a_common_passage(spark):
    draw = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(14))
    base = [f"b{k}" for k in range(100)]
    rows = [(k, edited(draw, base, draw.choice([1, 3, 6, 9]))) for k in range(120)]
    rows += [(200 + k, passage + " " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.choice([2, 4, 12])))) for k in range(120)]
    rows += [(400 + k, "same text again and again " * 3) for k in range(100)]
    assert judged(spark, rows) == expected(rows)


def made(spark, rows):
    """How many rows the steps behind the table keys have for these texts."""
    docs, tables = spark.createDataFrame(rows, "doc_id long, text string"), near_dup.Tables()
    signed = near_dup.stage(near_dup.sign(docs, "doc_id", "text", tables), folder(spark), "signed")
    held = near_dup.stars(signed, folder(spark))
    sets = near_dup.stage(near_dup.full_sets(docs, "text", tables).dropDuplicates(["digest"]), folder(spark), "sets")
    pairs = held.select(held.digest.alias("a"), held["first.digest"].alias("b"))
    linked = components(near_dup.confirm(pairs, sets, tables), folder(spark))
    opened = near_dup.stage(near_dup.open_sets(held, linked, sets, folder(spark)), folder(spark), "opened")
    return {"sets": sets.count(), "stars": held.count(), "opened": opened.count(), "rare": near_dup.rare_shingles(opened, sets, tables).count()}


def test_rows_grow_with_sets(spark):
    """A family of near copies, most of them apart: no step makes a row for each member of each table key."""
    found = {}
    for size in (100, 200, 400):
        draw = random.Random(8)
        base = [f"b{k}" for k in range(120)]
        found[size] = made(spark, [(k, edited(draw, base, draw.choice([1, 2, 5, 8]))) for k in range(size)])
        assert found[size]["opened"] <= found[size]["sets"]
    assert found[400]["stars"] <= 40 * found[400]["sets"] and found[400]["stars"] <= 8 * found[100]["stars"], found


def test_common_shingles_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "THOUSAND", 7)
    draw = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, passage + " " + " ".join(f"u{draw.randrange(400)}" for _ in range(draw.choice([3, 5, 7])))) for k in range(150)]
    assert judged(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "One two"), (7, "one TWO"), (8, "x " * 100_000), (9, "x " * 5)]
    assert judged(spark, rows) == expected(rows)
    assert judged(spark, []) == {}
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "alone in the world today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, folder(spark)).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id), r.kept) for r in got) == [
        ("3", "3", True),
        ("3", "3", True),
        ("None", "3", False),
        ("None", "None", True),
    ]


def test_rows_without_an_id_are_compared(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(["x", *base[1:]])), (9, " ".join([*base[:-1], "y"])), (4, "something else altogether here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, folder(spark)).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == [("4", "4"), ("9", "9"), ("None", "9"), ("None", "9")]


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "q r s t u v", "y"), (7, "k l m n o", "z"), (7, "k l m n o", "z"), (None, "lone words stay here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = near_dup.without_copies(docs, folder(spark))
    assert left.columns == docs.columns
    # a repeated id is no reason to drop a text of its own
    assert sorted((repr(r.doc_id), r.text) for r in left.collect()) == [
        ("1", "a b c d e f"),
        ("2", "q r s t u v"),
        ("7", "k l m n o"),
        ("None", "lone words stay here"),
    ]


def test_rows_go_for_their_own_text_only(spark):
    same, near = "a b c d e f", " ".join(f"w{k}" for k in range(60))
    rows = [(1, same, "x"), (2, same, "y"), (2, "q r s t u v", "y"), (7, "k l m n o", "z"), (7, "k l m n o", "z"), (None, "lone words stay here", "x")]
    rows += [(None, same, "x"), (None, "A b c d e f", "x"), (None, near, "x"), (None, near, "y"), (None, near + " end", "x")]
    rows += [(8, "m n o p q", "x"), (8, "M n o p q", "x"), (9, "", "x"), (9, "", "x"), (9, None, "x"), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = sorted((repr(r.doc_id), repr(r.text)) for r in near_dup.without_copies(docs, folder(spark)).collect())
    free = [(i, t) for i, t in left if i == "None" and t.startswith("'w0 ")] + [(i, t) for i, t in left if i == "8"]
    assert len(free) == 2 and [i for i, _ in free] == ["None", "8"]
    assert [row for row in left if row not in free] == sorted(
        [("1", repr(same)), ("2", "'q r s t u v'"), ("7", "'k l m n o'"), ("9", "''"), ("9", "None")]
        + [("None", "''"), ("None", "''"), ("None", "'lone words stay here'")]
    )


def test_components_against_union_find(spark):
    draw = random.Random(9)
    for nodes, count in ((60, 40), (200, 260), (50, 0)):
        links = [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(count)] + [(k, k + 1) for k in range(300, 340)]
        parent = {x: x for link in links for x in link}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r.a: r.b for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), folder(spark)).collect()}
        assert got == {x: find(x) for x in parent if find(x) != x}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_near_duplicates(spark, sf).collect()}
    assert got == expected(rows)
    assert sum(not kept for _, _, kept in got.values()) > 0
