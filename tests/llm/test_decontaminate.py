import re

from helpers_llm import folder

from barlake.llm import decontaminate, queries

ITEM = "At noon Anna has 12 apples and gives 5 apples to Ben so how many apples does Anna keep after lunch today"


def judged(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS key", "2 AS text_hash")
    items = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate.judge_leaks(docs, items, folder(spark), **more).collect()


def test_other_numbers_and_names_are_found(spark):
    same = ITEM.replace("12", "7").replace("5", "1,000").replace("Anna", "Maria").replace("Ben", "Tom")
    torn = ITEM.replace("12", "7").replace("has Anna", "x").replace("does Anna", "does Peter").replace("noon Anna", "noon Maria")
    other = "At noon the cat sleeps and dreams of birds so how many dreams does it have before dinner is served today"
    docs = [(1, f"Intro text here. {same}. The end."), (2, torn), (3, other), (4, ITEM.upper()), (5, f"{ITEM[:40]} and then something else entirely")]
    got = {r.doc_id: r for r in judged(spark, docs, [(9, ITEM)])}
    assert got[1].items == [9] and got[1].coverage == 1.0
    assert got[2].coverage < got[1].coverage
    assert not got[3].contaminated and got[3].items == []
    assert not got[5].contaminated


def test_copies_in_any_case_and_wrapping_are_found(spark):
    words = ITEM.split()
    wrapped = "\n".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3))
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.replace(" ", "\n")), (4, ITEM.replace(" ", "  ")), (5, ITEM.title()), (6, f"Word {wrapped}")]
    docs += [(7, wrapped.replace("12", "7").replace("Anna", "Maria"))]
    got = {r.doc_id: (r.items, r.coverage) for r in judged(spark, docs, [(9, ITEM)])}
    assert got == {k: ([9], 1.0) for k in range(1, 8)}


def test_slots_must_agree(spark):
    item = "first we take 3 parts of flour and later we take 3 parts of sugar and mix 4 parts of milk"
    match = "first we take 8 parts of flour and later we take 8 parts of sugar and mix 2 parts of milk"
    clash = "first we take 8 parts of flour and later we take 7 parts of sugar and mix 2 parts of milk"
    fused = "first we take 8 parts of flour and later we take 8 parts of sugar and mix 8 parts of milk"
    got = {r.doc_id: r.contaminated for r in judged(spark, [(1, match), (2, clash), (3, fused)], [(1, item)])}
    assert got == {1: True, 2: False, 3: False}


def test_a_clash_takes_only_its_own_windows(spark):
    tail = "then stir it with a long spoon until the whole bowl is warm and serve it on 6 plates to all of the guests"
    item = f"first we take 3 parts of flour and later 3 parts of sugar and 4 parts of milk {tail}"
    edited = item.replace("later 3", "later 5")
    fused = item.replace("3 parts", "8 parts").replace("4 parts", "8 parts").replace("6 plates", "9 plates")
    got = {r.doc_id: r for r in judged(spark, [(1, item), (2, edited), (3, fused), (4, fused.replace("9 plates", "8 plates"))], [(1, item)])}
    n = len(item.split())
    assert got[1].coverage == 1.0 and got[2].items == [1] and got[3].items == [1]
    assert got[2].coverage == (n - 1) / n
    assert got[4].coverage < got[3].coverage < 1.0


def test_long_excerpts_of_long_items_are_found(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    docs = [(1, "x " + " ".join(words[20:33]) + " y"), (2, "x " + " ".join(words[20:32]) + " y")]
    docs += [(3, " ".join(words[:9]) + " x " + " ".join(words[30:39])), (4, " ".join(words[:10]) + " x " + " ".join(words[10:20]))]
    got = {r.doc_id: (r.items, r.coverage) for r in judged(spark, docs, [(1, " ".join(words))])}
    assert got == {1: ([1], 13 / 60), 2: ([], 0.0), 3: ([], 0.0), 4: ([], 0.0)}


def test_items_dense_in_slots_and_short_items_are_found(spark):
    dense = "Solve 3 + 4 * 5 - 6 / 2 + 7 and then add 8 9 10 11 12 13 14 15 to get it"
    items = [(1, dense), (2, "1 2 3 4 5 6 7 8 9"), (3, "Paris or Rome")]
    docs = [(1, f"Intro. {dense} The end."), (2, "so 1 2 3 4 5 6 7 8 9 and on"), (3, "in paris, or rome?"), (4, "3 4 5 6 2 7 1 1 1 9 9 9 8 8 8"), (5, "Paris and Rome")]
    got = {r.doc_id: (r.items, r.coverage) for r in judged(spark, docs, items)}
    assert got == {1: ([1], 1.0), 2: ([2], 1.0), 3: ([3], 1.0), 4: ([], 0.0), 5: ([], 0.0)}


def test_odd_rows(spark):
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short"), (None, ITEM), (5, "1 2 3 4 5 6 7 8 9")]
    docs = [(1, None), (2, ""), (3, "word " * 60_000 + ITEM), (3, "word " * 60_000 + ITEM), (None, ITEM), (None, "clean"), (7, ITEM), (7, "clean"), (8, "1 2 3 4 5 6 7 8 9")]
    got = judged(spark, docs, items)
    assert len(got) == len(docs)
    assert sorted((repr(r.doc_id), r.contaminated) for r in got) == sorted(
        [("1", False), ("2", False), ("3", True), ("3", True), ("None", True), ("None", False), ("7", True), ("7", False), ("8", True)]
    )
    assert judged(spark, [], items) == [] and not judged(spark, docs, [])[0].contaminated
    left = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), folder(spark))
    assert left.columns == ["doc_id", "text"] and left.count() == 4


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in queries.table(spark, sf, "benchmark").collect()}
    texts = {r.doc_id: plain(r.text) for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op8_benchmark_templates(spark, sf).collect()
    assert {r.doc_id: r.items for r in got} == {i: [k for k, item in sorted(items.items()) if item in t] for i, t in texts.items()}
    assert sum(r.contaminated for r in got) > 10


def test_plan_runs_no_python(spark):
    sf = "/root/testdata/sf0.001"
    plan = queries.op8_benchmark_templates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
