import re

import pytest
import sentencepiece
from helpers_llm import near_components

import corpus_pipeline
from barlake.llm import queries, rule_ensemble

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        found.append((name, docs, spark.read.parquet(path)))
        docs = found[-1][2]
    return found


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
    assert steps[-1][2].columns == ["doc_id", "ids", "n_tokens", "round_trip", "parity"]


def test_quality(spark, steps):
    _, before, after = steps[0]
    left = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    scored = {r.doc_id: r.predicted for r in rule_ensemble.score_quality(before, queries.table(spark, SF, "labels"), spark.conf.get("spark.checkpoint.dir")).collect()}
    assert left == {i for i, p in scored.items() if p}
    known = [(i in left) == bool(q) for i, q in labels.items()]
    assert sum(known) >= 0.95 * len(known)


def test_near_copies(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    kept = {i for i, (_, c) in near_components(rows, 5).items() if i == c}
    assert {r.doc_id for r in after.collect()} == kept and len(kept) < len(rows)


def test_benchmark(spark, steps):
    _, before, after = steps[2]
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in before.collect() if not any(item in plain(r.text) for item in items)}
    assert {r.doc_id for r in after.collect()} == clean


def test_secrets_and_tokens(steps):
    _, before, after = steps[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    own = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    tokens = {r.doc_id: r for r in steps[4][2].collect()}
    for r in after.collect():
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) and r.n_chars == len(r.text)
        if not re.search(r"(?i)token|passw|secret|api_?key|AKIA|[0-9a-f]{32}|eyJ|gh[pousr]_|KEY--", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        assert tokens[r.doc_id].ids == own.encode(r.text) and tokens[r.doc_id].round_trip and tokens[r.doc_id].parity
    assert len(tokens) == len(texts)


def test_run(spark, steps):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids for r in steps[-1][2].collect()}


ODD = [
    (None, None, "a", 0),
    (900_001, None, "a", None),
    (900_002, "", "b", 0),
    (900_002, "", "b", 0),
    (900_003, "one two three four five six seven", "b", 33),
    (900_003, "one two three four five six seven", "b", 33),
    (None, "one two three four five six seven", "c", 33),
    (900_004, "password=abcdefghijk and some words around it", "c", 45),
    (900_005, "long words " * 20_000, "c", 220_000),
]
NAMES = "__score __secret_text __secret_spans __token_text __copy_id __copy_hash __leak_key __leak_hash".split()


def odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    return docs.selectExpr("*", *(f"'{name}' AS {name}" for name in NAMES))


def test_odd_rows_pass_all_stages(spark):
    docs = odd_rows(spark, ODD)
    stages = dict(corpus_pipeline.STAGES)
    left = {}
    for name in list(stages)[:-1]:
        after = stages[name](spark, docs, SF)
        assert after.columns == docs.columns, name
        left[name] = sorted((repr(r.doc_id), repr(r.text)[:40]) for r in after.collect())
        assert all(r[n] == n for r in after.collect() for n in NAMES)
    everything = sorted((repr(i), repr(t)[:40]) for i, t, _, _ in ODD)
    assert left["quality classifier"] in ([], everything)
    assert left["benchmark decontamination"] == everything
    assert len(left["secret scans"]) == len(ODD) and ("900004", "'[assign] and some words around it'") in left["secret scans"]
    kept = left["MinHash near-dedup"]
    assert sum("one two" in t for _, t in kept) == 1 and ("900003", repr("one two three four five six seven")) in kept
    assert [i for i, t in kept if t in ("None", "''")] == ["900001", "900002", "None"]
    tokens = stages["SentencePiece encoding and decoding"](spark, docs, SF).collect()
    assert len(tokens) == len(ODD) and sum(not r.ids for r in tokens) == 4 and all(r.round_trip and r.parity for r in tokens)


def test_no_rows_pass_all_stages(spark):
    docs = odd_rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_secrets_without_a_length(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijk")], "doc_id bigint, text string")
    assert corpus_pipeline.clean_secrets(spark, docs, SF).collect() == [(1, "[assign]")]
