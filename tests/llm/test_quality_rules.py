from collections import Counter

from helpers_llm import words

from barlake.llm import quality_rules


def brute(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    often = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if often[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(found),
        sum(map(len, found)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(repeated),
        len(found) < 50 or 100 * len(repeated) > 50 * len(found),
    )


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_words")
    return quality_rules.judge_quality(docs).collect()


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\rw", "é ü 漢 字 é ü 漢 字", "# * $ %", "a\n\na\n a\na"]
    texts += ["to be or not to be " * 3000, "w" * 100_000, "the a of\n" * 60, "\n".join(f"the {k} of {k + 1}" for k in range(100)), "the a of\n" * 60]
    got = {r.doc_id: r for r in judged(spark, list(enumerate(texts)))}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), repr(text)[:80]
        assert not (r.kept and r.base_failed)


def test_no_rows(spark):
    assert judged(spark, []) == []


def test_hash_clashes_are_told_apart(spark, monkeypatch):
    # all windows of a text get one hash, so neighbours differ and the windows are compared as strings
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_rules, "windows_key", lambda words, place: F.lit(7).cast("long"))
    texts = ["a b c x a b c y", "a b c d e f", "x " * 40, "a b a b a b a"]
    got = {r.doc_id: r for r in judged(spark, list(enumerate(texts)))}
    assert [got[k].n_repeat_words for k in range(4)] == [brute(t)[4] for t in texts]


def test_texts_beyond_the_place_bits(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 4)
    texts = ["a b c " * 30, " ".join(map(str, range(60)))]
    got = {r.doc_id: r for r in judged(spark, list(enumerate(texts)))}
    assert [got[k].n_repeat_words for k in range(2)] == [brute(t)[4] for t in texts]


def test_clean_stays_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.judge_quality(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_plan_runs_no_python(spark):
    plan = quality_rules.judge_quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
