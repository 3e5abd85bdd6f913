import zlib

from helpers_llm import folder
from pyspark.sql import functions as F

from barlake.llm import queries, rule_ensemble


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_rule_ensemble(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out and r.quality is not None]
    assert len(unseen) > 50
    assert sum(r.predicted == r.quality for r in unseen) >= 0.95 * len(unseen)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    hidden = rule_ensemble.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"source": F.lit("s"), "lang": F.lit("l"), "score": F.lit(1)})
    score = lambda d, x: {r.doc_id: r.score for r in rule_ensemble.score_quality(d, x, folder(spark)).collect()}
    assert score(docs, labels) == score(renamed, flipped)


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "# # #"), (4, "x" * 300_000)], "doc_id long, text string")
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 3))
    # the share of label 1, smoothed by one of each; the repeated document counts twice, its lowest label holds
    for labels, share in (([], 0.5), ([(1, 1), (1, None)], 2 / 3), ([(1, 5), (None, 1)], 0.5), ([(3, 0), (3, 1)], 1 / 4)):
        rows = rule_ensemble.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), folder(spark)).collect()
        assert len(rows) == 6 and all(abs(r.score - share) < 1e-9 for r in rows)
    assert rule_ensemble.score_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"), folder(spark)).count() == 0


def test_rules_are_sparse_conjunctions(spark):
    sf = "/root/testdata/sf0.01"
    rows = rule_ensemble.training_rows(
        queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), folder(spark), rule_ensemble.Settings(), "doc_id", "text", "quality"
    )
    ensemble = rule_ensemble.fit(rows)
    assert 0 < len(ensemble.rules) < 80
    assert {c.statistic for rule, _ in ensemble.rules for c in rule} <= set(rule_ensemble.STATISTICS)
    few = rule_ensemble.training_rows(
        queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), folder(spark), rule_ensemble.Settings(max_rows=100), "doc_id", "text", "quality"
    )
    assert 50 < few.count() < 160
