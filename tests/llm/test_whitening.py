import math
import random
from fractions import Fraction

import numpy as np
import pytest

from barlake.llm import queries, whitening
from helpers_llm import folder

NAN, INF = float("nan"), float("inf")


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def brute(vectors):
    """Whole numbers, sums and the exact covariance as fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), range(len(x[0]))
    sums = [sum(row[d] for row in x) for d in dims]
    cov = [[Fraction(sum((n * row[i] - sums[i]) * (n * row[j] - sums[j]) for row in x), n**3) for j in dims] for i in dims]
    return x, sums, cov


def check(rows, ids, vectors):
    x, sums, cov = brute(vectors)
    n = len(x)
    exact = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(exact)[::-1]
    trace = float(sum(cov[d][d] for d in range(len(cov))))
    by_component = {}
    for r in rows:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, len(by_component) + 1))
    centred = {i: np.array([n * a - s for a, s in zip(row, sums)], dtype=float) / n for i, row in zip(ids, x)}
    for k, own in by_component.items():
        assert sorted(r.vec_id for r in own) == sorted(ids)
        assert {r.n for r in own} == {n}
        assert abs(own[0].explained - values[k - 1] / trace) < 1e-10
        # whitened * sqrt(e) is the projection on a unit vector u; u comes back from the projections: V u = e u
        weights = np.array([r.whitened for r in own])
        unit = np.array([centred[r.vec_id] for r in own]).T @ weights / n / math.sqrt(values[k - 1])
        assert abs(np.linalg.norm(unit) - 1) < 1e-8
        assert np.abs(exact @ unit - values[k - 1] * unit).max() < 1e-7 * values[0]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert all(r.deviation == deviation[r.vec_id] for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query_against_brute_force(spark):
    rows = queries.op12_bit_sliced_whitening(spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    given = [r for r in given if usable(r.embedding)]
    assert max(r.component for r in rows) == 32
    check(rows, [r.vec_id for r in given], [r.embedding for r in given])


def long(spark, vectors, **more):
    rows = spark.createDataFrame([(k, v, "a") for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, x string")
    return whitening.long_rows(*whitening.whiten(rows.repartition(3), folder(spark), **more)).collect()


def test_wide_and_negative_numbers(spark):
    random.seed(5)
    vectors = [[random.uniform(-3e5, 3e5), random.gauss(0, 1), random.choice([0.0, 1.0]), -1e-9 * k] for k in range(130)]
    check(long(spark, vectors), list(range(130)), vectors)


def test_numbers_beyond_64_bit_products(spark):
    random.seed(6)
    rows = spark.createDataFrame([(k, [random.uniform(-1e13, 1e13), random.gauss(0, 2)]) for k in range(40)], "vec_id bigint, embedding array<double>")
    whitened, found, error = whitening.whiten(rows, folder(spark))
    x, sums, cov = brute([r.embedding for r in rows.orderBy("vec_id").collect()])
    assert found.sums == sums
    assert abs(found.values[0] / max(float(cov[0][0]), float(cov[1][1])) - 1) < 1e-12
    wanted = [sum((40 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [int(r.deviation) for r in whitened.orderBy("vec_id").collect()] == wanted


def test_unusable_vectors_are_left_out(spark):
    good = [[float(k % 5), float(k % 3)] for k in range(20)]
    bad = [None, [NAN, 1.0], [INF, 1.0], [1.0, -INF], [None, 1.0], [1.0, None], [], [1.0], [1.0, 2.0, 3.0]]
    rows = long(spark, good + bad)
    assert {r.vec_id for r in rows} == set(range(20))
    check(rows, list(range(20)), good)


def test_repeated_rows_and_ids_count_each(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [3.0, 1.0])], "vec_id bigint, embedding array<float>")
    found = whitening.long_rows(*whitening.whiten(rows, folder(spark))).collect()
    assert len(found) == 8 and {r.n for r in found} == {4}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3])
def test_no_variance_gives_no_components(spark, vectors):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    whitened, found, error = whitening.whiten(rows, folder(spark))
    assert whitening.long_rows(whitened, found, error).collect() == []
    assert error == 0.0


def test_as_many_components_as_the_rank(spark):
    vectors = [[float(k), 2.0 * k, 7.0] for k in range(50)]
    rows = long(spark, vectors)
    assert {r.component for r in rows} == {1}
    assert {r.component for r in long(spark, [[random.random() * 9 for _ in range(6)] for _ in range(60)], components=4)} == {1, 2, 3, 4}


def test_popcounts_are_cross_products():
    random_numbers = np.random.default_rng(3)
    for top in (1, 2, 1000, 2**40):
        x = random_numbers.integers(0, top, (333, 5))
        widths = [int(c.max()).bit_length() for c in x.T]
        counts = np.zeros((sum(widths), sum(widths)), dtype=np.int64)
        for first in range(0, 333, 100):
            whitening._popcounts(whitening._planes(x[first : first + 100], widths), counts)
        wanted = x.astype(object).T @ x.astype(object)
        assert (whitening._weighted(counts, widths, 333) == wanted).all()
