"""Embedding whitening from an exact covariance: bit planes of the dimensions, packed across rows, AND and popcount.

Entries become whole numbers; shifted by the dimension's least one they are sums of bit planes. A plane of 64 rows is a word,
so the cross-product of two dimensions is a sum of popcounts of ANDed words, weighted by powers of two. All sums are whole
numbers, also the centred ones; doubles begin with the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.session import stage

#: Fixed values of the whole numbers: floor(SCALE * entry) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Rows whose planes are held at once; a multiple of 64.
BLOCK_ROWS = 16_384
#: Eigenvalues below this part of the largest one are rounding errors of zero; such a direction can't be scaled to variance 1.
LEAST_EIGENVALUE = 1e-13


@dataclass(frozen=True)
class Fit:
    """n, the sums of the whole numbers, unit eigenvectors as columns, their eigenvalues (falling) and shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): the vectors as whole numbers, without those that are null or hold an entry that is null or not finite."""
    entry = lambda v: v.cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(entry(v)) & (F.abs(entry(v)) < F.lit(float("inf")))
    given = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    kept = given.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    return kept.select("vec_id", F.transform("vector", lambda v: F.floor(entry(v) * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def dimension_totals(x: DataFrame) -> list[tuple[int, int, int, int]]:
    """n, sum, least and largest number of each dimension; a row for each task and dimension goes into the sums."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch, 0)
            # halves keep the sums of a batch within 64 bits, whatever the numbers are
            found = [(int(a) << 32) + int(b) for a, b in zip((values >> 32).sum(axis=0), (values & 0xFFFFFFFF).sum(axis=0), strict=True)]
            least, most = values.min(axis=0), values.max(axis=0)
            sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
            n += len(values)
        if n:
            columns = [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), _decimals(sums), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "total", "low", "high"])

    found = x.select("x").mapInArrow(totals, "dim int, n bigint, total decimal(38,0), low bigint, high bigint")
    found = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return [(r.n, int(r.total), r.low, r.high) for r in found.orderBy("dim").collect()]


def _decimals(numbers: list[int]) -> pa.Array:
    return pa.array([Decimal(number) for number in numbers], pa.decimal128(38, 0))


def _planes(shifted: np.ndarray, widths: list[int]) -> np.ndarray:
    """The bit planes of each dimension in turn, lowest first: a row of 64-bit words for each plane."""
    rows = np.zeros((-(-len(shifted) // 64) * 64, shifted.shape[1]), dtype=np.uint64)
    rows[: len(shifted)] = shifted
    firsts = np.concatenate([[0], np.cumsum(widths)])
    words = np.zeros((int(firsts[-1]), len(rows) // 64), dtype=np.uint64)
    for bit in range(max(widths, default=0)):
        packed = np.packbits(((rows >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=0)
        packed = np.ascontiguousarray(packed.T).view(np.uint64)
        own = [dim for dim, width in enumerate(widths) if width > bit]
        words[[int(firsts[dim]) + bit for dim in own]] = packed[own]
    return words


def _popcounts(words: np.ndarray, counts: np.ndarray) -> None:
    """Adds the rows in which both planes are set, for each pair of planes (the second one not before the first)."""
    for plane in range(len(words)):
        counts[plane, plane:] += np.bitwise_count(words[plane] & words[plane:]).sum(axis=1, dtype=np.int64)


def _weighted(counts: np.ndarray, widths: list[int], rows: int) -> np.ndarray:
    """Cross-products of the dimensions from the popcounts of their planes; in Python's numbers where 64 bits are too few."""
    counts = np.triu(counts) + np.triu(counts, 1).T
    bits = np.concatenate([np.arange(width) for width in widths]) if widths else np.zeros(0, dtype=np.int64)
    if rows.bit_length() + 2 * max(widths, default=0) + 2 < 63:
        weights = np.int64(1) << bits.astype(np.int64)
    else:
        counts, weights = counts.astype(object), np.array([1 << int(bit) for bit in bits], dtype=object)
    product = counts * weights[:, None] * weights[None, :]
    dims = np.repeat(np.arange(len(widths)), widths)
    sums = np.zeros((len(widths), len(widths)), dtype=product.dtype)
    np.add.at(sums, (dims[:, None], dims[None, :]), product)
    return sums


def cross_products(x: DataFrame, low: list[int], high: list[int]) -> dict[tuple[int, int], int]:
    """The sum over all rows of (x_i - low_i) * (x_j - low_j), for i <= j.

    A task holds one block of rows as words and one table of popcounts; a row for each task and pair goes into the sums, and
    the driver gets one for each pair.
    """
    widths = [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    least = np.array(low, dtype=np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((sum(widths), sum(widths)), dtype=np.int64), 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                shifted = (_matrix(batch.slice(first, BLOCK_ROWS), 0) - least).astype(np.uint64)
                _popcounts(_planes(shifted, widths), counts)
                rows += len(shifted)
        if rows:
            i, j = np.triu_indices(len(widths))
            products = _decimals([int(p) for p in _weighted(counts, widths, rows)[i, j]])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), products], names=["i", "j", "product"])

    found = x.select("x").mapInArrow(scatter, "i int, j int, product decimal(38,0)")
    return {(r.i, r.j): int(r.product) for r in found.groupBy("i", "j").agg(F.sum("product").alias("product")).collect()}


def fit(x: DataFrame, components: int = 32) -> Fit | None:
    """Mean, components and eigenvalues of `x`, a staged frame of whole_vectors of one length; None without rows."""
    totals = dimension_totals(x)
    if not totals:
        return None
    n, sums, low = totals[0][0], [t[1] for t in totals], [t[2] for t in totals]
    products = cross_products(x, low, [t[3] for t in totals])
    rest = [s - n * least for s, least in zip(sums, low, strict=True)]
    scatter = np.zeros((len(sums), len(sums)))
    for (i, j), product in products.items():
        # n * n * covariance is a whole number; dividing such numbers rounds once
        scatter[i, j] = scatter[j, i] = (n * product - rest[i] * rest[j]) / (n * n)
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    usable = int(np.sum(values > max(values[0], 0) * LEAST_EIGENVALUE)) if values[0] > 0 else 0
    kept = min(components, usable)
    trace = float(np.trace(scatter))
    explained = values[:kept] / trace if kept else np.zeros(0)
    return Fit(n, sums, np.ascontiguousarray(vectors[:, :kept]), values[:kept].copy(), explained)


def project(x: DataFrame, found: Fit) -> DataFrame:
    """(vec_id, whitened, deviation): the centred vectors on the components, each scaled to variance 1, and the sum over
    the dimensions of (n * x - sum)^2, as a whole number."""
    n, sums = found.n, np.array(found.sums, dtype=object)
    narrow = all(abs(s) < 2**62 for s in found.sums)
    scaled = found.vectors / np.sqrt(found.values)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch, 1)
            if narrow and int(np.abs(values).max(initial=0)) * n < 2**62:
                centred = values * np.int64(n) - sums.astype(np.int64)
            else:
                centred = values.astype(object) * n - sums
            wide = centred if int(np.abs(centred).max(initial=0)) ** 2 * max(1, centred.shape[1]) < 2**63 else centred.astype(object)
            deviation = _decimals([int(d) for d in (wide * wide).sum(axis=1)])
            whitened = (centred / n).astype(np.float64) @ scaled
            ends = np.arange(0, whitened.size + 1, max(1, whitened.shape[1]), dtype=np.int32) if whitened.shape[1] else np.zeros(len(values) + 1, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, deviation], names=["vec_id", "whitened", "deviation"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.select("vec_id", "x").mapInArrow(whiten, f"vec_id {kind}, whitened array<double>, deviation decimal(38,0)")


def identity_error(whitened: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, from the vectors themselves."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch, 0)
                n, sums, products = n + len(values), sums + values.sum(axis=0), products + values.T @ values
        if n:
            i, j = np.triu_indices(count)
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(products[i, j]), pa.array(sums[i]), pa.array([n] * len(i), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "product", "total", "n"])

    found = whitened.select("whitened").mapInArrow(moments, "i int, j int, product double, total double, n bigint")
    rows = found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("product", "total", "n"))).collect()
    means = {r.i: r.total / r.n for r in rows}
    return max((abs(r.product / r.n - means[r.i] * means[r.j] - (r.i == r.j)) for r in rows), default=0.0)


def usual_length(vectors: DataFrame) -> int | None:
    """The length that most vectors have, of several the greatest."""
    lengths = vectors.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else None


def whiten(rows: DataFrame, folder: str, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Fit | None, float]:
    """(vec_id, whitened, deviation) for each vector that is not left out, with the fit and the identity error.

    An entry c becomes floor(64 * c) + 1,000,000; mean, covariance (divisor n) and components are those of these numbers over
    all vectors that stay. Component 1 has the largest eigenvalue.

    - Vectors that are null or hold an entry that is null or not finite are left out. So are vectors of another length than
      most have (of equally many, the greatest length), which lack entries. Rows that repeat a vec_id or a vector count each.
    - Directions without variance can't be scaled to variance 1, so there are at most as many components as the covariance has
      rank: none for one vector, for vectors that are all equal, and for vectors without entries.
    - An entry beyond 1.4e17, whose whole number has more than 64 bits, is an error. No rows give no rows. Other columns are
      not read.
    """
    spark = rows.sparkSession
    kept = stage(whole_vectors(rows, vec_id, vector), folder, "vectors")
    size = usual_length(kept)
    kept = kept.where(F.size("x") == (size if size is not None else 0))
    found = fit(kept, components) if size else None
    if found is None:
        kind = kept.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, whitened array<double>, deviation decimal(38,0)"), None, 0.0
    whitened = stage(project(kept, found), folder, "whitened")
    return whitened, found, identity_error(whitened, len(found.values))


def long_rows(whitened: DataFrame, found: Fit | None, error: float) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    shares: Column = F.array(*(F.lit(float(s)) for s in found.explained)) if found and len(found.explained) else F.array().cast("array<double>")
    n = found.n if found else 0
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
