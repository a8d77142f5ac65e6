"""Operator 12 against a dense eigendecomposition and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from herald.llm import whitening as op

SHAPE = "vec_id long, embedding array<double>"


def brute(rows, components=op.COMPONENTS):
    """Integers x of the rows that remain, their deviations, V, and its leading eigenvalues and vectors."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    c = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    return [k for k, _ in kept], deviation, c, np.trace(v), values[::-1][:components], vectors[:, ::-1][:, :components]


def check(spark, rows, got, components=op.COMPONENTS):
    ids, deviation, c, trace, values, vectors = brute(rows, components)
    held = {}
    for r in got:
        held.setdefault(r["component"], []).append(r)
    assert sorted(held) == list(range(1, len(values) + 1))
    for k, found in held.items():
        w = dict(zip(ids, c @ vectors[:, k - 1] / math.sqrt(values[k - 1])))
        assert sorted((r["vec_id"], r["deviation"], r["n"]) for r in found) == sorted((i, d, len(ids)) for i, d in zip(ids, deviation))
        sign = np.sign(sum(r["whitened"] * w[r["vec_id"]] for r in found))
        assert max(abs(sign * r["whitened"] - w[r["vec_id"]]) for r in found) < 1e-9
        assert all(abs(r["explained"] - values[k - 1] / trace) <= 1e-9 * values[k - 1] / trace for r in found)
        assert 0 <= found[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in found}) == 1


def test_rows_that_are_left_out(spark):
    draw = np.random.default_rng(1)
    rows = [(k, [float(a) for a in draw.normal(size=12) * np.arange(1, 13)]) for k in range(80)]
    bad = [(100, None), (101, [None] * 12), (102, [math.nan] * 12), (103, [math.inf] + [0.0] * 11), (104, []), (105, [1.0] * 5), (None, None)]
    df = spark.createDataFrame(rows + bad, SHAPE).repartition(3).withColumn("n", F.lit("own")).withColumn("component", F.lit("own")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    check(spark, rows, op.whitened(df).collect())
    assert {r["vec_id"] for r in op.whitened(spark.createDataFrame([*rows, (None, rows[0][1])], SHAPE)).collect()} == {None, *range(80)}


@pytest.mark.parametrize("dims, components", [(1, 8), (2, 8), (8, 8), (9, 3), (60, 8)])
def test_small_and_large_dimensions(spark, dims, components):
    """As many dimensions as components, fewer, and more than the block."""
    draw = np.random.default_rng(dims)
    rows = [(k, [float(a) for a in draw.normal(size=dims) * np.linspace(1, 2, dims)]) for k in range(200)]
    check(spark, rows, op.whitened(spark.createDataFrame(rows, SHAPE), components=components).collect(), components)


def test_no_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(k, [0.5, 0.5]) for k in range(5)], [(1, None)]):
        assert op.whitened(spark.createDataFrame(rows, SHAPE)).count() == 0
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(10)]  # one component has variance
    assert {r["component"] for r in op.whitened(spark.createDataFrame(line, SHAPE)).collect()} == {1}


def test_deviations_beyond_a_long():
    n, x = 4, np.array([[1 << 40, 0], [0, 0], [-(1 << 20), 5], [3, 1 << 30]], np.int64)
    sums = x.sum(axis=0)
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert op.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want] and None in op.deviations(x, n, sums)


def test_level_spectrum(spark):
    """Equal eigenvalues: any orthonormal basis whitens."""
    rows = [(2 * k + s, [float((2 * s - 1) * (k == j)) for j in range(50)]) for k in range(50) for s in range(2)]
    got = op.whitened(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 800 and got[0]["identity_error"] < 1e-9 and all(abs(r["explained"] - 1 / 50) < 1e-9 for r in got)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], [float(a) for a in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(spark, rows, op.op12_whitening(spark, sf_dir).collect())
