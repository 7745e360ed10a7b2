"""Whitening against a plain covariance of all rows, on the small table and on awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, w string, at string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 0, "w", "at") for k, v in enumerate(vectors)], SCHEMA)


def brute(vectors, components=8):
    """(deviations, whitened by row, shares) from whole-number x and one covariance matrix."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array(x, dtype=float) - np.array(s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return deviation, centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(rows, vectors, ids):
    deviation, whitened, shares = brute(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(ids)
    k = whitened.shape[1]
    signs = np.array([np.sign(by[ids[0]][c + 1].whitened * whitened[0, c]) for c in range(k)])
    for i, vec_id in enumerate(ids):
        got = by[vec_id]
        assert sorted(got) == list(range(1, k + 1))
        assert all(r.n == len(vectors) and r.deviation == deviation[i] for r in got.values())
        assert np.allclose([got[c + 1].whitened for c in range(k)] * signs, whitened[i], rtol=1e-7, atol=1e-7)
        assert np.allclose([got[c + 1].explained for c in range(k)], shares, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in got.values())


@pytest.mark.parametrize("width,tile", [(64, 32), (11, 4), (3, 32), (8, 8)])
def test_whitening_equals_one_matrix(spark, width, tile):
    rng = np.random.default_rng(width)
    vectors = (rng.normal(size=(300, width)) * rng.uniform(0.1, 2, width) + rng.normal(size=width)).astype(np.float32).tolist()
    check(whitening.whiten(table(spark, vectors).repartition(5), tile=tile).collect(), vectors, list(range(300)))


def test_query_equals_one_matrix(spark):
    held = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    kept = [r for r in held if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(queries.QUERIES["op13_tiled_whitening"](spark, SF).collect(), [r.embedding for r in kept], [r.vec_id for r in kept])


def test_unusable_vectors_are_dropped(spark):
    rng = random.Random(2)
    good = [[float(np.float32(rng.gauss(0, 1))) for _ in range(5)] for _ in range(40)]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [0.0, float("-inf"), 0.0, 0.0, 0.0]]
    check(whitening.whiten(table(spark, good + bad)).collect(), good, list(range(40)))


def test_empty_tables_give_no_rows(spark):
    for vectors in ([], [None], [[]]):
        found = whitening.whiten(table(spark, vectors))
        assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_one_row_and_equal_rows_have_no_variance(spark):
    for vectors in ([[1.0, 2.0]], [[0.5, 0.25]] * 3):
        rows = whitening.whiten(table(spark, vectors)).collect()
        assert len(rows) == 2 * len(vectors)
        assert all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in rows)


def test_a_flat_direction_is_left_out(spark):
    vectors = [[float(k), 3.0, float(k % 3)] for k in range(12)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r.component for r in rows if r.whitened is None} == {3} and all(r.identity_error < 1e-9 for r in rows)


def test_shorter_vectors_are_filled_with_zeros(spark):
    vectors = [[1.0, 2.0, 0.5], [0.5], [], [2.0, 1.0, 0.25], [0.1, 0.9]]
    filled = [(v + [0.0] * 3)[:3] for v in vectors]
    check(whitening.whiten(table(spark, vectors)).collect(), [np.float32(v).tolist() for v in filled], list(range(5)))


def test_far_entries_keep_a_defined_result(spark):
    rows = whitening.whiten(table(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]])).collect()
    held = 2**25
    assert len(rows) == 6 and {r.deviation for r in rows if r.vec_id == 0} == {(3 * held) ** 2 + (3 * 1024) ** 2}
    big = whitening.whiten(table(spark, [[9e30 * (-1) ** k, float(k)] for k in range(200)])).collect()
    assert len(big) == 400 and all(r.deviation is None for r in big)
