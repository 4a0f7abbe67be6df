"""Whitening against whole-number brute force and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from tonemill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def brute(vectors, components=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    far = [[n * r[j] - sums[j] for j in range(dim)] for r in x]
    z = np.array([[f / n for f in r] for r in far])
    v = z.T @ z / n
    e, basis = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return [sum(f * f for f in r) for r in far], z, e[order], basis[:, order], float(np.trace(v))


def check(got, vectors, ids, components=32, tolerance=1e-8):
    deviation, z, e, basis, trace = brute(vectors, components)
    k = len(e)
    assert len(got) == len(vectors) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    white = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids], float)
    for at, i in enumerate(ids):
        assert {by[i, c + 1]["deviation"] for c in range(k)} == {deviation[at]}
    for c in range(k):
        assert {r["n"] for r in got} == {len(vectors)}
        assert abs(by[ids[0], c + 1]["explained"] - e[c] / trace) <= 1e-4 * e[c] / trace
        want = z @ basis[:, c] / math.sqrt(e[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < tolerance
    assert max(r["identity_error"] for r in got) < 1e-8
    assert np.abs(white.T @ white / len(vectors) - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("dim,parts", [(5, 1), (40, 6)])
def test_equals_brute_force(spark, dim, parts):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(200, dim)) @ rng.normal(size=(dim, dim)) * np.linspace(0.5, 6, dim)).tolist()
    rows = [(i, v, "x", "y") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    check(whitening.whiten(df).collect(), vectors, list(range(200)))


def test_small_eigenvalues_are_accurate():
    rng = np.random.default_rng(3)
    scale = 10.0 ** -np.arange(12)
    a = rng.normal(size=(12, 12))
    well = a @ a.T + 12 * np.eye(12)
    matrix = well * np.outer(scale, scale)
    values, basis = whitening.jacobi(matrix)
    assert (np.diff(values) <= 0).all() and np.abs(basis.T @ basis - np.eye(12)).max() < 1e-13
    from fractions import Fraction

    # The determinant of the scaled matrix, in exact arithmetic, is the product of the eigenvalues.
    m = [[Fraction(float(c)) for c in r] for r in matrix]
    det = Fraction(1)
    for i in range(12):
        det *= m[i][i]
        for j in range(i + 1, 12):
            f = m[j][i] / m[i][i]
            m[j] = [p - f * q for p, q in zip(m[j], m[i], strict=True)]
    assert abs(math.prod(values) / float(det) - 1) < 1e-10
    inverse = np.linalg.inv(well)
    assert abs(values[-1] * (inverse[-1, -1] / scale[-1] ** 2) - 1) < 0.2


def test_dropped_rows_repeats_and_missing_variance(spark):
    good = [[0.1 * i, (i * i % 7) / 3, 5.0, 0.1 * i] for i in range(30)]
    rows = [(i, v, None, None) for i, v in enumerate(good)] + [(3, good[3], None, None), (None, good[4], None, None)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [1.0, float("inf"), 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(100 + i, v, None, None) for i, v in enumerate(bad)], SCHEMA)
    got = whitening.whiten(df, components=4).collect()
    assert len(got) == 32 * 4 and {r["n"] for r in got} == {32}
    live = {r["component"]: r["whitened"] is not None for r in got}
    assert live == {1: True, 2: True, 3: False, 4: False}
    assert max(r["identity_error"] for r in got) < 1e-9
    deviation = brute([r[1] for r in rows])[0]
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)


def test_huge_entries_and_one_vector(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], None, None)], SCHEMA)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, 0.0, 0.0, 0)] * 2
    rows = [(1, [1e300, 0.0], None, None), (2, [-1e300, 1.0], None, None), (3, [0.0, 0.25], None, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
