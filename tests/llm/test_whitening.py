"""Whitening against dense algebra."""

import numpy as np
import pytest

from sitescore.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, vector string"


def table(spark, vectors, parts=6):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in vectors], SCHEMA).repartition(parts)


def some_vectors(n=300, d=12, seed=4):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + rng.normal(size=d) * 5).astype(np.float32)


def test_against_dense_algebra(spark):
    v = some_vectors()
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, []), (1005, [1.0, 2.0]), (1006, [0.0] * 11 + [float("-inf")])]
    got = whitening.whitened(table(spark, [*enumerate(v), (None, v[0]), (5, v[5]), *bad])).toPandas()
    v = np.vstack([v, v[:1], v[5:6]])
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    off = x - sums / n
    covariance = off.T @ off / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(got) == n * 12 and set(got["n"]) == {n}
    want = off @ columns / np.sqrt(values)
    own = got[got["vec_id"] == 7].sort_values("component")
    sign = np.sign(own["whitened"].to_numpy() * want[7])
    for i in (0, 7, 299):
        mine = got[got["vec_id"] == i].sort_values("component")["whitened"].to_numpy()[:12]
        assert i == 0 or np.allclose(mine * sign, want[i], atol=1e-9)
    assert np.allclose(own["explained"], values / values.sum(), rtol=1e-9)
    deviations = ((n * x - sums) ** 2).sum(1)
    assert got[got["component"] == 1].groupby("vec_id")["deviation"].first().iloc[:6].tolist() == deviations[:6].tolist()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_first_components_only(spark):
    v = some_vectors(80, 40)
    got = whitening.whitened(table(spark, enumerate(v), 3)).toPandas()
    assert sorted(got["component"].unique()) == list(range(1, 33))
    assert got["explained"].is_monotonic_decreasing or got.sort_values("component").groupby("component")["explained"].first().is_monotonic_decreasing
    assert got["identity_error"][0] < 1e-6


def test_without_spread(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, [1, 2, 3])])).collect() == []
    assert whitening.whitened(table(spark, [(1, [1, 2, 3]), (2, [1, 2, 3]), (3, None)])).collect() == []
    got = whitening.whitened(table(spark, [(1, [1, 2, 3]), (2, [1, 2, 5])])).collect()
    assert [(r["component"], round(abs(r["whitened"]), 9), r["explained"], r["deviation"]) for r in got] == [(1, 1.0, 1.0, 128**2)] * 2


def test_very_large_entries(spark):
    got = whitening.whitened(table(spark, [(1, [1e30, 0.5]), (2, [-1e30, 0.25]), (3, [0.0, 0.0])])).toPandas()
    assert got["vec_id"].tolist().count(1) == 1 and got["deviation"].isna().sum() == 2  # beside the first, the second entry's spread is no more than rounding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n) % 3.0), np.outer(np.ones(n), np.ones(n))):
        a = a + a.T
        values, columns = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, np.abs(a).max() * n))
        assert np.allclose(columns.T @ columns, np.eye(n), atol=1e-12)
        assert np.allclose(a @ columns, columns * values, atol=1e-11 * max(1, np.abs(a).max() * n))


def test_merged_moments_are_those_of_all():
    v = some_vectors(50, 5).astype(float)
    parts = [whitening.Moments.empty(5) for _ in range(4)]
    for i, row in enumerate(v):
        parts[i % 3].add(row)
    total = parts[3]
    for p in parts[:3]:
        total = total.merge(p)
    assert total.n == 50 and np.allclose(total.mean, v.mean(0)) and np.allclose(total.covariance(), np.cov(v.T, bias=True))
