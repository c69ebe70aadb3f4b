"""op13: exact sums, the factorisation, and whitened values against numpy."""

import math
import random

import numpy as np
import pytest

from pitwise.llm import queries, whitening
from pitwise.llm.tables import table
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 3) for i, v in rows], SCHEMA)


def check(rows, x, k=8):
    """rows of whiten() against numpy on the whole numbers x, in order of vec_id."""
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    e, u = e[::-1], u[:, ::-1]
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    got = np.array([r.whitened for r in rows]).reshape(n, -1)
    got = got * np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-6
    for r in rows[:got.shape[1]]:
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    assert [int(r.deviation) for r in rows if r.component == 1] == deviation
    assert {r.n for r in rows} == {n} and all(r.identity_error < 1e-9 for r in rows)


def test_query_matches_numpy(spark):
    rows = sorted(queries.op13_embedding_whitening(spark, SF_SMALL).collect(), key=lambda r: (r.vec_id, r.component))
    src = sorted(table(spark, SF_SMALL, "embeddings").collect(), key=lambda r: r.vec_id)
    x = np.floor(1024 * np.array([r.embedding for r in src])).astype(np.int64) + 100000
    assert len(rows) == 8 * len(src)
    check(rows, x)


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 0.1)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 1.0]), (104, []), (105, [1.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    rows = sorted(whitening.whiten(frame(spark, good + bad)).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(rows) == 180  # three dimensions, three components
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100000
    check(rows, x, 3)
    again = whitening.whiten(frame(spark, good + good + [(None, good[0][1])]), k=2)
    assert again.count() == 2 * 121 and again.filter("vec_id is null").count() == 2 and again.first().n == 121


def test_no_rows_and_no_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0, float(2 * i)]) for i in range(20)]))
    assert flat.count() == 20 and {r.component for r in flat.collect()} == {1}


def test_wide_range_is_exact(spark):
    """Values whose products pass 64 bits."""
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1e9, 1e9), rng.uniform(0, 1)]) for i in range(50)]
    rows = sorted(whitening.whiten(frame(spark, vectors)).collect(), key=lambda r: (r.vec_id, r.component))
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = 50, [int(t) for t in x.sum(0)]
    assert [int(r.deviation) for r in rows if r.component == 1] == [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(frame(spark, [(1, [1e30]), (2, [2.0])])).count()


@pytest.mark.parametrize("top", [4, 1 << 19, 1 << 21, 1 << 35, 1 << 50])
def test_products_are_exact(top):
    z = np.random.default_rng(top).integers(-top, top, (200, 5))
    assert (whitening.products(z) == z.astype(object).T @ z.astype(object)).all()


@pytest.mark.parametrize("d", [1, 2, 7, 32])
def test_factorisation(d):
    rng = np.random.default_rng(d)
    for scale in (np.ones(d), 10.0 ** -np.arange(d).clip(max=7)):
        b = rng.normal(size=(d, d)) * scale
        v = b.T @ b
        factor, p = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(p, p)], atol=1e-12 * np.abs(v).max())
        assert np.allclose(factor, np.tril(factor))
        e, u = whitening._eigen(v)
        assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
        assert np.allclose(v @ u, u * e, atol=1e-12 * e[0])
        assert (np.diff(e) <= 0).all()
    low_rank = np.outer(np.arange(1, d + 1), np.arange(1, d + 1)).astype(float)
    assert whitening.pivoted_cholesky(low_rank)[0].shape[1] == 1
