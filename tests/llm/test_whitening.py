"""Whitening against NumPy's own decomposition, and its rows on odd tables."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.llm import spectrum, whitening
from veritab.llm.queries import QUERIES
from veritab.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, n string, id string, vec string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "x", None, "x") for i, v in rows], KIND)


def check_pairs(v, count):
    values, vectors = spectrum.leading_pairs(v, count)
    want = np.linalg.eigvalsh(v)[::-1][:len(values)]
    size = max(np.abs(v).max(initial=0), 1e-300)
    assert np.allclose(values, want, atol=1e-12 * size * len(v))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-12 * size * len(v)
    return values


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10**6), st.integers(0, 3))
def test_eigenpairs(n, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, n))
    if kind == 1:  # few distinct eigenvalues
        q, _ = np.linalg.qr(a)
        a = q @ np.diag(rng.integers(0, 3, n).astype(float)) @ q.T
    elif kind == 2:  # blocks that repeat, so that the tridiagonal form falls apart
        a = np.kron(np.eye(max(n // 3, 1)), rng.standard_normal((3, 3)))
    elif kind == 3:
        a = np.diag(rng.integers(0, 4, n).astype(float))
    check_pairs(a @ a.T, 32)


def test_clusters_and_empty_matrices():
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((64, 64)))
    assert len(check_pairs(q @ np.diag(np.r_[np.full(10, 5.0), np.full(10, 5 - 1e-9), np.ones(44)]) @ q.T, 32)) == 32
    assert len(check_pairs(q @ np.diag(np.r_[7, np.full(20, 2.0), np.zeros(43)]) @ q.T, 64)) == 21
    assert len(check_pairs(np.eye(40) * 3, 32)) == 32
    assert len(spectrum.leading_pairs(np.zeros((4, 4)), 2)[0]) == 0
    assert len(spectrum.leading_pairs(np.zeros((0, 0)), 2)[0]) == 0


def brute(vectors, count=32):
    """{(row, component): (n, deviation, |whitened|, explained)} of one list of equally long vectors."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s).astype(float) / n
    w, u = np.linalg.eigh(c.T @ c / n)
    w, u = w[::-1][:count], u[:, ::-1][:, :count]
    k = int((w > 4 * len(s) * 2.3e-16 * max(w[0], 0)).sum()) if w[0] > 0 else 0
    white = c @ u[:, :k] / np.sqrt(w[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), np.abs(white), w[:k] / np.trace(c.T @ c / n)


def check_rows(got, ids, vectors):
    n, deviation, white, explained = brute(vectors)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == white.size
    for i, name in enumerate(ids):
        for k in range(white.shape[1]):
            r = rows[name, k + 1]
            assert (r.n, r.deviation) == (n, deviation[i]) and r.identity_error < 1e-4
            assert abs(abs(r.whitened) - white[i, k]) < 1e-7 and abs(r.explained - explained[k]) < 1e-9


def test_rows_of_odd_tables(spark):
    rng = np.random.default_rng(3)
    good = [rng.standard_normal(5).tolist() for _ in range(30)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [nan] * 5), (103, [inf, 0.0, 0.0, 0.0, 0.0]), (104, [])]
    rows = [*enumerate(good), *bad, (200, [1.0, 2.0])]
    got = whiten(table(spark, rows)).collect()
    # The lone vector of two components is a fit of its own, without components.
    check_rows(got, range(30), good)
    assert not whiten(table(spark, [])).collect() and not whiten(table(spark, bad)).collect() and not whiten(table(spark, [(1, [1.0]), (2, [1.0])])).collect()


def test_lengths_are_separate_spaces_and_rows_repeat(spark):
    rng = np.random.default_rng(4)
    short, long_ = [rng.standard_normal(2).tolist() for _ in range(9)], [(rng.standard_normal(4) * 1e3).tolist() for _ in range(11)]
    got = whiten(table(spark, [*enumerate(short), *((50 + i, v) for i, v in enumerate(long_))])).collect()
    check_rows([r for r in got if r.vec_id < 50], range(9), short)
    check_rows([r for r in got if r.vec_id >= 50], range(50, 61), long_)
    twice = whiten(table(spark, [(None, [0.0, 1.0]), (7, [3.0, 1.5]), (7, [3.0, 1.5]), (8, [-1.0, 2.0])])).collect()
    assert len(twice) == 8 and {r.n for r in twice} == {4} and sum(r.vec_id == 7 for r in twice) == 4 and sum(r.vec_id is None for r in twice) == 2


def test_huge_components_stay_exact_or_null(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [5.0, 2.0]]
    got = whiten(table(spark, list(enumerate(vectors)))).collect()
    assert {r.vec_id for r in got} == {0, 1, 2}
    assert {r.deviation for r in got if r.vec_id != 2} == {None} and all(np.isfinite(r.whitened) for r in got)
    x = np.array([[1 << 33, -(1 << 40)], [3, 5]])
    dev = whitening._deviations(x, 10**9, [10**9 * (1 << 33), 7])
    assert dev.dtype == object and whitening._square_sums(dev)[0] is None
    assert [Fraction(int(v)) for v in dev[1]] == [Fraction(10**9 * 3 - 10**9 * (1 << 33)), Fraction(10**9 * 5 - 7)]


@pytest.mark.parametrize("sf", [SF])
def test_query_against_numpy(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    got = QUERIES["op11_whitening"](spark, sf).collect()
    check_rows(got, [r.vec_id for r in t], [r.embedding for r in t])
    assert len({(r.component, r.explained) for r in got}) == 32
