"""Mutual information by nearest neighbours against plain distances of all pairs."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.operators import neighbours as nb


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def unit(name):
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2147483648.0 - 1


def scaled(values, names):
    v = np.array(values, float)
    s = v.std() or 1.0
    return v / s + 1e-10 * max(1.0, np.abs(v).mean() / s) * np.array([unit(n) for n in names])


def plain(x, y, ids, feature, k=3, discrete=False):
    use = [i for i in range(len(x)) if x[i] is not None and math.isfinite(x[i]) and y[i] is not None]
    if discrete:
        use = [i for i in use if sum(y[j] == y[i] for j in use) > 1]
    if len(use) < 2:
        return 0.0
    a = scaled([x[i] for i in use], [f"{feature}|{ids[i]}" for i in use])
    dx = np.abs(a[:, None] - a[None, :])
    if discrete:
        label = np.array([y[i] for i in use])
        total = []
        for i in range(len(use)):
            own = np.sort(dx[i][(label == label[i]) & (np.arange(len(use)) != i)])
            kk = min(k, len(own))
            total.append(psi(kk) - psi(len(own) + 1) - psi(int((dx[i] < own[kk - 1]).sum())))
        return max(0.0, psi(len(use)) + float(np.mean(total)))
    b = scaled([y[i] for i in use], [f"y|{ids[i]}" for i in use])
    dy = np.abs(b[:, None] - b[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    kk = min(k, len(use) - 1)
    r = np.sort(d, axis=1)[:, kk - 1]
    count = [psi(int((dx[i] < r[i]).sum())) + psi(int((dy[i] < r[i]).sum())) for i in range(len(use))]
    return max(0.0, psi(len(use)) + psi(kk) - float(np.mean(count)))


def test_digamma_of_whole_numbers(spark):
    got = spark.range(1, 400).select("id", nb.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-13) for r in got)


def test_two_thousand_rows_against_all_pairs(spark, monkeypatch):
    """Small cells, so that many points look into others; lone, tied, skewed and strongly dependent columns."""
    monkeypatch.setattr(nb, "CELL", 40)
    rng = np.random.default_rng(0)
    n = 2000
    y = rng.normal(size=n)
    cols = {"line": 3 * y, "noisy": y + rng.normal(size=n), "free": rng.normal(size=n), "steps": np.floor(rng.uniform(size=n) * 5) + (y > 0), "heavy": np.exp(4 * rng.normal(size=n))}
    cells = [[None if (i + j) % 41 == 0 else float("nan") if (i + j) % 43 == 0 else float(v) for j, v in enumerate(row)] for i, row in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame([(i, float(y[i]), int(i % 7 // 3), *c) for i, c in enumerate(cells)], "id long, y double, kind int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.score for r in nb.knn_mutual_information(df, list(cols), "y", "id").collect()}
    for j, c in enumerate(cols):
        assert got[c] == pytest.approx(plain([v[j] for v in cells], y, range(n), c), abs=1e-9)
    assert got["line"] > 3 > got["noisy"] > 0.2 > got["free"]
    by_class = {r.feature: r.score for r in nb.knn_mutual_information(df, ["noisy", "steps"], "kind", "id", k=4).collect()}
    for j, c in ((1, "noisy"), (3, "steps")):
        assert by_class[c] == pytest.approx(plain([v[j] for v in cells], [i % 7 // 3 for i in range(n)], range(n), c, 4, True), abs=1e-9)


def test_small_and_empty_tables(spark):
    kind = "id long, y double, a double, b double"
    assert [(r.n, r.score) for r in nb.knn_mutual_information(spark.createDataFrame([], kind), ["a"], "y", "id", discrete=False).collect()] == [(0, 0.0)]
    rows = [(1, 0.5, 1.0, None), (2, 1.25, 1.0, None), (3, 7.0, 2.0, None), (4, None, 9.0, 9.0)]
    got = {r.feature: (r.n, r.score) for r in nb.knn_mutual_information(spark.createDataFrame(rows, kind), ["a", "b"], "y", "id", discrete=False).collect()}
    assert got["b"] == (0, 0.0) and got["a"][0] == 3 and got["a"][1] == pytest.approx(plain([1.0, 1.0, 2.0], [0.5, 1.25, 7.0], [1, 2, 3], "a"), abs=1e-9)


def test_classes_are_sorted_not_compared(spark, monkeypatch):
    """Blocks of a few values over many tasks: small and lone classes, equal values, neighbours and bounds in other tasks. No two rows meet in a cell."""
    monkeypatch.setattr(nb, "BLOCK", 3)
    monkeypatch.setattr(nb, "_radii", None)
    rng = np.random.default_rng(3)
    n = 600
    kind = np.where(np.arange(n) == 7, 9, np.where(np.arange(n) % 100 == 3, 8, rng.integers(0, 3, n)))
    free, skewed = rng.normal(size=n), np.exp(6 * rng.normal(size=n))
    free[::50] = np.nan
    df = spark.createDataFrame([(i, int(kind[i]), float(free[i]), float(skewed[i])) for i in range(n)], "id long, kind int, free double, skewed double").repartition(7)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = {r.feature: r.score for r in nb.knn_mutual_information(df, ["free", "skewed"], "kind", "id", k=3, discrete=True).collect()}
            for name, v in (("free", free), ("skewed", skewed)):
                assert got[name] == pytest.approx(plain(v.tolist(), kind.tolist(), range(n), name, 3, True), abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("window", [4, 16, 1000])
def test_a_task_holds_a_window_of_an_axis(spark, monkeypatch, window):
    """Bounds that reach behind or beyond the values held, equal values across blocks and axes that share a task: counts as over the whole axis."""
    monkeypatch.setattr(nb, "BLOCK", 4)
    monkeypatch.setattr(nb, "WINDOW", window)
    rng = np.random.default_rng(window)
    rows = []
    for f, n in ((0, 90), (1, 3), (2, 57)):
        x = np.round(rng.normal(size=n), 1)
        reach = rng.choice([0.0, 0.1, 0.5, 9.0], n)
        rows += [(f, int(k), float(v), float(x[x >= v - r].min()), float(x[x <= v + r].max())) for k, v, r in zip(rng.integers(1, 4, n), x, reach)]
    counts, near = nb._within(spark.createDataFrame(rows, "f int, k int, x double, low double, high double").repartition(3).orderBy("f", "x"))
    want, ks = {}, {}
    for f, k, _, low, high in rows:
        n = sum(g == f and low <= v <= high for g, _, v, _, _ in rows)
        want[f, n], ks[f, k] = want.get((f, n), 0) + 1, ks.get((f, k), 0) + 1
    got = {}
    for r in counts.collect():
        got[r.f, r.n] = got.get((r.f, r.n), 0) + r.points
    assert got == want
    got = {}
    for r in near.collect():
        got[r.f, r.k] = got.get((r.f, r.k), 0) + r.points
    assert got == ks
    held = [len(block[1]) for block in nb._axis_blocks([pa.RecordBatch.from_pylist([dict(zip(("f", "k", "x", "low", "high"), r)) for r in sorted(rows)])])]
    assert max(held) == 4 and sum(held) == len(rows)
