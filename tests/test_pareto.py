"""Pareto fronts over grids of cells against plain comparison of all rows."""

import numpy as np
import pytest

from veritab.operators import pareto as po

KIND = "identity long, gain double, stability double, novelty double, complexity double, knowledge_version string"


def plain(rows):
    p = np.array([[g, s, n, -c] for _, g, s, n, c, _ in rows], float)
    keep = []
    for i, row in enumerate(rows):
        diff = p - p[i]
        if not ((diff >= -1e-12).all(1) & (diff > 1e-12).any(1)).any():
            keep.append(row[0])
    return set(keep)


@pytest.mark.parametrize("shape", ["free", "sphere", "coarse", "line", "signed zero"])
def test_grid_front_against_all_pairs(spark, monkeypatch, shape):
    monkeypatch.setattr(po, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(len(shape))
    v = rng.normal(size=(1500, 4))
    if shape == "sphere":  # nothing dominates much
        v = np.abs(v) / np.linalg.norm(v, axis=1, keepdims=True) * [1, 1, 1, -1]
    elif shape == "coarse":  # many equal rows and ties
        v = np.round(v)
    elif shape == "line":  # one chain, and steps below the tolerance
        v = np.repeat(np.arange(1500.0)[:, None] * 1e-13, 4, axis=1) * [1, 1, 1, -1]
    elif shape == "signed zero":
        v = np.where(v > 0, 0.0, -0.0)
    rows = [(i, *map(float, r), "v1") for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert {r.identity for r in po.pareto_front(df, version="knowledge_version").collect()} == plain(rows)


def plain_layers(rows):
    left, out, layer = list(rows), {}, 0
    while left:
        front = plain(left)
        out |= {i: layer for i in front}
        left, layer = [r for r in left if r[0] not in front], layer + 1
    return out


@pytest.mark.parametrize("shape", ["free", "coarse", "near"])
def test_layers_against_peeling(spark, monkeypatch, shape):
    monkeypatch.setattr(po, "BLOCK_ROWS", 90)
    rng = np.random.default_rng(len(shape))
    v = rng.normal(size=(120 if shape == "near" else 400, 4))
    if shape == "coarse":
        v = np.round(v * 2) / 2 + 0.1
    elif shape == "near":  # below the tolerance: points are no order
        v = np.round(v) + rng.integers(0, 2, v.shape) * 4e-13
    rows = [(i, *map(float, r), "v1") for i, r in enumerate(v)]
    df = spark.createDataFrame([*rows, (1000, None, 1.0, 1.0, 1.0, "v1")], KIND).repartition(5)
    want = plain_layers(rows)
    assert {r.identity: r.layer for r in po.pareto_layers(df).collect()} == want
    assert {r.identity: r.layer for r in po.pareto_layers(df, max_layers=2).collect()} == {i: n for i, n in want.items() if n < 2}


@pytest.mark.parametrize("shape", ["free", "coarse", "equal", "chain"])
def test_layers_by_waves_of_cells(spark, monkeypatch, shape):
    """Cells of a grid, points on its bounds and shared axes; a grid that leaves a cell too full falls back to blocks."""
    monkeypatch.setattr(po, "CELL_ROWS", 8)
    monkeypatch.setattr(po, "BLOCK_ROWS", 60)
    blocks = []
    by_blocks = po._block_layers
    monkeypatch.setattr(po, "_block_layers", lambda p: blocks.append(1) or by_blocks(p))
    rng = np.random.default_rng(len(shape) + 7)
    v = rng.normal(size=(600, 4))
    if shape == "coarse":
        v = np.round(v * 2) / 2
    elif shape == "equal":  # two axes that say nothing
        v[:, 1:3] = 0.25
    elif shape == "chain":
        v = np.arange(600.0)[:, None] * [1, 1, 1, -1]
        monkeypatch.setattr(po, "MOST_PARTS", 4)
    rows = [(i, *map(float, r), "v1") for i, r in enumerate(v)]
    got = {r.identity: r.layer for r in po.pareto_layers(spark.createDataFrame(rows, KIND).repartition(5)).collect()}
    want = {i: 599 - i for i in range(600)} if shape == "chain" else plain_layers(rows)
    assert got == want and bool(blocks) == (shape == "chain")


def test_many_layers_take_few_jobs(spark, monkeypatch):
    def refuse(_):
        raise AssertionError("fronts are not peeled one by one")
    monkeypatch.setattr(po, "_grid_front", refuse)
    rows = [(i, i % 300 * 0.5, 1.0, 1.0, 1.0, "v1") for i in range(900)]
    got = {r.identity: r.layer for r in po.pareto_layers(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: 299 - i % 300 for i in range(900)}


def test_incomplete_rows_and_mixed_versions(spark):
    rows = [(1, 1.0, 1.0, 1.0, 1.0, "a"), (2, None, 9.0, 9.0, 0.0, "a"), (3, 0.5, 1.0, 1.0, 1.0, "b")]
    df = spark.createDataFrame(rows, KIND)
    assert [r.identity for r in po.pareto_front(df).collect()] == [1]
    with pytest.raises(ValueError, match="several"):
        po.pareto_front(df, version="knowledge_version")
    assert not po.pareto_front(df.limit(0)).collect()
