"""Keyed k-means against plain loops: scaling, farthest-first seeds, rounds, silhouettes, choice of k."""

import math

import numpy as np
import pytest

from veritab.operators.clusters import ClusterSearch
from veritab.operators.structure import cluster_stability

KIND = "id long, v array<double>, g string"


def plain(rows, ks, rounds=100, min_size=2, accept=0.1, squared=False):
    """(k, {k: silhouette}, labels by id) of [(id, vector)]."""
    rows = sorted(rows)
    x = np.array([v for _, v in rows], float)
    keep = x.std(axis=0) > 1e-12
    z = (x[:, keep] - x[:, keep].mean(axis=0)) / x[:, keep].std(axis=0)
    scores, found = {}, {}
    if keep.any():
        for k in ks:
            seeds = [z[0]]
            while len(seeds) < k:
                far = np.array([min(((p - s) ** 2).sum() for s in seeds) for p in z])
                if far.max() <= 1e-12:
                    break
                seeds.append(z[far.argmax()])
            if len(seeds) < k or k > len(rows) // min_size:
                continue
            c = np.array(seeds)
            for _ in range(rounds):
                label = np.array([min(range(k), key=lambda j: (((p - c[j]) ** 2).sum(), j)) for p in z])
                assert len(set(label)) == k, "repair is tested apart"
                new = np.array([z[label == j].mean(axis=0) for j in range(k)])
                if np.abs(new - c).max() <= 1e-12:
                    break
                c = new
            c = np.array(sorted(c.tolist(), key=lambda v: tuple(round(q, 12) for q in v)))
            label = np.array([min(range(k), key=lambda j: (((p - c[j]) ** 2).sum(), j)) for p in z])
            total = []
            for i, p in enumerate(z):
                d = [(q - p) @ (q - p) if squared else math.dist(q, p) for q in z]
                own = [d[j] for j in range(len(z)) if label[j] == label[i] and j != i]
                a = sum(own) / len(own) if own else 0.0
                b = min(np.mean([d[j] for j in range(len(z)) if label[j] == o]) for o in range(k) if o != label[i])
                total.append((b - a) / max(a, b) if max(a, b) > 1e-12 else 0.0)
            scores[k] = float(np.mean(total))
            found[k] = label
    good = [(round(s, 12), -k) for k, s in scores.items() if min(np.bincount(found[k], minlength=k)) >= min_size]
    k = -max(good)[1] if good and max(good)[0] >= accept else None
    return k, scores, {i: int(found[k][n]) if k else 0 for n, (i, _) in enumerate(rows)}


def check(search, draw, rows, **kw):
    k, scores, labels = plain(rows, (2, 3, 4), **kw)
    s = search.draws[draw]
    assert s.k == k and s.scores.keys() == scores.keys()
    assert all(abs(s.scores[j] - scores[j]) < 1e-9 for j in scores)
    assert {r.id: r.cluster for r in search.labels().filter(f"draw = {draw}").collect()} == labels


def blobs(seed, n=60):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 2)) * 6
    return [(int(i), [*(centre[i % 3] + rng.normal(size=2)).tolist(), 7.0], f"g{i % 10}") for i in rng.permutation(n)]


@pytest.mark.parametrize("distance", ["euclidean", "squared"])
def test_draws_of_one_job_against_plain_loops(spark, distance):
    rows = blobs(1)
    draws = spark.createDataFrame([(0, f"g{i}") for i in range(10)] + [(1, f"g{i}") for i in range(6)] + [(5, f"g{i}") for i in range(3, 10)] + [(5, "g3"), (6, "absent")], "draw int, g string")
    found = ClusterSearch(spark.createDataFrame(rows, KIND), "id", "v", draws=draws, group="g", distance=distance, block=17)
    assert sorted(found.draws) == [0, 1, 5]
    for d, groups in ((0, range(10)), (1, range(6)), (5, range(3, 10))):
        check(found, d, [(i, v) for i, v, g in rows if g in {f"g{j}" for j in groups}], squared=distance == "squared")
    assert found.chosen().filter("draw = 0").first().k == 3


def test_small_samples_side_by_side(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=2).tolist(), f"n{n}") for n in (1, 3, 4, 7, 12) for i in range(100 * n, 101 * n)]
    draws = spark.createDataFrame([(n, f"n{n}") for n in (1, 3, 4, 7, 12)], "draw int, g string")
    found = ClusterSearch(spark.createDataFrame(rows, KIND), "id", "v", draws=draws, group="g", accept=-1.0)
    for n in (1, 3, 4, 7, 12):
        check(found, n, [(i, v) for i, v, g in rows if g == f"n{n}"], accept=-1.0)


def test_odd_rows_and_samples_without_structure(spark):
    nan = float("nan")
    odd = [(1, None, "g"), (None, [1.0, 2.0], "g"), (3, [1.0, None], "g"), (4, [nan, 1.0], "g"), (5, [], "g")]
    assert not ClusterSearch(spark.createDataFrame(odd, KIND), "id", "v").draws
    assert not ClusterSearch(spark.createDataFrame([], KIND), "id", "v").labels().collect()
    same = ClusterSearch(spark.createDataFrame([(i, [2.0, 2.0], "g") for i in range(9)], KIND), "id", "v")
    assert same.draws[0].k is None and {r.cluster for r in same.labels().collect()} == {0}
    two = ClusterSearch(spark.createDataFrame([(i, [float(i % 2), 0.0], "g") for i in range(8)] + odd, KIND), "id", "v")
    # Two places only: three clusters find no third seed.
    assert two.draws[0].k == 2 and sorted(two.draws[0].scores) == [2] and abs(two.draws[0].scores[2] - 1) < 1e-12
    noise = ClusterSearch(spark.createDataFrame([(i, np.random.default_rng(i).normal(size=6).tolist(), "g") for i in range(40)], KIND), "id", "v", accept=0.5)
    assert noise.chosen().first().k is None and noise.candidates().count() == 3


def test_an_emptied_cluster_takes_the_farthest_row(spark):
    """Two seeds side by side far out lose all rows to others; the search still ends with clusters that hold rows."""
    rows = [(0, [0.0, 0.0], "g"), (1, [100.0, 0.0], "g"), (2, [100.0, 0.5], "g"), (3, [-100.0, 0.0], "g"), (4, [0.0, 0.1], "g"), (5, [0.0, -0.1], "g")]
    found = ClusterSearch(spark.createDataFrame(rows, KIND), "id", "v", ks=(2, 3), min_size=1, rounds=50)
    assert all(s.sum() == 6 and s.min() >= 1 for s in found.draws[0].sizes.values())


def test_stability_counts_what_the_full_sample_shows(spark):
    rows = blobs(4, 90)
    points = spark.createDataFrame(rows, KIND)
    draws = spark.createDataFrame([(d, f"g{i}") for d in range(3) for i in range(10) if (i + d) % 5], "draw int, g string")
    got = cluster_stability(points, "id", "v", "g", draws).collect()
    full = plain([(i, v) for i, v, _ in rows], (2, 3, 4))
    for r in got:
        k, _, labels = plain([(i, v) for i, v, g in rows if (int(g[1:]) + r.draw) % 5], (2, 3, 4))
        ids = sorted(labels)
        agree = [(labels[a] == labels[b]) == (full[2][a] == full[2][b]) for n, a in enumerate(ids) for b in ids[n + 1:]]
        assert r.k == k and abs(r.rand - np.mean(agree)) < 1e-12 and r.reproduced == (k == full[0] and np.mean(agree) >= 0.8)
    flat = spark.createDataFrame([(i, [1.0], f"g{i % 10}") for i in range(30)], KIND)
    assert not any(r.reproduced for r in cluster_stability(flat, "id", "v", "g", draws).collect())


def test_silhouettes_of_blocks_held_against_all(spark, monkeypatch):
    """The number of blocks, and so how often a row is sent, stays at TASKS while a task may hold more rows; lone clusters and equal rows as defined."""
    from veritab.operators import clusters, structure
    monkeypatch.setattr(clusters, "TASKS", 3)
    monkeypatch.setattr(clusters, "CHUNK", 7)
    sent = []
    spread = clusters.F.sequence
    monkeypatch.setattr(clusters.F, "sequence", lambda a, b: sent.append(b) or spread(a, b))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(250, 3)) + 4 * (np.arange(250) % 3 == 0)[:, None]
    x[10] = x[20]
    label = np.where(np.arange(250) == 249, 99, rng.integers(0, 4, 250))
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, v array<double>, c int").repartition(5)
    got = structure.silhouette_exact(df, "id", "v", "c", block=10).first()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(250):
        mean = {c: far[i, label == c].sum() / max((label == c).sum() - (c == label[i]), 1) for c in np.unique(label)}
        a, b = mean.pop(label[i]), min(mean.values())
        want.append((b - a) / max(a, b))
    assert got.n == 250 and abs(got.silhouette - np.mean(want)) < 1e-12
    assert len(sent) == 1 and "2" in str(sent[0])


def test_choice_takes_exact_silhouettes_only_where_k_is_open(spark):
    """Distances in single precision settle k for blobs; a bound of acceptance beside the score leaves it open, and silhouettes are then taken as defined."""
    from veritab.operators import clusters
    rows = blobs(1)
    found = ClusterSearch(spark.createDataFrame(rows, KIND), "id", "v", choice=True, block=17)
    assert found.draws[0].k == 3 and not found.draws[0].scores and found.chosen().first().silhouette is None
    rng = np.random.default_rng(3)
    noise = [(i, rng.normal(size=8).tolist(), "g") for i in range(90)]
    whole = ClusterSearch(spark.createDataFrame(noise, KIND), "id", "v", accept=-1.0).draws[0]
    edge = whole.scores[whole.k]
    for accept, k in ((edge - 1e-9, whole.k), (edge + 1e-9, None)):
        near = ClusterSearch(spark.createDataFrame(noise, KIND), "id", "v", accept=accept, choice=True).draws[0]
        assert near.k == k and near.scores[whole.k] == pytest.approx(edge, abs=1e-12)
    z, w = rng.normal(size=(300, 64)), rng.normal(size=(400, 64))
    w[:3] = z[:3] + [[0.0], [1e-9], [1e-3]]
    z2, w2 = (z ** 2).sum(1), (w ** 2).sum(1)
    z4, w4 = np.column_stack([z, z2, np.ones(300)]), np.column_stack([-2 * w, np.ones(400), w2])
    got = clusters._near_distances(z, w, *[v.astype(np.float32) for v in (z4, z2, w4, w2)])
    want = np.sqrt(((z[:, None] - w[None]) ** 2).sum(2))
    assert (np.abs(got - want) <= 8 * 68 * clusters.UNIT * want).all() and got[0, 0] == 0
