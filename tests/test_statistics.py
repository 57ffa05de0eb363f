"""Hand-computed values and brute force for the statistical operators."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.functions.exprs import Candidate, explode_candidates
from veritab.functions.ordered import average_rank, exact_quantiles, hash_rank, ordered_scan
from veritab.functions.stats import binomial_upper_tail, normal_upper_tail
from veritab.operators import relations as rel
from veritab.operators import relevance as rv
from veritab.operators import structure as st
from veritab.operators import testing as tst
from veritab.operators import trials as tr
from veritab.operators.split import seats
from veritab.session import cut_lineage

X1 = Candidate("x1", ("var", "X1"))


def test_sign_test_exact(spark):
    rows = spark.createDataFrame([(f"g{i}", float(i + 1), float(i + 1)) for i in range(20)], "grp string, X1 double, Y double")
    base = spark.createDataFrame([(0.0,)], "b double")
    for slope, expected in ((1.0, 2.0 ** -20), (-1.0, None)):
        frozen = spark.createDataFrame([("x1", slope, 0.0)], "cand string, slope double, intercept double")
        out = rel.sign_test(rel.group_differences(rows, frozen, [X1], "Y", "grp", base), 0.0, 2).first()
        assert out["unit_count"] == 20
        if expected:
            assert out["p_value"] == pytest.approx(expected, rel=1e-9) and out["wins"] == 20
        else:
            assert out["p_value"] == pytest.approx(1.0) and out["wins"] == 0


def test_binomial_tail_against_sums(spark):
    rows = [(n, w) for n in (1, 2, 7, 20, 101) for w in range(0, n + 2)]
    got = spark.createDataFrame(rows, "n long, w long").select("n", "w", binomial_upper_tail(F.col("n"), F.col("w")).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r["n"], k) for k in range(r["w"], r["n"] + 1)) / 2 ** r["n"]
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_tails_of_any_size_and_depth(spark):
    """Long sums of exact ratios from the middle, whose probability Stirling's series gives; far tails keep their digits."""
    def long_sum(n, w):
        h = n // 2
        rest = lambda x: 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
        k = np.arange(h, w + int(12 * math.sqrt(n)), dtype=np.longdouble)
        logs = np.concatenate([[0], np.cumsum(np.log1p((n - 2 * k - 1) / (k + 1)))])
        return float(np.exp(-0.5 * math.log(math.pi * h) + rest(n) - 2 * rest(h) + logs[w - h:]).sum())

    rows = [(n, n // 2 + int(z * math.sqrt(n) / 2)) for n in (10**4, 10**6, 10**8) for z in (0, 1, 6, 12)]
    df = spark.createDataFrame(rows, "n long, w long").select("n", "w", binomial_upper_tail(F.col("n"), F.col("w")).alias("p"), binomial_upper_tail(F.col("n"), F.col("n") - F.col("w") + 1).alias("q"))
    for r in df.collect():
        assert r.p == pytest.approx(long_sum(r.n, r.w), rel=2e-11) and r.q == pytest.approx(1 - r.p, abs=1e-12)
    far = spark.createDataFrame([(1000, 999), (1000, 1000), (333, 330)], "n long, w long").select("n", "w", binomial_upper_tail(F.col("n"), F.col("w")).alias("p"))
    assert all(r.p == pytest.approx(sum(math.comb(r.n, k) for k in range(r.w, r.n + 1)) / 2 ** r.n, rel=1e-11) for r in far.collect())
    odd = spark.createDataFrame([(None, 1), (3, None), (-1, 0)], "n long, w long").select(binomial_upper_tail(F.col("n"), F.col("w")).alias("p"))
    assert {r.p for r in odd.collect()} == {None}
    ts = [0.0, 0.3, -0.3, 1.0, 2.5, -5.0, 10.0, 37.0, -40.0, float("inf"), float("-inf")]
    for r in spark.createDataFrame([(t,) for t in ts], "t double").select("t", normal_upper_tail(F.col("t")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.t / math.sqrt(2)), rel=1e-12, abs=1e-300)
    assert {r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "t double").select(normal_upper_tail(F.col("t"))).collect()} == {None}


def test_holm_flags_differ_from_step_down(spark):
    tests = spark.createDataFrame([("a", 0.03), ("b", 0.04), ("c", None)], "test_id string, p_value double")
    out = {r["test_id"]: r for r in tst.holm_thresholds(tst.holm_adjust(tests, []), 0.05).collect()}
    assert not out["a"]["significant"] and out["b"]["significant"]
    assert not out["a"]["holm_reject"] and not out["b"]["holm_reject"]
    assert out["c"]["adjusted"] is None and out["a"]["m"] == 2


def test_holm_null_prediction_voids_only_its_hypothesis(spark):
    cands = [X1, Candidate("log", ("func", "log", ("var", "X1")))]
    rows = spark.createDataFrame([("a", -1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0)], "grp string, X1 double, Y double")
    frozen = spark.createDataFrame([("x1", 1.0, 0.0), ("log", 1.0, 0.0)], "cand string, slope double, intercept double")
    base = spark.createDataFrame([(2.0,)], "b double")
    out = {r["cand"]: r["p_value"] for r in rel.sign_test(rel.group_differences(rows, frozen, cands, "Y", "grp", base), 0.0, 2).collect()}
    assert out["log"] is None and out["x1"] is not None


def test_expression_domain_and_values(spark):
    c = Candidate("c", ("func", "sqrt", ("mul", ("var", "a"), ("inv", ("var", "b")))))
    assert (c.nodes(), c.depth(), c.conditions(), c.variables()) == (5, 4, 2, ["a", "b"])
    df = spark.createDataFrame([(4.0, 1.0), (1.0, 0.0), (-1.0, 1.0), (None, 1.0)], "a double, b double")
    rows = explode_candidates(df, [c]).select("in_domain", "z").collect()
    assert [(r[0], r[1]) for r in rows] == [(True, 2.0), (False, None), (False, None), (False, None)]


def test_invariant_with_one_outlier(spark):
    rows = [(f"r{i:02d}", float(i + 1), 2.0 / (i + 1)) for i in range(19)] + [("r99", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "record_id string, x double, y double")
    summary, worst = rel.invariant_check(df, [Candidate("p", ("mul", ("var", "x"), ("var", "y")))], 0.05)
    s = summary.first()
    assert s["holds"] and s["conformity"] == pytest.approx(0.95) and s["counterexample_count"] == 1
    assert [w["record_id"] for w in worst.collect()] == ["r99"]


def test_seats_give_every_part_one():
    assert seats(3, {"E": 0.9, "V": 0.05, "C1": 0.05}) == {"E": 1, "V": 1, "C1": 1}
    assert seats(10, {"E": 0.5, "V": 0.25, "C1": 0.25}) == {"E": 5, "V": 3, "C1": 2}
    assert seats(7, {"E": 1.0, "V": 0.0}) == {"E": 7, "V": 0}
    assert seats(4, {"E": 0.94, "V": 0.02, "C1": 0.02, "C2": 0.02}) == {"E": 1, "V": 1, "C1": 1, "C2": 1}
    for total in (5, 6, 37, 1000, 10**12 + 7):
        got = seats(total, {"E": 0.61, "V": 0.28, "C1": 0.1, "C2": 0.01})
        assert sum(got.values()) == total and min(got.values()) >= 1 and (total < 100 or abs(got["E"] - 0.61 * total) < 1)
    with pytest.raises(ValueError):
        seats(1, {"E": 0.5, "V": 0.5})


def test_ordered_scan_with_one_hot_key(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"k{i}", random.randint(0, 50), i, float(random.randint(-5, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v double").repartition(7)
    got = ordered_scan(df, ["k"], ["o", "id"], number="n", sums={"s": "v"}, maxs={"m": "v"}, prevs={"p": "v"}).toPandas().set_index("id")
    want = pd.DataFrame(rows, columns=["k", "o", "id", "v"]).sort_values(["k", "o", "id"])
    g = want.groupby("k")["v"]
    want = want.assign(n=g.cumcount() + 1, s=g.cumsum(), m=g.cummax(), p=g.shift(1)).set_index("id")
    for c in ("n", "s", "m", "p"):
        np.testing.assert_allclose(got[c].sort_index().to_numpy(float), want[c].sort_index().to_numpy(float))


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).withColumn("h", F.md5(F.col("id").cast("string")))
    got = [r["rk"] for r in hash_rank(df, [], "h", ["id"]).orderBy("h").collect()]
    assert got == list(range(1, 5001))


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    """Groups beyond the size that is ranked whole: hot values, ties at the brackets, null keys, infinite values."""
    from veritab.functions import ordered
    monkeypatch.setattr(ordered, "ALL", 40)
    monkeypatch.setattr(ordered, "MARGIN", 0.03)
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=3000), "hot": np.r_[np.zeros(2000), rng.normal(size=500)], "small": rng.normal(size=30), "steps": np.repeat(np.arange(25.0), 40),
              None: rng.exponential(size=777), "one": np.array([4.0] * 100), "wide": np.r_[rng.normal(size=200) * 1e300, 1e308, -1e308]}
    rows = [(k, i % 2, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)] + [("normal", 0, None), ("void", 0, None)]
    df = spark.createDataFrame(rows, "k string, part int, v double")
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.51, "e": 0.975, "f": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k][q] for q in qs] == pytest.approx(list(np.quantile(vs, list(qs.values()))), rel=1e-12)
    two = {(r.k, r.part): r.m for r in exact_quantiles(df, ["k", "part"], "v", {"m": 0.5}).collect()}
    assert two[None, 1] == pytest.approx(np.median(groups[None][1::2])) and len(two) == 14
    every = np.concatenate(list(groups.values()))
    assert exact_quantiles(df, [], "v", {"m": 0.25}).first().m == pytest.approx(np.quantile(every, 0.25))
    assert not exact_quantiles(df.filter("v is null"), ["k"], "v", {"m": 0.5}).collect()


def test_quantiles_and_ranks_match_numpy(spark):
    random.seed(1)
    data = [("a", float(random.choice([0, 0, 0, 1, 2, 5.5, 7]))) for _ in range(501)] + [("b", float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.05, "q5": 0.5, "q9": 0.95}).collect()}
    for k in "ab":
        v = [x for kk, x in data if kk == k]
        assert [got[k][q] for q in ("q1", "q5", "q9")] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.95])))
    ranks = {r["v"]: r["avg_rank"] for r in average_rank(df.filter("k = 'a'"), ["k"], "v").collect()}
    want = pd.Series([x for kk, x in data if kk == "a"]).rank()
    for value, rank in zip([x for kk, x in data if kk == "a"], want):
        assert ranks[value] == rank


@pytest.mark.parametrize("kind", ["ties", "continuous"])
def test_distance_correlation_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 120).astype(float) if kind == "ties" else rng.normal(size=150)
    y = np.abs(x) + rng.normal(size=len(x)) * 0.3
    got = rv.distance_correlation(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x"], "y").first()["score"]

    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    cov = lambda p, q: math.sqrt(max((p * q).mean(), 0))
    assert got == pytest.approx(cov(a, b) / math.sqrt((cov(a, a) + 1e-12) * (cov(b, b) + 1e-12)), rel=1e-6)


@pytest.mark.parametrize("kind", ["ties", "free"])
def test_distance_correlation_over_many_blocks(spark, monkeypatch, kind):
    """Blocks of few rows, two features at once, and no row repeated once per binary level."""
    monkeypatch.setattr(rv, "PAIR_BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, 400).astype(float) if kind == "ties" else rng.normal(size=400) + 1e4
    y, z = np.round(np.abs(x - x.mean()) + rng.normal(size=400), 1), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(x, y, z)], "x double, y double, z double").repartition(5)
    got = {r["feature"]: r["score"] for r in rv.distance_correlation(df, ["x", "z"], "y").collect()}

    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    cov = lambda p, q: math.sqrt(max((p * q).mean(), 0))
    b = centred(y)
    for name, v in (("x", x), ("z", z)):
        a = centred(v)
        assert got[name] == pytest.approx(cov(a, b) / math.sqrt((cov(a, a) + 1e-12) * (cov(b, b) + 1e-12)), rel=1e-6)


def test_meta_features_moments_are_not_kept_per_target_value(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i)) for i in range(60)], "a double, b double, y double")
    out = rv.meta_features(df, ["a", "b"], "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "keys=[y#" in line and ("var_pop" in line or "avg(" in line)]
    row = out.first()
    assert row["y_unique"] == row["n_samples"] == 60


def test_group_folds_are_the_greedy_ones(spark):
    sizes = [9, 7, 7, 5, 3, 3, 3, 2, 2, 1, 1, 1, 1]
    rows = [(f"g{i:02d}",) for i, s in enumerate(sizes) for _ in range(s)]
    df = spark.createDataFrame(rows, "g string")
    folds = df.join(rv.group_folds(df, "g", 3), "g").groupBy("fold").count().collect()
    load = [0, 0, 0]
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    assert sorted(r["count"] for r in folds) == sorted(load)


def test_experience_ties_and_low_runtime(spark):
    pred = spark.createDataFrame([("d", 1, "m1", 0.5), ("d", 2, "m2", 0.4), ("e", 1, "m1", 0.7), ("e", 2, "m2", 0.2)], "dataset_id string, position long, method string, probability double")
    got = {r["dataset_id"]: r["methods"] for r in rv.low_runtime_choice(pred).collect()}
    assert got == {"d": ["m1", "m2"], "e": ["m1"]}


def test_changepoints_find_planted_shifts(spark):
    random.seed(2)
    rows = [("s", i, (0.0 if i < 40 else 8.0 if i < 70 else -4.0) + random.random()) for i in range(100)] + [("flat", i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r["k"], r["position"]) for r in st.changepoints(df, ["k"], ["i"], "v").collect()}
    assert got == {("s", 40), ("s", 70)}


def test_silhouettes_and_rand(spark):
    rng = np.random.default_rng(1)
    pts = [(i, int(i % 3), [float(x) for x in rng.normal(size=4) + (i % 3) * 2]) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, c int, v array<double>")

    def brute(power):
        x, c = np.array([p[2] for p in pts]), np.array([p[1] for p in pts])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
        out = []
        for i in range(len(x)):
            a = d[i][(c == c[i]) & (np.arange(len(x)) != i)].mean()
            b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    assert st.silhouette_exact(df, "id", "v", "c", block=25).first()["silhouette"] == pytest.approx(brute(1))
    assert st.silhouette_squared(df, "v", "c").first()["silhouette"] == pytest.approx(brute(2))
    a = spark.createDataFrame([(i, i % 2) for i in range(8)], "id int, a int")
    b = spark.createDataFrame([(i, i // 4) for i in range(8)], "id int, b int")
    agree = sum((i % 2 == j % 2) == (i // 4 == j // 4) for i in range(8) for j in range(i))
    assert st.rand_index(a, b, "id", "a", "b").first()["rand"] == pytest.approx(agree / 28)


@pytest.mark.parametrize("values", [(5, 3), (5, 3, 4, 8, 1, 0.5, 7, 2, 9, 4, 1), (4.0,)])
def test_trajectory_features(spark, values):
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    got = tr.trajectory_features(df, ["k"], ["i"], "v").first()
    v = np.array(values, float)
    assert got["length"] == len(v) and got["min_index"] == int(v.argmin())
    if len(v) == 1:
        assert (got["auc"], got["early_slope"], got["diff_std"]) == (v[0], 0.0, 0.0)
        return
    m = max(2, int(0.2 * len(v)))
    assert got["auc"] == pytest.approx(v.sum() - (v[0] + v[-1]) / 2)
    assert got["early_slope"] == pytest.approx(np.polyfit(np.arange(m), v[:m], 1)[0])
    assert got["late_slope"] == pytest.approx(np.polyfit(np.arange(m), v[-m:], 1)[0])
    assert got["diff_std"] == pytest.approx(np.diff(v).std())


def test_guided_promotion_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, r, float(s), float(p)) for r in (0, 1) for i, (s, p) in enumerate(rng.random((20, 2)))]
    out = tr.guided_promotion(spark.createDataFrame(rows, "config int, rung int, score double, proba double"), 3, shortlist=12, max_swaps=3, margin=0.05, min_proba=0.4)
    got = {(r["rung"], r["config"]) for r in out.filter("guided").collect()}
    want = set()
    for rung in (0, 1):
        ranked = sorted((x for x in rows if x[1] == rung), key=lambda x: -x[2])
        k, pool = math.ceil(len(ranked) / 3), ranked[:12]
        lo, hi = min(x[2] for x in pool), max(x[2] for x in pool)
        mix = {x[0]: 0.6 * x[3] + 0.4 * (x[2] - lo) / (hi - lo + 1e-12) for x in pool}
        inside = sorted(pool[:k], key=lambda x: mix[x[0]])
        extra = [x for x in sorted(pool[k:], key=lambda x: -mix[x[0]]) if x[3] >= 0.4]
        chosen = {x[0] for x in inside}
        for old, new in list(zip(inside, extra))[:3]:
            if mix[new[0]] <= mix[old[0]] + 0.05:
                break
            chosen = chosen - {old[0]} | {new[0]}
        want |= {(rung, c) for c in chosen}
    assert got == want


def test_resource_levels():
    assert tr.resource_levels(1, 27, 3) == [1, 3, 9, 27] and tr.resource_levels(2, 9, 3) == [2, 6, 9]


def test_quantile_bins_count_values_once(spark):
    rows = [(i % 3, float(i * 7 % 20) if i % 11 else None) for i in range(300)]
    df = cut_lineage(spark.createDataFrame(rows, "g int, v double"))
    cuts = rv.quantile_cuts(df, ["g"], "v", 4)
    # Values are counted in the sorted scan, which is stored; what is left counts rows by key.
    assert not re.search(r"Aggregate \[g#\d+, v#\d+", cuts._jdf.queryExecution().optimizedPlan().toString())
    found = {r.g: r.cuts for r in cuts.collect()}
    placed = df.join(cuts, "g").select("g", "v", rv.bin_of(F.col("v"), F.col("cuts"), 4).alias("b"))
    for r in placed.collect():
        assert r.b == sum(c < r.v for c in found[r.g] if r.v is not None)


def test_rows_are_multiplied_by_draws_where_they_lie(spark):
    """Each row once for every draw of its group and once as draw -1, rows without a group too; only the list of draws is joined."""
    rows = spark.createDataFrame([(g, float(i)) for i, g in enumerate(["a", "a", "b", "c", None])], "g string, z double")
    draws = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "absent")], "draw int, g string")
    made = st._drawn(rows, draws, "g")
    want = [("a", 0.0, d) for d in (-1, 0, 1)] + [("a", 1.0, d) for d in (-1, 0, 1)] + [("b", 2.0, -1), ("b", 2.0, 1), ("c", 3.0, -1), (None, 4.0, -1)]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
