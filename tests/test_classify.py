"""Logistic fits over folds, exact areas and permutation importance against plain NumPy."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions.ordered import hash_rank
from veritab.operators import classify as cl
from veritab.session import cut_lineage


def plain_auc(scores, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(scores, y) for b, q in zip(scores, y) if p == 1 and q == 0]
    return sum(pairs) / len(pairs) if pairs else None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1), st.integers(0, 2)), min_size=1, max_size=60))
def test_auc_is_the_share_of_ordered_pairs(spark, rows):
    df = spark.createDataFrame([(f, float(s), y) for s, y, f in rows], "fold int, s double, y int")
    got = {r.fold: r.auc for r in cl.roc_auc(df, ["fold"], "s", "y").collect()}
    for f in {r[2] for r in rows}:
        want = plain_auc([s for s, _, g in rows if g == f], [y for _, y, g in rows if g == f])
        assert got[f] is None if want is None else abs(got[f] - want) < 1e-12


def logistic_rows(spark, classes, n=240, features=3, seed=0, nulls=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)) * [1, 5, 0.2][:features]
    y = np.argmax(x @ rng.normal(size=(features, classes)) + rng.gumbel(size=(n, classes)), axis=1)
    cells = [[None if nulls and (i + j) % 17 == 0 else float(v) for j, v in enumerate(row)] for i, row in enumerate(x)]
    return cells, y, spark.createDataFrame([(i % 3, int(c), v) for i, (v, c) in enumerate(zip(cells, y))], "fold int, code int, x array<double>")


@pytest.mark.parametrize("classes", [2, 4])
def test_fits_stand_at_the_optimum(spark, classes):
    """The gradient of each fold's penalised loss, counted by plain loops over its training rows, vanishes."""
    cells, y, df = logistic_rows(spark, classes)
    means = cl.training_means(df.select("fold", *[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(3)]), ["f0", "f1", "f2"])
    top = [2, 0]
    models = cl.logistic_folds(df, {k: top for k in range(3)}, means, classes)
    for k, model in models.items():
        train = [i for i in range(len(y)) if i % 3 != k]
        known = [[cells[i][j] for i in train if cells[i][j] is not None] for j in range(3)]
        assert np.allclose(means[k], [sum(v) / len(v) for v in known])
        grad = np.zeros((len(model.weights), 3))
        for i in train:
            z = np.array([means[k][j] if cells[i][j] is None else cells[i][j] for j in top] + [1.0])
            s = model.weights @ z
            if classes == 2:
                p, hit = np.array([1 / (1 + math.exp(-s[0]))]), np.array([y[i]])
            else:
                p, hit = np.exp(s) / np.exp(s).sum(), np.eye(classes)[y[i]]
            grad += np.outer(p - hit, z)
        grad[:, :-1] += model.weights[:, :-1]
        assert np.abs(grad).max() < 1e-7


def test_separable_classes_and_single_classes(spark):
    rows = [(i, "yes" if i >= 20 else "no", float(i) * 100, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double")
    got = cl.evaluate_selection(df, ["b", "a"], "kind", F.col("id"), 1, 4, "1").collect()
    assert {tuple(r.top) for r in got} == {("a",)} and all(r.score == 1.0 and r.metric == "roc_auc" for r in got)
    assert not cl.evaluate_selection(df.filter("id < 20"), ["a"], "kind", F.col("id"), 1, 4, "1", metric="accuracy").collect()
    assert not cl.evaluate_selection(df.limit(0), ["a"], "kind", F.col("id"), 1, 4, "1", metric="accuracy").collect()
    lone = cl.evaluate_selection(df.filter("id <= 20"), ["a"], "kind", F.col("id"), 1, 2, "1", metric="accuracy").collect()
    # The one row of its class tests a fold, which then has one class to learn from.
    assert sorted(r.score is None for r in lone) == [False, True]


def test_metric_follows_the_task(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5, i * 0.37, "ab"[i % 2]) for i in range(50)], "id long, two int, five int, real double, name string")
    assert [cl.choose_metric(df, c) for c in ("two", "five", "real", "name")] == ["roc_auc", "accuracy", "r2", "roc_auc"]
    scores = cl.evaluate_selection(df, ["id"], "real", F.col("id"), 1, 3, "1").collect()
    assert all(r.metric == "r2" and r.score > 0.99 for r in scores)


def test_stratified_folds_deal_each_class_evenly(spark):
    df = spark.createDataFrame([(i, "rare" if i % 10 == 0 else None if i % 10 == 1 else "common") for i in range(100)], "id long, c string")
    counts = cl.stratified_folds(df, "c", F.col("id"), 5, "s").groupBy("c", "fold").count().collect()
    assert {(r.c, r["count"]) for r in counts} == {("rare", 2), (None, 2), ("common", 16)} and len(counts) == 15


def test_scores_of_many_classes(spark):
    cells, y, df = logistic_rows(spark, 3, n=60, nulls=False)
    scores = [[float(v) for v in np.random.default_rng(i).normal(size=3)] for i in range(60)]
    scored = spark.createDataFrame([(i % 2, int(c), s) for i, (c, s) in enumerate(zip(y, scores))], "fold int, code int, scores array<double>")
    for metric in ("accuracy", "neg_log_loss"):
        got = {r.fold: r.score for r in cl.fold_scores(scored, metric, ["fold"]).collect()}
        for f in (0, 1):
            own = [(c, s) for i, (c, s) in enumerate(zip(y, scores)) if i % 2 == f]
            want = np.mean([np.argmax(s) == c for c, s in own]) if metric == "accuracy" else np.mean([s[c] - math.log(sum(map(math.exp, s))) for c, s in own])
            assert abs(got[f] - want) < 1e-12


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_permutation_importance_by_hand(spark):
    """One feature set, plain loops: same folds, ranks, fills, fits and drops."""
    rng = np.random.default_rng(5)
    n, seed = 90, "4"
    rows = [(f"k{i}", *[None if (i + j) % 13 == 0 else float(v) for j, v in enumerate(rng.normal(size=2))]) for i in range(n)]
    rows = [(k, a, b, 3.0 * (a or 0) + 0.01 * i) for i, (k, a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y double")
    got = {r.feature: (r.importance_mean, r.importance_std) for r in cl.permutation_importance(df, ["a", "b"], "y", "key", 3, 2, seed).collect()}
    fold = {k: int(md5(f"{seed}|{k}")[:8], 16) % 3 for k, *_ in rows}
    means, stds = [], []
    for f in range(3):
        mean = [np.mean([r[j] for r in rows if fold[r[0]] != f and r[j] is not None]) for j in (1, 2)]
        x = {r[0]: [m if v is None else v for v, m in zip(r[1:3], mean)] for r in rows}
        y = {r[0]: r[3] for r in rows}
        train, test = [k for k in x if fold[k] != f], sorted((k for k in x if fold[k] == f), key=md5)
        w = np.linalg.lstsq(np.column_stack([[x[k] for k in train], np.ones(len(train))]), np.array([y[k] for k in train]), rcond=None)[0]
        target = np.array([y[k] for k in test])

        def score(z):
            return 1 - ((target - np.column_stack([z, np.ones(len(z))]) @ w) ** 2).sum() / ((target - target.mean()) ** 2).sum()

        base, drops = np.array([x[k] for k in test]), []
        for rep in range(2):
            other = np.array([x[k] for k in sorted(test, key=lambda k: md5(f"{seed}|{rep}|{k}"))])
            drops.append([score(base) - score(np.column_stack([other[:, 0], base[:, 1]])), score(base) - score(np.column_stack([base[:, 0], other[:, 1]]))])
        means.append(np.mean(drops, axis=0))
        stds.append(np.std(drops, axis=0))
    for j, name in enumerate(["a", "b"]):
        assert np.allclose(got[name], (np.mean(means, axis=0)[j], np.mean(stds, axis=0)[j]), atol=1e-9)
    assert got["a"][0] > 1 > got["b"][0]


def test_ranks_by_digest_shuffle_rows_once(spark):
    rows = cut_lineage(spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("d"), F.unhex(F.md5(F.col("id").cast("string"))).alias("b")))
    by_text, by_bytes = hash_rank(rows, ["g"], "d", out="rk"), hash_rank(rows, ["g"], "b", out="rk")
    plan = by_text._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    want = {}
    for g in range(3):
        want |= {r.id: i + 1 for i, r in enumerate(sorted((r for r in rows.collect() if r.g == g), key=lambda r: r.d))}
    for ranked in (by_text, by_bytes):
        assert {r.id: r.rk for r in ranked.collect()} == want
