"""Selector by dataset folds: features of texts and numbers, held-out ranks, reports."""

from collections import Counter

from pyspark.sql import functions as F

from veritab.operators import relevance as rv
from veritab.operators import selector as sel


def test_numbers_are_averaged_and_else_the_first_text_stands(spark):
    rows = [("d", 2, {"n": 1.0, "z": float("nan")}, {"s": 3.0}, {"kind": "late", "n": "text", "none": None}), ("d", 1, {"n": 3.0}, None, {"kind": "early"}),
            ("e", 1, {}, None, {"kind": None}), ("f", 1, {"z": float("inf")}, None, {"z": "word"})]
    df = spark.createDataFrame(rows, "dataset_id string, record_no int, meta_features map<string,double>, trajectory_features map<string,double>, text_features map<string,string>")
    got = {tuple(r) for r in sel.aggregate_features(df).collect()}
    assert got == {("d", "n", 2.0, None), ("d", "traj__s", 3.0, None), ("d", "kind", None, "early"), ("f", "z", None, "word")}


def planted(spark, n=60):
    """The best method follows a text for some datasets and a number for the others; a feature is missing here and there."""
    feats, labels = [], []
    for i in range(n):
        name, kind, x = f"d{i:02d}", "abc"[i // 3 % 3], float(i % 7)
        label = "m_text" if kind == "a" else "m_high" if x > 3 else "m_low"
        if i % 11:
            feats.append((name, "x", x, None))
        feats += [(name, "kind", None, kind), (name, "noise", float(i * 37 % 5), None), (name, "mixed", 1.0 if i % 2 else None, None if i % 2 else "word")]
        labels.append((name, label))
    return spark.createDataFrame(feats, "dataset_id string, feature string, value double, text string"), spark.createDataFrame(labels, "dataset_id string, label string")


def test_held_out_ranks_never_see_their_fold(spark):
    features, labels = planted(spark)
    folds = sel.dataset_folds(labels, 3).cache()
    sizes = Counter(r.fold for r in folds.collect())
    assert sorted(sizes) == [0, 1, 2] and set(sizes.values()) == {20}
    ranks = sel.held_out_ranks(features, labels, folds, 3, trees=20, seed=1)
    first = {r.dataset_id: r.method for r in ranks.filter("position = 1").collect()}
    truth = {r.dataset_id: r.label for r in labels.collect()}
    assert len(first) == 60 and sum(first[d] == truth[d] for d in truth) >= 50
    # A method that is best in one fold only cannot be offered there.
    fold = {r.dataset_id: r.fold for r in folds.collect()}
    odd = labels.withColumn("label", F.when(F.col("dataset_id").isin([d for d in fold if fold[d] == 1]), "only_here").otherwise(F.col("label")))
    again = sel.held_out_ranks(features, odd, folds, 3, trees=5).collect()
    assert all(r.method != "only_here" for r in again if r.fold == 1) and {r.dataset_id for r in again if r.fold == 1} == {d for d in fold if fold[d] == 1}
    for d in truth:
        p = [r.probability for r in again if r.dataset_id == d]
        assert p == sorted(p, reverse=True) and 0 < sum(p) <= 1 + 1e-6


def test_single_method_and_missing_features(spark):
    features, labels = planted(spark, 12)
    same = labels.withColumn("label", F.lit("only"))
    folds = sel.dataset_folds(labels, 2)
    assert {(r.method, r.probability) for r in sel.held_out_ranks(features, same, folds, 2, trees=3).collect()} == {("only", 1.0)}
    wide, numbers, texts = sel.wide_features(features.unionByName(features.limit(1).select("dataset_id", F.lit("void").alias("feature"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))))
    model = sel.fit_selector(wide, labels, numbers, texts, trees=3)
    assert "void" not in model.numbers and sorted(texts) == ["kind", "mixed"]
    unseen = wide.withColumn("t_kind", F.lit("never met"))
    assert model.rank(unseen, 1).count() == 12


def test_prior_and_report(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z")], "dataset_id string, label string")
    folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 0)], "dataset_id string, fold int")
    got = {(r.dataset_id, r.position): (r.method, round(r.probability, 6)) for r in sel.prior_ranks(labels, folds, 2).collect()}
    # Elsewhere fold 0 sees x, y once each; fold 1 sees x, y, z once each.
    assert got == {(d, p): (m, v) for d in "ade" for p, m, v in ((1, "x", 0.5), (2, "y", 0.5))} | {(d, p): (m, round(1 / 3, 6)) for d in "bc" for p, m in ((1, "x"), (2, "y"))}
    methods = spark.createDataFrame([(d, m, 1.0 if m == b else 0.5, 1.0 if m == b else 0.25, 2.0, b) for d, b in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z")) for m in "xyz"],
                                    "dataset_id string, method string, cv double, j double, runtime_sec double, label string")
    report = rv.selector_report(sel.prior_ranks(labels, folds, 2), methods, 2)
    summary = sel.selector_summary(report).first()
    assert (summary.folds, summary.datasets) == (2, 5) and abs(summary.top1_accuracy - (1 / 3 + 1 / 2) / 2) < 1e-12
    assert abs(summary.regret_cv - (1 / 3 + 1 / 4) / 2) < 1e-12 and abs(summary.time_ratio_top1 - 1 / 3) < 1e-12 and abs(summary.topn_hit - (2 / 3 + 1) / 2) < 1e-12
