"""Recommendation: history rule for all datasets at once, ties, and the choice between history and measurement."""

import random

from veritab.operators import recommend as rc

KIND = "dataset_id string, source_hash string, evidence_purpose string, selected_method string"


def test_history_counts_against_loops(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdefg"), rng.choice(["s1", "s2", "s3", None]), rng.choice(["E", "E", "V"]), rng.choice([*rc.METHODS, "other", None])) for _ in range(40)] + [(None, "s1", "E", "pearson_abs")]
    targets = [(d, s) for d in "abcdefgz" for s in ("s1", "s2", "s9", None)]
    got = {(r.dataset_id, r.source_hash): r.historical_datasets for r in rc.history_counts(spark.createDataFrame(rows, KIND), spark.createDataFrame(targets, "dataset_id string, source_hash string")).collect()}
    for d, s in targets:
        want = {r[0] for r in rows if r[0] not in (d, None) and (s is None or r[1] != s) and r[2] == "E" and r[3] in rc.METHODS}
        assert got[d, s] == len(want), (d, s)


def test_measured_best_breaks_ties_by_order(spark):
    nan = float("nan")
    rows = [("a", "mutual_info", 1.0), ("a", "spearman_abs", 1.0), ("a", "pearson_abs", nan), ("b", "pearson_abs", None), ("c", "other", 9.0), ("c", "mutual_info", -1.0)]
    got = {r.d: r.measured_best_method for r in rc.measured_best(spark.createDataFrame(rows, "d string, method string, objective double"), ["d"]).collect()}
    assert got == {"a": "spearman_abs", "c": "mutual_info"}


def test_history_chooses_from_three_other_datasets_on(spark):
    measured = spark.createDataFrame([("pearson_abs", 0.2), ("spearman_abs", 0.9), ("mutual_info", 0.1)], "method string, objective double")
    features = spark.createDataFrame([("x", 5.0, None)], "feature string, value double, text string")
    history = [(f"d{i}", "other", "E", "mutual_info" if i % 2 else "pearson_abs") for i in range(12)] + [("me", "mine", "E", "spearman_abs"), ("copy", "mine", "E", "spearman_abs")]
    known = spark.createDataFrame([(f"d{i}", "x", 5.0 if i % 2 else 1.0, None) for i in range(12)] + [("me", "x", 5.0, None)], "dataset_id string, feature string, value double, text string")
    many = rc.recommend(measured, features, spark.createDataFrame(history, KIND), known, "me", "mine", trees=10).first()
    assert tuple(many) == ("me", "mutual_info", "spearman_abs", "historical_meta_selector", 12)
    few = rc.recommend(measured, features, spark.createDataFrame(history[:2] + history[-2:], KIND), known, "me", "mine").first()
    assert tuple(few) == ("me", "spearman_abs", "spearman_abs", "cold_start_grouped_cv", 2)
