"""Trajectory, trial, split and structure queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import structure as st
from veritab.operators import trials as tr
from veritab.plans.common import OBS_CTE, observations, r
from veritab.plans.registry import Tables, query


def series(t: Tables) -> DataFrame:
    """One trajectory per user: value over time, with problem number and event type."""
    return t.events.select(
        F.col("user_id").alias("traj"), F.col("ts"), F.col("event_id"), F.col("value").alias("tendency"),
        F.get_json_object("props", "$.k").cast("int").alias("sequence"), F.col("event_type").alias("selection"))


_SERIES = """
s AS (SELECT user_id AS traj, ts, event_id, value AS tendency, CAST(json_extract_string(props, '$.k') AS INTEGER) AS sequence, event_type AS selection,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS len,
             lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""


@query("b16_label_completion", """
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE CAST(vec_id AS DOUBLE) END AS retrieval_time,
       CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE CAST(label AS DOUBLE) END AS decision_effect, CAST(len(embedding) AS BIGINT) AS trajectory_length FROM embeddings""")
def b16(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        "vec_id", F.col("embedding").alias("tendency"), F.lit(None).cast("array<int>").alias("sequence"),
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id").cast("double")).alias("retrieval_time"),
        F.when(F.col("vec_id") % 5 != 0, F.col("label").cast("double")).alias("decision_effect"), F.lit(7).alias("trajectory_length"))
    return tr.complete_labels(rows).select("vec_id", "retrieval_time", "decision_effect", "trajectory_length")


@query("d23_trajectory_features", f"""
WITH {_SERIES}, m AS (SELECT *, greatest(2, floor(len * 0.2)) AS m FROM s)
SELECT traj, any_value(len) AS length, arg_min(tendency, pos) AS start, arg_max(tendency, pos) AS "end", min(tendency) AS min_value, arg_min(pos, (tendency, pos)) - 1 AS min_index,
       round(sum(tendency) - (arg_min(tendency, pos) + arg_max(tendency, pos)) / 2, 6) AS auc,
       round(regr_slope(tendency, pos) FILTER (WHERE pos <= m), 6) AS early_slope, round(regr_slope(tendency, pos) FILTER (WHERE pos > len - m), 6) AS late_slope,
       round(stddev_pop(tendency - prev), 6) AS diff_std FROM m GROUP BY traj""")
def d23(t: Tables) -> DataFrame:
    return tr.trajectory_features(series(t), ["traj"], ["ts", "event_id"], "tendency").select(
        "traj", "length", "start", "end", "min_value", "min_index", *[r(c).alias(c) for c in ("auc", "early_slope", "late_slope", "diff_std")])


@query("d23_trajectory_features_normalised", f"""
WITH {_SERIES}, z AS (SELECT *, (tendency - avg(tendency) OVER (PARTITION BY traj)) / (stddev_pop(tendency) OVER (PARTITION BY traj) + 1e-12) AS v, greatest(2, floor(len * 0.2)) AS m FROM s)
SELECT traj, round(arg_min(v, pos), 6) AS start, round(regr_slope(v, pos) FILTER (WHERE pos <= m), 6) AS early_slope, round(min(v), 6) AS min_value FROM z GROUP BY traj""")
def d23_normalised(t: Tables) -> DataFrame:
    return tr.trajectory_features(series(t), ["traj"], ["ts", "event_id"], "tendency", normalize=True).select(
        "traj", *[r(c).alias(c) for c in ("start", "early_slope", "min_value")])


def _quality_rows(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(
        F.least(F.lit(1.0), F.avg("value") / 80).alias("effect"), F.count(F.lit(1)).alias("length"), (F.max("value") / 100).alias("time"))


_QROWS = "q AS (SELECT user_id, event_type, least(1.0, avg(value) / 80) AS e, count(*) AS l, max(value) / 100 AS t FROM events GROUP BY 1, 2)"


@query("d24_quality_tables", f"""
WITH {_QROWS},
b AS (SELECT *, CASE WHEN e >= 0.7 THEN 'high' WHEN e >= 0.5 THEN 'medium' ELSE 'low' END AS band, CASE WHEN l <= 5 THEN '2-5' WHEN l <= 15 THEN '6-15' WHEN l <= 25 THEN '16-25' ELSE '26+' END AS lb FROM q),
u AS (SELECT 'category' AS grouping, event_type AS item, * FROM b UNION ALL SELECT 'band', band, * FROM b UNION ALL SELECT 'length_band', lb, * FROM b)
SELECT grouping, item, count(*) AS n, round(avg(e), 6) AS mean_effect, round(min(e), 6) AS min_effect, round(max(e), 6) AS max_effect,
       round(avg(l), 6) AS mean_length, min(l) AS min_length, max(l) AS max_length, round(avg(t), 6) AS mean_time FROM u GROUP BY 1, 2""")
def d24(t: Tables) -> DataFrame:
    q = tr.quality_tables(_quality_rows(t), "event_type", "effect", "length", "time")
    return q.select("grouping", "item", "n", *[r(c).alias(c) for c in ("mean_effect", "min_effect", "max_effect", "mean_length", "mean_time")], "min_length", "max_length")


def _summary(t: Tables) -> DataFrame:
    rows = series(t).withColumn("code", tr.stable_code(F.col("selection")))
    return tr.summary_features(rows, ["traj"], ["tendency", "sequence", "code"])


@query("d25_summary_features", f"""
WITH {_SERIES}, c AS (SELECT *, CAST('0x' || substr(md5(selection), 1, 6) AS BIGINT) % 1000 AS code FROM s)
SELECT traj, count(*) AS length, {", ".join(f"round(avg({v}), 9) AS {v}_mean, round(stddev_pop({v}), 9) AS {v}_std, CAST(min({v}) AS DOUBLE) AS {v}_min, CAST(max({v}) AS DOUBLE) AS {v}_max, round(median({v}), 9) AS {v}_median" for v in ("tendency", "sequence", "code"))}
FROM c GROUP BY traj""")
def d25(t: Tables) -> DataFrame:
    out = _summary(t)
    return out.select("traj", "length", *[r(F.col(c).cast("double"), 9).alias(c) for c in out.columns if c not in ("traj", "length")])


@query("d25_quality_regressor")
def d25_model(t: Tables) -> DataFrame:
    rows = _summary(t).withColumn("quality", F.col("tendency_mean") / 100).drop("tendency_mean")
    model = tr.fit_quality_regressor(rows.drop("traj"), "quality")
    return model.transform(rows).select("traj", r("quality").alias("quality"), r("prediction").alias("prediction"))


@query("d26_decision_objective", f"""
WITH {_QROWS} SELECT user_id, event_type, round(e - 0.05 * l - 0.10 * ln(1 + greatest(t, 0)), 6) AS objective FROM q""")
def d26(t: Tables) -> DataFrame:
    return _quality_rows(t).select("user_id", "event_type", r(tr.decision_objective(F.col("effect"), F.col("length"), F.col("time"))).alias("objective"))


@query("e16_mixed_matrix", f"""
WITH {_SERIES}, c AS (SELECT traj, event_id, tendency AS t, CAST(sequence AS DOUBLE) AS s, CAST(dense_rank() OVER (PARTITION BY traj ORDER BY selection) - 1 AS DOUBLE) AS sel FROM s)
SELECT traj, event_id, round(t, 9) AS t, s, sel, round(t * s, 9) AS t_s, round(t * sel, 9) AS t_sel, s * sel AS s_sel,
       round(t - avg(t) OVER w, 9) AS t_centred, round(s - avg(s) OVER w, 9) AS s_centred, round(sel - avg(sel) OVER w, 9) AS sel_centred,
       round((t - avg(t) OVER w) / (CASE WHEN stddev_pop(t) OVER w = 0 THEN 1 ELSE stddev_pop(t) OVER w END), 9) AS t_std,
       round((s - avg(s) OVER w) / (CASE WHEN stddev_pop(s) OVER w = 0 THEN 1 ELSE stddev_pop(s) OVER w END), 9) AS s_std,
       round((sel - avg(sel) OVER w) / (CASE WHEN stddev_pop(sel) OVER w = 0 THEN 1 ELSE stddev_pop(sel) OVER w END), 9) AS sel_std
FROM c WINDOW w AS (PARTITION BY traj)""")
def e16(t: Tables) -> DataFrame:
    out = tr.mixed_matrix(series(t), ["traj"], ["event_id"], "full")
    return out.select("traj", "event_id", *[r(c, 9).alias(c) for c in out.columns[2:]])


@query("e16_mixed_matrix_scaled", f"""
WITH {_SERIES}, c AS (SELECT traj, event_id, tendency AS t, CAST(sequence AS DOUBLE) AS s, CAST(dense_rank() OVER (PARTITION BY traj ORDER BY selection) - 1 AS DOUBLE) AS sel FROM s),
n AS (SELECT traj, event_id, (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w + 1e-8) AS t, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8) AS s,
             (sel - min(sel) OVER w) / (max(sel) OVER w - min(sel) OVER w + 1e-8) AS sel FROM c WINDOW w AS (PARTITION BY traj))
SELECT traj, event_id, round(t, 5) AS t, round(s, 5) AS s, round(sel, 5) AS sel, round(t * s, 5) AS t_s, round(t * sel, 5) AS t_sel, round(s * sel, 5) AS s_sel FROM n""")
def e16_scaled(t: Tables) -> DataFrame:
    out = tr.mixed_matrix(series(t), ["traj"], ["event_id"], "with_interaction", normalize=True)
    return out.select("traj", "event_id", *[r(c, 5).alias(c) for c in out.columns[2:]])


def trial_table(t: Tables) -> DataFrame:
    """One trial per (part, rung): mean discount as score, mean tax as learned probability."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("config"), ((F.col("l_linenumber") - 1) % 4).cast("int").alias("rung")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("score"), F.round(F.avg("l_tax") * 12, 6).alias("proba"))


_TRIALS = "tr AS (SELECT l_partkey AS config, CAST((l_linenumber - 1) % 4 AS INTEGER) AS rung, round(avg(l_discount) * 10, 6) AS score, round(avg(l_tax) * 12, 6) AS proba FROM lineitem GROUP BY 1, 2)"


@query("e10_successive_halving", f"""
WITH {_TRIALS},
r0 AS (SELECT *, row_number() OVER (ORDER BY score DESC, config) AS position, ceil(count(*) OVER () / 3) AS k FROM tr WHERE rung = 0),
r1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, config) AS position, ceil(count(*) OVER () / 3) AS k FROM tr WHERE rung = 1 AND config IN (SELECT config FROM r0 WHERE position <= k)),
r2 AS (SELECT *, row_number() OVER (ORDER BY score DESC, config) AS position, ceil(count(*) OVER () / 3) AS k FROM tr WHERE rung = 2 AND config IN (SELECT config FROM r1 WHERE position <= k))
SELECT rung, config, score, position, CAST(k AS BIGINT) AS k, position <= k AS promoted FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def e10(t: Tables) -> DataFrame:
    return tr.halving_run(trial_table(t), 3, 3).select("rung", "config", "score", "position", "k", "promoted")


_GUIDED = """
rk AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY score DESC, config) AS position, ceil(count(*) OVER (PARTITION BY rung) / 3) AS k FROM tr),
pool AS (SELECT * FROM rk),
mx AS (SELECT *, 0.6 * proba + 0.4 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) AS mix FROM pool WINDOW w AS (PARTITION BY rung)),
i AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY mix, position) AS pair FROM mx WHERE position <= k),
o AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY mix DESC, position) AS pair FROM mx WHERE position > k AND proba >= 0.3),
sw AS (SELECT i.rung, i.config AS old, o.config AS new FROM i JOIN o USING (rung, pair) WHERE o.mix > i.mix + 0.02 AND pair <= i.k),
g AS (SELECT rk.rung, rk.config, position <= k AS baseline,
             (position <= k AND NOT EXISTS (SELECT 1 FROM sw WHERE sw.rung = rk.rung AND sw.old = rk.config)) OR EXISTS (SELECT 1 FROM sw WHERE sw.rung = rk.rung AND sw.new = rk.config) AS guided FROM rk)"""


@query("e11_guided_promotion", f"WITH {_TRIALS}, {_GUIDED} SELECT rung, config, baseline, guided FROM g WHERE baseline OR guided")
def e11(t: Tables) -> DataFrame:
    return _guided(t).filter("baseline or guided").select("rung", "config", "baseline", "guided")


@query("e11_disagreement", f"WITH {_TRIALS}, {_GUIDED}, d AS (SELECT rung, bool_or(baseline <> guided) AS x FROM g GROUP BY rung) SELECT count(*) AS rungs, round(avg(CASE WHEN x THEN 1.0 ELSE 0 END), 6) AS disagree_rate FROM d")
def e11_rate(t: Tables) -> DataFrame:
    return tr.disagreement_rate(_guided(t)).withColumn("disagree_rate", r("disagree_rate"))


def _guided(t: Tables) -> DataFrame:
    return tr.guided_promotion(trial_table(t), 3, margin=0.02, min_proba=0.3)


@query("e12_promotion_labels", f"""
WITH {_TRIALS},
p AS (SELECT a.config, a.rung, b.score - a.score AS uplift FROM tr a JOIN tr b ON a.config = b.config AND b.rung = a.rung + 1),
c AS (SELECT rung, quantile_cont(uplift, 0.65) AS cutoff FROM p GROUP BY rung)
SELECT config, rung, round(uplift, 6) AS uplift, CASE WHEN uplift >= cutoff - 1e-12 THEN 1 ELSE 0 END AS label FROM p JOIN c USING (rung)""")
def e12(t: Tables) -> DataFrame:
    rows = tr.promotion_labels(trial_table(t))
    return rows.select("config", "rung", r("uplift").alias("uplift"), "label")


def split_rows(t: Tables) -> DataFrame:
    return observations(t).select(
        F.col("env").alias("node"), "x1", "x2", "x4", F.when(F.col("y") > 50000, "big").otherwise("small").alias("label"),
        F.when(F.col("grp").cast("int") % 4 == 0, "val").otherwise("train").alias("part"))


_SPLIT = OBS_CTE + """,
sr AS (SELECT env AS node, x1, x2, x4, CASE WHEN y > 50000 THEN 'big' ELSE 'small' END AS label, CASE WHEN CAST(grp AS INTEGER) % 4 = 0 THEN 'val' ELSE 'train' END AS part FROM obs0),
lg AS (SELECT node, label, part, 'x1' AS feature, x1 AS x FROM sr UNION ALL SELECT node, label, part, 'x2', x2 FROM sr UNION ALL SELECT node, label, part, 'x4', x4 FROM sr),
qs AS (SELECT node, feature, unnest(quantile_cont(x, [""" + ", ".join(repr(0.05 + 0.06 * i) for i in range(16)) + """])) AS q FROM lg WHERE part = 'train' GROUP BY node, feature),
cu AS (SELECT DISTINCT node, feature, round(q, 9) AS q FROM qs),
mi AS (SELECT node, feature, (q + lead(q) OVER (PARTITION BY node, feature ORDER BY q)) / 2 AS threshold FROM cu),
th AS (SELECT * FROM mi WHERE threshold IS NOT NULL),
ct AS (SELECT node, feature, threshold, part, label, count(*) FILTER (WHERE x <= threshold) AS l, count(*) FILTER (WHERE x > threshold) AS rr FROM lg JOIN th USING (node, feature) GROUP BY ALL),
tot AS (SELECT node, feature, threshold, sum(l) AS nl, sum(rr) AS nr, sum(l) + sum(rr) AS n, sum(l * l) AS l2, sum(rr * rr) AS r2, sum((l + rr) * (l + rr)) AS p2 FROM ct WHERE part = 'train' GROUP BY 1, 2, 3)"""


def _counts(t: Tables) -> DataFrame:
    return t.once("split_counts", lambda: tr.split_counts(split_rows(t), "node", ["x1", "x2", "x4"], "label", "part")[1])


@query("d27_split_gain", f"""
WITH {_SPLIT}
SELECT node, feature, round(threshold, 6) AS threshold, round((1 - p2 / (n * n)) - nl / n * (1 - l2 / (nl * nl)) - nr / n * (1 - r2 / (nr * nr)), 6) AS gain, round(nl / n, 6) AS left_ratio FROM tot WHERE nl > 0 AND nr > 0""")
def d27(t: Tables) -> DataFrame:
    return tr.split_gains(_counts(t), "node", "part").select("node", "feature", r("threshold", 6).alias("threshold"), r("gain").alias("gain"), r("left_ratio").alias("left_ratio"))


@query("d27_split_gain_entropy", f"""
WITH {_SPLIT},
h AS (SELECT node, feature, threshold, n, nl, nr, sum(-(l + rr) / n * log2((l + rr) / n)) AS hp, coalesce(sum(CASE WHEN l > 0 THEN -l / nl * log2(l / nl) END), 0) AS hl, coalesce(sum(CASE WHEN rr > 0 THEN -rr / nr * log2(rr / nr) END), 0) AS hr
      FROM ct JOIN tot USING (node, feature, threshold) WHERE part = 'train' AND nl > 0 AND nr > 0 GROUP BY ALL)
SELECT node, feature, round(threshold, 6) AS threshold, round(hp - nl / n * hl - nr / n * hr, 6) AS gain FROM h""")
def d27_entropy(t: Tables) -> DataFrame:
    return tr.split_gains(_counts(t), "node", "part", "entropy").select("node", "feature", r("threshold", 6).alias("threshold"), r("gain").alias("gain"))


@query("d28_validation_gain", f"""
WITH {_SPLIT},
mj AS (SELECT node, feature, threshold, arg_min(label, (-l, label)) AS ml, arg_min(label, (-rr, label)) AS mr, arg_min(label, (-(l + rr), label)) AS mp FROM ct WHERE part = 'train' GROUP BY 1, 2, 3)
SELECT node, feature, round(threshold, 6) AS threshold, CAST(sum(l + rr) AS BIGINT) AS n_val,
       round((coalesce(sum(l) FILTER (WHERE label = ml), 0) + coalesce(sum(rr) FILTER (WHERE label = mr), 0) - coalesce(sum(l + rr) FILTER (WHERE label = mp), 0)) / sum(l + rr), 6) AS val_gain
FROM ct JOIN mj USING (node, feature, threshold) WHERE part = 'val' GROUP BY ALL""")
def d28(t: Tables) -> DataFrame:
    return tr.validation_gains(_counts(t), "node", "label", "part").select("node", "feature", r("threshold", 6).alias("threshold"), "n_val", r("val_gain").alias("val_gain"))


@query("d36_experiment_summary", """
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_tax), 9) AS mean, round(stddev_pop(l_tax), 9) AS std FROM lineitem GROUP BY 1, 2""")
def d36(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_tax")
    return tr.mean_std(rows, ["flag", "status"], "l_tax").select("flag", "status", "n", r("mean", 9).alias("mean"), r("std", 9).alias("std"))


def predictions(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("y"),
                             F.when(F.col("l_quantity") > 33, "A").when(F.col("l_quantity") > 16, "N").otherwise("R").alias("pred_a"),
                             F.when(F.col("l_quantity") > 30, "A").when(F.col("l_discount") > 0.04, "N").otherwise("R").alias("pred_b"))


_PRED = """p AS (SELECT l_linenumber AS seed, l_returnflag AS y, CASE WHEN l_quantity > 33 THEN 'A' WHEN l_quantity > 16 THEN 'N' ELSE 'R' END AS a, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_discount > 0.04 THEN 'N' ELSE 'R' END AS b FROM lineitem),
s AS (SELECT seed, count(*) AS n, avg((a = y)::INT) AS acc_a, avg((b = y)::INT) AS acc_b, avg((a = b)::INT) AS agreement FROM p GROUP BY 1)"""


@query("d39_prediction_agreement", f"""
WITH {_PRED}, u AS (SELECT 'acc_a' AS metric, acc_a AS v FROM s UNION ALL SELECT 'acc_b', acc_b FROM s UNION ALL SELECT 'agreement', agreement FROM s)
SELECT metric, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(min(v), 9) AS min FROM u GROUP BY 1""")
def d39(t: Tables) -> DataFrame:
    _, overall = tr.prediction_agreement(predictions(t))
    return overall.select("metric", *[r(c, 9).alias(c) for c in ("mean", "std", "min")])


def _tree(t: Tables) -> DataFrame:
    """A depth-2 tree read off the data: cut price at its mean, then quantity at the mean of each side."""
    obs = observations(t)
    root = obs.agg(F.struct(F.avg("x4").alias("cut"), F.count(F.lit(1)).alias("n")).alias("r"))
    side = obs.withColumn("r", root.scalar()).groupBy((F.col("x4") <= F.col("r.cut")).alias("low")).agg(
        F.avg("x1").alias("cut"), F.count(F.lit(1)).alias("n"))
    top = root.select(F.lit(0).alias("id"), F.lit("x4").alias("feature"), F.col("r.cut").alias("threshold"), F.lit(1).alias("left"), F.lit(4).alias("right"), F.lit(0.5).alias("impurity"), F.col("r.n").alias("n"))
    base = F.when(F.col("low"), 1).otherwise(4)
    mid = side.select(base.alias("id"), F.lit("x1").alias("feature"), F.col("cut").alias("threshold"), (base + 1).alias("left"), (base + 2).alias("right"), F.lit(0.25).alias("impurity"), "n")
    leaves = side.select(F.explode(F.array(base + 1, base + 2)).alias("id"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"),
                         F.lit(-1).alias("left"), F.lit(-1).alias("right"), F.lit(0.125).alias("impurity"), F.floor(F.col("n") / 2).alias("n"))
    return top.unionByName(mid).unionByName(leaves)


@query("f23_tree_paths", f"""
WITH {OBS_CTE}, rt AS (SELECT avg(x4) AS c, count(*) AS n FROM obs0), sd AS (SELECT x4 <= c AS low, avg(x1) AS c1, count(*) AS n1 FROM obs0, rt GROUP BY 1),
w AS (SELECT x4 <= c AS low, x1 <= c1 AS low1, n, n1 FROM obs0, rt, sd WHERE sd.low = (x4 <= c)),
p AS (SELECT 0 AS depth, 0 AS node, 0.5 AS tendency, CASE WHEN low THEN 'left' ELSE 'right' END AS selection FROM w
      UNION ALL SELECT 1, CASE WHEN low THEN 1 ELSE 4 END, 0.25 * n1 / n, CASE WHEN low1 THEN 'left' ELSE 'right' END FROM w
      UNION ALL SELECT 2, CASE WHEN low THEN 1 ELSE 4 END + CASE WHEN low1 THEN 1 ELSE 2 END, 0.125 * floor(n1 / 2) / n, 'leaf' FROM w)
SELECT depth, node, selection, round(any_value(tendency), 6) AS tendency, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def f23(t: Tables) -> DataFrame:
    paths = tr.tree_paths(observations(t), "record_id", ["x1", "x4"], _tree(t), 2)
    return paths.groupBy("depth", "node", "selection").agg(r(F.max("tendency")).alias("tendency"), F.count(F.lit(1)).alias("n"))


@query("f25_signature_difference", """
WITH s AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position, l_linenumber AS depth, l_returnflag AS feature, l_tax AS threshold FROM lineitem),
a AS (SELECT * FROM s WHERE side = 0), b AS (SELECT * FROM s WHERE side = 1)
SELECT pair, count(*) FILTER (WHERE a.depth IS DISTINCT FROM b.depth OR a.feature IS DISTINCT FROM b.feature OR a.threshold IS DISTINCT FROM b.threshold) AS differences, count(*) AS positions
FROM a FULL JOIN b USING (pair, position) GROUP BY pair""")
def f25(t: Tables) -> DataFrame:
    from veritab.functions.ordered import ordered_scan
    rows = ordered_scan(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], number="position").select(
        F.expr("l_orderkey div 2").alias("pair"), (F.col("l_orderkey") % 2).alias("side"), "position",
        F.col("l_linenumber").alias("depth"), F.col("l_returnflag").alias("feature"), F.col("l_tax").alias("threshold"))
    return tr.signature_difference(rows.filter("side = 0"), rows.filter("side = 1"), ["pair"], ["depth", "feature", "threshold"])


# --- structure -----------------------------------------------------------------


_CP = """
pv AS (SELECT traj, pos AS i, sum(tendency) OVER (PARTITION BY traj ORDER BY pos) AS s, sum(tendency * tendency) OVER (PARTITION BY traj ORDER BY pos) AS ss, len FROM s),
en AS (SELECT traj, max(i) AS n, arg_max(s, i) AS sn, arg_max(ss, i) AS ssn FROM pv GROUP BY 1),
gn AS (SELECT traj, i, n, greatest(0, ssn - sn * sn / n) AS parent,
              greatest(0, ssn - sn * sn / n) - greatest(0, ss - s * s / i) - greatest(0, ssn - ss - (sn - s) * (sn - s) / (n - i)) AS gain
       FROM pv JOIN en USING (traj) WHERE i BETWEEN 3 AND n - 3)"""


@query("f4_first_changepoint", f"""
WITH {_SERIES}, {_CP}
SELECT traj, arg_max(i, (gain, -i)) AS position, round(max(gain), 2) AS gain FROM gn WHERE gain > 1.5 * parent / n * ln(n) + 1e-12 GROUP BY traj""")
def f4_first(t: Tables) -> DataFrame:
    return st.changepoints(series(t), ["traj"], ["ts", "event_id"], "tendency", max_points=1, penalty=1.5).withColumn("gain", r("gain", 2))


def _segment_round(number: int) -> str:
    """One round of binary segmentation in SQL over the accepted cuts so far."""
    p = number - 1
    return f"""
b{number} AS (SELECT traj, i AS cut FROM pick{p}),
sg{number} AS (SELECT traj, cut AS low, lead(cut) OVER (PARTITION BY traj ORDER BY cut) AS high FROM (SELECT traj, 0::BIGINT AS cut FROM en UNION ALL SELECT traj, n FROM en UNION ALL SELECT traj, i FROM pick{p})),
sx{number} AS (SELECT g.traj, low, high, coalesce(a.s, 0) AS sl, coalesce(a.ss, 0) AS ssl, b.s AS sh, b.ss AS ssh FROM sg{number} g LEFT JOIN pv a ON a.traj = g.traj AND a.i = low JOIN pv b ON b.traj = g.traj AND b.i = high WHERE high IS NOT NULL AND high - low >= 6),
gx{number} AS (SELECT x.traj, low, p.i, high - low AS n, greatest(0, ssh - ssl - (sh - sl) * (sh - sl) / (high - low)) AS parent,
        greatest(0, ssh - ssl - (sh - sl) * (sh - sl) / (high - low)) - greatest(0, p.ss - ssl - (p.s - sl) * (p.s - sl) / (p.i - low)) - greatest(0, ssh - p.ss - (sh - p.s) * (sh - p.s) / (high - p.i)) AS gain
      FROM sx{number} x JOIN pv p ON p.traj = x.traj AND p.i BETWEEN low + 3 AND high - 3),
pick{number} AS (SELECT * FROM pick{p} UNION ALL SELECT traj, arg_max(i, (gain, -low, -i)) AS i, max(gain) AS gain, {number} AS round FROM gx{number} WHERE gain > 1.5 * parent / n * ln(n) + 1e-12
      AND traj IN (SELECT traj FROM pick{p} WHERE round = {p} UNION ALL SELECT traj FROM en WHERE {number} = 1) GROUP BY traj)"""


@query("f4_changepoints", f"""
WITH {_SERIES}, {_CP}, pick0 AS (SELECT traj, i, gain, 0 AS round FROM gn WHERE false), {_segment_round(1)}, {_segment_round(2)}, {_segment_round(3)}
SELECT traj, i AS position, round(gain, 2) AS gain FROM pick3""")
def f4(t: Tables) -> DataFrame:
    return st.changepoints(series(t), ["traj"], ["ts", "event_id"], "tendency", penalty=1.5).withColumn("gain", r("gain", 2))


@query("f6_silhouette", """
WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN own = c THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM p GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN greatest(a, b) <= 1e-12 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def f6(t: Tables) -> DataFrame:
    return st.silhouette_exact(t.embeddings, "vec_id", "embedding", "label").select("n", r("silhouette").alias("silhouette"))


@query("f6_silhouette_squared", """
WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS s, count(*) AS n FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN own = c THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM p GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN greatest(a, b) <= 1e-12 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def f6_squared(t: Tables) -> DataFrame:
    return st.silhouette_squared(t.embeddings, "embedding", "label").select("n", r("silhouette").alias("silhouette"))


@query("d29_rand_index", """
WITH c AS (SELECT l_returnflag AS g, l_linenumber AS a, CAST(l_quantity AS INTEGER) % 7 AS b, count(*) AS n FROM lineitem GROUP BY ALL),
x AS (SELECT g, sum(n * (n - 1) / 2) AS bo, sum(n) AS n FROM c GROUP BY g),
l AS (SELECT g, sum(m * (m - 1) / 2) AS v FROM (SELECT g, a, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY g),
q AS (SELECT g, sum(m * (m - 1) / 2) AS v FROM (SELECT g, b, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY g)
SELECT g, CAST(n AS BIGINT) AS n, round((2 * bo + n * (n - 1) / 2 - l.v - q.v) / (n * (n - 1) / 2), 6) AS rand FROM x JOIN l USING (g) JOIN q USING (g)""")
def d29(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), F.concat_ws("|", *t.lineitem.columns[:4], "l_extendedprice", "l_shipdate").alias("key"),
                             F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 7).alias("b"))
    return st.rand_index(rows.select("g", "key", "a"), rows.select("g", "key", "b"), "key", "a", "b", ["g"]).withColumn("rand", r("rand"))


@query("f8_structure_stability")
def f8(t: Tables) -> DataFrame:
    """Invariant, change-point and cluster patterns re-found on group draws."""
    obs = observations(t)
    draws = t.once("draws", lambda: st.group_draws(obs, "grp", 4, "2"))
    inv = st.invariant_stability(obs.select("grp", F.exp("x2").alias("z")), draws, "grp", "z", 0.1).select(
        F.lit("invariant").alias("kind"), F.lit("all").alias("item"), "draw", "reproduced")
    rows = series(t).withColumn("grp", (F.col("event_id") % 40).cast("string")).withColumn("traj", F.col("traj") % 3)
    cdraws = t.once("cdraws", lambda: st.group_draws(rows, "grp", 4, "2"))
    cps = st.changepoint_stability(rows.select("grp", "traj", "ts", "event_id", "tendency"), cdraws, "grp", ["traj"], ["ts", "event_id"], "tendency", penalty=1.5).select(
        F.lit("changepoint").alias("kind"), F.col("traj").cast("string").alias("item"), "draw", "reproduced")
    pts = t.embeddings.withColumn("grp", (F.col("vec_id") % 20).cast("string"))
    pdraws = t.once("pdraws", lambda: st.group_draws(pts, "grp", 2, "2"))
    cl = st.cluster_stability(pts, "vec_id", "embedding", "grp", pdraws, accept=0.0).select(F.lit("cluster").alias("kind"), F.lit("all").alias("item"), "draw", "reproduced")
    return inv.unionByName(cps).unionByName(cl)
