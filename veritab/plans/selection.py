"""Feature relevance and method-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import recommend as rec
from veritab.operators import relevance as rv
from veritab.operators import selector as sel
from veritab.operators.neighbours import knn_mutual_information
from veritab.plans.common import FEATURES, OBS_CTE, observations, r
from veritab.plans.registry import Tables, query
from veritab.session import sized_join, stored


def table(t: Tables) -> DataFrame:
    """Feature table with missing tax values and a unique row key."""
    return observations(t).withColumn("x3", F.when(F.col("x3") != 0, F.col("x3"))).withColumn(
        "key", F.concat_ws("|", "record_id", F.round(F.col("x4") * 100).cast("long"), F.unix_timestamp("event_time")))


_TAB = OBS_CTE + """,
tab AS (SELECT record_id || '|' || CAST(round(x4 * 100) AS BIGINT) || '|' || CAST(epoch(event_time) AS BIGINT) AS key, grp, x1, x2,
               CASE WHEN x3 <> 0 THEN x3 END AS x3, x4, y FROM obs0),
filled AS (SELECT key, grp, x1, x2, coalesce(x3, avg(x3) OVER ()) AS x3, x4, y FROM tab)"""
_LONG = "SELECT y, 'x1' AS feature, x1 AS x FROM {0} UNION ALL SELECT y, 'x2', x2 FROM {0} UNION ALL SELECT y, 'x3', x3 FROM {0} UNION ALL SELECT y, 'x4', x4 FROM {0}"


@query("d3_pearson_relevance", f"""
WITH {_TAB}, l AS ({_LONG.format("filled")})
SELECT feature, round(abs(covar_pop(x, y) / ((stddev_pop(x) + 1e-12) * (stddev_pop(y) + 1e-12))), 6) AS score FROM l GROUP BY feature""")
def d3(t: Tables) -> DataFrame:
    return rv.pearson_abs(table(t), FEATURES, "y").withColumn("score", r("score"))


@query("d4_spearman_relevance", f"""
WITH {_TAB}, l AS ({_LONG.format("filled")}),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)
SELECT feature, round(abs(corr(rx, ry)), 6) AS score FROM k GROUP BY feature""")
def d4(t: Tables) -> DataFrame:
    return rv.spearman_abs(table(t), FEATURES, "y").withColumn("score", r("score"))


@query("d5_mutual_information", f"""
WITH {_TAB}, l AS (SELECT * FROM ({_LONG.format("tab")}) WHERE x IS NOT NULL),
xb AS (SELECT feature, x, ((sum(count(*)) OVER (PARTITION BY feature ORDER BY x) - count(*)) * 8) // sum(count(*)) OVER (PARTITION BY feature) AS bx FROM l GROUP BY feature, x),
yb AS (SELECT y, ((sum(count(*)) OVER (ORDER BY y) - count(*)) * 8) // sum(count(*)) OVER () AS by_ FROM tab GROUP BY y),
c AS (SELECT feature, bx, by_, count(*) AS n FROM l JOIN xb USING (feature, x) JOIN yb USING (y) GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, bx) AS na, sum(n) OVER (PARTITION BY feature, by_) AS nb, sum(n) OVER (PARTITION BY feature) AS nn FROM c)
SELECT feature, round(sum(n / nn * ln(n * nn / (na * nb))), 6) AS score FROM m GROUP BY feature""")
def d5(t: Tables) -> DataFrame:
    return rv.binned_mutual_information(table(t), FEATURES, "y").withColumn("score", r("score"))


_KNN_JITTER = "1e-10 * greatest(1.0, avg(abs({0})) OVER () / stddev_pop({0}) OVER ()) * (CAST('0x' || substr(md5('{1}|' || id), 1, 8) AS BIGINT) / 2147483648.0 - 1)"
_KNN_FEATURES = ["quantity", "discount", "size"]


def parts(t: Tables) -> DataFrame:
    """Per part: average quantity and discount of its lines, its size, and its mean price."""
    sold = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"))
    return sold.join(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size")), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("id"), "quantity", "discount", "size", "price")


@query("d5_neighbour_information", f"""
WITH p AS (SELECT p_partkey AS id, avg(l_quantity) AS quantity, avg(l_discount) AS discount, any_value(p_size)::DOUBLE AS size, avg(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
h AS (SELECT i AS n, -0.57721566490153286 + coalesce(sum(1.0 / (i - 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi FROM (SELECT unnest(range(2, 20001)) AS i)),
ps AS (SELECT 1 AS n, -0.57721566490153286 AS psi UNION ALL SELECT * FROM h),
s AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, id, {f} / stddev_pop({f}) OVER () + {_KNN_JITTER.format(f, f)} AS x, price / stddev_pop(price) OVER () + {_KNN_JITTER.format('price', 'y')} AS y FROM p" for f in _KNN_FEATURES)}),
d AS (SELECT a.feature, a.id, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM s a JOIN s b ON a.feature = b.feature AND a.id <> b.id),
k AS (SELECT feature, id, min(d, 3)[3] AS r FROM d GROUP BY feature, id),
c AS (SELECT a.feature, a.id, count(*) FILTER (abs(a.x - b.x) < k.r) AS nx, count(*) FILTER (abs(a.y - b.y) < k.r) AS ny FROM s a JOIN k USING (feature, id) JOIN s b ON a.feature = b.feature GROUP BY ALL),
m AS (SELECT feature, count(*) AS n, avg(px.psi) + avg(py.psi) AS both_ FROM c JOIN ps px ON px.n = nx JOIN ps py ON py.n = ny GROUP BY feature)
SELECT feature, m.n, round(greatest(0, pn.psi + pk.psi - both_), 6) AS score FROM m JOIN ps pn ON pn.n = m.n JOIN ps pk ON pk.n = 3""")
def d5_knn(t: Tables) -> DataFrame:
    """The estimator by three nearest neighbours; the binned one above stays for tables where bins do."""
    return knn_mutual_information(parts(t), _KNN_FEATURES, "price", "id", discrete=False).select("feature", "n", r("score").alias("score"))


@query("d5_class_information")
def d5_classes(t: Tables) -> DataFrame:
    """Numbers against a class, over all lines; checked against all pairs on a fixture."""
    rows = table(t)
    return knn_mutual_information(rows.withColumn("flag", F.ascii("env").cast("double")), FEATURES, "flag", "key", discrete=True).select("feature", "n", r("score").alias("score"))


@query("d7_task_inference", """
SELECT 'l_linenumber' AS target, CASE WHEN bool_and(abs(l_linenumber - round_even(l_linenumber, 0)) <= 1e-8) AND count(DISTINCT l_linenumber) <= greatest(20, count(*) // 10) THEN 'classification' ELSE 'regression' END AS task, count(DISTINCT l_linenumber) AS y_unique, true AS y_is_integer FROM lineitem
UNION ALL SELECT 'l_discount', CASE WHEN bool_and(l_discount = round_even(l_discount, 0)) THEN 'classification' ELSE 'regression' END, count(DISTINCT l_discount), bool_and(l_discount = round_even(l_discount, 0)) FROM lineitem
UNION ALL SELECT 'l_orderkey', CASE WHEN count(DISTINCT l_orderkey) <= greatest(20, count(*) // 10) THEN 'classification' ELSE 'regression' END, count(DISTINCT l_orderkey), true FROM lineitem
UNION ALL SELECT 'l_returnflag', 'classification', count(DISTINCT l_returnflag), false FROM lineitem""")
def d7(t: Tables) -> DataFrame:
    out = None
    for name, numeric in (("l_linenumber", True), ("l_discount", True), ("l_orderkey", True), ("l_returnflag", False)):
        row = rv.infer_task(t.lineitem, name, numeric).select(F.lit(name).alias("target"), "task", "y_unique", "y_is_integer")
        out = row if out is None else out.unionByName(row)
    return out


@query("d8_meta_features", f"""
WITH {_TAB},
c AS (SELECT abs(corr(x1, x2)) + abs(corr(x1, x3)) + abs(corr(x1, x4)) + abs(corr(x2, x3)) + abs(corr(x2, x4)) + abs(corr(x3, x4)) AS s, count(*) AS n FROM filled)
SELECT count(*) AS n_samples, 4::BIGINT AS n_features, round(4 / count(*), 9) AS p_over_n,
       round(count(*) FILTER (WHERE x3 IS NULL) / (4 * count(*)), 6) AS missing_rate,
       round((count(*) FILTER (WHERE x3 IS NULL) + count(*) FILTER (WHERE x2 = 0)) / (4 * count(*)), 6) AS sparsity_rate,
       count(DISTINCT y) AS y_unique, 'regression' AS task, round(any_value(s) * any_value(n) / (any_value(n) - 1) * 2 / 12, 6) AS mean_abs_corr
FROM tab, c""")
def d8(t: Tables) -> DataFrame:
    return rv.meta_features(table(t), FEATURES, "y").select(
        "n_samples", "n_features", r("p_over_n", 9).alias("p_over_n"), r("missing_rate").alias("missing_rate"),
        r("sparsity_rate").alias("sparsity_rate"), "y_unique", "task", r("mean_abs_corr").alias("mean_abs_corr"))


def _folded(t: Tables, folds: int) -> DataFrame:
    return table(t).withColumn("x3", F.coalesce("x3", F.lit(0.0))).withColumn("fold", rv.hash_fold("9", F.col("key"), folds))


@query("d9_selection_evaluation", f"""
WITH {_TAB},
f AS (SELECT *, coalesce(x3, 0) AS z3, CAST('0x' || substr(md5('9|' || key), 1, 8) AS BIGINT) % 5 AS fold FROM tab),
gm AS (SELECT avg(x1) a1, avg(x2) a2, avg(z3) a3, avg(x4) a4, avg(y) ay FROM f),
c AS (SELECT fold, x1 - a1 AS x1, x2 - a2 AS x2, z3 - a3 AS x3, x4 - a4 AS x4, y - ay AS y FROM f, gm),
tr AS (SELECT k.fold AS k, c.* FROM c, (SELECT unnest(generate_series(0, 4)) AS fold) k WHERE c.fold <> k.fold),
sc AS (SELECT k, 'x1' AS feat, abs(corr(x1, y)) AS s, covar_pop(x1, y) AS cxy, avg(x1) AS mx, var_pop(x1) AS vx, count(*) AS n, avg(y) AS my, covar_pop(x1, x4) AS with_x4 FROM tr GROUP BY k
       UNION ALL SELECT k, 'x2', abs(corr(x2, y)), covar_pop(x2, y), avg(x2), var_pop(x2), count(*), avg(y), covar_pop(x2, x4) FROM tr GROUP BY k
       UNION ALL SELECT k, 'x3', abs(corr(x3, y)), covar_pop(x3, y), avg(x3), var_pop(x3), count(*), avg(y), covar_pop(x3, x4) FROM tr GROUP BY k
       UNION ALL SELECT k, 'x4', abs(corr(x4, y)), covar_pop(x4, y), avg(x4), var_pop(x4), count(*), avg(y), covar_pop(x4, x4) FROM tr GROUP BY k),
top AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, feat) AS rn FROM sc),
two AS (SELECT a.k, a.feat AS fa, b.feat AS fb, a.n, a.vx * a.n + 1 AS saa, b.vx * b.n + 1 AS sbb, b.with_x4 * a.n AS sab,
               a.cxy * a.n AS say, b.cxy * b.n AS sby, a.mx AS ma, b.mx AS mb, a.my AS my FROM top a JOIN top b USING (k) WHERE a.rn = 1 AND b.rn = 2),
co AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM two),
te AS (SELECT k, y, my + ba * ((CASE fa WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 WHEN 'x3' THEN x3 ELSE x4 END) - ma)
              + bb * ((CASE fb WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 WHEN 'x3' THEN x3 ELSE x4 END) - mb) AS pred FROM c JOIN co ON c.fold = co.k),
r2 AS (SELECT k, 1 - sum(power(y - pred, 2)) / (var_pop(y) * count(*)) AS score FROM te GROUP BY k),
jac AS (SELECT avg(len(list_intersect([a.fa, a.fb], [b.fa, b.fb])) / len(list_distinct([a.fa, a.fb, b.fa, b.fb]))) AS s FROM two a JOIN two b ON a.k < b.k)
SELECT round(avg(score), 6) AS cv_score_mean, round(stddev_pop(score), 6) AS cv_score_std, round(any_value(s), 6) AS stability_jaccard FROM r2, jac""")
def d9(t: Tables) -> DataFrame:
    per_fold = t.once("folds", lambda: rv.evaluate_folds(rv.fold_moments(_folded(t, 5), "fold", FEATURES, "y"), FEATURES, "y", 2))
    return rv.fold_summary(per_fold).select(*[r(c).alias(c) for c in ("cv_score_mean", "cv_score_std", "stability_jaccard")])


@query("d10_grouped_recommendation")
def d10(t: Tables) -> DataFrame:
    """Relevance methods compared on group folds; objective = score + 0.1 * stability."""
    rows = table(t).withColumn("x3", F.coalesce("x3", F.lit(0.0)))
    folds = t.once("gf", lambda: rv.group_folds(rows, "grp", 3))
    # Read seven times: stored with the columns that count.
    data = stored(sized_join(rows, folds, "grp").select("fold", *FEATURES, "y"))
    moments = t.once("moments", lambda: rv.fold_moments(data, "fold", FEATURES, "y"))
    out = rv.evaluate_folds(moments, FEATURES, "y", 2, metric="neg_mse").withColumn("method", F.lit("pearson_abs"))
    # Every row trains all folds but its own; one keyed pass scores all of them.
    train = data.withColumn("k", F.explode(F.array_except(F.array(*[F.lit(i) for i in range(3)]), F.array("fold"))))
    for name, scores in (("spearman_abs", rv.spearman_abs(train, FEATURES, "y", by=["k"])),
                         ("mutual_info", rv.binned_mutual_information(train, FEATURES, "y", by=["k"]))):
        ev = rv.evaluate_folds(moments, FEATURES, "y", 2, scores.withColumnRenamed("k", "fold"), metric="neg_mse")
        out = out.unionByName(ev.withColumn("method", F.lit(name)))
    summary = rv.fold_summary(t.once("per", lambda: out), ["method"])
    j = F.col("cv_score_mean") + 0.1 * F.col("stability_jaccard")
    return summary.select("method", r("cv_score_mean", 2).alias("cv_score_mean"), r("stability_jaccard").alias("stability_jaccard"),
                          r(j, 2).alias("objective"))


@query("d10_group_folds")
def d10_folds(t: Tables) -> DataFrame:
    rows = observations(t)
    return rows.join(rv.group_folds(rows, "grp", 3), "grp").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"))


def experience(t: Tables) -> DataFrame:
    """One experience record per (supplier, return flag); method scores read off line averages."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"), F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))

    def ev(cv, st, rt):
        return F.struct(cv.alias("cv_score_mean"), st.alias("stability_jaccard"), rt.alias("runtime_sec"))

    dropped = F.col("s") % 11 == 0
    return g.select(
        F.concat(F.lit("d"), F.col("s")).alias("dataset_id"),
        F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("q"), F.when(F.col("s") % 7 == 0, float("nan")).otherwise(F.col("q"))).alias("meta_features"),
        F.when(F.col("f") == "A", F.create_map(F.lit("slope"), F.col("d") * 100)).alias("trajectory_features"),
        F.create_map(F.lit("flag"), F.when(F.col("s") % 6 != 0, F.col("f")), F.lit("n"), F.lit("many"), F.lit("size"), F.when(F.col("n") > 12, "large").otherwise("small")).alias("text_features"),
        F.ascii("f").alias("record_no"),
        F.when(dropped, F.create_map(F.lit("perm"), ev(F.col("d"), F.lit(0.5), F.lit(1.0)))).otherwise(F.create_map(
            F.lit("Mutual_Info_binned"), ev(F.col("d") * 10, F.col("x") * 10, F.lit(0.5)),
            F.lit("dcor"), ev(F.col("x") * 12, F.lit(None).cast("double"), F.col("q") / 25),
            F.lit("pearson_abs"), ev(F.when(F.col("s") % 5 == 0, float("nan")).otherwise(F.col("d") * 9), F.lit(0.9), F.lit(None).cast("double")),
            F.lit(""), ev(F.lit(9.0), F.lit(1.0), F.lit(0.0)))).alias("evaluations"), F.col("f").alias("flag"))


_EXP = """
g AS (SELECT l_suppkey AS s, l_returnflag AS f, avg(l_discount) AS d, avg(l_tax) AS x, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
ev AS (
  SELECT s, f, 'permutation_importance' AS method, d AS cv, 0.5 AS st, 1.0 AS rt FROM g WHERE s % 11 = 0
  UNION ALL SELECT s, f, 'mutual_info', d * 10, x * 10, 0.5 FROM g WHERE s % 11 <> 0
  UNION ALL SELECT s, f, 'distance_correlation', x * 12, NULL, q / 25 FROM g WHERE s % 11 <> 0
  UNION ALL SELECT s, f, 'pearson_abs', CASE WHEN s % 5 <> 0 THEN d * 9 END, 0.9, NULL FROM g WHERE s % 11 <> 0),
evj AS (SELECT 'd' || s AS dataset_id, f, method, cv, st, coalesce(rt, 0) AS rt, CASE WHEN cv IS NOT NULL THEN cv + 0.1 * coalesce(st, 0) - 0.15 * ln(1 + greatest(coalesce(rt, 0), 0)) END AS j FROM ev),
per AS (SELECT dataset_id, method, avg(rt) AS runtime_sec, avg(cv) AS cv, avg(j) AS j, avg(st) AS stability FROM evj WHERE j IS NOT NULL GROUP BY 1, 2),
lab AS (SELECT dataset_id, count(*) AS n_methods, arg_min(method, (-j, method)) AS label FROM per GROUP BY 1 HAVING count(*) >= 2)"""


@query("b8_feature_flattening", """
WITH g AS (SELECT l_suppkey AS s, l_returnflag AS f, avg(l_discount) AS d, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'd' || s AS dataset_id, f AS flag, 'n' AS feature, round(CAST(n AS DOUBLE), 9) AS value FROM g
UNION ALL SELECT 'd' || s, f, 'q', CASE WHEN s % 7 <> 0 THEN round(q, 9) END FROM g
UNION ALL SELECT 'd' || s, f, 'traj__slope', round(d * 100, 9) FROM g WHERE f = 'A'""")
def b8(t: Tables) -> DataFrame:
    flat = experience(t).select("dataset_id", "flag", F.explode(rv.flatten_features(F.col("meta_features"), F.col("trajectory_features"))).alias("feature", "value"))
    return flat.withColumn("value", F.when(~F.isnan("value"), r("value", 9)))


@query("b9_method_normalisation", f"""
WITH {_EXP} SELECT method, count(*) AS n FROM ev GROUP BY 1""")
def b9(t: Tables) -> DataFrame:
    return experience(t).select(F.explode("evaluations").alias("raw", "e")).select(
        rv.normalize_method(F.col("raw")).alias("method")).filter("method is not null").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("b10_objective", f"""
WITH {_EXP} SELECT dataset_id, f AS flag, method, CASE WHEN j IS NOT NULL THEN round(j, 9) END AS j FROM evj""")
def b10(t: Tables) -> DataFrame:
    ev = experience(t).select("dataset_id", "flag", F.explode("evaluations").alias("raw", "e")).withColumn("method", rv.normalize_method(F.col("raw")))
    j = rv.objective_j(F.col("e.cv_score_mean"), F.col("e.stability_jaccard"), F.col("e.runtime_sec"))
    return ev.filter("method is not null").select("dataset_id", "flag", "method", F.when(j > float("-inf"), r(j, 9)).alias("j"))


@query("d11_experience_aggregation", f"""
WITH {_EXP}
SELECT dataset_id, method, round(runtime_sec, 9) AS runtime_sec, round(cv, 9) AS cv, round(j, 9) AS j, label FROM per JOIN lab USING (dataset_id)""")
def d11(t: Tables) -> DataFrame:
    _, methods = rv.aggregate_experience(experience(t))
    return methods.select("dataset_id", "method", r("runtime_sec", 9).alias("runtime_sec"), r("cv", 9).alias("cv"), r("j", 9).alias("j"), "label")


@query("d11_feature_aggregation", """
WITH g AS (SELECT l_suppkey AS s, l_returnflag AS f, avg(l_discount) AS d, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
num AS (SELECT s, 'n' AS feature, CAST(n AS DOUBLE) AS x FROM g UNION ALL SELECT s, 'q', q FROM g WHERE s % 7 <> 0 UNION ALL SELECT s, 'traj__slope', d * 100 FROM g WHERE f = 'A'),
txt AS (SELECT s, f, 'flag' AS feature, f AS t FROM g WHERE s % 6 <> 0 UNION ALL SELECT s, f, 'n', 'many' FROM g UNION ALL SELECT s, f, 'size', CASE WHEN n > 12 THEN 'large' ELSE 'small' END FROM g),
a AS (SELECT s, feature, avg(x) AS value FROM num GROUP BY 1, 2),
b AS (SELECT s, feature, arg_min(t, f) AS text FROM txt GROUP BY 1, 2)
SELECT 'd' || coalesce(a.s, b.s) AS dataset_id, coalesce(a.feature, b.feature) AS feature, round(value, 9) AS value, CASE WHEN value IS NULL THEN text END AS text
FROM a FULL JOIN b ON a.s = b.s AND a.feature = b.feature""")
def d11_features(t: Tables) -> DataFrame:
    """Numbers are averaged over a dataset's records; where there are none, the first text stands."""
    return sel.aggregate_features(experience(t)).select("dataset_id", "feature", r("value", 9).alias("value"), "text")


FOLDS = 3
_FOLDS_SQL = f"""
folds AS (SELECT dataset_id, CAST((row_number() OVER (ORDER BY dataset_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM lab)"""


def selector_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(methods per dataset, best method per dataset, dataset folds)."""
    methods = t.once("methods", lambda: rv.aggregate_experience(experience(t))[1])
    labels = methods.select("dataset_id", "label").distinct()
    return methods, labels, t.once("folds", lambda: sel.dataset_folds(labels, FOLDS))


@query("d13_dataset_folds", f"""
WITH {_EXP}, {_FOLDS_SQL} SELECT dataset_id, fold, label FROM folds JOIN lab USING (dataset_id)""")
def d13_folds(t: Tables) -> DataFrame:
    """All records of a dataset share a fold."""
    _, labels, folds = selector_parts(t)
    return labels.join(folds, "dataset_id").select("dataset_id", "fold", "label")


def _ranks(t: Tables) -> DataFrame:
    _, labels, folds = selector_parts(t)
    return t.once("ranks", lambda: sel.held_out_ranks(sel.aggregate_features(experience(t)), labels, folds, 3, trees=16))


@query("d12_meta_selector")
def d12(t: Tables) -> DataFrame:
    """Each dataset ranked by a forest that learnt from the other folds, and how many methods are worth running."""
    pred = _ranks(t)
    return pred.join(rv.low_runtime_choice(pred), "dataset_id").select(
        "dataset_id", "fold", "position", "method", r("probability").alias("probability"), F.size("methods").alias("methods_to_run"))


def _report_columns(rep: DataFrame) -> DataFrame:
    return rep.select("fold", "datasets", *[r(c).alias(c) for c in rep.columns if c not in ("fold", "datasets")])


@query("d13_forest_report")
def d13_forest(t: Tables) -> DataFrame:
    """The report of the forests' held-out ranks."""
    return _report_columns(rv.selector_report(_ranks(t), selector_parts(t)[0], 2))


_PRIOR_SQL = f"""
WITH {_EXP}, {_FOLDS_SQL},
known AS (SELECT dataset_id, fold, label FROM folds JOIN lab USING (dataset_id)),
freq AS (SELECT k.fold, o.label AS method, count(*) AS n FROM (SELECT DISTINCT fold FROM known) k JOIN known o ON o.fold <> k.fold GROUP BY ALL),
pred AS (SELECT dataset_id, fold, method, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, method) AS position FROM known JOIN freq USING (fold)),
m AS (SELECT * FROM per JOIN lab USING (dataset_id)),
truth AS (SELECT dataset_id, any_value(label) AS label, max(cv) AS bcv, max(j) AS bj, sum(runtime_sec) AS tf FROM m GROUP BY 1),
pp AS (SELECT fold, p.dataset_id, max(p.method) FILTER (WHERE position = 1) AS f1, list(p.method) AS offered, max(cv) FILTER (WHERE position = 1) AS cv1,
              max(j) FILTER (WHERE position = 1) AS j1, max(j) AS jn, coalesce(sum(runtime_sec) FILTER (WHERE position = 1), 0) AS t1, coalesce(sum(runtime_sec), 0) AS tn
       FROM pred p LEFT JOIN m ON m.dataset_id = p.dataset_id AND m.method = p.method WHERE position <= 2 GROUP BY 1, 2),
rep AS (SELECT fold, count(*) AS datasets, avg(CASE WHEN f1 = label THEN 1.0 ELSE 0 END) AS top1_accuracy, avg(CASE WHEN list_contains(offered, label) THEN 1.0 ELSE 0 END) AS topn_hit,
       avg(bcv - cv1) AS regret_cv, avg(bj - j1) AS regret_j, avg(bj - jn) AS regret_j_topn, sum(t1) / sum(tf) AS time_ratio_top1, sum(tn) / sum(tf) AS time_ratio_topn
FROM pp JOIN truth USING (dataset_id) GROUP BY fold)"""
_MEASURES = ["top1_accuracy", "topn_hit", "regret_cv", "regret_j", "regret_j_topn", "time_ratio_top1", "time_ratio_topn"]


@query("d13_selector_report", f"{_PRIOR_SQL} SELECT fold, datasets, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)} FROM rep")
def d13(t: Tables) -> DataFrame:
    """The report of a selector that knows how often each method was best in the other folds: what a forest has to beat."""
    methods, labels, folds = selector_parts(t)
    return _report_columns(rv.selector_report(sel.prior_ranks(labels, folds, 2), methods, 2))


@query("d13_selector_summary", f"{_PRIOR_SQL} SELECT count(*) AS folds, CAST(sum(datasets) AS BIGINT) AS datasets, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _MEASURES)} FROM rep")
def d13_summary(t: Tables) -> DataFrame:
    methods, labels, folds = selector_parts(t)
    got = sel.selector_summary(rv.selector_report(sel.prior_ranks(labels, folds, 2), methods, 2))
    return got.select("folds", "datasets", *[r(c).alias(c) for c in _MEASURES])


@query("d10_recommendation", f"""
WITH {_EXP},
ds AS (SELECT dataset_id, label, 's' || (CAST(substr(dataset_id, 2) AS BIGINT) % 4) AS source_hash FROM lab),
hist AS (SELECT DISTINCT ds.dataset_id, source_hash FROM g JOIN ds ON ds.dataset_id = 'd' || s WHERE f <> 'R' AND label IN ('pearson_abs', 'spearman_abs', 'mutual_info')),
c AS (SELECT t.dataset_id, count(h.dataset_id) AS n FROM ds t LEFT JOIN hist h ON h.dataset_id <> t.dataset_id AND h.source_hash <> t.source_hash GROUP BY 1),
o AS (SELECT dataset_id, method, avg(cv + 0.1 * coalesce(st, 0)) AS objective FROM evj WHERE j IS NOT NULL AND method IN ('pearson_abs', 'spearman_abs', 'mutual_info') GROUP BY 1, 2),
b AS (SELECT dataset_id, arg_min(method, (-objective, list_position(['pearson_abs', 'spearman_abs', 'mutual_info'], method))) AS best, max(objective) AS objective FROM o GROUP BY 1)
SELECT dataset_id, best AS measured_best_method, round(objective, 9) AS objective, n AS historical_datasets,
  CASE WHEN n >= 3 THEN 'historical_meta_selector' ELSE 'cold_start_grouped_cv' END AS mode FROM b JOIN c USING (dataset_id)""")
def d10_recommendation(t: Tables) -> DataFrame:
    """For every dataset: the best method measured on it, and whether the others' history suffices to learn from."""
    records, (_, labels, _) = experience(t), selector_parts(t)
    source = F.concat(F.lit("s"), F.expr("cast(substring(dataset_id, 2) as bigint) % 4"))
    history = records.join(labels, "dataset_id").select("dataset_id", source.alias("source_hash"), F.when(F.col("flag") == "R", "V").otherwise("E").alias("evidence_purpose"), F.col("label").alias("selected_method"))
    counts = rec.history_counts(history, labels.select("dataset_id", source.alias("source_hash")))
    ev = records.select("dataset_id", F.explode("evaluations").alias("raw", "e")).withColumn("method", rv.normalize_method(F.col("raw"))).filter("method is not null and not isnan(e.cv_score_mean)")
    objective = F.avg(F.col("e.cv_score_mean") + 0.1 * F.coalesce("e.stability_jaccard", F.lit(0.0)))
    best = rec.measured_best(ev.groupBy("dataset_id", "method").agg(objective.alias("objective")), ["dataset_id"])
    mode = F.when(F.col("historical_datasets") >= rec.LEAST_DATASETS, "historical_meta_selector").otherwise("cold_start_grouped_cv")
    return best.join(counts, "dataset_id").select("dataset_id", "measured_best_method", r("objective", 9).alias("objective"), "historical_datasets", mode.alias("mode"))


@query("e19_best_method", f"""
WITH {_EXP}
SELECT dataset_id, arg_min(method, (-j, -cv, -coalesce(stability, 0), runtime_sec, method)) AS method, round(max(j), 9) AS j FROM per GROUP BY 1""")
def e19(t: Tables) -> DataFrame:
    ev = experience(t).select("dataset_id", F.explode("evaluations").alias("raw", "e")).withColumn("method", rv.normalize_method(F.col("raw")))
    ev = ev.filter("method is not null").withColumn("j", rv.objective_j(F.col("e.cv_score_mean"), F.col("e.stability_jaccard"), F.col("e.runtime_sec")))
    per = ev.filter(F.col("j") > float("-inf")).groupBy("dataset_id", "method").agg(
        F.avg(F.coalesce("e.runtime_sec", F.lit(0.0))).alias("runtime_sec"), F.avg("e.cv_score_mean").alias("cv"),
        F.avg("j").alias("j"), F.coalesce(F.avg("e.stability_jaccard"), F.lit(0.0)).alias("stability"))
    return rv.best_method(per, "dataset_id").select("dataset_id", "method", r("j", 9).alias("j"))


@query("e20_feature_top_k", f"""
WITH {_TAB}, l AS (SELECT grp, y, 1 AS position, x1 AS x FROM obs0 UNION ALL SELECT grp, y, 2, x2 FROM obs0 UNION ALL SELECT grp, y, 3, x3 FROM obs0 UNION ALL SELECT grp, y, 4, x4 FROM obs0),
s AS (SELECT grp, position, abs(corr(x, y)) AS score FROM l GROUP BY 1, 2)
SELECT grp, 'x' || position AS feature, row_number() OVER (PARTITION BY grp ORDER BY score DESC, position) AS rn FROM s QUALIFY rn <= 2""")
def e20(t: Tables) -> DataFrame:
    scores = rv.pearson_abs(observations(t), FEATURES, "y", ["grp"]).withColumn("position", F.expr("cast(substring(feature, 2) as int)"))
    return rv.feature_top_k(scores, ["grp"], 2).select("grp", "feature", F.col("rn").cast("long").alias("rn"))


@query("c11_distance_correlation", """
WITH l AS (SELECT 'l_discount' AS feature, l_discount AS x, l_quantity AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_quantity FROM lineitem
           UNION ALL SELECT 'l_linenumber', l_linenumber, l_quantity FROM lineitem),
p AS (SELECT feature, x, y, CAST(count(*) AS DOUBLE) AS w FROM l GROUP BY ALL),
n AS (SELECT feature, sum(w) AS n FROM p GROUP BY 1),
d AS (SELECT a.feature, a.x, a.y, a.w, sum(b.w * abs(a.x - b.x)) AS ax, sum(b.w * abs(a.y - b.y)) AS ay,
             sum(b.w * abs(a.x - b.x) * abs(a.y - b.y)) AS xy, sum(b.w * power(a.x - b.x, 2)) AS xx, sum(b.w * power(a.y - b.y, 2)) AS yy
      FROM p a JOIN p b USING (feature) GROUP BY ALL),
s AS (SELECT feature, any_value(n.n) AS n, sum(w * xy) AS xy, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * ax * ay) AS t3, sum(w * ax * ax) AS tx, sum(w * ay * ay) AS ty, sum(w * ax) AS a, sum(w * ay) AS b
      FROM d JOIN n USING (feature) GROUP BY feature),
q AS (SELECT feature, n, sqrt(greatest(0, xy / n^2 + a * b / n^4 - 2 * t3 / n^3)) AS dxy, sqrt(greatest(0, xx / n^2 + a * a / n^4 - 2 * tx / n^3)) AS dxx, sqrt(greatest(0, yy / n^2 + b * b / n^4 - 2 * ty / n^3)) AS dyy FROM s)
SELECT feature, CAST(n AS BIGINT) AS n, round(dxy / sqrt((dxx + 1e-12) * (dyy + 1e-12)), 6) AS score FROM q""")
def c11(t: Tables) -> DataFrame:
    return rv.distance_correlation(t.lineitem, ["l_discount", "l_tax", "l_linenumber"], "l_quantity").withColumn("score", r("score"))


@query("c11_distance_correlation_continuous")
def c11_continuous(t: Tables) -> DataFrame:
    """Near-unique values, where a pair table would be quadratic; checked on a fixture."""
    return rv.distance_correlation(t.lineitem, ["l_extendedprice"], "l_quantity").withColumn("score", r("score"))


@query("b11_first_appearance_codes", """
WITH f AS (SELECT p_name, min(p_partkey) AS first FROM part WHERE p_size % 10 <> 0 GROUP BY 1),
k AS (SELECT p_name, row_number() OVER (ORDER BY first, p_name) - 1 AS code FROM f)
SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN k.code ELSE -1 END AS code FROM part LEFT JOIN k USING (p_name)""")
def b11(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("name"))
    return rv.encode_by_first_appearance(rows, "name", "p_partkey", "code").select("p_partkey", "code")


@query("b12_rare_class_drop", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""")
def b12(t: Tables) -> DataFrame:
    return rv.drop_rare_classes(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("b13_dataset_candidates", """
WITH q AS (SELECT l_partkey AS d, count(*) AS n, count(DISTINCT l_suppkey) AS f FROM lineitem GROUP BY 1)
SELECT 'p' || d AS dataset_id FROM q WHERE (n BETWEEN 25 AND 35 OR n <= 0) AND (f BETWEEN 5 AND 28 OR f <= 0 OR d % 9 = 0)
ORDER BY md5('4|p' || d), 1 LIMIT 60""")
def b13(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("l_suppkey").cast("double").alias("f"))
    pairs = F.array(F.struct(F.lit("NumberOfInstances").alias("name"), F.col("n").alias("value")),
                    F.struct(F.lit("NumberOfFeatures").alias("name"), F.when(F.col("l_partkey") % 9 != 0, F.col("f")).alias("value")))
    cat = q.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("dataset_id"), pairs.alias("qualities"))
    return rv.dataset_candidates(cat, {"NumberOfInstances": (25, 35), "NumberOfFeatures": (5, 28)}, 20, 3, "4")
