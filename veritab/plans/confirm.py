"""Relations from fit to family-wise decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import relations as rel
from veritab.operators import testing as tst
from veritab.operators.split import assign_purposes, split_by_time, stratified_split, dataset_holdout
from veritab.plans.common import (
    ALLOCATION, CANDIDATES, FEATURES, FIT_CTE, OBS_CTE, SEED, SIGN_CTE, SPLIT_CTE, candidate_rows, observations, r,
    split_observations,
)
from veritab.plans.registry import Tables, query

ALPHA, ROUND = 0.05, 1


def _part(t: Tables, name: str) -> DataFrame:
    return split_observations(t).filter(F.col("purpose") == name)


def _fits(t: Tables) -> DataFrame:
    """Frozen parameters: one row per candidate, written once."""
    return t.once("fits", lambda: rel.fit_relations(_part(t, "E"), CANDIDATES, FEATURES, "y"))


def _baseline(t: Tables) -> DataFrame:
    return t.once("baseline", lambda: _part(t, "E").groupBy().agg(F.avg("y")))


def _diffs(t: Tables) -> DataFrame:
    return rel.group_differences(_part(t, "C1"), _fits(t), CANDIDATES, "y", "grp", _baseline(t))


def _tests(t: Tables) -> DataFrame:
    return t.once("tests", lambda: rel.sign_test(_diffs(t), 0.0, 2))


def _family(t: Tables) -> DataFrame:
    adjusted = tst.holm_adjust(_tests(t).withColumnRenamed("cand", "test_id"), [])
    return tst.holm_thresholds(adjusted, tst.alpha_for_round(ALPHA, ROUND))


_HOLM_CTE = SIGN_CTE + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY p_value, cand) AS rank, count(*) OVER () AS m
  FROM tests WHERE p_value IS NOT NULL),
adj AS (
  SELECT cand, rank, m, m - rank + 1 AS factor,
         max(least(1.0, p_value * (m - rank + 1))) OVER (ORDER BY rank) AS adjusted FROM ranked),
family AS (
  SELECT tests.*, rank, m, factor, adjusted, 0.025 / factor AS threshold,
         coalesce(p_value <= 0.025 / factor, false) AS significant,
         coalesce(adjusted <= 0.025, false) AS holm_reject,
         CASE WHEN p_value IS NULL THEN 'failed'
              WHEN NOT coalesce(p_value <= 0.025 / factor, false) THEN 'inconclusive'
              WHEN effect IS NULL OR effect = 0 THEN 'inconclusive'
              WHEN effect > 0 THEN 'supported' ELSE 'refuted' END AS status
  FROM tests LEFT JOIN adj USING (cand))"""


def _decided(t: Tables) -> DataFrame:
    return _family(t).withColumn(
        "status", tst.classify(F.col("p_value"), F.col("significant"), F.col("effect"), F.lit(1.0)))


@query("d19_confirmed_relations", f"""
WITH {_HOLM_CTE}
SELECT cand AS test_id, unit_count, CAST(sample_size AS BIGINT) AS sample_size, wins, round(effect, 2) AS effect,
       round(p_value, 9) AS p_value, round(adjusted, 9) AS adjusted, significant, holm_reject, status FROM family""")
def confirmed_relations(t: Tables) -> DataFrame:
    """Flagship: fit on E, test frozen relations on unseen groups of C1, decide by family."""
    return _decided(t).select(
        "test_id", "unit_count", "sample_size", "wins", r("effect", 2).alias("effect"),
        r("p_value", 9).alias("p_value"), r("adjusted", 9).alias("adjusted"), "significant", "holm_reject", "status")


@query("f1_grouped_split", f"""
WITH {SPLIT_CTE}
SELECT purpose, count(*) AS n, count(DISTINCT grp) AS groups, round(sum(y), 2) AS total FROM obs GROUP BY purpose""")
def f1(t: Tables) -> DataFrame:
    return split_observations(t).groupBy("purpose").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"), r(F.sum("y"), 2).alias("total"))


@query("f1_group_assignment", f"WITH {SPLIT_CTE} SELECT grp, purpose FROM parts")
def f1_groups(t: Tables) -> DataFrame:
    return assign_purposes(observations(t), "grp", SEED, ALLOCATION)


@query("f2_temporal_split", """
WITH p AS (
  SELECT l_orderkey, epoch(l_shipdate) AS t, epoch(l_shipdate) + 86400 * 20 AS avail,
    CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'E' WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'V'
         WHEN l_shipdate < TIMESTAMP '2001-01-01' THEN 'C1' ELSE 'Q' END AS part,
    CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN epoch(TIMESTAMP '1997-01-01') - 864000
         WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN epoch(TIMESTAMP '1999-01-01') - 864000
         WHEN l_shipdate < TIMESTAMP '2001-01-01' THEN epoch(TIMESTAMP '2001-01-01') END AS cut
  FROM lineitem),
q AS (
  SELECT CASE WHEN part = 'Q' OR t >= cut THEN 'Q' ELSE part END AS purpose,
         CASE WHEN part = 'Q' OR t >= cut THEN 'excluded' WHEN avail >= cut THEN 'quarantined' ELSE 'usable' END AS status,
         CASE WHEN part = 'Q' THEN 'outside_temporal_window' WHEN t >= cut THEN 'temporal_gap'
              WHEN avail >= cut THEN 'availability_after_partition_cutoff:price' ELSE '' END AS reason
  FROM p)
SELECT purpose, status, reason, count(*) AS n FROM q GROUP BY ALL""")
def f2(t: Tables) -> DataFrame:
    rows = observations(t).withColumn("avail", F.col("event_time") + F.expr("interval 20 days"))
    cut = split_by_time(
        rows, "event_time", [("E", "1997-01-01"), ("V", "1999-01-01"), ("C1", "2001-01-01")], 864000,
        {"price": "avail"})
    return cut.groupBy("purpose", "status", F.array_join("reasons", ",").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b6_domain_counts", f"""
WITH {SPLIT_CTE}
SELECT cand, count(*) AS input_rows, count(z) AS kept, count(*) FILTER (WHERE NOT in_domain) AS domain_out,
       count(*) FILTER (WHERE in_domain AND z IS NULL) AS nonfinite
FROM ({candidate_rows("obs", "WHERE purpose = 'E'")}) GROUP BY cand""")
def b6(t: Tables) -> DataFrame:
    return rel.domain_counts(_part(t, "E"), CANDIDATES)


@query("b7_candidate_values", f"""
WITH {OBS_CTE}
SELECT cand, env, count(z) AS n, round(avg(z), 6) AS mean_z, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z
FROM ({candidate_rows("obs0")}) GROUP BY cand, env""")
def b7(t: Tables) -> DataFrame:
    from veritab.functions.exprs import explode_candidates
    return explode_candidates(observations(t), CANDIDATES).groupBy("cand", "env").agg(
        F.count("z").alias("n"), r(F.avg("z")).alias("mean_z"), r(F.min("z")).alias("min_z"), r(F.max("z")).alias("max_z"))


_FIT_COLS = """cand, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(mse, 2) AS mse,
  round(constant_mse, 2) AS constant_mse, round(1 - mse / constant_mse, 6) AS r2,
  CASE least(m1, m2, m3, m4) WHEN m1 THEN 'x1' WHEN m2 THEN 'x2' WHEN m3 THEN 'x3' ELSE 'x4' END AS best_feature,
  round(least(m1, m2, m3, m4), 2) AS best_feature_mse"""


@query("d15_relation_fit", f"WITH {FIT_CTE} SELECT {_FIT_COLS}, 'ok' AS status FROM fit")
def d15(t: Tables) -> DataFrame:
    return _fits(t).select(
        "cand", "n", r("slope").alias("slope"), r("intercept", 4).alias("intercept"), r("mse", 2).alias("mse"),
        r("constant_mse", 2).alias("constant_mse"), r("r2").alias("r2"), "best_feature",
        r("best_feature_mse", 2).alias("best_feature_mse"), "status")


@query("d16_gain_vs_baseline", f"""
WITH {FIT_CTE},
h AS (SELECT cand, n, mse, least(constant_mse, m1, m2, m3, m4) AS b, constant_mse, m1, m2, m3, m4 FROM fit)
SELECT cand, n, round(mse, 2) AS mse, round(b, 2) AS baseline_mse,
       CASE b WHEN constant_mse THEN 'constant' WHEN m1 THEN 'linear:x1' WHEN m2 THEN 'linear:x2'
              WHEN m3 THEN 'linear:x3' ELSE 'linear:x4' END AS baseline,
       round(b - mse, 2) AS difference, round((b - mse) / b, 6) AS relative FROM h""")
def d16(t: Tables) -> DataFrame:
    return rel.gains(_fits(t)).select(
        "cand", "n", r("mse", 2).alias("mse"), r("baseline_mse", 2).alias("baseline_mse"), "baseline",
        r("difference", 2).alias("difference"), r("relative").alias("relative"))


@query("d14_residual_summary", f"""
WITH {FIT_CTE},
p AS (SELECT cand, y, y - (intercept + slope * z) AS e FROM ez JOIN fit USING (cand))
SELECT cand, count(*) AS n, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
       round(max(abs(e)), 4) AS max_abs, round(stddev_pop(e), 4) AS residual_std,
       round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, true AS r2_defined
FROM p GROUP BY cand""")
def d14(t: Tables) -> DataFrame:
    scored = rel.predict(_part(t, "E"), _fits(t), CANDIDATES).filter(F.col("z").isNotNull())
    return rel.residual_summary(scored, ["cand"], "y", "pred").select(
        "cand", "n", r("mse", 2).alias("mse"), r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"),
        r("max_abs", 4).alias("max_abs"), r("residual_std", 4).alias("residual_std"), r("r2").alias("r2"), "r2_defined")


@query("d21_validation_gate", f"""
WITH {FIT_CTE},
v AS (SELECT cand, power(y - (intercept + slope * z), 2) AS l, power(y - mu, 2) AS b
      FROM ({candidate_rows("obs", "WHERE purpose = 'V'")}) JOIN fit USING (cand), base)
SELECT cand, count(*) AS n, count(*) FILTER (WHERE l IS NULL) AS undefined_rows,
       CASE WHEN count(*) = count(l) THEN round(avg(l), 2) END AS mse, round(avg(b), 2) AS constant_mse,
       count(*) = count(l) AND avg(l) < avg(b) AS passed FROM v GROUP BY cand""")
def d21(t: Tables) -> DataFrame:
    return rel.validation_gate(_part(t, "V"), _fits(t), CANDIDATES, "y", _baseline(t)).select(
        "cand", "n", "undefined_rows", r("mse", 2).alias("mse"), r("constant_mse", 2).alias("constant_mse"), "passed")


@query("d18_group_loss_difference", f"""
WITH {SIGN_CTE}
SELECT cand, grp, round(diff, 2) AS diff, undefined_rows, n FROM diffs""")
def d18(t: Tables) -> DataFrame:
    return _diffs(t).select("cand", "grp", r("diff", 2).alias("diff"), "undefined_rows", "n")


@query("d19_group_sign_test", f"""
WITH {SIGN_CTE}
SELECT cand, unit_count, CAST(sample_size AS BIGINT) AS sample_size, wins, round(effect, 2) AS effect,
       round(p_value, 9) AS p_value FROM tests""")
def d19(t: Tables) -> DataFrame:
    return _tests(t).select("cand", "unit_count", "sample_size", "wins", r("effect", 2).alias("effect"),
                            r("p_value", 9).alias("p_value"))


@query("d20_group_normal_test", f"""
WITH {SIGN_CTE},
s AS (SELECT cand, count(diff) AS n, avg(diff) AS effect, avg(diff) / sqrt(var_samp(diff) / count(diff)) AS t
      FROM diffs GROUP BY cand HAVING var_samp(diff) > 0),
k AS (SELECT unnest(generate_series(0, 4000)) AS i)
SELECT cand, n, round(effect, 2) AS effect, round(any_value(t), 6) AS statistic,
       round(greatest(0, 0.5 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * exp(-power(t * i / 4000, 2) / 2)) * t / 4000 / 3 / sqrt(2 * pi())), 7) AS p_value
FROM s, k GROUP BY cand, n, effect, t""")
def d20(t: Tables) -> DataFrame:
    return rel.normal_test(_diffs(t)).select(
        "cand", "n", r("effect", 2).alias("effect"), r("statistic").alias("statistic"), r("p_value", 7).alias("p_value"))


@query("e3_holm_adjust", f"""
WITH {_HOLM_CTE}
SELECT cand AS test_id, rank, m, factor, round(p_value, 9) AS p_value, round(adjusted, 9) AS adjusted FROM family""")
def e3(t: Tables) -> DataFrame:
    return _family(t).select("test_id", "rank", "m", "factor", r("p_value", 9).alias("p_value"), r("adjusted", 9).alias("adjusted"))


@query("e4_alpha_threshold", f"""
WITH {_HOLM_CTE}
SELECT cand AS test_id, round(threshold, 9) AS threshold, significant, holm_reject FROM family""")
def e4(t: Tables) -> DataFrame:
    return _family(t).select("test_id", r("threshold", 9).alias("threshold"), "significant", "holm_reject")


@query("e5_result_classification", f"WITH {_HOLM_CTE} SELECT cand AS test_id, status FROM family")
def e5(t: Tables) -> DataFrame:
    return _decided(t).select("test_id", "status")


@query("d31_aggregate_status", f"""
WITH {_HOLM_CTE}
SELECT left(cand, 1) AS hyp, CASE WHEN bool_and(status = 'failed') THEN 'failed'
  WHEN bool_or(status = 'supported') AND NOT bool_or(status = 'refuted') THEN 'supported'
  WHEN bool_or(status = 'refuted') AND NOT bool_or(status = 'supported') THEN 'refuted'
  ELSE 'inconclusive' END AS status FROM family GROUP BY left(cand, 1)""")
def d31(t: Tables) -> DataFrame:
    return _decided(t).groupBy(F.left("test_id", F.lit(1)).alias("hyp")).agg(
        tst.aggregate_status(F.col("status")).alias("status"))


@query("d32_family_summary", f"""
WITH {_HOLM_CTE}
SELECT count(*) AS tests, count(p_value) AS available, count(*) FILTER (WHERE significant) AS significant,
       count(threshold) AS thresholds, count(*) = count(p_value) AS complete FROM family""")
def d32(t: Tables) -> DataFrame:
    return tst.summarize_family(_family(t), [])


# Per-supplier metric tests: hypothesis = supplier, metric = return flag, a normal
# score of the mean discount against the overall mean plays the p-value.
_SUPPLIER_TESTS = """
mt AS (
  SELECT l_suppkey AS hyp, l_returnflag AS metric, count(*) AS n, avg(l_discount) AS m, var_samp(l_discount) AS v
  FROM lineitem GROUP BY 1, 2),
mtests AS (
  SELECT hyp, metric, exp(-abs(m - 0.05) * sqrt(n) * 10) AS p_value, m - 0.05 AS effect,
         exp(-abs(m - 0.05) * sqrt(n) * 10) <= 0.5 AS significant
  FROM mt),
mstatus AS (
  SELECT *, CASE WHEN NOT significant OR effect = 0 THEN 'inconclusive' WHEN effect > 0 THEN 'supported' ELSE 'refuted' END AS status
  FROM mtests)"""


def supplier_tests(t: Tables) -> DataFrame:
    agg = t.lineitem.groupBy(F.col("l_suppkey").alias("hyp"), F.col("l_returnflag").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"))
    p = F.exp(-F.abs(F.col("m") - 0.05) * F.sqrt("n") * 10)
    tests = agg.select("hyp", "metric", p.alias("p_value"), (F.col("m") - 0.05).alias("effect")).withColumn(
        "significant", F.col("p_value") <= 0.5)
    return tests.withColumn("status", tst.classify(F.col("p_value"), F.col("significant"), F.col("effect"), F.lit(1.0)))


@query("d40_hypothesis_outcomes", f"""
WITH {_SUPPLIER_TESTS},
scoped AS (
  SELECT *, bool_or(metric = 'R') OVER (PARTITION BY hyp) AS has_primary FROM mstatus)
SELECT hyp, CASE WHEN bool_or(has_primary) THEN 'primary_metric' ELSE 'all_tests' END AS scope, count(*) AS tests,
       count(*) FILTER (WHERE significant) AS significant, round(min(p_value), 6) AS min_p, round(max(p_value), 6) AS max_p,
       count(*) FILTER (WHERE status = 'supported') AS n_supported, count(*) FILTER (WHERE status = 'refuted') AS n_refuted,
       CASE WHEN bool_and(status = 'failed') THEN 'failed'
            WHEN bool_or(status = 'supported') AND NOT bool_or(status = 'refuted') THEN 'supported'
            WHEN bool_or(status = 'refuted') AND NOT bool_or(status = 'supported') THEN 'refuted'
            ELSE 'inconclusive' END AS status
FROM scoped WHERE metric = 'R' OR NOT has_primary GROUP BY hyp""")
def d40(t: Tables) -> DataFrame:
    return tst.hypothesis_outcomes(supplier_tests(t), "hyp", "R").select(
        "hyp", "scope", "tests", "significant", r("min_p").alias("min_p"), r("max_p").alias("max_p"),
        "n_supported", "n_refuted", "status")


_INV = [c for c in CANDIDATES if c.cand_id in ("net_price", "exp_discount", "log_discount")]
_INV_CTE = OBS_CTE + f""",
z AS (SELECT * FROM ({candidate_rows("obs0")}) WHERE cand IN ('net_price', 'exp_discount', 'log_discount')),
c AS (SELECT cand, median(z) AS centre FROM z GROUP BY cand),
j AS (SELECT z.*, centre, abs(z - centre) AS dev,
             abs(z - centre) <= 0.04 * CASE WHEN abs(centre) > 1e-12 THEN abs(centre) ELSE 1 END + 1e-12 AS ok
      FROM z JOIN c USING (cand))"""


@query("d17_invariant_check", f"""
WITH {_INV_CTE}
SELECT cand, count(*) AS n_rows, count(z) AS n_used, round(any_value(centre), 6) AS estimate,
       round(count(z) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE ok) / count(z), 6) AS conformity,
       round(max(dev), 6) AS error, count(*) FILTER (WHERE NOT ok) AS counterexample_count,
       count(z) >= 2 AND count(z) / count(*) >= 0.5 AND count(*) FILTER (WHERE ok) / count(z) >= 0.9 AS holds
FROM j GROUP BY cand""")
def d17(t: Tables) -> DataFrame:
    summary, _ = rel.invariant_check(observations(t), _INV, 0.04)
    return summary.select("cand", "n_rows", "n_used", r("estimate").alias("estimate"), r("coverage").alias("coverage"),
                          r("conformity").alias("conformity"), r("error").alias("error"), "counterexample_count", "holds")


@query("d38_counterexamples", f"""
WITH {_INV_CTE},
w AS (SELECT cand, record_id, z, dev, row_number() OVER (PARTITION BY cand ORDER BY dev DESC, record_id, x1) AS position FROM j WHERE NOT ok)
SELECT cand, position, round(z, 6) AS z, round(dev, 6) AS deviation FROM w""")
def d38(t: Tables) -> DataFrame:
    _, worst = rel.invariant_check(observations(t), _INV, 0.04)
    return worst.select("cand", F.col("position").cast("long"), r("z").alias("z"), r("deviation").alias("deviation"))


_DRAWS = 20
_BOOT_FEATURES = """
sum({w} * (x{i} - mx{i})) AS s{i}, sum({w} * (x{i} - mx{i}) * (x{i} - mx{i})) AS ss{i}, sum({w} * (x{i} - mx{i}) * (y - my)) AS sy{i}"""


def _bootstrap_sql() -> str:
    feats = ", ".join(_BOOT_FEATURES.format(w="w", i=i) for i in range(1, 5))
    fullfeats = ", ".join(_BOOT_FEATURES.format(w="1", i=i) for i in range(1, 5))
    losses = ", ".join(f"(syy - sy * sy / n - (sy{i} - s{i} * sy / n) * (sy{i} - s{i} * sy / n) / (ss{i} - s{i} * s{i} / n)) / n" for i in range(1, 5))
    core = "sum({w}) AS n, sum({w} * (y - my)) AS sy, sum({w} * (y - my) * (y - my)) AS syy, sum({w} * (z - mz)) AS sz, sum({w} * (z - mz) * (z - mz)) AS szz, sum({w} * (z - mz) * (y - my)) AS szy"
    return f"""
WITH {SPLIT_CTE},
ez AS (SELECT * FROM ({candidate_rows("obs", "WHERE purpose = 'E'")}) WHERE z IS NOT NULL),
gm AS (SELECT avg(x1) AS mx1, avg(x2) AS mx2, avg(x3) AS mx3, avg(x4) AS mx4, avg(y) AS my FROM obs WHERE purpose = 'E'),
zm AS (SELECT cand, avg(z) AS mz FROM ez GROUP BY cand),
gr AS (SELECT grp, row_number() OVER (ORDER BY md5(grp), grp) AS rk, count(*) OVER () AS g
       FROM (SELECT DISTINCT grp FROM ez)),
pick AS (SELECT draw, CAST('0x' || substr(md5('5|' || draw || '|' || rk), 1, 12) AS BIGINT) % g + 1 AS rk
         FROM gr, (SELECT unnest(generate_series(0, {_DRAWS - 1})) AS draw)),
weight AS (SELECT draw, grp, count(*) AS w FROM pick JOIN gr USING (rk) GROUP BY draw, grp),
d AS (SELECT cand, draw, {core.format(w="w")}, {feats}
      FROM ez JOIN weight USING (grp) JOIN zm USING (cand), gm GROUP BY cand, draw),
full_fit AS (SELECT cand, {core.format(w="1")}, count(DISTINCT grp) AS groups FROM ez JOIN zm USING (cand), gm GROUP BY cand),
fits AS (SELECT cand, draw, (szy - sz * sy / n) / (szz - sz * sz / n) AS slope,
                (syy - sy * sy / n - power(szy - sz * sy / n, 2) / (szz - sz * sz / n)) / n AS mse,
                least((syy - sy * sy / n) / n, {losses}) AS best FROM d),
j AS (SELECT f.*, groups, (b.szy - b.sz * b.sy / b.n) / (b.szz - b.sz * b.sz / b.n) AS fs FROM fits f JOIN full_fit b USING (cand))
"""


_WILSON = "(k/n + 3.8416/(2*n) - 1.96*sqrt((k/n*(1-k/n) + 3.8416/(4*n))/n)) / (1 + 3.8416/n)"


@query("f7_bootstrap_stability", _bootstrap_sql() + f""",
a AS (SELECT cand, any_value(groups) AS groups, count(*) AS n, count(*) FILTER (WHERE best - mse > 0 AND sign(slope) = sign(fs)) AS k,
             avg(slope) AS mean_slope FROM j GROUP BY cand)
SELECT cand, groups, n AS draws, k AS reproduced, round(mean_slope, 5) AS mean_slope, round(k / n, 6) AS stability,
       round(greatest(0, {_WILSON}), 6) AS wilson_lower, 'ok' AS status FROM a""")
def f7(t: Tables) -> DataFrame:
    return _stability(t).select(
        "cand", "groups", "draws", "reproduced", r("mean_slope", 5).alias("mean_slope"), r("stability").alias("stability"),
        r("wilson_lower").alias("wilson_lower"), "status")


def _stability(t: Tables) -> DataFrame:
    sample = _part(t, "E")
    stats = t.once("stats", lambda: rel.group_sufficient_statistics(sample, CANDIDATES, FEATURES, "y", "grp"))
    weights = rel.draw_multiplicities(stats, "grp", _DRAWS, "5")
    return rel.bootstrap_stability(stats, weights, FEATURES, "grp")


@query("d30_stability_wilson", f"""
WITH a AS (SELECT l_suppkey AS supplier, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
SELECT supplier, round(k / n, 6) AS stability, round(greatest(0, {_WILSON}), 6) AS wilson_lower FROM a""")
def d30(t: Tables) -> DataFrame:
    agg = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return agg.select("supplier", r(rel.stability_score(F.col("k"), F.col("n"))).alias("stability"),
                      r(rel.wilson_lower(F.col("k"), F.col("n"))).alias("wilson_lower"))


@query("f24_stratified_split", """
WITH h AS (SELECT d.doc_id, quality, md5('11|' || d.doc_id) AS h FROM documents d JOIN labels l USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rl, row_number() OVER (ORDER BY h, doc_id) AS ra,
             count(*) OVER (PARTITION BY quality) AS n, count(*) OVER () AS total FROM h),
m AS (SELECT min(n) AS least_n FROM k)
SELECT doc_id, CASE WHEN (least_n >= 2 AND rl <= ceil(n * 0.3)) OR (least_n < 2 AND ra <= ceil(total * 0.3)) THEN 'test' ELSE 'train' END AS part,
       least_n < 2 AS fallback FROM k, m""")
def f24(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id")
    return stratified_split(rows, "quality", "doc_id", "11", 0.3).select("doc_id", "part", "fallback")


@query("f26_dataset_holdout", """
WITH d AS (SELECT DISTINCT l_suppkey AS dataset FROM lineitem),
k AS (SELECT dataset, row_number() OVER (ORDER BY md5('3|' || dataset), dataset) AS rk, count(*) OVER () AS n FROM d)
SELECT dataset, CASE WHEN rk <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS part FROM k""")
def f26(t: Tables) -> DataFrame:
    return dataset_holdout(t.lineitem.select(F.col("l_suppkey").alias("dataset")), "dataset", "3", 0.2)
