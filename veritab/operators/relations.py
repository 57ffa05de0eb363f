"""Candidate relations: domain, fit, baselines, gains, group tests, bootstrap.

Every statistic is a merge-able aggregate, so rows are scanned once and only
one row per (candidate) or (candidate, group) is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import Candidate, explode_candidates, is_finite
from veritab.functions.ordered import exact_quantiles, hash_rank, ordered_scan, top_rows
from veritab.functions.stats import binomial_upper_tail, normal_upper_tail

from veritab.session import cut_lineage, sized_join

EPS = 1e-12


def domain_counts(sample: DataFrame, cands: list[Candidate]) -> DataFrame:
    """Input, kept, out-of-domain and non-finite rows per candidate."""
    rows = explode_candidates(sample, cands)
    return rows.groupBy("cand").agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count("z").alias("kept"),
        F.count_if(~F.col("in_domain")).alias("domain_out"),
        F.count_if(F.col("in_domain") & F.col("z").isNull()).alias("nonfinite"),
    )


def residual_summary(df: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    """SSE, MSE, RMSE, MAE, maximum, bias, spread and R2 of residuals in one pass."""
    r = F.col(y) - F.col(yhat)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(r * r).alias("sse"), F.avg(r * r).alias("mse"),
        F.avg(F.abs(r)).alias("mae"), F.max(F.abs(r)).alias("max_abs"),
        F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("residual_std"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    defined = F.col("_sst") > EPS
    return agg.select(
        *keys, "n", "sse", "mse", F.sqrt("mse").alias("rmse"), "mae", "max_abs", "mean_residual",
        "residual_std", F.when(defined, 1 - F.col("sse") / F.col("_sst")).alias("r2"),
        defined.alias("r2_defined"),
    )


def fit_relations(sample: DataFrame, cands: list[Candidate], features: list[str], y: str) -> DataFrame:
    """y ~ a + b z per candidate, with constant and per-feature linear baselines
    on exactly the same rows."""
    rows = explode_candidates(sample, cands).filter(F.col("z").isNotNull())
    per_feature = [
        F.struct(F.covar_pop(f, y).alias("c"), F.var_pop(f).alias("v"),
                 F.max(F.abs(F.col(f))).alias("m")).alias(f"_b_{f}")
        for f in features
    ]
    agg = rows.groupBy("cand").agg(
        F.count(F.lit(1)).alias("n"), F.avg("z").alias("_mz"), F.avg(y).alias("mean_y"),
        F.covar_pop("z", y).alias("_czy"), F.var_pop("z").alias("_vz"), F.var_pop(y).alias("_vy"),
        F.max(F.abs("z")).alias("_scale"), *per_feature,
    )

    def degenerate(var: Column, scale: Column) -> Column:
        s = F.greatest(F.lit(1.0), scale)
        return var * F.col("n") <= EPS * s * s

    constant_z = degenerate(F.col("_vz"), F.col("_scale")) | (F.col("n") < 2)
    slope = F.when(~constant_z, F.col("_czy") / F.col("_vz"))
    baselines = F.array_compact(F.array(*[
        F.when(~degenerate(F.col(f"_b_{f}.v"), F.col(f"_b_{f}.m")),
               F.struct(F.greatest(F.lit(0.0), F.col("_vy") - F.col(f"_b_{f}.c") * F.col(f"_b_{f}.c") / F.col(f"_b_{f}.v")).alias("mse"),
                        F.lit(f).alias("feature")))
        for f in features
    ]))
    best = F.array_min(baselines)
    fitted = agg.select(
        "cand", "n", "mean_y", slope.alias("slope"),
        (F.col("mean_y") - slope * F.col("_mz")).alias("intercept"),
        F.when(~constant_z, F.greatest(F.lit(0.0), F.col("_vy") - slope * F.col("_czy"))).alias("mse"),
        F.col("_vy").alias("constant_mse"), best["feature"].alias("best_feature"),
        best["mse"].alias("best_feature_mse"),
        F.when(F.col("n") < 2, "too_few_rows").when(constant_z, "constant_candidate").otherwise("ok").alias("status"),
    )
    sst = F.col("constant_mse") * F.col("n")
    return fitted.withColumn("r2", F.when(sst > EPS, 1 - F.col("mse") / F.col("constant_mse")))


def gain_against(base: Column, cand: Column, floor_at_zero: bool = False) -> Column:
    """struct(difference, relative); relative is 0 or infinite on a zero baseline."""
    diff = base - cand
    if floor_at_zero:
        diff = F.greatest(diff, F.lit(0.0))
    relative = F.when(base > EPS, diff / base).when(F.abs(diff) <= EPS, F.lit(0.0)).otherwise(
        F.signum(diff) * F.lit(float("inf")))
    return F.struct(diff.alias("difference"), relative.alias("relative"))


def gains(fits: DataFrame) -> DataFrame:
    """Gain of each fitted candidate against its hardest baseline."""
    hardest = F.array_min(F.array_compact(F.array(
        F.struct(F.col("constant_mse").alias("loss"), F.lit("constant").alias("name")),
        F.when(F.col("best_feature_mse").isNotNull(),
               F.struct(F.col("best_feature_mse").alias("loss"), F.concat(F.lit("linear:"), "best_feature").alias("name"))),
    )))
    return (
        fits.filter(F.col("mse").isNotNull()).withColumn("_h", hardest)
        .withColumn("_g", gain_against(F.col("_h.loss"), F.col("mse")))
        .select("cand", "n", "mse", F.col("_h.name").alias("baseline"), F.col("_h.loss").alias("baseline_mse"),
                F.col("_g.difference").alias("difference"), F.col("_g.relative").alias("relative"))
    )


def predict(rows: DataFrame, frozen: DataFrame, cands: list[Candidate]) -> DataFrame:
    """Rows x frozen candidates with ``pred``; null where the candidate is undefined.

    The frozen table has one row per candidate.
    """
    return sized_join(explode_candidates(rows, cands), frozen.select("cand", "slope", "intercept"), "cand").withColumn(
        "pred", F.col("intercept") + F.col("slope") * F.col("z")
    )


def validation_gate(rows: DataFrame, frozen: DataFrame, cands: list[Candidate], y: str, baseline: DataFrame) -> DataFrame:
    """Frozen parameters on V: passes when mse beats the constant; any undefined loss fails."""
    scored = predict(rows, frozen, cands).withColumn("_base", baseline.scalar())
    loss = (F.col(y) - F.col("pred")) * (F.col(y) - F.col("pred"))
    base = (F.col(y) - F.col("_base")) * (F.col(y) - F.col("_base"))
    agg = scored.groupBy("cand").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(loss)).alias("undefined_rows"),
        F.avg(F.when(is_finite(loss), loss)).alias("_mse"), F.avg(base).alias("constant_mse"),
    )
    complete = F.col("undefined_rows") == 0
    return agg.select(
        "cand", "n", "undefined_rows", F.when(complete, F.col("_mse")).alias("mse"), "constant_mse",
        F.coalesce(complete & (F.col("_mse") < F.col("constant_mse")), F.lit(False)).alias("passed"),
    )


def group_differences(rows: DataFrame, frozen: DataFrame, cands: list[Candidate], y: str, group: str, baseline: DataFrame) -> DataFrame:
    """Mean loss reduction per (candidate, group) and the count of undefined rows."""
    scored = predict(rows, frozen, cands).withColumn("_base", baseline.scalar())
    base, cand = F.col(y) - F.col("_base"), F.col(y) - F.col("pred")
    gain = base * base - cand * cand
    return scored.groupBy("cand", group).agg(
        F.avg(F.when(is_finite(gain), gain)).alias("diff"),
        F.count_if(~is_finite(gain)).alias("undefined_rows"), F.count(F.lit(1)).alias("n"),
    )


def sign_test(diffs: DataFrame, delta: float, min_groups: int) -> DataFrame:
    """Exact one-sided sign test over groups; ties lose; any undefined row voids the test."""
    diffs = cut_lineage(diffs)
    median = exact_quantiles(diffs, ["cand"], "diff", {"_effect": 0.5})
    agg = diffs.groupBy("cand").agg(
        F.count(F.lit(1)).alias("unit_count"), F.sum("n").alias("sample_size"),
        F.count_if(F.col("diff") > delta).alias("wins"), F.sum("undefined_rows").alias("_bad"),
    ).join(median, "cand", "left")
    usable = (F.col("_bad") == 0) & (F.col("unit_count") >= min_groups)
    return agg.select(
        "cand", "unit_count", "sample_size", F.when(usable, F.col("wins")).alias("wins"),
        F.when(usable, F.col("_effect")).alias("effect"),
        F.when(usable, binomial_upper_tail(F.col("unit_count"), F.col("wins"))).alias("p_value"),
    )


def normal_test(diffs: DataFrame) -> DataFrame:
    """One-sided normal test of the mean group difference."""
    agg = diffs.groupBy("cand").agg(
        F.count("diff").alias("n"), F.avg("diff").alias("effect"), F.var_samp("diff").alias("_v"))
    stat = F.when((F.col("n") >= 2) & (F.col("_v") > 0), F.col("effect") / F.sqrt(F.col("_v") / F.col("n")))
    return agg.select("cand", "n", "effect", stat.alias("statistic")).withColumn(
        "p_value", normal_upper_tail(F.col("statistic")))


def invariant_check(
    sample: DataFrame, cands: list[Candidate], tolerance: float, min_conformity: float = 0.9,
    min_coverage: float = 0.5, max_counterexamples: int | None = None, record_id: str = "record_id",
) -> tuple[DataFrame, DataFrame]:
    """Approximate invariants around the exact median: (summary, counterexamples)."""
    rows = explode_candidates(sample.select(record_id, *_needed(cands)), cands)
    centre = exact_quantiles(rows, ["cand"], "z", {"centre": 0.5})
    scale = F.when(F.abs("centre") > EPS, F.abs("centre")).otherwise(1.0)
    judged = sized_join(rows, centre, "cand").withColumn("deviation", F.abs(F.col("z") - F.col("centre"))).withColumn(
        "conforming", F.col("deviation") <= tolerance * scale + EPS)
    summary = judged.groupBy("cand").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("z").alias("n_used"), F.first("centre").alias("estimate"),
        F.count_if("conforming").alias("_ok"), F.max("deviation").alias("error"),
        F.min(F.when(F.col("conforming"), F.col("z"))).alias("core_low"),
        F.max(F.when(F.col("conforming"), F.col("z"))).alias("core_high"),
    ).select(
        "cand", "n_rows", "n_used", "estimate", (F.col("n_used") / F.col("n_rows")).alias("coverage"),
        (F.col("_ok") / F.col("n_used")).alias("conformity"), "core_low", "core_high", "error",
        (F.col("n_used") - F.col("_ok")).alias("counterexample_count"),
    ).withColumn(
        "holds", F.coalesce((F.col("n_used") >= 2) & (F.col("coverage") >= min_coverage)
                            & (F.col("conformity") >= min_conformity), F.lit(False)))
    # Only what is returned is sorted.
    broken = judged.filter(~F.col("conforming")).select("cand", record_id, "z", "deviation")
    order = [F.desc("deviation"), F.asc(record_id)]
    if max_counterexamples is None:
        worst = ordered_scan(broken, ["cand"], order, number="position")
    else:
        worst = top_rows(broken, ["cand"], order, max_counterexamples, "position")
    return summary, worst.select("cand", "position", record_id, "z", "deviation")


def _needed(cands: list[Candidate]) -> list[str]:
    return sorted({v for c in cands for v in c.variables()})


def group_sufficient_statistics(sample: DataFrame, cands: list[Candidate], features: list[str], y: str, group: str) -> DataFrame:
    """Per (candidate, group) sums on globally centred values; rows are read once."""
    means = sample.groupBy().agg(F.struct(*[F.avg(c).alias(c) for c in [*features, y]]).alias("m"))
    rows = explode_candidates(sample, cands).filter(F.col("z").isNotNull())
    centre = rows.groupBy("cand").agg(F.avg("z").alias("_cz"))
    rows = sized_join(rows, centre, "cand").withColumn("_m", means.scalar())
    z, v = F.col("z") - F.col("_cz"), F.col(y) - F.col(f"_m.{y}")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(v).alias("sy"), F.sum(v * v).alias("syy"),
            F.sum(z).alias("sz"), F.sum(z * z).alias("szz"), F.sum(z * v).alias("szy")]
    for f in features:
        x = F.col(f) - F.col(f"_m.{f}")
        sums += [F.sum(x).alias(f"s_{f}"), F.sum(x * x).alias(f"ss_{f}"), F.sum(x * v).alias(f"sy_{f}")]
    return rows.groupBy("cand", group).agg(*sums)


def draw_multiplicities(groups: DataFrame, group: str, draws: int, seed: str) -> DataFrame:
    """(draw, group, weight): with-replacement draws by hash.

    Each (draw, slot) picks the group whose rank is a hash modulo the group
    count; the slots are the groups themselves, so the table is generated in
    parallel and has draws x groups rows before counting.
    """
    ids = groups.select(group).distinct().withColumn("_h", F.md5(F.col(group).cast("string")))
    ranked = hash_rank(ids, [], "_h", [group]).select(group, "rk")
    total = ranked.groupBy().agg(F.count(F.lit(1)).alias("g"))
    slots = ranked.select("rk", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("rk").cast("string")))
    pick = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % total.scalar() + 1
    weights = slots.select("draw", pick.alias("rk")).groupBy("draw", "rk").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(ranked, "rk").select("draw", group, "weight")


def bootstrap_fits(stats: DataFrame, weights: DataFrame, features: list[str], group: str) -> DataFrame:
    """Refit of every candidate on every draw from the per-group sums alone."""
    sums = [c for c in stats.columns if c not in ("cand", group)]
    drawn = stats.join(weights, group).groupBy("cand", "draw").agg(
        *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in sums])
    return _closed_form(drawn, features)


def _closed_form(sums: DataFrame, features: list[str]) -> DataFrame:
    n = F.col("n")
    syy = F.col("syy") - F.col("sy") * F.col("sy") / n
    szz = F.col("szz") - F.col("sz") * F.col("sz") / n
    szy = F.col("szy") - F.col("sz") * F.col("sy") / n
    losses = [syy / n]
    for f in features:
        sxx = F.col(f"ss_{f}") - F.col(f"s_{f}") * F.col(f"s_{f}") / n
        sxy = F.col(f"sy_{f}") - F.col(f"s_{f}") * F.col("sy") / n
        losses.append(F.when(sxx > EPS * n, (syy - sxy * sxy / sxx) / n))
    keys = [c for c in ("cand", "draw") if c in sums.columns]
    ok = szz > EPS * n
    return sums.select(
        *keys, "n", F.when(ok, szy / szz).alias("slope"),
        F.when(ok, (syy - szy * szy / szz) / n).alias("mse"), F.array_min(F.array_compact(F.array(*losses))).alias("best_baseline_mse"),
    )


def bootstrap_stability(stats: DataFrame, weights: DataFrame, features: list[str], group: str, min_groups: int = 3, min_effective: int = 5) -> DataFrame:
    """Share of draws where the candidate still beats every baseline with the same sign."""
    sums = [c for c in stats.columns if c not in ("cand", group)]
    full = _closed_form(stats.groupBy("cand").agg(*[F.sum(c).alias(c) for c in sums]), features)
    sizes = stats.groupBy("cand").agg(F.count(F.lit(1)).alias("groups"))
    drawn = bootstrap_fits(stats, weights, features, group).join(
        full.select("cand", F.col("slope").alias("full_slope")), "cand")
    effective = F.col("slope").isNotNull()
    hit = effective & (F.col("best_baseline_mse") - F.col("mse") > 0) & (F.signum("slope") == F.signum("full_slope"))
    agg = drawn.groupBy("cand").agg(
        F.count(F.lit(1)).alias("draws"), F.count_if(effective).alias("effective"),
        F.count_if(hit).alias("reproduced"), F.avg("slope").alias("mean_slope"))
    out = agg.join(sizes, "cand")
    enough = (F.col("groups") >= min_groups) & (F.col("effective") >= min_effective)
    return out.select(
        "cand", "groups", "draws", "effective", "reproduced", "mean_slope",
        stability_score(F.col("reproduced"), F.col("effective")).alias("stability"),
        wilson_lower(F.col("reproduced"), F.col("effective")).alias("wilson_lower"),
        F.when(enough, "ok").otherwise("insufficient").alias("status"))


def stability_score(reproduced: Column, effective: Column) -> Column:
    return F.when(effective > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), reproduced / effective))).otherwise(0.0)


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))).otherwise(0.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
