"""Family-wise control and classification of test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import ordered_scan
from veritab.session import cut_lineage

SUPPORTED, REFUTED, INCONCLUSIVE, FAILED = "supported", "refuted", "inconclusive", "failed"


def alpha_for_round(alpha: float, round_index: int) -> float:
    return alpha * 2.0 ** -round_index


def holm_adjust(tests: DataFrame, family: list[str], test_id: str = "test_id", p: str = "p_value") -> DataFrame:
    """Step-down adjusted p-values per family; null p-values stay null and are counted
    as missing, never imputed."""
    tests = cut_lineage(tests)
    sizes = tests.groupBy(*family).agg(F.count(p).alias("m")) if family else None
    known = tests.filter(F.col(p).isNotNull())
    ranked = ordered_scan(known, family, [p, test_id], number="rank")
    if family:
        ranked = ranked.join(sizes, family)
    else:
        ranked = ranked.withColumn("m", tests.groupBy().agg(F.count(p)).scalar())
    ranked = ranked.withColumn("factor", F.col("m") - F.col("rank") + 1).withColumn(
        "_raw", F.least(F.lit(1.0), F.col(p) * F.col("factor")))
    adjusted = ordered_scan(ranked, family, ["rank"], maxs={"adjusted": "_raw"})
    out = adjusted.select(*family, test_id, "rank", "m", "factor", "adjusted")
    return tests.join(out, [*family, test_id], "left")


def holm_thresholds(adjusted: DataFrame, alpha_t: float, p: str = "p_value") -> DataFrame:
    """Per-row threshold and flag; ``holm_reject`` is the true step-down decision."""
    threshold = F.lit(alpha_t) / F.col("factor")
    return adjusted.withColumn("threshold", threshold).withColumn(
        "significant", F.coalesce(F.col(p) <= threshold, F.lit(False))
    ).withColumn("holm_reject", F.coalesce(F.col("adjusted") <= alpha_t, F.lit(False)))


def classify(p: Column, significant: Column, effect: Column, predicted: Column, eps: float = 0.0) -> Column:
    """Result status from availability, significance and direction of the effect."""
    direction = F.when(F.abs(effect) > eps, F.signum(effect))
    return (
        F.when(p.isNull(), FAILED)
        .when(~significant, INCONCLUSIVE)
        .when(direction.isNull(), INCONCLUSIVE)
        .when(direction == predicted, SUPPORTED)
        .otherwise(REFUTED)
    )


def aggregate_status(status: Column) -> Column:
    """Aggregate column: all failed, only supported, only refuted, else inconclusive."""
    any_s = F.coalesce(F.bool_or(status == SUPPORTED), F.lit(False))
    any_r = F.coalesce(F.bool_or(status == REFUTED), F.lit(False))
    all_failed = F.coalesce(F.bool_and(status == FAILED), F.lit(True))
    return (
        F.when(all_failed, FAILED).when(any_s & ~any_r, SUPPORTED)
        .when(any_r & ~any_s, REFUTED).otherwise(INCONCLUSIVE)
    )


def summarize_family(results: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    return results.groupBy(*family).agg(
        F.count(F.lit(1)).alias("tests"), F.count(p).alias("available"),
        F.count_if("significant").alias("significant"), F.count("threshold").alias("thresholds"),
        (F.count(F.lit(1)) == F.count(p)).alias("complete"),
    )


def hypothesis_outcomes(tests: DataFrame, hyp: str, primary_metric: str) -> DataFrame:
    """Outcome per hypothesis from its primary-metric tests if it has any, else all.

    Both scopes are aggregated in one pass and the scope is chosen afterwards,
    so no hypothesis is held by one window task.
    """
    primary = F.col("metric") == primary_metric

    def both(name: str, build) -> list[Column]:
        return [build(F.lit(True)).alias(f"_a_{name}"), build(primary).alias(f"_p_{name}")]

    status = F.col("status")
    aggs = []
    for code in (SUPPORTED, REFUTED, INCONCLUSIVE, FAILED):
        aggs += both(f"n_{code}", lambda ok, code=code: F.count_if(ok & (status == code)))
    aggs += both("tests", lambda ok: F.count_if(ok))
    aggs += both("significant", lambda ok: F.count_if(ok & F.col("significant")))
    aggs += both("min_p", lambda ok: F.min(F.when(ok, F.col("p_value"))))
    aggs += both("max_p", lambda ok: F.max(F.when(ok, F.col("p_value"))))
    wide = tests.groupBy(hyp).agg(*aggs)
    has_primary = F.col("_p_tests") > 0
    names = [a for a in ("tests", "significant", "min_p", "max_p", f"n_{SUPPORTED}", f"n_{REFUTED}",
                         f"n_{INCONCLUSIVE}", f"n_{FAILED}")]
    scoped = wide.select(hyp, F.when(has_primary, "primary_metric").otherwise("all_tests").alias("scope"), *[
        F.when(has_primary, F.col(f"_p_{n}")).otherwise(F.col(f"_a_{n}")).alias(n) for n in names])
    s, r, f, n = (F.col(c) for c in (f"n_{SUPPORTED}", f"n_{REFUTED}", f"n_{FAILED}", "tests"))
    return scoped.withColumn(
        "status", F.when(f == n, FAILED).when((s > 0) & (r == 0), SUPPORTED)
        .when((r > 0) & (s == 0), REFUTED).otherwise(INCONCLUSIVE))
