"""Where to sample next: divergence of predictions, budgeted plans, catalogue lookup."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.ordered import ordered_scan
from veritab.session import cut_lineage

TOLERANCE = 1e-12
EPSILON = 1e-12


def divergence(predictions: DataFrame, observations: DataFrame, mode: str = "spread") -> DataFrame:
    """Spread of competing predictions per observation; null when fewer than two exist.

    predictions: obs, hyp, value; observations: obs, cost, near_boundary.
    """
    agg = predictions.groupBy("obs").agg(
        F.count("value").alias("participating"), (F.max("value") - F.min("value")).alias("_s"), F.max(F.abs("value")).alias("_m"))
    j = observations.join(agg, "obs", "left")
    enough = F.coalesce(F.col("participating"), F.lit(0)) >= 2
    spread = F.when(enough, F.when(F.col("_s") > TOLERANCE, F.col("_s")).otherwise(0.0))
    normal = F.when(enough, F.when(F.col("_m") > 0, spread / (F.col("_m") + EPSILON)).otherwise(0.0))
    basis = spread if mode == "spread" else normal
    return j.select(
        "obs", "cost", "near_boundary", F.coalesce("participating", F.lit(0)).alias("participating"),
        spread.alias("divergence"), normal.alias("normalized"), (basis / F.col("cost")).alias("heuristic"))


def divergence_report(entries: DataFrame) -> DataFrame:
    """(obs, kind): undetermined, unanimous or comparable, and unknown cost beside them."""
    kind = F.when(F.col("divergence").isNull(), "undetermined").when(F.col("divergence") == 0, "unanimous").otherwise("comparable")
    return entries.select("obs", kind.alias("kind"), F.col("cost").isNull().alias("unknown_cost"))


# Ranks per block of the running sums below.
_BLOCK_BITS = 16


def _running(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums by ``rank``: inside blocks of consecutive ranks, with the sums of the blocks before."""
    placed = rows.withColumn("_b", F.shiftright("rank", _BLOCK_BITS))
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("_b").alias("_k")).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    totals = totals.select("_k", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in sums])
    inside = Window.partitionBy("_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(totals, F.col("_b") == F.col("_k")).select(
        *rows.columns, *[(F.sum(c).over(inside) + F.col(f"_c_{o}")).alias(o) for o, c in sums.items()])


def acquisition_plan(entries: DataFrame, max_items: int, budget: float | None = None) -> DataFrame:
    """Entries with (rank, position, state): the greedy plan that skips what no longer fits and goes on.

    Each round settles all ranks up to a halt. Entries dearer than half of the money left are large: until one of them
    fits, only small ones are taken, and these fit for as long as they cost no more than that half together. The halt is
    the first large entry that fits, the small one that passes the half, or the last one the limit allows; whichever it
    is, at most half of the money stays. So the rounds are as many as the budget can be halved before
    it falls below the least positive cost, and one row a round reaches the driver. Costs are not negative.
    """
    determined = F.col("heuristic").isNotNull()
    order = [F.when(determined, 0).otherwise(1).alias("_o1"), F.coalesce(-F.col("heuristic"), F.lit(0.0)).alias("_o2"),
             F.when(F.col("cost").isNotNull(), 0).otherwise(1).alias("_o3"), F.when(F.col("near_boundary"), 0).otherwise(1).alias("_o4")]
    keyed = entries.select("*", *order)
    ranked = cut_lineage(ordered_scan(keyed, [], ["_o1", "_o2", "_o3", "_o4", "obs"], number="rank").drop("_o1", "_o2", "_o3", "_o4"))
    usable = F.col("divergence").isNotNull() & F.col("cost").isNotNull()
    most = math.inf if budget is None else budget + TOLERANCE
    spent, room, at, last, taken = 0.0, max_items, 0, 0, F.lit(False)
    while room > 0:
        half = F.lit((most - spent) / 2)
        small = F.col("cost") <= half
        live = ranked.filter(usable & (F.col("rank") > at) & (F.lit(spent) + F.col("cost") <= most)).select(
            "rank", "cost", small.alias("small"), F.when(small, F.col("cost")).otherwise(0.0).alias("_paid"), small.cast("long").alias("_one"))
        halts = _running(live, {"paid": "_paid", "count": "_one"}).filter(F.when(
            F.col("small"), (F.col("paid") > half) | (F.col("count") >= room)).otherwise(F.lit(spent) + F.col("paid") + F.col("cost") <= most))
        halt = halts.agg(F.min(F.struct("rank", "paid", "count", "cost", "small")).alias("halt")).first()["halt"]
        settled = F.col("rank") > at
        if halt is None:
            taken = taken | (settled & small)
            last = None
            break
        taken = taken | (settled & (F.col("rank") <= halt["rank"]) & (small | (F.col("rank") == halt["rank"])))
        at = last = halt["rank"]
        spent += halt["paid"] + (0.0 if halt["small"] else halt["cost"])
        room -= halt["count"] + (0 if halt["small"] else 1)
    marked = ranked.withColumn("_taken", F.coalesce(usable & taken, F.lit(False))).withColumn("_one", F.col("_taken").cast("long"))
    over_limit = F.lit(False) if last is None else F.col("rank") > last
    state = (
        F.when(F.col("_taken"), "selected").when(F.col("divergence").isNull(), "undetermined")
        .when(F.col("cost").isNull(), "unknown_cost").when(over_limit, "over_limit").otherwise("over_budget"))
    return _running(marked, {"_nth": "_one"}).withColumn("state", state).withColumn(
        "position", F.when(F.col("_taken"), F.col("_nth") - 1).cast("int")).drop("_taken", "_one", "_nth")


def plan_requests(plan: DataFrame, by_observation: DataFrame, by_purpose: DataFrame, default: str | None, max_requests: int | None = None) -> DataFrame:
    """Plan items (obs, purpose, rank) with their design; plan order is kept.

    Reasons: no_mapping, or budget_exhausted past the cap on matched items.
    """
    j = plan.join(by_observation.select("obs", F.col("design").alias("_a")), "obs", "left").join(
        by_purpose.select("purpose", F.col("design").alias("_b")), "purpose", "left")
    j = j.withColumn("design", F.coalesce("_a", "_b", F.lit(default).cast("string"))).drop("_a", "_b")
    matched = ordered_scan(j.withColumn("_hit", F.col("design").isNotNull().cast("int")), [], ["rank", "obs"], sums={"request": "_hit"})
    over = F.lit(False) if max_requests is None else F.col("request") > max_requests
    reason = F.when(F.col("design").isNull(), "no_mapping").when(over, "budget_exhausted")
    return matched.withColumn("reason", reason).drop("_hit")
