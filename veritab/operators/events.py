"""Learner events: validation, mapping, gap filter, episodes, skill model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.ordered import top_rows
from veritab.session import sized_join

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_events(raw: DataFrame) -> DataFrame:
    """Adds the parsed time and attempts, so every rule reads one parsed value."""
    tries = F.col("attempts").try_cast("int")
    return raw.withColumn("_when", F.try_to_timestamp("submit_time", F.lit(TIME_FORMAT))).withColumn(
        "_tries", F.when(tries.isNull() | (tries <= 0), 1).otherwise(tries))


def drop_reason(min_year: int = 2015, max_year: int = 2030, max_attempts: int = 20) -> Column:
    """First failing rule of a parsed event, null when it passes."""
    return (
        F.when(~F.coalesce(F.col("user_id").startswith("U_"), F.lit(False)), "bad_user_id")
        .when(~F.coalesce(F.col("problem_id").startswith("Pm_"), F.lit(False)), "bad_problem_id")
        .when(~F.coalesce(F.col("is_correct").isin(0, 1), F.lit(False)), "bad_is_correct")
        .when(F.col("_when").isNull(), "bad_submit_time")
        .when(~F.year("_when").between(min_year, max_year), "time_out_of_range")
        .when(F.col("_tries") > max_attempts, "too_many_attempts")
    )


def validate_events(raw: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(clean, dropped): clean rows carry user_id, t (epoch seconds), pm_id, y, attempts."""
    tagged = parse_events(raw).withColumn("reason", drop_reason(**limits))
    extra = [c for c in raw.columns if c not in ("user_id", "problem_id", "is_correct", "submit_time", "attempts")]
    clean = tagged.filter(F.col("reason").isNull()).select(
        "user_id", F.unix_timestamp("_when").alias("t"), F.col("problem_id").alias("pm_id"),
        F.col("is_correct").cast("int").alias("y"), F.col("_tries").alias("attempts"), *extra)
    return clean, tagged.filter(F.col("reason").isNotNull()).drop("_when", "_tries")


def with_gap(events: DataFrame, ties: list[str], bucket_seconds: int = 21600) -> DataFrame:
    """``gap`` to the user's previous event, dropped or not (null for the first).

    The window key is (user, time bucket), so a user with a third of all events
    spreads over many tasks. Only the first row of a bucket looks further back:
    it takes the last time of the bucket before from a table with one row per
    user and bucket, which shares the rows' partitioning.
    """
    rows = events.withColumn("_bucket", F.floor(F.col("t") / bucket_seconds))
    last = rows.groupBy("user_id", "_bucket").agg(F.max("t").alias("_last"))
    carry = last.select("user_id", "_bucket", F.lag("_last").over(
        Window.partitionBy("user_id").orderBy("_bucket")).alias("_before"))
    inside = Window.partitionBy("user_id", "_bucket").orderBy("t", *ties)
    previous = F.coalesce(F.lag("t").over(inside), F.col("_before"))
    return rows.join(carry, ["user_id", "_bucket"]).withColumn("gap", F.col("t") - previous).drop("_bucket", "_before")


def gap_filter(events: DataFrame, min_gap: int, ties: list[str], bucket_seconds: int = 21600) -> tuple[DataFrame, DataFrame]:
    """(kept, too_fast): events closer than ``min_gap`` to the one before are dropped."""
    gapped = with_gap(events, ties, bucket_seconds)
    fast = F.coalesce(F.col("gap") < min_gap, F.lit(False))
    return gapped.filter(~fast), gapped.filter(fast)


def map_knowledge(events: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) after the pm_id -> k_id lookup; the mapping is broadcast only
    after its size is measured."""
    joined = sized_join(events, mapping, "pm_id", "left")
    known = F.coalesce(F.col("k_id"), F.lit("")) != ""
    return joined.filter(known).withColumn("group_id", skill_group(F.col("k_id"))), joined.filter(~known)


def skill_group(k_id: Column) -> Column:
    """Text after the last underscore, ``unknown`` without one."""
    suffix = F.substring_index(k_id, "_", -1)
    return F.when(k_id.contains("_") & (suffix != ""), suffix).otherwise("unknown")


def episodes(mapped: DataFrame, exam_size: int, order: list[str]) -> DataFrame:
    """Flat episodes: every event of a (group, user) with role history or exam.

    The last ``exam_size`` events are the exam; groups without history are
    dropped. ``order`` must be a total order. Only the exam rows (a bounded
    number per group) are ranked; history is decided by comparing with the
    first exam row, so long histories stay spread over tasks.
    """
    key = ["group_id", "user_id"]
    exam = top_rows(mapped.select(*key, *order), key, [F.desc(c) for c in order], exam_size)
    bounds = exam.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    sizes = mapped.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= exam_size + 1)
    joined = sized_join(mapped, bounds.join(sizes, key), key)
    role = F.when(F.struct(*order) < F.col("_first"), "history").otherwise("exam")
    return joined.withColumn("role", role).withColumn(
        "episode_id", F.concat(F.col("group_id"), F.lit("|"), F.col("user_id"), F.lit("#0"))).drop("_first", "_n")


def skill_model(history: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Beta-Bernoulli success rate per (group, skill)."""
    agg = history.groupBy("group_id", "k_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("c"))
    return agg.withColumn("p", (F.col("c") + alpha) / (F.col("n") + alpha + beta))


def exam_readiness(exam: DataFrame, model: DataFrame, order: list[str], default: float = 0.5) -> DataFrame:
    """Mean clipped success rate over the exam and its weakest skill (first minimum)."""
    scored = sized_join(exam, model.select("group_id", "k_id", "p"), ["group_id", "k_id"], "left").withColumn(
        "p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("p", F.lit(default)))))
    return scored.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("exam_size"), F.avg("p").alias("readiness"),
        F.min_by("k_id", F.struct("p", *order)).alias("weakest"), F.min("p").alias("weakest_p"))
