"""Learner-event queries over the event stream table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import events as ev
from veritab.plans.common import r
from veritab.plans.registry import Tables, query

MIN_GAP, EXAM = 1800, 3


def raw_events(t: Tables) -> DataFrame:
    """Learner events read off the event table; some break one rule each."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id"),
        F.when((F.col("event_type") == "error") & (k % 10 == 0), F.concat(F.lit("X"), F.col("user_id")))
        .otherwise(F.concat(F.lit("U_"), F.col("user_id"))).alias("user_id"),
        F.when(k == 77, F.concat(F.lit("Q_"), k)).otherwise(F.concat(F.lit("Pm_"), k)).alias("problem_id"),
        F.when((F.col("event_type") == "signup") & (k % 7 == 0), 2)
        .otherwise(F.when(F.col("value") > 50, 1).otherwise(0)).alias("is_correct"),
        F.when(k == 13, F.lit("yesterday")).when(k == 14, F.date_format("ts", "2042-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", ev.TIME_FORMAT)).alias("submit_time"),
        (k % 25 - 1).alias("attempts"),
    )


_RAW = """
raw AS (
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, user_id AS u, date_trunc('second', ts) AS ts FROM events),
tagged AS (
  SELECT event_id, 'U_' || u AS user_id, 'Pm_' || k AS pm_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y,
         CAST(epoch(ts) AS BIGINT) AS t, CASE WHEN k % 25 - 1 <= 0 THEN 1 ELSE k % 25 - 1 END AS attempts,
         CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'bad_user_id' WHEN k = 77 THEN 'bad_problem_id'
              WHEN event_type = 'signup' AND k % 7 = 0 THEN 'bad_is_correct' WHEN k = 13 THEN 'bad_submit_time'
              WHEN k = 14 THEN 'time_out_of_range' WHEN k % 25 - 1 > 20 THEN 'too_many_attempts' END AS reason
  FROM raw),
clean AS (SELECT * FROM tagged WHERE reason IS NULL)"""

_GAP = _RAW + f""",
gapped AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, pm_id, y, attempts, event_id) AS gap FROM clean),
kept AS (SELECT * FROM gapped WHERE gap IS NULL OR gap >= {MIN_GAP})"""

_MAPPED = _GAP + """,
km AS (
  SELECT 'Pm_' || p_partkey AS pm_id,
         CASE WHEN p_partkey % 10 = 3 THEN '' WHEN p_size % 9 = 0 THEN 'K' ELSE 'K_' || p_size % 5 || '_' || p_type END AS k_id
  FROM part WHERE p_partkey % 11 <> 5),
joined AS (SELECT kept.*, k_id FROM kept LEFT JOIN km USING (pm_id)),
mapped AS (
  SELECT *, CASE WHEN contains(k_id, '_') AND split_part(k_id, '_', -1) <> '' THEN split_part(k_id, '_', -1) ELSE 'unknown' END AS group_id
  FROM joined WHERE coalesce(k_id, '') <> '')"""

_EPISODES = _MAPPED + f""",
ep AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, user_id ORDER BY t DESC, pm_id DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY group_id, user_id) AS n FROM mapped),
episodes AS (
  SELECT *, group_id || '|' || user_id || '#0' AS episode_id, CASE WHEN rn <= {EXAM} THEN 'exam' ELSE 'history' END AS role
  FROM ep WHERE n >= {EXAM + 1})"""

ORDER = ["t", "pm_id", "event_id"]
TIES = ["pm_id", "y", "attempts", "event_id"]


def _clean(t: Tables) -> DataFrame:
    return ev.validate_events(raw_events(t))[0]


def _kept(t: Tables) -> DataFrame:
    return ev.gap_filter(_clean(t), MIN_GAP, TIES)[0]


def knowledge_map(t: Tables) -> DataFrame:
    pk = F.col("p_partkey")
    return t.part.filter(pk % 11 != 5).select(
        F.concat(F.lit("Pm_"), pk).alias("pm_id"),
        F.when(pk % 10 == 3, "").when(F.col("p_size") % 9 == 0, "K")
        .otherwise(F.concat(F.lit("K_"), (F.col("p_size") % 5).cast("string"), F.lit("_"), F.col("p_type"))).alias("k_id"))


def _mapped(t: Tables) -> DataFrame:
    """Cleaned, filtered and mapped events: read several times below, so stored once."""
    return t.once("mapped", lambda: ev.map_knowledge(_kept(t), knowledge_map(t))[0])


def _episodes(t: Tables) -> DataFrame:
    return t.once("episodes", lambda: ev.episodes(_mapped(t), EXAM, ORDER))


@query("b1_event_validation", f"""
WITH {_RAW} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM tagged GROUP BY 1""")
def b1(t: Tables) -> DataFrame:
    return ev.parse_events(raw_events(t)).withColumn("reason", ev.drop_reason()).groupBy(
        F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("attempts") <= 0, 1).otherwise(F.col("attempts"))).alias("attempts"))


@query("b1_clean_events", f"WITH {_RAW} SELECT user_id, t, pm_id, y, attempts FROM clean")
def b1_clean(t: Tables) -> DataFrame:
    return _clean(t).select("user_id", "t", "pm_id", "y", "attempts")


@query("e1_gap_filter", f"WITH {_GAP} SELECT event_id, user_id, t, CAST(gap AS BIGINT) AS gap FROM kept")
def e1(t: Tables) -> DataFrame:
    return _kept(t).select("event_id", "user_id", "t", "gap")


@query("c1_knowledge_join", f"""
WITH {_MAPPED} SELECT coalesce(nullif(k_id, ''), 'unmapped') AS k_id, count(*) AS n FROM joined GROUP BY 1""")
def c1(t: Tables) -> DataFrame:
    mapped, unmapped = ev.map_knowledge(_kept(t), knowledge_map(t))
    return mapped.select("k_id").unionByName(unmapped.select(F.lit("unmapped").alias("k_id"))).groupBy("k_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("c2_skill_group", f"WITH {_MAPPED} SELECT group_id, count(*) AS n, count(DISTINCT k_id) AS skills FROM mapped GROUP BY 1")
def c2(t: Tables) -> DataFrame:
    return _mapped(t).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k_id").alias("skills"))


@query("e2_episodes", f"WITH {_EPISODES} SELECT episode_id, role, event_id, t, pm_id, k_id, y FROM episodes")
def e2(t: Tables) -> DataFrame:
    return _episodes(t).select("episode_id", "role", "event_id", "t", "pm_id", "k_id", "y")


_MODEL = _EPISODES + """,
model AS (
  SELECT group_id, k_id, count(*) AS n, count(*) FILTER (WHERE y = 1) AS c,
         (count(*) FILTER (WHERE y = 1) + 1) / (count(*) + 2) AS p
  FROM episodes WHERE role = 'history' GROUP BY 1, 2)"""


@query("d1_skill_model", f"WITH {_MODEL} SELECT group_id, k_id, n, c, round(p, 9) AS p FROM model")
def d1(t: Tables) -> DataFrame:
    return ev.skill_model(_episodes(t).filter("role = 'history'")).withColumn("p", r("p", 9))


@query("d2_exam_readiness", f"""
WITH {_MODEL},
s AS (SELECT e.*, coalesce(p, 0.5) AS pp FROM episodes e LEFT JOIN model m USING (group_id, k_id) WHERE role = 'exam')
SELECT episode_id, count(*) AS exam_size, round(avg(pp), 9) AS readiness,
       arg_min(k_id, (pp, t, pm_id, event_id)) AS weakest, round(min(pp), 9) AS weakest_p
FROM s GROUP BY episode_id""")
def d2(t: Tables) -> DataFrame:
    ep = _episodes(t)
    model = ev.skill_model(ep.filter("role = 'history'"))
    return ev.exam_readiness(ep.filter("role = 'exam'"), model, ORDER).select(
        "episode_id", "exam_size", r("readiness", 9).alias("readiness"), "weakest", r("weakest_p", 9).alias("weakest_p"))
