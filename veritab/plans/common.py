"""Bindings of the shared tables to the observation model, in Spark and in SQL.

Observation = one order line: group = supplier, environment = return flag,
x1..x4 = quantity, discount, tax, price, y = price after discount and tax.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import Candidate
from veritab.operators.split import assign_purposes
from veritab.plans.registry import Tables
from veritab.session import sized_join

FEATURES = ["x1", "x2", "x3", "x4"]
SEED = "7"
ALLOCATION = {"E": 0.5, "V": 0.25, "C1": 0.25}


def var(name: str) -> tuple:
    return ("var", name)


CANDIDATES = [
    Candidate("net_price", ("mul", var("x4"), ("add", ("num", 1), ("neg", var("x2"))))),
    Candidate("unit_price", ("mul", var("x4"), ("inv", var("x1")))),
    Candidate("root_price", ("func", "sqrt", var("x4"))),
    Candidate("log_discount", ("func", "log", var("x2"))),
    Candidate("inverse_tax", ("inv", var("x3"))),
    Candidate("quantity_squared", ("pow", var("x1"), 2)),
    Candidate("exp_discount", ("func", "exp", var("x2"))),
    Candidate("abs_quantity", ("func", "abs", ("add", var("x1"), ("num", -25)))),
]

# The same candidates by hand, for the oracle: id, value, domain.
_SQL_CANDIDATES = [
    ("net_price", "x4 * (1 - x2)", "true"),
    ("unit_price", "x4 / x1", "abs(x1) > 1e-9"),
    ("root_price", "sqrt(x4)", "x4 >= 0"),
    ("log_discount", "ln(x2)", "x2 > 0"),
    ("inverse_tax", "1 / x3", "abs(x3) > 1e-9"),
    ("quantity_squared", "x1 * x1", "true"),
    ("exp_discount", "exp(x2)", "true"),
    ("abs_quantity", "abs(x1 - 25)", "true"),
]


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def observations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.col("l_suppkey").cast("string").alias("grp"), F.col("l_returnflag").alias("env"),
        F.col("l_shipdate").alias("event_time"), F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), F.col("l_extendedprice").alias("x4"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"),
    )


def split_observations(t: Tables) -> DataFrame:
    obs = observations(t)
    parts = t.once("parts", lambda: assign_purposes(obs, "grp", SEED, ALLOCATION))
    return sized_join(obs, parts, "grp")


OBS_CTE = """
obs0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS record_id,
         CAST(l_suppkey AS VARCHAR) AS grp, l_returnflag AS env, l_shipdate AS event_time,
         l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS x4,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y
  FROM lineitem)"""

SPLIT_CTE = OBS_CTE + """,
comp AS (
  SELECT grp, row_number() OVER (ORDER BY sha256('7|' || grp)) AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT grp FROM obs0)),
alloc AS (
  SELECT part, pos, floor(n * share) AS base, n * share - floor(n * share) AS rest, n
  FROM (VALUES ('E', 0, 0.5), ('V', 1, 0.25), ('C1', 2, 0.25)) a(part, pos, share),
       (SELECT DISTINCT n FROM comp)),
cuts AS (
  SELECT part, pos,
         base + CASE WHEN row_number() OVER (ORDER BY rest DESC, pos)
                          <= n - sum(base) OVER () THEN 1 ELSE 0 END AS size
  FROM alloc),
bounds AS (
  SELECT part, sum(size) OVER (ORDER BY pos) - size AS lo, sum(size) OVER (ORDER BY pos) AS hi FROM cuts),
parts AS (SELECT grp, part AS purpose FROM comp JOIN bounds ON rk > lo AND rk <= hi),
obs AS (SELECT obs0.*, purpose FROM obs0 JOIN parts USING (grp))"""


def candidate_rows(source: str, extra: str = "") -> str:
    """SQL: one row per (row of source, candidate) with z null outside the domain."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS cand, {valid} AS in_domain, CASE WHEN {valid} THEN {value} END AS z, * FROM {source} {extra}"
        for name, value, valid in _SQL_CANDIDATES
    )


FIT_CTE = SPLIT_CTE + f""",
ez AS (SELECT * FROM ({candidate_rows("obs", "WHERE purpose = 'E'")}) WHERE z IS NOT NULL),
fit AS (
  SELECT cand, count(*) AS n, covar_pop(z, y) / var_pop(z) AS slope,
         avg(y) - covar_pop(z, y) / var_pop(z) * avg(z) AS intercept,
         var_pop(y) - covar_pop(z, y) * covar_pop(z, y) / var_pop(z) AS mse, var_pop(y) AS constant_mse,
         var_pop(y) - covar_pop(x1, y) * covar_pop(x1, y) / var_pop(x1) AS m1,
         var_pop(y) - covar_pop(x2, y) * covar_pop(x2, y) / var_pop(x2) AS m2,
         var_pop(y) - covar_pop(x3, y) * covar_pop(x3, y) / var_pop(x3) AS m3,
         var_pop(y) - covar_pop(x4, y) * covar_pop(x4, y) / var_pop(x4) AS m4
  FROM ez GROUP BY cand),
base AS (SELECT avg(y) AS mu FROM obs WHERE purpose = 'E')"""

# Group loss differences on C1 and the sign test on them.
SIGN_CTE = FIT_CTE + f""",
cz AS (SELECT * FROM ({candidate_rows("obs", "WHERE purpose = 'C1'")})),
gain AS (
  SELECT cand, grp, (y - mu) * (y - mu) - power(y - (intercept + slope * z), 2) AS g
  FROM cz JOIN fit USING (cand), base),
diffs AS (
  SELECT cand, grp, avg(g) AS diff, count(*) FILTER (WHERE g IS NULL) AS undefined_rows, count(*) AS n
  FROM gain GROUP BY cand, grp),
tests0 AS (
  SELECT cand, count(*) AS unit_count, sum(n) AS sample_size, count(*) FILTER (WHERE diff > 0.0) AS w,
         median(diff) AS eff, sum(undefined_rows) AS bad
  FROM diffs GROUP BY cand),
tests AS (
  SELECT cand, unit_count, sample_size,
         CASE WHEN bad = 0 AND unit_count >= 2 THEN w END AS wins,
         CASE WHEN bad = 0 AND unit_count >= 2 THEN eff END AS effect,
         CASE WHEN bad = 0 AND unit_count >= 2 THEN (
           SELECT sum(exp(lgamma(unit_count + 1) - lgamma(k + 1) - lgamma(unit_count - k + 1) - unit_count * ln(2)))
           FROM (SELECT unnest(generate_series(CAST(w AS BIGINT), unit_count)) AS k)) END AS p_value
  FROM tests0)"""
