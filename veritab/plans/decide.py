"""Pareto selection, candidate tables, acquisition and rule-check queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators import acquire as aq
from veritab.operators import candidates as cd
from veritab.operators import pareto as po
from veritab.operators import rules as ru
from veritab.plans.common import r
from veritab.plans.registry import Tables, query


def evaluations(t: Tables) -> DataFrame:
    """One evaluated hypothesis per part: gain, stability, novelty from its lines, complexity its size.

    Means are taken in whole ten-thousandths, so that ties are the same in any engine.
    """
    mean = lambda total, unit: F.expr(f"({total} * {2 * unit} + count(1)) div (2 * count(1)) / 10000.0").cast("double")
    agg = t.lineitem.groupBy("l_partkey").agg(
        mean("sum(cast(round(l_discount * 100) as bigint))", 100).alias("gain"), mean("count_if(l_returnflag = 'N')", 10000).alias("stability"),
        mean("sum(cast(round(l_tax * 100) as bigint))", 100).alias("novelty"))
    return t.part.join(agg, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").alias("identity"), "gain", "stability",
        F.when(F.col("p_partkey") % 50 != 7, F.col("novelty")).alias("novelty"), F.col("p_size").cast("double").alias("complexity"))


_EVAL = """
lm AS (SELECT l_partkey, count(*) AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) * 200 AS g, count(*) FILTER (l_returnflag = 'N') * 20000 AS s,
       sum(CAST(round(l_tax * 100) AS BIGINT)) * 200 AS n FROM lineitem GROUP BY 1),
ev AS (SELECT p_partkey AS identity, ((g + k) // (2 * k))::DOUBLE / 10000 AS gain, ((s + k) // (2 * k))::DOUBLE / 10000 AS stability,
       CASE WHEN p_partkey % 50 <> 7 THEN ((n + k) // (2 * k))::DOUBLE / 10000 END AS novelty, CAST(p_size AS DOUBLE) AS complexity
       FROM part LEFT JOIN lm ON l_partkey = p_partkey),
c AS (SELECT * FROM ev WHERE gain IS NOT NULL AND novelty IS NOT NULL)"""
_DOM = "b.gain >= a.gain - 1e-12 AND b.stability >= a.stability - 1e-12 AND b.novelty >= a.novelty - 1e-12 AND b.complexity <= a.complexity + 1e-12 AND (b.gain > a.gain + 1e-12 OR b.stability > a.stability + 1e-12 OR b.novelty > a.novelty + 1e-12 OR b.complexity < a.complexity - 1e-12)"


@query("e6_pareto_front", f"WITH {_EVAL} SELECT identity, gain, stability, novelty, complexity FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {_DOM})")
def e6(t: Tables) -> DataFrame:
    return po.pareto_front(evaluations(t)).select("identity", "gain", "stability", "novelty", "complexity")


def _peel_sql(rounds: int) -> str:
    """Peeling written out; the SQL check's tables are through after far fewer rounds, and the last one checks it."""
    ctes = ["c0 AS MATERIALIZED (SELECT * FROM c)"]
    for i in range(rounds):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT * FROM c{i} a WHERE NOT EXISTS (SELECT 1 FROM c{i} b WHERE {_DOM}))")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} ANTI JOIN l{i} USING (identity))")
    body = " UNION ALL ".join(f"SELECT identity, {i} AS layer FROM l{i}" for i in range(rounds))
    return f"WITH {_EVAL}, {', '.join(ctes)} {body} UNION ALL SELECT identity, -1 FROM c{rounds}"


@query("e6_pareto_layers", _peel_sql(40))
def e6_layers(t: Tables) -> DataFrame:
    return po.pareto_layers(evaluations(t)).select("identity", "layer")


def _rotate_sql(slots: int) -> str:
    dims = ["gain DESC", "stability DESC", "novelty DESC", "complexity"]
    ctes = ["l0 AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE " + _DOM + "))"]
    for i in range(slots):
        before = " UNION ALL ".join(f"SELECT identity FROM p{k}" for k in range(i)) or "SELECT -1 AS identity"
        ctes.append(f"p{i} AS (SELECT identity FROM l0 WHERE identity NOT IN ({before}) ORDER BY {dims[i % 4]}, identity LIMIT 1)")
    body = " UNION ALL ".join(f"SELECT identity, {i} AS slot, '{dims[i % 4].split()[0]}' AS dimension FROM p{i}" for i in range(slots))
    return f"WITH {_EVAL}, {', '.join(ctes)} {body}"


@query("e7_rotation_top_k", _rotate_sql(7))
def e7(t: Tables) -> DataFrame:
    front = t.once("front", lambda: po.pareto_front(evaluations(t)))
    rows = [(p["identity"], p["slot"], p["dimension"]) for p in po.rotate(front, 7)]
    return t.spark.createDataFrame(rows, "identity long, slot int, dimension string")


@query("e8_freeze_selection")
def e8(t: Tables) -> DataFrame:
    picked, _ = po.freeze_selection(evaluations(t), cap=25, incomplete_last=True)
    return picked


def candidate_rows(t: Tables) -> DataFrame:
    """Candidate metadata per part: name is the skeleton, size and brand give size and cost."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return t.part.select(
        F.col("p_partkey").alias("cand_id"), F.concat_ws("|", "p_name", "p_type", "p_size", brand % 4).alias("expression"),
        F.concat_ws("|", "p_name", "p_type").alias("skeleton"), F.col("p_size").alias("nodes"), (F.col("p_size") % 3).alias("depth"), (brand % 4).alias("conditions"))


_CAND = """
cn AS (SELECT p_partkey AS cand_id, p_name || '|' || p_type || '|' || p_size || '|' || CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 4 AS expression, p_name || '|' || p_type AS skeleton,
              p_size AS nodes, p_size % 3 AS depth, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 4 AS conditions FROM part),
pr AS (SELECT * FROM cn a WHERE NOT EXISTS (SELECT 1 FROM cn b WHERE b.skeleton = a.skeleton AND (b.nodes, b.depth) <= (a.nodes, a.depth) AND b.conditions <= a.conditions
         AND ((b.nodes, b.depth) < (a.nodes, a.depth) OR b.conditions < a.conditions)))"""


@query("f9_prune_dominated", f"WITH {_CAND} SELECT cand_id, expression, nodes, conditions FROM pr")
def f9_prune(t: Tables) -> DataFrame:
    return cd.prune_dominated(candidate_rows(t)).select("cand_id", "expression", "nodes", "conditions")


@query("f9_candidate_dedup", f"""
WITH {_CAND} SELECT skeleton, arg_min(expression, (nodes, depth, expression)) AS expression, min(nodes) AS nodes FROM pr GROUP BY skeleton""")
def f9(t: Tables) -> DataFrame:
    return cd.dedup_candidates(cd.prune_dominated(candidate_rows(t))).select("skeleton", "expression", "nodes")


@query("f12_complexity", f"WITH {_CAND} SELECT cand_id, nodes + depth + 2 AS complexity FROM cn")
def f12(t: Tables) -> DataFrame:
    return candidate_rows(t).select("cand_id", cd.complexity(F.col("nodes"), F.col("depth") + 2).alias("complexity"))


_PATTERNS = """
pt AS (SELECT 'pat' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS pattern_id, CASE p_partkey % 4 WHEN 0 THEN 'relation' WHEN 1 THEN 'cluster' WHEN 2 THEN 'changepoint' ELSE 'invariant' END AS kind,
              p_name || '|' || p_size AS content, p_name AS skeleton FROM part)"""


def patterns(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("relation", "cluster", "changepoint", "invariant")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.concat(F.lit("pat"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("pattern_id"), kind.alias("kind"),
                         F.concat_ws("|", "p_name", "p_size").alias("content"), F.col("p_name").alias("skeleton"))


@query("f10_hypotheses", f"WITH {_PATTERNS} SELECT kind, skeleton, min(pattern_id) AS hypothesis_id, arg_min(content, pattern_id) AS content, count(*) AS merged FROM pt GROUP BY 1, 2")
def f10(t: Tables) -> DataFrame:
    return cd.hypotheses_from_patterns(patterns(t)).select("kind", "skeleton", "hypothesis_id", "content", "merged")


@query("f10_merged_patterns", f"WITH {_PATTERNS} SELECT pattern_id, min(pattern_id) OVER (PARTITION BY kind, skeleton) AS hypothesis_id FROM pt")
def f10_ids(t: Tables) -> DataFrame:
    return cd.merged_pattern_ids(patterns(t)).select("pattern_id", "hypothesis_id")


def _hyps(t: Tables) -> DataFrame:
    return t.part.filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("hyp"), F.concat_ws("|", "p_name", "p_type", "p_size").alias("canonical"), F.concat_ws("|", "p_name", "p_type", "p_brand").alias("skeleton"),
        F.array(F.concat_ws("|", "p_name", "p_type", F.col("p_size") - 1), F.concat_ws("|", "p_name", "p_type", "p_size")).alias("subtrees"),
        F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("S"), F.col("p_size") % 9), F.concat(F.lit("H"), F.col("p_partkey") % 11)).alias("statement"))


def _known(t: Tables) -> DataFrame:
    return t.part.filter("p_partkey % 3 = 0 and p_size > 30").select(
        F.col("p_partkey").alias("entry"), F.concat_ws("|", "p_name", "p_type", "p_size").alias("canonical"), F.concat_ws("|", "p_name", "p_type", "p_brand").alias("skeleton"),
        F.concat_ws(" ", "p_type", F.concat(F.lit("S"), F.col("p_size") % 9), F.concat(F.lit("E"), F.col("p_partkey") % 13), F.lit("known fact about sizes")).alias("statement"))


@query("f11_novelty", """
WITH h AS (SELECT p_partkey AS hyp, p_name || '|' || p_type || '|' || p_size AS canonical, p_name || '|' || p_type || '|' || p_brand AS skeleton, p_name || '|' || p_type || '|' || (p_size - 1) AS sub,
             list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' S' || p_size % 9 || ' H' || p_partkey % 11), '[a-z][a-z0-9_]*')) AS tk FROM part WHERE p_partkey % 3 <> 0),
e AS (SELECT p_partkey AS entry, p_name || '|' || p_type || '|' || p_size AS canonical, p_name || '|' || p_type || '|' || p_brand AS skeleton,
             list_distinct(regexp_extract_all(lower(p_type || ' S' || p_size % 9 || ' E' || p_partkey % 13 || ' known fact about sizes'), '[a-z][a-z0-9_]*')) AS tk FROM part WHERE p_partkey % 3 = 0 AND p_size > 30),
j AS (SELECT hyp, entry, len(list_intersect(h.tk, e.tk)) / len(list_distinct(list_concat(h.tk, e.tk))) AS jac, h.canonical = e.canonical AS c1, h.skeleton = e.skeleton AS c2, h.sub = e.canonical AS c3 FROM h, e),
m AS (SELECT hyp, entry, CASE WHEN c1 THEN 1.0 WHEN c2 THEN 0.85 WHEN c3 THEN 0.7 WHEN jac >= 0.12 THEN least(jac, 0.6) ELSE 0 END AS s,
             CASE WHEN c1 THEN 'equivalent_expression' WHEN c2 THEN 'equivalent_skeleton' WHEN c3 THEN 'known_corollary' ELSE 'statement_similarity' END AS match FROM j),
b AS (SELECT hyp, max(s) AS similarity, arg_min(entry, (-s, entry)) AS entry, arg_min(match, (-s, entry)) AS match FROM m WHERE s > 0 GROUP BY hyp)
SELECT hyp, round(coalesce(similarity, 0), 6) AS similarity, entry, coalesce(match, 'none') AS match, round(1 - coalesce(similarity, 0), 6) AS novelty FROM h LEFT JOIN b USING (hyp)""")
def f11(t: Tables) -> DataFrame:
    return cd.novelty(_hyps(t), _known(t)).select("hyp", r("similarity").alias("similarity"), "entry", "match", r("novelty").alias("novelty"))


@query("d37_evaluation_assembly", """
WITH hp AS (SELECT l_orderkey AS hyp, l_linenumber AS position, l_partkey AS pattern_id FROM lineitem),
f AS (SELECT hyp, arg_min(pattern_id, (position, pattern_id)) AS cand FROM hp WHERE pattern_id % 3 <> 0 GROUP BY hyp),
hy AS (SELECT DISTINCT hyp FROM hp),
j AS (SELECT hy.hyp, cand, p_size AS complexity, CASE WHEN p_size % 11 = 0 THEN 'inf' WHEN p_size % 7 <> 0 THEN 'ok' END AS g FROM hy LEFT JOIN f USING (hyp) LEFT JOIN part ON p_partkey = cand AND p_partkey % 5 <> 0)
SELECT CASE WHEN cand IS NULL THEN 'no_candidate' WHEN complexity IS NULL THEN 'candidate_not_in_pool' WHEN g IS NULL THEN 'no_fit' WHEN g = 'inf' THEN 'gain_not_finite' ELSE 'evaluated' END AS reason,
       count(*) AS n, CAST(sum(complexity) FILTER (WHERE g = 'ok') AS BIGINT) AS total FROM j GROUP BY 1""")
def d37(t: Tables) -> DataFrame:
    hp = t.lineitem.select(F.col("l_orderkey").alias("hyp"), F.struct("l_linenumber", "l_partkey").alias("position"), F.col("l_partkey").alias("pattern_id"))
    pc = t.part.select(F.col("p_partkey").alias("pattern_id"), F.col("p_partkey").alias("cand")).filter("cand % 3 <> 0")
    cands = t.part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("cand"), F.col("p_size").alias("complexity"))
    fits = t.part.filter("p_size % 7 <> 0 or p_size % 11 = 0").select(F.col("p_partkey").alias("cand"), F.when(F.col("p_size") % 11 == 0, float("inf")).otherwise(F.col("p_retailprice")).alias("gain"))
    stab = t.part.select(F.col("p_partkey").alias("cand"), F.lit(0.9).alias("stability"))
    done, skipped = cd.assemble_evaluations(hp, pc, cands, fits, stab)
    rows = done.select(F.lit("evaluated").alias("reason"), "complexity").unionByName(skipped.select("reason", F.lit(None).cast("int").alias("complexity")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("total"))


# --- acquisition -----------------------------------------------------------------


def cents(value: Column) -> Column:
    """Two decimals by scaling in doubles, as SQL rounds; Spark's own rounding goes by the printed digits."""
    return F.round(value * 100) / 100


def _divergence(t: Tables) -> DataFrame:
    preds = t.lineitem.select(F.col("l_orderkey").alias("obs"), F.col("l_linenumber").alias("hyp"), F.when(F.col("l_quantity") >= 25, F.col("l_extendedprice")).alias("value"))
    obs = t.orders.select(F.col("o_orderkey").alias("obs"), F.when(F.col("o_custkey") % 10 != 0, cents(F.col("o_totalprice") / 1000)).alias("cost"),
                          (F.col("o_orderstatus") == "P").alias("near_boundary"))
    return aq.divergence(preds, obs)


_DIV = """
o AS (SELECT o_orderkey AS obs, CASE WHEN o_custkey % 10 <> 0 THEN round(o_totalprice / 1000, 2) END AS cost, o_orderstatus = 'P' AS near_boundary FROM orders),
a AS (SELECT l_orderkey AS obs, count(*) AS participating, max(l_extendedprice) - min(l_extendedprice) AS s, max(abs(l_extendedprice)) AS m FROM lineitem WHERE l_quantity >= 25 GROUP BY 1),
dv AS (SELECT obs, cost, near_boundary, coalesce(participating, 0) AS participating, CASE WHEN participating >= 2 THEN CASE WHEN s > 1e-12 THEN s ELSE 0 END END AS divergence,
              CASE WHEN participating >= 2 THEN s / (m + 1e-12) END AS normalized, CASE WHEN participating >= 2 THEN s END / cost AS heuristic FROM o LEFT JOIN a USING (obs))"""


@query("e13_prediction_divergence", f"WITH {_DIV} SELECT obs, participating, round(divergence, 4) AS divergence, round(normalized, 6) AS normalized, round(heuristic, 6) AS heuristic FROM dv")
def e13(t: Tables) -> DataFrame:
    return _divergence(t).select("obs", "participating", r("divergence", 4).alias("divergence"), r("normalized").alias("normalized"), r("heuristic").alias("heuristic"))


@query("e13_divergence_report", f"""
WITH {_DIV} SELECT CASE WHEN divergence IS NULL THEN 'undetermined' WHEN divergence = 0 THEN 'unanimous' ELSE 'comparable' END AS kind, cost IS NULL AS unknown_cost, count(*) AS n FROM dv GROUP BY 1, 2""")
def e13_report(t: Tables) -> DataFrame:
    return aq.divergence_report(_divergence(t)).groupBy("kind", "unknown_cost").agg(F.count(F.lit(1)).alias("n"))


@query("e14_acquisition_plan", f"""
WITH RECURSIVE {_DIV}, k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY heuristic IS NULL, heuristic DESC, cost IS NULL, NOT near_boundary, obs) AS rank FROM dv),
u AS MATERIALIZED (SELECT rank, cost FROM k WHERE divergence IS NOT NULL AND cost IS NOT NULL),
p AS (SELECT -1 AS position, 0::BIGINT AS rank, 0.0::DOUBLE AS spent UNION ALL
  SELECT position + 1, min(u.rank), spent + arg_min(cost, u.rank) FROM p JOIN u ON u.rank > p.rank AND spent + cost <= 3000 + 1e-12 WHERE position < 39 GROUP BY position, spent)
SELECT obs, p.position, k.rank, CASE WHEN p.position IS NOT NULL THEN 'selected' WHEN divergence IS NULL THEN 'undetermined' WHEN cost IS NULL THEN 'unknown_cost'
  WHEN k.rank > (SELECT max(rank) FROM p WHERE position = 39) THEN 'over_limit' ELSE 'over_budget' END AS state FROM k LEFT JOIN p ON p.rank = k.rank""")
def e14(t: Tables) -> DataFrame:
    return aq.acquisition_plan(_divergence(t), 40, 3000.0).select("obs", "position", "rank", "state")


@query("e14_unbudgeted_plan", f"""
WITH {_DIV}, k AS (SELECT *, row_number() OVER (ORDER BY heuristic IS NULL, heuristic DESC, cost IS NULL, NOT near_boundary, obs) AS rank FROM dv),
u AS (SELECT obs, row_number() OVER (ORDER BY rank) AS pos FROM k WHERE divergence IS NOT NULL AND cost IS NOT NULL)
SELECT obs, rank, CASE WHEN pos <= 40 THEN 'selected' WHEN divergence IS NULL THEN 'undetermined' WHEN cost IS NULL THEN 'unknown_cost' ELSE 'over_limit' END AS state FROM k LEFT JOIN u USING (obs)""")
def e14_free(t: Tables) -> DataFrame:
    return aq.acquisition_plan(_divergence(t), 40).select("obs", "rank", "state")


@query("c9_plan_catalogue", f"""
WITH {_DIV}, p AS (SELECT obs, 'p' || obs % 5 AS purpose, row_number() OVER (ORDER BY heuristic IS NULL, heuristic DESC, cost IS NULL, NOT near_boundary, obs) AS rank FROM dv),
j AS (SELECT p.*, CASE WHEN obs % 4 = 0 THEN 'obs-design' WHEN purpose IN ('p1', 'p2') THEN 'purpose-' || purpose END AS design FROM p),
q AS (SELECT *, sum(CASE WHEN design IS NOT NULL THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS request FROM j)
SELECT obs, rank, design, CASE WHEN design IS NULL THEN 'no_mapping' WHEN request > 500 THEN 'budget_exhausted' END AS reason FROM q""")
def c9(t: Tables) -> DataFrame:
    plan = aq.acquisition_plan(_divergence(t), 1).select("obs", "rank", F.concat(F.lit("p"), F.col("obs") % 5).alias("purpose"))
    by_obs = t.orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("obs"), F.lit("obs-design").alias("design"))
    by_purpose = t.orders.filter("o_orderkey % 5 in (1, 2)").select(F.concat(F.lit("p"), F.col("o_orderkey") % 5).alias("purpose")).distinct().withColumn("design", F.concat(F.lit("purpose-"), "purpose"))
    return aq.plan_requests(plan, by_obs, by_purpose, None, 500).select("obs", "rank", "design", "reason")


# --- rules -----------------------------------------------------------------------


def _items(t: Tables) -> DataFrame:
    price = F.format_string("%.2f", F.col("l_extendedprice") / F.col("l_quantity"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.when(F.col("l_partkey") % 400 == 0, "12,50").otherwise(price).alias("unit_price"), F.format_string("%.2f", "l_extendedprice").alias("line_amount"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


def _headers(t: Tables, items: DataFrame) -> DataFrame:
    total = items.groupBy("doc").agg((F.sum("cents") / 100).alias("s"))
    o = t.orders.join(total, F.col("o_orderkey") == F.col("doc"), "left")
    return o.select(
        F.col("o_orderkey").alias("doc"), F.lit("1.50").alias("tax"), F.lit("0").alias("shipping"), F.lit("0.50").alias("discount"),
        F.when((F.col("o_orderkey") % 3 == 0) & F.col("s").isNotNull(), F.format_string("%.2f", F.col("s") + 1.0)).when(F.col("o_orderkey") % 3 != 0, F.format_string("%.2f", F.col("o_totalprice"))).alias("total"),
        F.when(F.col("o_custkey") % 13 != 0, F.col("o_orderpriority")).alias("priority"))


def _checks(t: Tables) -> DataFrame:
    items = _items(t)
    headers = _headers(t, items)
    return ru.required_checks(headers, "doc", ["priority", "total"]).unionByName(ru.line_amount_checks(items, "doc", "0.05")).unionByName(
        ru.order_total_checks(headers, items, "doc", "0.02", True))


_CHECKS = """
it AS (SELECT l_orderkey AS doc, l_quantity AS q, CASE WHEN l_partkey % 400 = 0 THEN NULL ELSE CAST(printf('%.2f', l_extendedprice / l_quantity) AS DECIMAL(18,2)) END AS p, CAST(printf('%.2f', l_extendedprice) AS DECIMAL(18,2)) AS a FROM lineitem),
ln AS (SELECT doc, count(*) FILTER (WHERE p IS NOT NULL AND abs(CAST(CAST(q AS INTEGER) * p AS DECIMAL(18,2)) - a) > 0.05) AS bad_lines, bool_and(p IS NOT NULL) AS ok, sum(a) AS s FROM it GROUP BY doc),
h AS (SELECT o_orderkey AS doc, CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 AND s IS NULL THEN 1 ELSE 0 END AS miss, s, CASE WHEN o_orderkey % 3 = 0 THEN s + 1.00 ELSE CAST(printf('%.2f', o_totalprice) AS DECIMAL(18,2)) END AS total FROM orders LEFT JOIN ln ON doc = o_orderkey),
ck AS (SELECT doc, 'required' AS rule, CAST(miss AS BIGINT) AS bad_lines, CASE WHEN miss > 0 THEN 'fail' ELSE 'pass' END AS status FROM h
       UNION ALL SELECT doc, 'line_amounts', bad_lines, CASE WHEN NOT ok THEN 'unknown' WHEN bad_lines > 0 THEN 'fail' ELSE 'pass' END FROM ln
       UNION ALL SELECT doc, 'order_total', 0, CASE WHEN s IS NULL THEN 'unknown' WHEN abs(s + 1.00 - total) <= 0.02 THEN 'pass' ELSE 'fail' END FROM h)"""


@query("b14_rule_checks", f"WITH {_CHECKS} SELECT doc, rule, bad_lines, status FROM ck")
def b14(t: Tables) -> DataFrame:
    return _checks(t).select("doc", "rule", "bad_lines", "status")


@query("b14_accepted", f"""
WITH {_CHECKS} SELECT doc, bool_and(status = 'pass') FILTER (WHERE rule <> 'required') AS accepted, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'unknown') AS unknown FROM ck GROUP BY doc""")
def b14_accepted(t: Tables) -> DataFrame:
    return ru.accept(_checks(t), "doc", ["line_amounts", "order_total"])
