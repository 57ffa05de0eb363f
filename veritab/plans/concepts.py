"""Concept and relation graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import graph as gr
from veritab.plans.registry import Tables, query

_KINDS = ["part_of", "prerequisite", "depends_on", "causes", "explains", "applies_to", "contrasts", "related"]


def relations(t: Tables) -> DataFrame:
    """Relation candidates between parts; ``related`` edges are one per unordered pair."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("l_linenumber") + F.col("l_suppkey")) % 8 + 1).cast("int"))
    # Parts have even ids, suppliers odd ones.
    rows = t.lineitem.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), kind.alias("kind"), "l_discount")
    rel = F.col("kind") == "related"
    rows = rows.select(F.when(rel, F.least("a", "b")).otherwise(F.col("a")).alias("source"), F.when(rel, F.greatest("a", "b")).otherwise(F.col("b")).alias("target"), "kind", "l_discount")
    return rows.filter("source <> target").groupBy("source", "target", "kind").agg(F.max("l_discount").alias("confidence")).select(
        F.concat_ws("-", "source", "target", "kind").alias("id"), "source", "target", "kind", "confidence")


_REL = """
r0 AS (SELECT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b, ['part_of', 'prerequisite', 'depends_on', 'causes', 'explains', 'applies_to', 'contrasts', 'related'][(l_linenumber + l_suppkey) % 8 + 1] AS kind, l_discount FROM lineitem),
r1 AS (SELECT CASE WHEN kind = 'related' THEN least(a, b) ELSE a END AS source, CASE WHEN kind = 'related' THEN greatest(a, b) ELSE b END AS target, kind, l_discount FROM r0),
rl AS (SELECT source || '-' || target || '-' || kind AS id, source, target, kind, max(l_discount) AS confidence FROM r1 WHERE source <> target GROUP BY source, target, kind)"""


@query("e9_sparse_relations", f"""
WITH {_REL},
pr AS (SELECT *, 8 - list_position(['part_of', 'prerequisite', 'depends_on', 'causes', 'explains', 'applies_to', 'contrasts', 'related'], kind) AS p FROM rl),
s AS (SELECT * FROM pr WHERE kind <> 'related' QUALIFY row_number() OVER (PARTITION BY source ORDER BY p DESC, confidence DESC, id) <= 30),
f AS (SELECT * FROM pr WHERE kind = 'related' AND NOT EXISTS (SELECT 1 FROM s WHERE least(s.source, s.target) = pr.source AND greatest(s.source, s.target) = pr.target)),
g AS (SELECT f.*, row_number() OVER (PARTITION BY f.source ORDER BY confidence DESC, id) AS rn, coalesce(used, 0) AS used FROM f LEFT JOIN (SELECT source, count(*) AS used FROM s GROUP BY 1) u USING (source)),
k AS (SELECT id FROM s UNION ALL SELECT id FROM g WHERE rn + used <= 30)
SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN 'kept' WHEN kind = 'related' AND EXISTS (SELECT 1 FROM s WHERE least(s.source, s.target) = pr.source AND greatest(s.source, s.target) = pr.target) THEN 'pair_already_related' ELSE 'over_source_budget' END AS state FROM pr""")
def e9(t: Tables) -> DataFrame:
    kept, omitted = gr.sparse_relations(relations(t), 30)
    return kept.select("id", F.lit("kept").alias("state")).unionByName(omitted.select("id", F.col("reason").alias("state")))


@query("c14_isolated_concepts", """
SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)""")
def c14(t: Tables) -> DataFrame:
    edges = t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return gr.isolated_nodes(t.part.select(F.col("p_partkey").alias("id")), edges)


def concepts(t: Tables) -> DataFrame:
    return t.part.select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" "))).alias("title"), F.col("p_type").alias("kind"),
        F.col("p_brand").alias("scope"), F.concat(F.lit("summary "), F.col("p_partkey")).alias("summary"), _explanation().alias("explanation"), F.array(F.concat(F.lit("size "), F.col("p_size") % 3), F.split("p_type", " ")[0], F.concat(F.lit("size "), F.col("p_size") % 2)).alias("pitfalls"), "p_partkey")


def _explanation():
    """Some mentions say more than others, and some of them what another one holds."""
    size = F.concat(F.lit("size "), F.col("p_size") % 5)
    return F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("comes in "), size, F.lit(" or more"))).when(F.col("p_partkey") % 7 == 0, F.lit("")).when(
        F.col("p_partkey") % 11 == 0, F.lit("or more")).otherwise(size)


_KEY = "'k-' || substr(sha256(trim(lower(p_name)) || '|' || lower(p_type) || '|' || lower(p_brand)), 1, 16)"


@query("f17_concept_merge", f"SELECT {_KEY} AS key, arg_min(p_type, p_partkey) AS kind, 'summary ' || min(p_partkey) AS summary, count(*) AS mentions FROM part GROUP BY 1")
def f17(t: Tables) -> DataFrame:
    nodes, _ = gr.merge_concepts(concepts(t), "p_partkey")
    return nodes.select("key", "kind", "summary", "mentions")


@query("f17_explanations", f"""
WITH e AS (SELECT {_KEY} AS key, CASE WHEN p_partkey % 3 = 0 THEN 'comes in size ' || p_size % 5 || ' or more' WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'or more' ELSE 'size ' || p_size % 5 END AS explanation, p_partkey FROM part),
d AS (SELECT key, explanation, min(p_partkey) AS first_seen FROM e GROUP BY 1, 2)
SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.key = a.key AND b.first_seen < a.first_seen AND contains(b.explanation, a.explanation))""")
def f17_texts(t: Tables) -> DataFrame:
    return gr.merge_concepts(concepts(t), "p_partkey")[1]


@query("f17_list_union", f"""
WITH v AS (SELECT {_KEY} AS key, p_partkey, unnest(range(1, 4)) AS i, unnest(['size ' || p_size % 3, split_part(p_type, ' ', 1), 'size ' || p_size % 2]) AS value FROM part),
f AS (SELECT key, value, min((p_partkey, i)) AS first_ FROM v GROUP BY 1, 2)
SELECT key, 'pitfalls' AS field, value, row_number() OVER (PARTITION BY key ORDER BY first_) AS position FROM f""")
def f17_lists(t: Tables) -> DataFrame:
    return gr.merge_lists(concepts(t), ["pitfalls"], "p_partkey")


def hierarchy(t: Tables) -> DataFrame:
    """region > nation > customer; a few customers name an unknown parent or each other."""
    k = F.col("c_custkey")
    parent = (F.when(k % 97 == 0, "n999").when(k % 101 == 1, F.concat(F.lit("c"), k + 1)).when(k % 101 == 2, F.concat(F.lit("c"), k - 1))
              .otherwise(F.concat(F.lit("n"), F.col("c_nationkey"))))
    reg = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("sort_key"))
    nat = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("sort_key"))
    cus = t.customer.select(F.concat(F.lit("c"), k).alias("id"), parent.alias("parent"), F.col("c_name").alias("sort_key"))
    return reg.unionByName(nat).unionByName(cus)


_HIER = """
nd AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS sort_key FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
       UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'n999' WHEN c_custkey % 101 = 1 THEN 'c' || (c_custkey + 1) WHEN c_custkey % 101 = 2 THEN 'c' || (c_custkey - 1) ELSE 'n' || c_nationkey END, c_name FROM customer)"""


@query("f18_hierarchy_checks", f"""
WITH RECURSIVE {_HIER},
ed AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS source, 'c' || (o_custkey * 7 % 1600) AS target FROM orders),
w AS (SELECT id, parent AS ancestor, 1 AS d FROM nd WHERE parent IS NOT NULL UNION ALL SELECT w.id, nd.parent, d + 1 FROM w JOIN nd ON nd.id = w.ancestor WHERE nd.parent IS NOT NULL AND d < 12)
SELECT 'unknown_parent' AS problem, id FROM nd WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM nd)
UNION ALL SELECT DISTINCT 'cycle', id FROM w WHERE id = ancestor
UNION ALL SELECT DISTINCT 'too_deep', id FROM w WHERE d >= 12
UNION ALL SELECT 'bad_edge', id FROM ed WHERE source NOT IN (SELECT id FROM nd) OR target NOT IN (SELECT id FROM nd) OR source = target""")
def f18(t: Tables) -> DataFrame:
    edges = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("edge_id"), F.concat(F.lit("c"), "o_custkey").alias("source"),
                            F.concat(F.lit("c"), F.col("o_custkey") * 7 % 1600).alias("target"))
    return gr.hierarchy_problems(hierarchy(t), edges)


@query("f19_hierarchy_walk", f"""
WITH RECURSIVE {_HIER},
w AS (SELECT id, 0 AS depth, sort_key AS path FROM nd WHERE parent IS NULL UNION ALL SELECT nd.id, depth + 1, path || '/' || nd.sort_key FROM nd JOIN w ON nd.parent = w.id)
SELECT id, depth, path FROM w""")
def f19(t: Tables) -> DataFrame:
    return gr.hierarchy_walk(hierarchy(t)).orderBy("path").select("id", "depth", F.array_join("path", "/").alias("path"))


@query("f20_backbone")
def f20(t: Tables) -> DataFrame:
    rel = relations(t)
    rank = F.struct((-gr.priority(F.col("kind"))).alias("p"), (-F.col("confidence")).alias("c"), F.col("id"))
    edges = rel.select("id", "source", "target", rank.alias("rank"))
    return gr.spanning_backbone(edges)


def concept_candidates(t: Tables) -> DataFrame:
    label = F.split("text", r"[ \n]")[0]
    return t.documents.select(
        F.concat(F.lit("c"), "doc_id").alias("id"), label.alias("label"), F.col("lang").alias("definition"), F.col("source").alias("section_id"),
        F.when(F.col("doc_id") % 6 == 0, F.substring("text", 30, 40)).otherwise(F.substring("text", 1, 60)).alias("quote"), "doc_id")


_NORM = r"replace(lower(regexp_replace({0}, '\s+', '', 'g')), 'ß', 'ss')"
_CC = r"""
cc AS (SELECT 'c' || doc_id AS id, doc_id, string_split_regex(text, '[ \n]')[1] AS label, lang AS definition, source AS section_id, CASE WHEN doc_id % 6 = 0 THEN substr(text, 30, 40) ELSE substr(text, 1, 60) END AS quote FROM documents),
cn AS (SELECT *, """ + _NORM.format("label") + " AS nl, " + _NORM.format("definition") + " AS ndf, " + _NORM.format("quote") + " AS nq FROM cc)"


@query("f21_concept_validation", f"""
WITH {_CC} SELECT arg_min(id, doc_id) AS id, arg_min(label, doc_id) AS label, count(DISTINCT section_id) AS sections, count(*) AS merged, 'kept' AS state FROM cn WHERE contains(nq, nl) GROUP BY nl, ndf
UNION ALL SELECT id, label, 0, 0, 'label_not_in_evidence' FROM cn WHERE NOT contains(nq, nl)""")
def f21(t: Tables) -> DataFrame:
    kept, rejected = gr.validate_concepts(concept_candidates(t), "doc_id")
    zero = F.lit(0).cast("long")
    return kept.select("id", "label", "sections", "merged", F.lit("kept").alias("state")).unionByName(
        rejected.select("id", "label", zero.alias("sections"), zero.alias("merged"), F.col("reason").alias("state")))


def relation_candidates(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    first = F.split("text", r"[ \n]")[0]
    nxt = t.documents.select((d - 1).alias("doc_id"), first.alias("next_label"))
    return t.documents.select("doc_id", first.alias("label")).join(nxt, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("c"), d).alias("source"), F.when(d % 7 == 0, F.concat(F.lit("c"), d)).otherwise(F.concat(F.lit("c"), d + 1)).alias("target"),
        F.when(d % 2 == 0, "related").otherwise("causes").alias("kind"),
        F.when(d % 5 == 0, F.col("label")).when(d % 11 == 0, "x").otherwise(F.concat_ws(" meets ", "label", "next_label")).alias("quote"))


@query("f21_relation_validation", f"""
WITH {_CC},
rc AS (SELECT a.doc_id, a.id AS source, CASE WHEN a.doc_id % 7 = 0 THEN a.id ELSE 'c' || (a.doc_id + 1) END AS target, CASE WHEN a.doc_id % 2 = 0 THEN 'related' ELSE 'causes' END AS kind,
         CASE WHEN a.doc_id % 5 = 0 THEN a.label WHEN a.doc_id % 11 = 0 THEN 'x' WHEN b.label IS NULL THEN a.label ELSE a.label || ' meets ' || b.label END AS quote FROM cn a LEFT JOIN cn b ON b.doc_id = a.doc_id + 1),
j AS (SELECT rc.*, s.nl AS ls, g.nl AS lt, {_NORM.format("rc.quote")} AS nq FROM rc LEFT JOIN cn s ON s.id = rc.source LEFT JOIN cn g ON g.id = rc.target)
SELECT doc_id, coalesce(CASE WHEN ls IS NULL OR lt IS NULL THEN 'unknown_endpoint' WHEN source = target THEN 'self_loop' WHEN length(nq) < 2 THEN 'no_evidence' WHEN NOT (contains(nq, ls) AND contains(nq, lt)) THEN 'evidence_misses_label' END, 'kept') AS state FROM j""")
def f21_relations(t: Tables) -> DataFrame:
    concepts_ = concept_candidates(t).select("id", "label")
    kept, rejected = gr.validate_relations(relation_candidates(t), concepts_, "doc_id")
    return kept.select("doc_id", F.lit("kept").alias("state")).unionByName(rejected.select("doc_id", F.col("reason").alias("state")))


def _selection(t: Tables) -> tuple[DataFrame, DataFrame]:
    cands = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), "p_partkey")
    sel = t.part.filter("p_size > 10").select(
        F.when(F.col("p_partkey") % 90 == 1, F.concat(F.lit("q"), "p_partkey")).otherwise(F.concat(F.lit("p"), "p_partkey")).alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("p"), F.col("p_partkey") - F.col("p_partkey") % 30)).otherwise(F.concat(F.lit("p"), "p_partkey")).alias("merged_into"))
    again = t.part.filter("p_partkey % 45 = 4 and p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("merged_into"))
    return cands, sel.unionByName(again)


@query("f22_key_selection", """
WITH c AS (SELECT 'p' || p_partkey AS id, lower(replace(p_name, ' ', '')) AS label FROM part),
s AS (SELECT CASE WHEN p_partkey % 90 = 1 THEN 'q' ELSE 'p' END || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey - p_partkey % 30) ELSE 'p' || p_partkey END AS into_ FROM part WHERE p_size > 10
      UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_partkey % 45 = 4 AND p_size > 10),
v AS (SELECT id, 'unknown_id' AS v FROM s WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'used_twice' FROM s GROUP BY id HAVING count(*) > 1
      UNION ALL SELECT s.id, 'label_mismatch' FROM s JOIN c USING (id) LEFT JOIN c d ON d.id = into_ WHERE c.label IS DISTINCT FROM d.label),
k AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM v))
SELECT v AS state, id, 1::BIGINT AS members FROM v
UNION ALL SELECT 'selected', into_, count(*) FROM k GROUP BY into_
UNION ALL SELECT 'not_selected', id, 1 FROM c WHERE id NOT IN (SELECT id FROM k)""")
def f22(t: Tables) -> DataFrame:
    selected, omitted, bad = gr.choose_key(*_selection(t))
    one = F.lit(1).cast("long")
    return selected.select(F.lit("selected").alias("state"), "id", "members").unionByName(
        omitted.select(F.col("reason").alias("state"), "id", one.alias("members"))).unionByName(
        bad.select(F.col("violation").alias("state"), "id", one.alias("members")))
