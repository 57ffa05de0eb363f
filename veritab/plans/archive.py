"""Quality, evidence registry and knowledge-version queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators import evidence as evd
from veritab.operators import graph as gr
from veritab.operators import quality as q
from veritab.plans.common import r
from veritab.plans.registry import Tables, query
from veritab.session import sized_join, spread
from veritab.sources import sinks

SPEC = q.ObservationSpec(
    fields={
        "quantity": q.FieldSpec("integer", unit="each", minimum=2, maximum=48, range_action="flag"),
        "discount": q.FieldSpec("number", unit="share", maximum=0.09, range_action="exclude"),
        "tax": q.FieldSpec("number", unit="share", required=False),
        "status": q.FieldSpec("string", role="context", categories=("O",)),
        "price": q.FieldSpec("number", role="target", unit="money", maximum=100000, range_action="quarantine"),
    },
    group_fields=("supplier",), environments=("A", "N"), missing_codes=(0.0,),
)


def records(t: Tables) -> DataFrame:
    """Order lines as observation records, with unit conflicts, gaps and repeats in them."""
    li = t.lineitem
    box = F.col("l_partkey") % 50 == 0
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.create_map(F.lit("supplier"), F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey").cast("string"))).alias("group_ids"),
        F.col("l_returnflag").alias("environment"),
        F.when(F.col("l_linenumber") < 7, F.col("l_shipdate")).alias("event_time"),
        F.expr("l_shipdate + interval 3 days").alias("prediction_time"),
        (F.col("l_shipdate") + F.make_dt_interval(F.round(F.col("l_tax") * 100).cast("int"))).alias("available_time"),
        F.when((F.col("l_tax") == 0.03) & (F.col("l_discount") == 0.02), "").otherwise("line").alias("source"),
        F.struct(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                 F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price")).alias("values"),
        F.create_map(F.lit("quantity"), F.when(box, "box").otherwise("each"), F.lit("discount"), F.lit("share"),
                     F.lit("tax"), F.when(F.col("l_tax") != 0, "share"), F.lit("price"), F.lit("money")).alias("units"),
        F.concat_ws("|", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("int")).alias("content"),
        "l_partkey", "l_orderkey",
    )


def assessed(t: Tables) -> DataFrame:
    return q.assess_records(records(t), SPEC, F.col("content"))


_RULES = [
    ("l_suppkey % 17 = 0", 3, "unresolved_group_identity"), ("l_returnflag = 'R'", 2, "environment_outside_scope"),
    ("l_linenumber >= 7", 3, "invalid_event_time"), ("l_tax = 0.03 AND l_discount = 0.02", 3, "missing_source"),
    ("l_partkey % 50 = 0", 3, "unit_conflict:quantity"),
    ("l_quantity < 2 OR l_quantity > 48", 1, "out_of_range:quantity"), ("late", 3, "feature_unavailable_at_prediction:quantity"),
    ("l_discount = 0", 3, "missing:discount"), ("l_discount > 0.09", 2, "out_of_range:discount"),
    ("late AND l_discount <> 0", 3, "feature_unavailable_at_prediction:discount"),
    ("l_tax = 0", 1, "missing:tax"), ("late AND l_tax <> 0", 3, "feature_unavailable_at_prediction:tax"),
    ("l_linestatus <> 'O'", 3, "unknown_category:status"),
    ("l_extendedprice > 100000", 3, "out_of_range:price"), ("late", 1, "target_available_after_prediction:price"),
    ("dup_id", 3, "duplicate_record_id"), ("dup_content", 3, "duplicate_content"),
]
_ASSESSED = """
base AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS record_id, round(l_tax * 100) > 3 AS late,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup_id,
         count(*) OVER (PARTITION BY l_suppkey, round(l_extendedprice * 100), CAST(l_quantity AS INTEGER)) > 1 AS dup_content
  FROM lineitem),
assessed AS (
  SELECT *, list_sort(list_filter([""" + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, _, m in _RULES) + """], lambda x: x IS NOT NULL)) AS reasons,
         CASE greatest(0, """ + ", ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for c, s, _ in _RULES) + """)
              WHEN 0 THEN 'usable' WHEN 1 THEN 'flagged' WHEN 2 THEN 'excluded' ELSE 'quarantined' END AS status
  FROM base)"""


@query("b2_quality_assessment", f"""
WITH {_ASSESSED} SELECT status, array_to_string(reasons, ',') AS reasons, count(*) AS n FROM assessed GROUP BY 1, 2""")
def b2(t: Tables) -> DataFrame:
    return assessed(t).groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("b3_duplicate_marking", f"""
WITH {_ASSESSED} SELECT record_id, dup_id, dup_content, count(*) AS n FROM assessed WHERE dup_id OR dup_content GROUP BY 1, 2, 3""")
def b3(t: Tables) -> DataFrame:
    marked = q.mark_duplicates(records(t), "record_id", "content")
    return marked.filter("dup_id or dup_content").groupBy("record_id", "dup_id", "dup_content").agg(F.count(F.lit(1)).alias("n"))


@query("b4_typed_missing", """
SELECT count(*) FILTER (WHERE l_discount = 0) AS discount, count(*) FILTER (WHERE l_tax = 0) AS tax,
       0::BIGINT AS quantity, 0::BIGINT AS status FROM lineitem""")
def b4(t: Tables) -> DataFrame:
    df = records(t)
    return df.agg(*[F.count_if(q.is_missing(df, n, (0.0, 0, False))).alias(n) for n in ("discount", "tax", "quantity", "status")])


@query("b5_sample_preparation", f"""
WITH {_ASSESSED},
raw AS (SELECT status, CASE WHEN l_partkey % 30 = 0 THEN 'NA' WHEN l_partkey % 31 = 0 THEN 'many' ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
        l_discount AS discount, CASE WHEN l_orderkey % 40 <> 0 THEN l_extendedprice END AS price FROM assessed),
c AS (SELECT CASE WHEN status IN ('quarantined', 'excluded') THEN 'status:' || status WHEN quantity = 'NA' THEN 'missing:quantity'
                  WHEN quantity = 'many' THEN 'not_numeric:quantity' WHEN price IS NULL THEN 'missing:price' ELSE 'kept' END AS cause,
             quantity, discount, price FROM raw)
SELECT cause, count(*) AS n, round(sum(CASE WHEN cause = 'kept' THEN price * CAST(quantity AS DOUBLE) END), 2) AS total FROM c GROUP BY 1""")
def b5(t: Tables) -> DataFrame:
    raw = assessed(t).select(
        "status", F.when(F.col("l_partkey") % 30 == 0, "NA").when(F.col("l_partkey") % 31 == 0, "many")
        .otherwise(F.col("values.quantity").cast("string")).alias("quantity"), F.col("values.discount").alias("discount"),
        F.when(F.col("l_orderkey") % 40 != 0, F.col("values.price")).alias("price"))
    out = q.prepare_sample(raw, ["quantity", "discount"], "price")
    return out.groupBy("cause").agg(F.count(F.lit(1)).alias("n"), r(
        F.sum(F.when(F.col("cause") == "kept", F.col("v_price") * F.col("v_quantity"))), 2).alias("total"))


@query("d22_quality_report", f"""
WITH {_ASSESSED}
SELECT 'records' AS item, count(*) AS n FROM assessed
UNION ALL SELECT 'status:' || s, count(*) FILTER (WHERE status = s) FROM assessed, (VALUES ('usable'), ('flagged'), ('excluded'), ('quarantined')) v(s) GROUP BY s
UNION ALL SELECT 'missing:' || f, CASE f WHEN 'discount' THEN count(*) FILTER (WHERE l_discount = 0) WHEN 'tax' THEN count(*) FILTER (WHERE l_tax = 0) ELSE 0 END
  FROM assessed, (VALUES ('quantity'), ('discount'), ('tax'), ('status'), ('price')) v(f) GROUP BY f
UNION ALL SELECT 'unit_conflict:' || f, count(*) FILTER (WHERE f = 'quantity' AND l_partkey % 50 = 0)
  FROM assessed, (VALUES ('quantity'), ('discount'), ('tax'), ('status'), ('price')) v(f) GROUP BY f
UNION ALL SELECT 'duplicate_record_id', count(*) FILTER (WHERE dup_id) FROM assessed
UNION ALL SELECT 'duplicate_content', count(*) FILTER (WHERE dup_content) FROM assessed
UNION ALL SELECT 'unresolved_rows', count(*) FILTER (WHERE l_suppkey % 17 = 0) FROM assessed
UNION ALL SELECT 'unique_identities', count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey % 17 <> 0) FROM assessed
UNION ALL SELECT 'environment:' || l_returnflag, count(*) FROM assessed GROUP BY l_returnflag""")
def d22(t: Tables) -> DataFrame:
    return q.quality_report(assessed(t), SPEC, q.identify(records(t), SPEC))


@query("b17_numeric_variables", """
SELECT name FROM (VALUES ('discount'), ('line'), ('quantity'), ('tax')) v(name)""")
def b17(t: Tables) -> DataFrame:
    payload = t.lineitem.select(F.create_map(
        F.lit("quantity"), F.col("l_quantity").cast("string"), F.lit("discount"), F.col("l_discount").cast("string"),
        F.lit("tax"), F.col("l_tax").cast("string"), F.lit("flag"), F.col("l_returnflag"), F.lit("line"),
        F.col("l_linenumber").cast("string"), F.lit("2nd"), F.lit("1"),
        F.lit("price"), F.col("l_extendedprice").cast("string")).alias("values"))
    return q.numeric_variables(payload, "values", "price")


# Identity tables: every line has a fingerprint and a sampling unit (order).
_CANON = "l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)"


def _lines(t: Tables) -> DataFrame:
    canon = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return t.lineitem.select(
        F.sha2(canon, 256).alias("fingerprint"), F.concat(F.lit("order|"), F.col("l_orderkey")).alias("unit_key"),
        F.col("l_shipdate").alias("event_time"), F.col("l_returnflag").alias("env"), "l_linenumber", "l_partkey")


def _registered(t: Tables) -> DataFrame:
    return _lines(t).filter("l_linenumber <= 3")


def _units(t: Tables) -> DataFrame:
    return _registered(t).groupBy("unit_key").agg(
        F.lit("p1").alias("protocol_id"), F.max("event_time").alias("latest_time"))


_REG = f"""
lines AS (SELECT sha256({_CANON}) AS fingerprint, 'order|' || l_orderkey AS unit_key, l_shipdate AS event_time, l_linenumber, l_returnflag AS env, l_partkey FROM lineitem),
reg AS (SELECT * FROM lines WHERE l_linenumber <= 3),
units AS (SELECT unit_key, max(event_time) AS latest_time FROM reg GROUP BY 1),
batch AS (SELECT * FROM lines WHERE l_linenumber > 3 OR l_partkey % 100 = 0)"""


def _batch(t: Tables) -> DataFrame:
    return _lines(t).filter("l_linenumber > 3 or l_partkey % 100 = 0")


@query("c3_evidence_anti_join", f"""
WITH {_REG},
u AS (SELECT unit_key, count(*) AS n, min(event_time) AS first_time FROM batch GROUP BY 1)
SELECT 'content' AS kind, fingerprint AS key, count(*) AS n FROM batch WHERE fingerprint IN (SELECT fingerprint FROM reg) GROUP BY 2
UNION ALL SELECT 'unit', u.unit_key, n FROM u JOIN units USING (unit_key) WHERE NOT first_time > latest_time""")
def c3(t: Tables) -> DataFrame:
    return evd.reuse_conflicts(_batch(t), _registered(t), _units(t), "p1", temporal=True)


@query("c3_units_after_append", f"""
WITH {_REG},
n AS (SELECT unit_key, max(event_time) AS t FROM batch GROUP BY 1)
SELECT unit_key, CASE WHEN units.unit_key IS NULL THEN 'p2' ELSE 'p1' END AS protocol_id, CAST(epoch(greatest(latest_time, t)) AS BIGINT) AS latest_time
FROM units FULL JOIN n USING (unit_key)""")
def c3_units(t: Tables) -> DataFrame:
    return evd.register_units(_batch(t), _units(t), "p2").withColumn("latest_time", F.unix_timestamp("latest_time"))


@query("c4_unit_reservation", """
WITH ledger AS (SELECT DISTINCT l_returnflag AS dataset, l_suppkey AS unit FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
req AS (SELECT DISTINCT l_returnflag AS dataset, l_suppkey AS unit FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')
SELECT dataset, unit FROM req SEMI JOIN ledger USING (dataset, unit)""")
def c4(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("unit"), "l_shipdate")
    _, conflicts = evd.reserve_units(rows.filter("l_shipdate >= '1998-06-01'"), rows.filter("l_shipdate < '1996-01-01'"), ["dataset", "unit"])
    return conflicts


@query("f3_connected_components", """
WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey AS node, l_partkey || '|' || CAST(epoch(l_shipdate) AS BIGINT) AS key FROM lineitem),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b USING (key)),
w AS (SELECT a AS node, a AS reach FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.reach)
SELECT CAST(node AS VARCHAR) AS node, min(CAST(reach AS VARCHAR)) AS component FROM w GROUP BY node""")
def f3(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_orderkey").cast("string").alias("node"),
                              F.concat_ws("|", "l_partkey", F.unix_timestamp("l_shipdate")).alias("key")).distinct()
    return gr.shared_key_components(pairs, "node", "key")


@query("d33_data_profile", f"""
WITH rows_ AS (SELECT l_returnflag AS env, sha256({_CANON}) AS d FROM lineitem),
dd AS (SELECT env, d, count(*) AS n FROM rows_ GROUP BY 1, 2),
bk AS (SELECT env, substr(d, 1, 2) AS b, sum(n) AS n,
              sum(CAST(CAST('0x' || substr(sha256(d || ':' || n), 1, 12) AS BIGINT) AS HUGEINT)) AS x FROM dd GROUP BY 1, 2)
SELECT env, sha256(string_agg(b || ':' || CAST(n AS VARCHAR) || ':' || CAST(x AS VARCHAR), '|' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS record_count
FROM bk GROUP BY env""")
def d33(t: Tables) -> DataFrame:
    return sinks.table_digest(_lines(t), "fingerprint", ["env"])


def ledger(t: Tables) -> DataFrame:
    """Hash chains of at most 1000 events (user and id block); large values were altered after hashing."""
    ev = t.events.select(
        F.concat_ws("|", "user_id", F.expr("event_id div 1000")).alias("ledger_id"), "event_id",
        F.concat_ws("|", "event_type", "props").alias("body"), "value")
    seq = Window.partitionBy("ledger_id").orderBy("event_id")
    rows = ev.withColumn("seq", F.row_number().over(seq).cast("long"))
    chains = rows.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_id", "body", "value"))).alias("es"))
    zero = F.lit(evd.ZERO_HASH)
    chain = F.aggregate("es", F.array(zero), lambda acc, e: F.concat(acc, F.array(F.sha2(
        F.concat_ws("|", F.element_at(acc, -1), e["seq"].cast("string"), e["body"]), 256))))
    out = chains.withColumn("hs", chain).select("ledger_id", F.posexplode("es").alias("i", "e"), "hs")
    return out.select(
        "ledger_id", "e.seq", "e.event_id", F.col("hs")[F.col("i")].alias("prev_hash"), F.col("hs")[F.col("i") + 1].alias("event_hash"),
        F.when(F.col("e.value") > 300, F.concat("e.body", F.lit("*"))).otherwise(F.col("e.body")).alias("body"))


@query("e17_hash_chain", """
WITH RECURSIVE ev AS (
  SELECT user_id || '|' || event_id // 1000 AS ledger_id, event_id, event_type || '|' || props AS body, value,
         row_number() OVER (PARTITION BY user_id || '|' || event_id // 1000 ORDER BY event_id) AS seq FROM events),
ch AS (
  SELECT ledger_id, seq, event_id, body, value, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || seq || '|' || body) AS h FROM ev WHERE seq = 1
  UNION ALL SELECT ev.ledger_id, ev.seq, ev.event_id, ev.body, ev.value, ch.h, sha256(ch.h || '|' || ev.seq || '|' || ev.body)
  FROM ch JOIN ev ON ev.ledger_id = ch.ledger_id AND ev.seq = ch.seq + 1)
SELECT event_id, seq, prev AS prev_hash, h AS event_hash, true AS seq_ok, true AS link_ok, value <= 300 AS hash_ok FROM ch""")
def e17(t: Tables) -> DataFrame:
    return evd.verify_chain(ledger(t), ["ledger_id"]).select(
        "event_id", "seq", "prev_hash", "event_hash", "seq_ok", "link_ok", "hash_ok")


def entries(t: Tables) -> DataFrame:
    """Archive entries: hypothesis = supplier, round = year, status by mean discount.

    A mean that lies on a bound is moved off it by the rounding of its sum; such sums are taken in the order the lines are stored in.
    """
    stored = t.spark.read.parquet(t.path("lineitem")).select("*", "_metadata.file_name", "_metadata.row_index")
    lines = spread(stored.withColumn("hyp", F.col("l_suppkey")).withColumn("round", F.year("l_shipdate")))
    agg = lines.groupBy("hyp", "round").agg(
        F.avg("l_discount").alias("m"), F.count(F.lit(1)).alias("record_count"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") == 50, F.concat(F.lit("env"), F.col("l_partkey") % 5)))).alias("environments"))
    on_bound = agg.filter((F.abs(F.col("m") - 0.051) < 1e-9) | (F.abs(F.col("m") - 0.046) < 1e-9)).select("hyp", "round")
    values = F.array_sort(F.collect_list(F.struct("file_name", "row_index", "l_discount")))
    in_order = sized_join(lines, on_bound, ["hyp", "round"]).groupBy("hyp", "round").agg(
        (F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x["l_discount"], F.lit(0.0))) / F.count("l_discount")).alias("ordered"))
    d = F.coalesce("ordered", "m")
    return agg.join(in_order, ["hyp", "round"], "left").select(
        "hyp", "round", F.when(d > 0.051, "supported").when(d < 0.046, "refuted").when(F.col("hyp") % 13 == 0, "failed")
        .otherwise("inconclusive").alias("status"),
        F.when(d > 0.051, F.when(F.col("round") % 2 == 0, "E1").otherwise("E2")).otherwise("E0").alias("grade"),
        F.concat_ws("|", "hyp", (F.col("round") % 3)).alias("data_identity"),
        F.concat_ws("#", "hyp", (F.col("round") % 4)).alias("evidence_identity"), "environments", "record_count")


_LAST = 1999
_ENTRIES = """
en0 AS (
  SELECT l_suppkey AS hyp, CAST(year(l_shipdate) AS INTEGER) AS round, avg(l_discount) AS d, count(*) AS record_count,
         list_sort(list_distinct(list('env' || l_partkey % 5) FILTER (WHERE l_quantity = 50))) AS environments
  FROM lineitem GROUP BY 1, 2),
en AS (
  SELECT hyp, round, CASE WHEN d > 0.051 THEN 'supported' WHEN d < 0.046 THEN 'refuted' WHEN hyp % 13 = 0 THEN 'failed' ELSE 'inconclusive' END AS status,
         CASE WHEN d > 0.051 THEN CASE WHEN round % 2 = 0 THEN 'E1' ELSE 'E2' END ELSE 'E0' END AS grade,
         hyp || '|' || round % 3 AS data_identity, hyp || '#' || round % 4 AS evidence_identity, environments, record_count FROM en0),
nw AS (SELECT * FROM en WHERE round = 1999), ar AS (SELECT * FROM en WHERE round < 1999),
retired AS (SELECT DISTINCT l_suppkey AS hyp FROM lineitem WHERE l_suppkey % 10 = 3),
changed AS (SELECT DISTINCT l_suppkey AS hyp FROM lineitem WHERE l_suppkey % 4 = 1)"""


def _split_rounds(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.once("entries", lambda: entries(t))
    return e.filter(F.col("round") == _LAST), e.filter(F.col("round") < _LAST)


def _suppliers(t: Tables, mod: int, rest: int) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("hyp")).filter(F.col("hyp") % mod == rest)


@query("f13_evidence_grade", f"""
WITH {_ENTRIES},
pe AS (SELECT DISTINCT hyp, unnest(environments) AS env FROM ar WHERE grade IN ('E1', 'E2')),
ne AS (SELECT DISTINCT n.hyp FROM (SELECT hyp, unnest(environments) AS env FROM nw) n ANTI JOIN pe USING (hyp, env)),
b AS (
  SELECT hyp, status, CASE WHEN status <> 'supported' THEN 'not_supported'
     WHEN EXISTS (SELECT 1 FROM ar WHERE ar.hyp = nw.hyp AND ar.data_identity = nw.data_identity) THEN 'reused_seen_data'
     WHEN NOT EXISTS (SELECT 1 FROM ar WHERE ar.hyp = nw.hyp AND ar.grade IN ('E1', 'E2')) THEN 'first_confirmation'
     WHEN hyp IN (SELECT hyp FROM ne) THEN 'new_environment' ELSE 'new_sample' END AS basis FROM nw)
SELECT hyp, status, basis, CASE basis WHEN 'not_supported' THEN 'E0' WHEN 'reused_seen_data' THEN 'E0' WHEN 'first_confirmation' THEN 'E1' ELSE 'E2' END AS grade FROM b""")
def f13(t: Tables) -> DataFrame:
    new, old = _split_rounds(t)
    return evd.grade_new(new.drop("grade"), old).select("hyp", "status", "basis", "grade")


@query("f14_version_update", f"""
WITH {_ENTRIES}
SELECT rule, hyp, n FROM (
  SELECT 'evidence_identity_reused' AS rule, hyp, count(*) AS n FROM nw WHERE evidence_identity IN (SELECT evidence_identity FROM ar) GROUP BY hyp
  UNION ALL SELECT 'seen_data', hyp, count(*) FROM nw WHERE grade <> 'E0' AND EXISTS (SELECT 1 FROM ar WHERE ar.hyp = nw.hyp AND ar.data_identity = nw.data_identity) GROUP BY hyp
  UNION ALL SELECT 'second_e1', hyp, count(*) FROM nw WHERE grade = 'E1' AND hyp IN (SELECT hyp FROM ar WHERE grade = 'E1') GROUP BY hyp
  UNION ALL SELECT 'e2_without_e1', hyp, count(*) FROM nw WHERE grade = 'E2' AND hyp NOT IN (SELECT hyp FROM ar WHERE grade = 'E1') GROUP BY hyp)""")
def f14(t: Tables) -> DataFrame:
    return evd.version_violations(*_split_rounds(t))


@query("f15_keep_revise_retire", f"""
WITH {_ENTRIES},
l AS (SELECT hyp, arg_max(status, round) AS latest_status FROM en GROUP BY hyp)
SELECT hyp, latest_status, CASE WHEN hyp IN (SELECT hyp FROM retired) OR (latest_status = 'refuted' AND hyp NOT IN (SELECT hyp FROM changed)) THEN 'retire'
       WHEN hyp IN (SELECT hyp FROM changed) THEN 'revise' ELSE 'keep' END AS decision FROM l""")
def f15(t: Tables) -> DataFrame:
    return evd.decide(entries(t), _suppliers(t, 10, 3), _suppliers(t, 4, 1))


@query("d41_knowledge_lookups", f"""
WITH {_ENTRIES}
SELECT hyp, max(grade) AS highest_grade, arg_max(status, round) AS latest_status, max(round) AS latest_round,
       count(DISTINCT data_identity) AS seen_data, count(DISTINCT evidence_identity) AS seen_evidence,
       CASE WHEN hyp NOT IN (SELECT hyp FROM retired) THEN max(grade) END AS active_grade FROM en GROUP BY hyp""")
def d41(t: Tables) -> DataFrame:
    return evd.lookups(entries(t), _suppliers(t, 10, 3))


@query("c12_regularities", f"""
WITH {_ENTRIES}
SELECT hyp, round, status, grade, evidence_identity NOT IN (SELECT evidence_identity FROM ar) AS is_new
FROM en WHERE status = 'refuted' OR (status = 'supported' AND grade IN ('E1', 'E2'))""")
def c12(t: Tables) -> DataFrame:
    _, old = _split_rounds(t)
    return evd.regularities(entries(t), old).select("hyp", "round", "status", "grade", "is_new")


@query("c13_evidence_freshness", f"""
WITH {_ENTRIES},
prop AS (SELECT hyp, data_identity AS identity FROM nw UNION ALL SELECT hyp, evidence_identity FROM nw),
used AS (SELECT DISTINCT hyp, data_identity AS identity FROM ar UNION SELECT DISTINCT hyp, evidence_identity FROM ar)
SELECT hyp, identity FROM prop SEMI JOIN used USING (hyp, identity)""")
def c13(t: Tables) -> DataFrame:
    new, old = _split_rounds(t)
    prop = new.select("hyp", F.col("data_identity").alias("identity")).union(new.select("hyp", "evidence_identity"))
    return evd.stale_proposals(prop, old)


@query("f16_open_questions", f"""
WITH {_ENTRIES},
best AS (SELECT hyp, max(grade) AS g, bool_or(status = 'supported') AS s FROM ar GROUP BY hyp)
SELECT hyp, 'unresolved:' || status AS reason FROM nw WHERE status IN ('inconclusive', 'failed')
UNION SELECT hyp, 'grade_e0' FROM best WHERE g = 'E0'
UNION SELECT hyp, 'retired_without_support' FROM retired WHERE hyp NOT IN (SELECT hyp FROM best WHERE s)
UNION SELECT s_suppkey, 'identification_gap' FROM supplier WHERE s_suppkey % 20 = 2
UNION SELECT s_suppkey, 'pending' FROM supplier WHERE s_suppkey % 25 = 4""")
def f16(t: Tables) -> DataFrame:
    new, old = _split_rounds(t)
    return evd.open_questions(new, old, _suppliers(t, 10, 3), _suppliers(t, 20, 2), _suppliers(t, 25, 4))


@query("c10_family_completeness", """
WITH d AS (SELECT DISTINCT l_suppkey AS hyp, l_returnflag AS metric, l_linestatus AS subgroup FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 20),
g AS (SELECT DISTINCT l_suppkey AS hyp, l_returnflag AS metric, l_linestatus AS subgroup FROM lineitem WHERE l_linenumber = 2 AND l_quantity < 30)
SELECT hyp, metric, subgroup, CASE WHEN d.rowid_ IS NULL THEN 'unexpected' WHEN g.rowid_ IS NULL THEN 'missing' ELSE 'present' END AS state
FROM (SELECT *, 1 AS rowid_ FROM d) d FULL JOIN (SELECT *, 1 AS rowid_ FROM g) g USING (hyp, metric, subgroup)""")
def c10(t: Tables) -> DataFrame:
    keys = ["hyp", "metric", "subgroup"]
    rows = t.lineitem.select(F.col("l_suppkey").alias("hyp"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("subgroup"), "l_linenumber", "l_quantity")
    return evd.family_coverage(rows.filter("l_linenumber = 1 and l_quantity > 20"), rows.filter("l_linenumber = 2 and l_quantity < 30"), keys)


@query("d42_reason_counts", """
WITH codes AS (SELECT DISTINCT p_type || '-' || p_brand AS code FROM part),
f AS (SELECT p_type || '-' || p_brand AS code, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1)
SELECT code, coalesce(n, 0) AS n FROM codes LEFT JOIN f USING (code)""")
def d42(t: Tables) -> DataFrame:
    rows = t.part.select(F.concat_ws("-", "p_type", "p_brand").alias("code"), "p_size")
    return evd.reason_counts(rows.select("code").distinct(), rows.filter("p_size > 45"), "code")


def label_versions(t: Tables) -> DataFrame:
    """One version per order of a customer, numbered by day."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    return t.orders.select(F.col("o_custkey").alias("id"), day.cast("long").alias("version"), "o_orderkey")


@query("e18_label_versions", """
WITH v AS (SELECT o_custkey AS id, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS version, o_orderkey FROM orders),
s AS (SELECT *, lag(version) OVER (PARTITION BY id ORDER BY version, o_orderkey) AS previous, max(version) OVER (PARTITION BY id) AS last,
             min(version) OVER (PARTITION BY id) AS first_version FROM v)
SELECT id, version, previous, first_version, version = last AS is_latest, coalesce(previous = version, false) AS repeated FROM s""")
def e18(t: Tables) -> DataFrame:
    return evd.version_chain(label_versions(t), "id", "version").drop("o_orderkey")


@query("e18_lineage", """
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent FROM customer),
w AS (SELECT id, parent AS ancestor, 1 AS distance FROM n WHERE parent IS NOT NULL
      UNION ALL SELECT w.id, n.parent, distance + 1 FROM w JOIN n ON n.id = w.ancestor WHERE n.parent IS NOT NULL)
SELECT id, ancestor, CAST(distance AS INTEGER) AS distance FROM w""")
def e18_lineage(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_custkey").alias("id"),
                          F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 3).cast("long")).alias("parent"))
    return gr.ancestors(n, 40)
