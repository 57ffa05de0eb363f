"""Source and sink queries: each writes a format from the tables and reads it back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.operators import evidence as evd
from veritab.plans import learner
from veritab.plans.archive import _lines, _registered, _units
from veritab.plans.common import r
from veritab.plans.registry import Tables, query
from veritab.plans.selection import experience
from veritab.session import cut_lineage
from veritab.sources import readers, sinks
from veritab.sources.sealed import Rejected, SealedStore
from veritab.sources.tree import local_path, scan_tree
from veritab.streaming import gap


def _csv(t: Tables, with_id: bool) -> str:
    path = t.scratch("csv")
    li = t.lineitem
    rid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    cols = [rid.alias("record_id")] if with_id else []
    rows = li.select(
        *cols, F.when(F.col("l_suppkey") % 23 == 0, " ").otherwise(F.col("l_suppkey").cast("string")).alias("batch"),
        F.when(F.col("l_partkey") % 41 == 0, "many").otherwise(F.col("l_quantity").cast("string")).alias("X1"),
        F.when(F.col("l_partkey") % 43 == 0, "NaN").otherwise(F.col("l_discount").cast("string")).alias("X2"),
        F.col("l_extendedprice").cast("string").alias("Y"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("environment"))
    rows.write.option("header", True).csv(path)
    return path


@query("a1_csv_observations", """
WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS record_id, l_partkey, l_quantity, l_extendedprice, CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE 'A' END AS env,
             count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS copies,
             CASE WHEN l_suppkey % 23 = 0 THEN 'blank_group' WHEN l_partkey % 41 = 0 THEN 'not_a_number:X1' WHEN l_partkey % 43 = 0 THEN 'nonfinite:X2' END AS reason FROM lineitem)
SELECT coalesce(reason, CASE WHEN copies > 1 THEN 'duplicate_record_id' END, 'ok') AS reason, env, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM x GROUP BY 1, 2""")
def a1(t: Tables) -> DataFrame:
    good, bad = readers.scan_observations_csv(t.spark, _csv(t, True), ["X1", "X2"], "Y", "batch", ["A", "N"])
    rows = good.select(F.lit("ok").alias("reason"), "environment", "Y").unionByName(bad.select("reason", "environment", "Y"))
    return rows.groupBy("reason", F.col("environment").alias("env")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("Y"), 2).alias("total"))


@query("a1_csv_row_numbers", """
SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS numbered, 2::BIGINT AS first_row FROM lineitem WHERE NOT (l_suppkey % 23 = 0 OR l_partkey % 41 = 0 OR l_partkey % 43 = 0) AND false
UNION ALL SELECT count(*), count(*), 2 FROM lineitem""")
def a1_rows(t: Tables) -> DataFrame:
    path = t.scratch("csv1")
    t.lineitem.select(F.col("l_suppkey").cast("string").alias("batch"), F.col("l_quantity").alias("X1"), F.col("l_extendedprice").alias("Y")).write.option("header", True).csv(path)
    numbered = readers._number_rows(t.spark.read.option("header", True).csv(path))
    files = numbered.select(F.col("record_id"), F.expr("cast(substring(record_id, 5) as bigint)").alias("no"))
    agg = files.agg(F.count(F.lit(1)).alias("n"), F.count("no").alias("numbered"), F.min("no").alias("first_row"))
    none = agg.select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("numbered"), F.lit(2).cast("long").alias("first_row"))
    return none.unionByName(agg)


@query("a2_jsonl_scan", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'blank' WHEN event_id % 23 = 0 THEN 'not_object' WHEN event_id % 29 = 0 THEN 'unparsable' ELSE 'ok' END AS reason, value FROM events)
SELECT reason, count(*) AS n, round(sum(CASE WHEN reason = 'ok' THEN value END), 2) AS total FROM x GROUP BY 1""")
def a2(t: Tables) -> DataFrame:
    path = t.scratch("jsonl")
    body = F.to_json(F.struct("event_id", "user_id", "value"))
    line = F.when(F.col("event_id") % 19 == 0, "").when(F.col("event_id") % 23 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(
        F.col("event_id") % 29 == 0, F.concat(F.lit("{"), F.substring(body, 1, 20))).otherwise(body)
    t.events.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    good, bad = readers.scan_jsonl(t.spark, path, schema)
    rows = good.select(F.lit("ok").alias("reason"), "value").unionByName(bad.select("reason", F.lit(None).cast("double").alias("value")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("a3_json_mapping", """
SELECT 'Pm_' || p_partkey AS key, 'K_' || p_type AS value FROM part""")
def a3(t: Tables) -> DataFrame:
    path = t.scratch("map")
    pair = F.to_json(F.create_map(F.concat(F.lit("Pm_"), "p_partkey"), F.concat(F.lit("K_"), "p_type")))
    t.part.select(F.concat(pair, F.lit(",")).alias("value")).write.text(path)
    return readers.read_json_map(t.spark, path)


@query("a3_json_groups", """
SELECT 'K_' || p_brand AS key, 'Pm_' || p_partkey AS value FROM part UNION ALL SELECT 'K_' || p_brand, 'Pn_' || p_size FROM part""")
def a3_groups(t: Tables) -> DataFrame:
    path = t.scratch("groups")
    obj = F.to_json(F.create_map(F.concat(F.lit("K_"), "p_brand"), F.array(F.concat(F.lit("Pm_"), "p_partkey"), F.concat(F.lit("Pn_"), "p_size"))))
    t.part.select(obj.alias("value")).write.text(path)
    return readers.read_json_groups(t.spark, path)


@query("a4_experience_store")
def a4(t: Tables) -> DataFrame:
    path = t.scratch("store")
    rows = experience(t).withColumn("selected_method", F.lit("pearson_abs")).withColumn("selection_reason", F.lit("measured")).drop("flag")
    sinks.append_experience(rows.filter("dataset_id < 'd5'"), path)
    sinks.append_experience(rows.filter("dataset_id >= 'd5'"), path)
    return sinks.read_experience(t.spark, path).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("evaluations")).alias("methods"), F.bool_and(F.col("created_at_utc").endswith("Z")).alias("stamped"))


@query("a5_artifact_manifest")
def a5(t: Tables) -> DataFrame:
    return sinks.write_artifact(t.part, t.scratch("run"), "parts").select("name", "digest", "record_count")


@query("a5_event_journal", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def a5_journal(t: Tables) -> DataFrame:
    return sinks.number_events(t.events, ["ts", "event_id"]).select("event_id", "event_type", "seq")


@query("a6_skip_ingested", """
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)""")
def a6(t: Tables) -> DataFrame:
    store = t.lineitem.filter("l_quantity > 45").select(F.col("l_suppkey").alias("o_custkey"))
    return sinks.skip_ingested(t.orders.select("o_orderkey", "o_custkey"), store, "o_custkey").select("o_orderkey")


@query("a8_confirmation_append", """
WITH b AS (SELECT l_returnflag AS env, l_linenumber AS ln, l_extendedprice AS p FROM lineitem)
SELECT CASE WHEN ln <= 5 THEN 'C1' ELSE 'C2' END AS purpose, env, count(*) AS n, round(sum(p), 2) AS total FROM b WHERE ln > 3 GROUP BY 1, 2""")
def a8(t: Tables) -> DataFrame:
    path = t.scratch("confirm")
    rows = t.lineitem.filter("l_linenumber > 3").select(F.col("l_returnflag").alias("env"), "l_linenumber", "l_extendedprice")
    sinks.append_confirmation(rows.filter("l_linenumber <= 5"), path, "C1")
    sinks.append_confirmation(rows.filter("l_linenumber > 5"), path, "C2")
    return t.spark.read.parquet(path).groupBy("purpose", "env").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"))


@query("a8_sealed_append", """
WITH l AS (SELECT sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)) AS f, l_orderkey AS o, l_linenumber AS ln, l_returnflag AS env FROM lineitem),
old AS (SELECT * FROM l WHERE o % 3 <> 2), new AS (SELECT * FROM l WHERE o % 3 = 2 OR ln = 1)
SELECT CASE WHEN o % 3 = 0 THEN 'C1' ELSE 'C2' END AS purpose, 'sealed ' || env AS item, count(*) AS n FROM old GROUP BY 1, 2
UNION ALL SELECT 'C3', 'met content', count(DISTINCT f) FROM new WHERE f IN (SELECT f FROM old)
UNION ALL SELECT 'C3', 'met unit', count(DISTINCT o) FROM new WHERE o IN (SELECT o FROM old)""")
def a8_sealed(t: Tables) -> DataFrame:
    """Two batches of whole orders are sealed; a third one that holds first lines of their orders is refused."""
    canon = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = t.lineitem.select(F.sha2(canon, 256).alias("fingerprint"), F.array(F.concat(F.lit("order|"), F.col("l_orderkey"))).alias("unit_keys"),
                             F.col("l_shipdate").cast("timestamp").alias("event_time"), F.col("l_returnflag").alias("env"), "l_orderkey", "l_linenumber")
    store = SealedStore(t.spark, t.scratch("sealed"))
    store.append(rows.filter("l_orderkey % 3 = 0"), "C1", "p1")
    store.append(rows.filter("l_orderkey % 3 = 1"), "C2", "p1")
    met: list[tuple[str, str, int]] = []
    try:
        store.append(rows.filter("l_orderkey % 3 = 2 or l_linenumber = 1"), "C3", "p1")
    except Rejected as e:
        met = [("C3", f"met {kind}", n) for kind, n in e.conflicts.items()]
    sealed = store.rows().groupBy("purpose", F.concat(F.lit("sealed "), "env").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return sealed.unionByName(t.spark.createDataFrame(met, "purpose string, item string, n long"))


@query("a8_confirmation_gate", """
WITH lines AS (SELECT sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)) AS f, 'order|' || l_orderkey AS u, l_linenumber AS ln FROM lineitem),
reg AS (SELECT * FROM lines WHERE ln <= 3), b AS (SELECT * FROM lines WHERE ln > 3)
SELECT 'content' AS kind, count(DISTINCT f) AS n FROM b WHERE f IN (SELECT f FROM reg) HAVING count(*) > 0
UNION ALL SELECT 'unit', count(DISTINCT u) FROM b WHERE u IN (SELECT u FROM reg)""")
def a8_gate(t: Tables) -> DataFrame:
    """Conflicts that keep a batch from being sealed."""
    conflicts = evd.reuse_conflicts(_lines(t).filter("l_linenumber > 3"), _registered(t), _units(t), "p1", temporal=False)
    return conflicts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _write_files(root: str):
    """Tasks write each row's bytes under its path; a repeated task writes the same files again."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write(content)
                os.replace(part, full)
            yield batch[["path"]]
    return run


@query("a7_tree_walk", """
WITH f AS (SELECT source || '/' || CASE doc_id % 11 WHEN 0 THEN 'node_modules/m' WHEN 1 THEN '.hidden' WHEN 2 THEN 'src/deep/er' WHEN 3 THEN 'src' ELSE 'pkg' || doc_id % 40 END || '/' || doc_id
    || CASE WHEN doc_id % 5 = 0 THEN '.bin' WHEN doc_id % 3 = 0 THEN '.PY' ELSE '.md' END AS path, doc_id, text AS t, doc_id % 11 > 1 AND doc_id % 5 > 0 AS seen FROM documents),
j AS (SELECT path, t, CASE WHEN octet_length(encode(t)) + (CASE WHEN doc_id % 13 = 0 THEN 1 WHEN doc_id % 17 = 0 THEN 3 ELSE 0 END) > 4000 THEN 'file exceeds the size limit'
    WHEN doc_id % 13 = 0 THEN 'not readable UTF-8' END AS reason FROM f WHERE seen)
SELECT path, CASE WHEN reason IS NULL THEN sha256(t) END AS sha256, CASE WHEN reason IS NULL THEN length(t) END AS n_chars, reason FROM j""")
def a7_tree(t: Tables) -> DataFrame:
    """Documents as files of real folders (some skipped, some not text, some too long), walked again."""
    root = local_path(t.scratch("tree"))
    rest = F.col("doc_id") % 11
    folder = F.when(rest == 0, "node_modules/m").when(rest == 1, ".hidden").when(rest == 2, "src/deep/er").when(rest == 3, "src").otherwise(
        F.concat(F.lit("pkg"), F.col("doc_id") % 40))
    suffix = F.when(F.col("doc_id") % 5 == 0, ".bin").when(F.col("doc_id") % 3 == 0, ".PY").otherwise(".md")
    text = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit(b"\xff"))).when(F.col("doc_id") % 17 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), text)).otherwise(text)
    files = t.documents.select(F.concat(F.concat_ws("/", "source", folder, "doc_id"), suffix).alias("path"), content.alias("content"))
    files.mapInPandas(_write_files(root), "path string").write.format("noop").mode("overwrite").save()
    return scan_tree(t.spark, root, [".py", ".md"], max_bytes=4000).select("path", "sha256", F.col("n_chars").cast("long").alias("n_chars"), "reason")


@query("e1_gap_filter_stream", f"WITH {learner._GAP} SELECT event_id, user_id, t, CAST(gap AS BIGINT) AS gap, 'kept' AS outcome FROM kept UNION ALL SELECT event_id, user_id, t, CAST(gap AS BIGINT), 'too_fast' FROM gapped WHERE gap < {learner.MIN_GAP}")
def e1_stream(t: Tables) -> DataFrame:
    """The same filter as a stateful stream over clean events that come out of order by up to an hour."""
    source = t.scratch("clean")
    clean = learner._clean(t).withColumn("ts", F.timestamp_seconds("t"))
    # Four batches by arrival, each event up to an hour late; the file source reads the oldest file first.
    arrival = F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(3600))
    span = clean.agg(F.struct(F.min("t").alias("lo"), ((F.max("t") - F.min("t") + 3600) / 4).alias("w")).alias("s"))
    tagged = cut_lineage(clean.withColumn("_s", span.scalar()).withColumn("_b", F.floor((arrival - F.col("_s.lo")) / F.col("_s.w"))).drop("_s"))
    for i in range(4):
        tagged.filter(F.col("_b") == i).drop("_b").write.mode("append").parquet(source)
    gap.closing_row(clean, 7200).write.mode("append").parquet(source)
    return gap.run_gap_stream(t.spark, source, clean.schema, t.scratch("out"), t.scratch("state"), learner.MIN_GAP, learner.TIES, delay="1 hour").select(
        "event_id", "user_id", "t", "gap", "outcome")
