"""Evidence registry and knowledge versions as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import ordered_scan

# Evidence grades.
GRADES = ("E0", "E1", "E2")
ZERO_HASH = "0" * 64


def reuse_conflicts(
    batch: DataFrame, identities: DataFrame, units: DataFrame, protocol: str, temporal: bool,
) -> DataFrame:
    """(kind, key, n): registered content or sampling units met again by a new batch.

    Batch rows carry fingerprint, unit_key and event_time; ``units`` has one row
    per unit with protocol_id and latest_time. The batch is fresh when empty.
    """
    content = batch.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).join(
        identities.select("fingerprint").distinct(), "fingerprint", "left_semi").select(
        F.lit("content").alias("kind"), F.col("fingerprint").alias("key"), "n")
    seen = batch.groupBy("unit_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("_first"),
        F.count_if(F.col("event_time").isNull()).alias("_untimed")).join(units, "unit_key")
    if temporal:
        follows = (
            (F.col("protocol_id") == protocol) & F.col("latest_time").isNotNull()
            & (F.col("_untimed") == 0) & (F.col("_first") > F.col("latest_time")))
        seen = seen.filter(~F.coalesce(follows, F.lit(False)))
    return content.unionByName(seen.select(F.lit("unit").alias("kind"), F.col("unit_key").alias("key"), "n"))


def register_units(batch: DataFrame, units: DataFrame, protocol: str) -> DataFrame:
    """Units table after the batch: latest time per unit moves forward only."""
    new = batch.groupBy("unit_key").agg(F.max("event_time").alias("_t"))
    return units.join(new, "unit_key", "full_outer").select(
        "unit_key", F.coalesce("protocol_id", F.lit(protocol)).alias("protocol_id"),
        F.greatest("latest_time", "_t").alias("latest_time"))


def reserve_units(requests: DataFrame, ledger: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): all or nothing; any key already reserved rejects the batch."""
    wanted = requests.select(*keys).distinct()
    conflicts = wanted.join(ledger.select(*keys).distinct(), keys, "left_semi")
    clash = conflicts.groupBy().agg(F.count(F.lit(1)))
    return wanted.withColumn("_c", clash.scalar()).filter("_c = 0").drop("_c"), conflicts


def verify_chain(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with seq_ok, link_ok, hash_ok. The body is stored text, so hashes are recomputed as is."""
    scanned = ordered_scan(ledger, keys, ["seq"], number="_expected", prevs={"_prev": "event_hash"})
    body = F.concat_ws("|", F.col("prev_hash"), F.col("seq").cast("string"), F.col("body"))
    return scanned.select(
        *ledger.columns, (F.col("seq") == F.col("_expected")).alias("seq_ok"),
        (F.col("prev_hash") == F.coalesce("_prev", F.lit(ZERO_HASH))).alias("link_ok"),
        (F.col("event_hash") == F.sha2(body, 256)).alias("hash_ok"))


def grade_new(new: DataFrame, archive: DataFrame) -> DataFrame:
    """Grade and basis of each new result against the archive of earlier entries.

    Archive rows: hyp, grade, data_identity, environments. Prior facts are
    aggregated per hypothesis before the join.
    """
    confirming = F.col("grade").isin("E1", "E2")
    seen = archive.select("hyp", "data_identity").distinct().withColumn("_seen", F.lit(True))
    facts = archive.groupBy("hyp").agg(F.count_if(confirming).alias("_confirmed"))
    envs = archive.filter(confirming).select("hyp", F.explode("environments").alias("env")).distinct()
    fresh = new.select("hyp", F.explode("environments").alias("env")).join(envs, ["hyp", "env"], "left_anti").select(
        "hyp").distinct().withColumn("_new_env", F.lit(True))
    j = new.join(seen, ["hyp", "data_identity"], "left").join(facts, "hyp", "left").join(fresh, "hyp", "left")
    first = F.coalesce("_confirmed", F.lit(0)) == 0
    basis = (
        F.when(F.col("status") != "supported", "not_supported").when(F.col("_seen"), "reused_seen_data")
        .when(first, "first_confirmation").when(F.col("_new_env"), "new_environment").otherwise("new_sample"))
    return j.withColumn("basis", basis).withColumn(
        "grade", F.when(F.col("basis").isin("not_supported", "reused_seen_data"), "E0")
        .when(F.col("basis") == "first_confirmation", "E1").otherwise("E2")).drop("_seen", "_confirmed", "_new_env")


def version_violations(new: DataFrame, archive: DataFrame) -> DataFrame:
    """(rule, hyp, n) rows that forbid appending ``new`` to the archive."""
    ids = archive.select("evidence_identity").distinct()
    reused = new.join(ids, "evidence_identity", "left_semi")
    seen = new.filter(F.col("grade") != "E0").join(archive.select("hyp", "data_identity").distinct(), ["hyp", "data_identity"], "left_semi")
    e1 = archive.filter("grade = 'E1'").select("hyp").distinct()
    twice = new.filter("grade = 'E1'").join(e1, "hyp", "left_semi")
    without = new.filter("grade = 'E2'").join(e1, "hyp", "left_anti")
    out = None
    for rule, rows in (("evidence_identity_reused", reused), ("seen_data", seen), ("second_e1", twice), ("e2_without_e1", without)):
        part = rows.groupBy("hyp").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "hyp", "n")
        out = part if out is None else out.unionByName(part)
    return out


def decide(entries: DataFrame, explicit_retire: DataFrame, changes: DataFrame) -> DataFrame:
    """keep / revise / retire per hypothesis from its latest status, requests and changes."""
    latest = entries.groupBy("hyp").agg(F.max_by("status", "round").alias("latest_status"))
    j = latest.join(explicit_retire.select("hyp").distinct().withColumn("_r", F.lit(True)), "hyp", "left").join(
        changes.select("hyp").distinct().withColumn("_c", F.lit(True)), "hyp", "left")
    changed = F.coalesce("_c", F.lit(False))
    decision = (
        F.when(F.coalesce("_r", F.lit(False)) | ((F.col("latest_status") == "refuted") & ~changed), "retire")
        .when(changed, "revise").otherwise("keep"))
    return j.select("hyp", "latest_status", decision.alias("decision"))


def lookups(entries: DataFrame, retired: DataFrame) -> DataFrame:
    """Highest and active grade, latest round and number of seen identities per hypothesis."""
    agg = entries.groupBy("hyp").agg(
        F.max("grade").alias("highest_grade"), F.max_by("status", "round").alias("latest_status"),
        F.max("round").alias("latest_round"), F.count_distinct("data_identity").alias("seen_data"),
        F.count_distinct("evidence_identity").alias("seen_evidence"))
    gone = retired.select("hyp").distinct().withColumn("_gone", F.lit(True))
    return agg.join(gone, "hyp", "left").withColumn(
        "active_grade", F.when(F.col("_gone").isNull(), F.col("highest_grade"))).drop("_gone")


def regularities(entries: DataFrame, prior: DataFrame) -> DataFrame:
    """Refuted, or supported with a confirming grade; ``is_new`` when absent before."""
    keep = (F.col("status") == "refuted") | ((F.col("status") == "supported") & F.col("grade").isin("E1", "E2"))
    old = prior.select("evidence_identity").distinct().withColumn("_old", F.lit(True))
    return entries.filter(keep).join(old, "evidence_identity", "left").withColumn(
        "is_new", F.col("_old").isNull()).drop("_old")


def stale_proposals(proposals: DataFrame, entries: DataFrame) -> DataFrame:
    """Proposals whose identity was used by the lineage as data or as evidence."""
    used = entries.select("hyp", F.col("data_identity").alias("identity")).union(
        entries.select("hyp", F.col("evidence_identity").alias("identity"))).distinct()
    return proposals.join(used, ["hyp", "identity"], "left_semi")


def open_questions(outcomes: DataFrame, entries: DataFrame, retired: DataFrame, gaps: DataFrame, pending: DataFrame) -> DataFrame:
    """(hyp, reason): unresolved results, best grade E0, retired without support, gaps, pending."""
    unresolved = outcomes.filter(F.col("status").isin("inconclusive", "failed")).select(
        "hyp", F.concat(F.lit("unresolved:"), F.col("status")).alias("reason"))
    best = entries.groupBy("hyp").agg(F.max("grade").alias("g"), F.bool_or(F.col("status") == "supported").alias("s"))
    weak = best.filter("g = 'E0'").select("hyp", F.lit("grade_e0").alias("reason"))
    dropped = retired.select("hyp").distinct().join(best.filter("s"), "hyp", "left_anti").select(
        "hyp", F.lit("retired_without_support").alias("reason"))
    return (
        unresolved.unionByName(weak).unionByName(dropped)
        .unionByName(gaps.select("hyp", F.lit("identification_gap").alias("reason")))
        .unionByName(pending.select("hyp", F.lit("pending").alias("reason"))).distinct())


def family_coverage(declared: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """Declared triples against registered tests: present, missing or unexpected."""
    d = declared.select(*keys).distinct().withColumn("_d", F.lit(True))
    g = registered.select(*keys).distinct().withColumn("_g", F.lit(True))
    return d.join(g, keys, "full_outer").select(
        *keys, F.when(F.col("_d").isNull(), "unexpected").when(F.col("_g").isNull(), "missing").otherwise("present").alias("state"))


def version_chain(labels: DataFrame, id_col: str, version: str) -> DataFrame:
    """Latest flag and predecessor of every label version, and repeated versions.

    The predecessor is the greatest smaller version: versions are integers, so it
    is found through an ordered scan rather than a window over the whole id.
    """
    scanned = ordered_scan(labels, [id_col], [version], prevs={"previous": version})
    last = labels.groupBy(id_col).agg(F.max(version).alias("_last"), F.min(version).alias("first_version"))
    return scanned.join(last, id_col).withColumn("is_latest", F.col(version) == F.col("_last")).withColumn(
        "repeated", F.coalesce(F.col("previous") == F.col(version), F.lit(False))).drop("_last")


def reason_counts(codes: DataFrame, facts: DataFrame, code: str) -> DataFrame:
    """One count per declared code, zeros kept."""
    counts = facts.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(counts, code, "left").withColumn("n", F.coalesce("n", F.lit(0)))


