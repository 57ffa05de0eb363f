"""Exact deduplication: odd tables, deliveries to one index, and the plan that leaves the index in place."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veritab.llm.exact import DigestIndex, deliver, digest, exact_duplicates

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, digest string, n long, id string, row long, keep_id string, delivery string, hot string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "x", 1, "x", "x", "x") for i, t in rows], KIND)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = ids.index(best)
        out += [(i, best, len(ids), k == kept, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return Counter(out)


def test_brute_force(spark):
    long_ = "Long text " * 200_000
    rows = [(1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, long_), (9, long_.upper()), (9, "a b"), (9, "A B"),
            (None, "lone"), (None, "LONE"), (None, "a b"), (10, "ß"), (11, "x\x00"), (12, "X\x00"), (-5, "a B"), (None, None)]
    rows += [(i, "Copies") for i in range(1000, 3000)]
    for deliveries in (1, 2, 4):
        got = Counter(map(tuple, exact_duplicates(table(spark, rows), deliveries=deliveries).collect()))
        assert got == brute(rows)
    assert not exact_duplicates(table(spark, [])).collect()
    assert exact_duplicates(table(spark, [])).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_outlives_the_session_and_a_repeated_delivery(spark, tmp_path):
    path = str(tmp_path / "index")
    first = {r.id: r.kept for r in deliver(DigestIndex(spark, path, buckets=4), table(spark, [(1, "a"), (2, "A"), (3, "b")]), "monday").collect()}
    assert first == {1: False, 2: True, 3: True}
    again = DigestIndex(spark, path)  # named anew, as another session would
    assert again.buckets == 4
    second = {r.id: (r.kept, r.keep_id, r.first_delivery) for r in deliver(again, table(spark, [(9, "a"), (10, "c"), (11, "C"), (12, "c")]), "tuesday").collect()}
    assert second == {9: (False, 2, "monday"), 10: (False, 12, "tuesday"), 11: (False, 12, "tuesday"), 12: (True, 12, "tuesday")}
    repeated = {r.id: r.kept for r in deliver(DigestIndex(spark, path), table(spark, [(1, "a"), (2, "A"), (3, "b")]), "monday").collect()}
    assert repeated == first
    held = DigestIndex(spark, path).entries()
    assert held.count() == held.select("digest").distinct().count() == 3
    by_index = {r.doc_id: (r.kept, r.keep_id) for r in exact_duplicates(table(spark, [(5, "B"), (6, "new")]), path=path).collect()}
    assert by_index == {5: (False, 3), 6: (True, 6)}


def test_index_is_not_shuffled_and_its_files_are_sorted(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=4)
    deliver(index, table(spark, [(i, f"text {i}") for i in range(100)]), "one")
    entries = table(spark, [(i, f"text {i}") for i in range(90, 110)]).select(digest(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
    new = index.fresh(entries)
    assert new.count() == 10
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    files = [f for f in index.entries().inputFiles()]
    assert len(files) == 4
    for f in files:
        held = [bytes(r.digest) for r in spark.read.parquet(f).select("digest").collect()]
        assert held == sorted(held)


def test_frequent_digests_meet_their_entry_in_every_task(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    out = exact_duplicates(table(spark, rows))
    assert Counter(map(tuple, out.collect())) == brute(rows)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
