"""Sealed appends: gates, parallel writers, writers that die."""

import threading
from datetime import datetime

import pytest

from veritab.sources.sealed import Rejected, SealedStore

KIND = "fingerprint string, unit_keys array<string>, event_time timestamp, value double"


def batch(spark, *rows):
    return spark.createDataFrame([(f, u, None if t is None else datetime(2024, 1, t), 1.0) for f, u, t in rows], KIND)


def test_gates(spark, tmp_path):
    store = SealedStore(spark, str(tmp_path / "s"))
    assert store.rows() is None
    first = store.append(batch(spark, ("f1", ["u1"], 1), ("f2", ["u2", "u3"], 2), ("f3", [], 3)), "C1", "p")
    assert (first["rows"], first["number"]) == (3, 0)
    cases = [("C1", batch(spark, ("f9", ["u9"], 9)), "purpose is taken", {}), ("c2", batch(spark, ("f9", ["u9"], 9)), "a purpose is C1, C2, ..", {}),
             ("C2", batch(spark), "empty batch", {}), ("C2", batch(spark, ("f1", ["u9"], 9), ("f8", ["u3"], 9)), "met before", {"content": 1, "unit": 1})]
    for purpose, rows, reason, conflicts in cases:
        with pytest.raises(Rejected) as e:
            store.append(rows, purpose, "p")
        assert (e.value.reason, e.value.conflicts) == (reason, conflicts)
    # Later events of a unit of the same protocol may follow, if time decides.
    with pytest.raises(Rejected):
        store.append(batch(spark, ("f8", ["u1"], 1)), "C2", "p", temporal=True)
    with pytest.raises(Rejected):
        store.append(batch(spark, ("f8", ["u1"], 5)), "C2", "other", temporal=True)
    store.append(batch(spark, ("f8", ["u1"], 5)), "C2", "p", temporal=True)
    assert [m["purpose"] for m in SealedStore(spark, str(tmp_path / "s")).manifests()] == ["C1", "C2"]
    assert {(r.purpose, r.fingerprint) for r in store.rows().collect()} == {("C1", "f1"), ("C1", "f2"), ("C1", "f3"), ("C2", "f8")}
    # What was refused leaves no data behind.
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2 and not list((tmp_path / "s").glob("spare-*"))


def race(jobs):
    """Run the jobs at once; 'ok' or the reason of each."""
    out, start = [None] * len(jobs), threading.Barrier(len(jobs))

    def run(i):
        start.wait()
        try:
            jobs[i]()
            out[i] = "ok"
        except Rejected as e:
            out[i] = e.reason

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return sorted(out)


def test_parallel_writers(spark, tmp_path):
    make = lambda: SealedStore(spark, str(tmp_path / "s"))
    one = race([lambda i=i: make().append(batch(spark, (f"a{i}", [f"a{i}"], 1)), "C1", "p") for i in range(3)])
    assert one == ["ok", "purpose is taken", "purpose is taken"]
    shared = race([lambda i=i: make().append(batch(spark, ("same", [f"b{i}"], 1)), f"C{10 + i}", "p") for i in range(3)])
    assert shared == ["met before", "met before", "ok"]
    apart = race([lambda i=i: make().append(batch(spark, (f"c{i}", [f"c{i}"], 1)), f"C{20 + i}", "p") for i in range(3)])
    assert apart == ["ok"] * 3
    assert len(make().manifests()) == 5 and make().rows().count() == 5


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store = SealedStore(spark, str(tmp_path / "s"))
    rows = batch(spark, ("f1", ["u1"], 1))
    rows.write.parquet(str(tmp_path / "s" / "data" / "C1-dead"))
    assert store.rows() is None and store.append(rows, "C1", "p")["number"] == 0 and store.rows().count() == 1
