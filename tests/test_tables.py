"""Events, evidence, graph, selection, acquisition, documents, sources and streams on fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.operators import acquire as aq
from veritab.operators import candidates as cd
from veritab.operators import documents as dc
from veritab.operators import events as ev
from veritab.operators import evidence as evd
from veritab.operators import graph as gr
from veritab.operators import pareto as po
from veritab.operators import quality as q
from veritab.operators.split import split_by_environment_map, stratified_split
from veritab.sources import readers, sinks
from veritab.streaming import gap


def test_gap_filter_advances_on_dropped_rows(spark):
    df = spark.createDataFrame([("u", 0, "a"), ("u", 5, "b"), ("u", 12, "c"), ("v", 3, "d")], "user_id string, t long, pm_id string")
    for bucket in (1, 6, 21600):
        kept, fast = ev.gap_filter(df, 10, ["pm_id"], bucket)
        assert {(r["user_id"], r["t"]) for r in kept.collect()} == {("u", 0), ("v", 3)}
        assert {r["t"] for r in fast.collect()} == {5, 12}


def test_event_rules_in_order(spark):
    rows = [("X1", "Pm_1", 5, "2020-01-01 00:00:00", "1"), ("U_1", "Q", 1, "2020-01-01 00:00:00", "1"), ("U_1", "Pm_1", 2, "bad", "1"),
            ("U_1", "Pm_1", 1, "bad", "99"), ("U_1", "Pm_1", 1, "2014-01-01 00:00:00", "99"), ("U_1", "Pm_1", 1, "2020-01-01 00:00:00", "21"),
            ("U_1", "Pm_1", 1, "2020-01-01 00:00:10", "-3"), (None, "Pm_1", 1, "2020-01-01 00:00:10", None)]
    df = spark.createDataFrame(rows, "user_id string, problem_id string, is_correct int, submit_time string, attempts string")
    clean, dropped = ev.validate_events(df)
    assert [tuple(r) for r in clean.collect()] == [("U_1", 1577836810, "Pm_1", 1, 1)]
    assert sorted(r["reason"] for r in dropped.collect()) == sorted(
        ["bad_user_id", "bad_problem_id", "bad_is_correct", "bad_submit_time", "time_out_of_range", "too_many_attempts", "bad_user_id"])


def test_episodes_with_a_hot_user(spark):
    rows = [("g", "hot", t, f"p{t % 7}", "k_g", t % 2) for t in range(500)] + [("g", "few", t, "p", "k_g", 1) for t in range(3)]
    df = spark.createDataFrame(rows, "group_id string, user_id string, t long, pm_id string, k_id string, y int").repartition(5)
    out = ev.episodes(df, 3, ["t", "pm_id"]).collect()
    assert len(out) == 500 and {r["user_id"] for r in out} == {"hot"}
    assert sorted(r["t"] for r in out if r["role"] == "exam") == [497, 498, 499]




def test_quality_duplicates_and_types(spark):
    spec = q.ObservationSpec({"a": q.FieldSpec("integer", unit="m", minimum=0, maximum=5)}, ("g",), ("E1",), missing_codes=(0, False))
    schema = ("record_id string, group_ids map<string,string>, environment string, event_time timestamp, prediction_time timestamp, "
              "available_time timestamp, source string, values struct<a:double>, units map<string,string>, content string")
    now = __import__("datetime").datetime(2024, 1, 1)
    row = lambda i, a, env="E1", u="m", c=None: (i, {"g": "x"}, env, now, None, now, "s", (a,), {"a": u}, c or str(i))
    df = spark.createDataFrame([row("1", 3.0), row("1", 4.0, c="k"), row("2", 9.0), row("3", 2.5), row("4", 0.0), row("5", 1.0, env="E9"), row("6", 1.0, u="cm")], schema)
    got = {}
    for r in q.assess_records(df, spec, F.col("content")).collect():
        got.setdefault(r["record_id"], []).append((r["status"], r["reasons"]))
    assert got["1"] == [("quarantined", ["duplicate_record_id"])] * 2
    assert got["2"] == [("flagged", ["out_of_range:a"])] and got["3"] == [("quarantined", ["invalid_type:a"])]
    # 0 and False are codes of other types, so 0.0 is a value.
    assert got["4"] == [("usable", [])] and got["5"] == [("excluded", ["environment_outside_scope"])]
    assert got["6"] == [("quarantined", ["unit_conflict:a"])]


def test_environment_map_conflict(spark):
    df = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "A")], "comp string, env string")
    rows, conflicts = split_by_environment_map(df, "comp", "env", {"A": "E", "B": "V"})
    assert [r["comp"] for r in conflicts.collect()] == ["c1"] and rows.count() == 3


def test_stratified_fallback(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id int, label string")
    out = stratified_split(df, "label", "id", "1", 0.3).collect()
    assert all(r["fallback"] for r in out) and sum(r["part"] == "test" for r in out) == 3


def test_reserved_unit_rejects_whole_batch(spark):
    ledger = spark.createDataFrame([("d", "u1")], "dataset string, unit string")
    ok, bad = evd.reserve_units(spark.createDataFrame([("d", "u1"), ("d", "u2")], "dataset string, unit string"), ledger, ["dataset", "unit"])
    assert ok.count() == 0 and bad.count() == 1
    ok, bad = evd.reserve_units(spark.createDataFrame([("d", "u2")], "dataset string, unit string"), ledger, ["dataset", "unit"])
    assert ok.count() == 1 and bad.count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_brute_force(spark, shape):
    random.seed(7)
    n = 60
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)] + [(100, 101)],
             "random": [(random.randrange(80), random.randrange(80)) for _ in range(45)]}[shape]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in gr.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: find(v) for v in parent}


def test_backbone_moves_narrow_edges(spark, monkeypatch):
    """Names are as long as they like: rounds checkpoint components and places, never an edge's id or rank."""
    kept = []
    monkeypatch.setattr(gr, "cut_lineage", lambda df, plain=gr.cut_lineage: kept.append(df.columns) or plain(df))
    edges = [(f"e{i}", i % 7, i * 3 % 11, i * 0.5) for i in range(60)]
    got = {r["id"] for r in gr.spanning_backbone(spark.createDataFrame(edges, "id string, source int, target int, rank double")).collect()}
    assert len(got) == 10 and "e1" in got
    assert kept and not any({"id", "rank"} & set(columns) for columns in kept)
    assert not gr.spanning_backbone(spark.createDataFrame(edges, "id string, source int, target int, rank double").limit(0)).collect()


def test_backbone_equals_greedy_forest(spark):
    random.seed(9)
    edges = [(f"e{i}", f"n{random.randrange(25)}", f"n{random.randrange(25)}", random.random()) for i in range(80)]
    got = {r["id"] for r in gr.spanning_backbone(spark.createDataFrame(edges, "id string, source string, target string, rank double")).collect()}
    parent = {v: v for e in edges for v in e[1:3]}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for i, a, b, _ in sorted(edges, key=lambda e: e[3]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add(i)
    assert got == want


def test_sparse_relations_brute_force(spark):
    random.seed(11)
    kinds = list(gr.RELATION_PRIORITY)
    rel = [(f"r{i:03d}", f"n{random.randrange(6)}", f"m{random.randrange(5)}", random.choice(kinds + ["related"] * 8), random.randrange(5) / 4) for i in range(70)]
    # Both directions of a pair, so the first kept edge decides the second.
    rel += [(f"s{i:03d}", t, s, "related", c) for i, (_, s, t, _, c) in enumerate(rel[:25])]
    kept, omitted = gr.sparse_relations(spark.createDataFrame(rel, "id string, source string, target string, kind string, confidence double"), 3)
    counts, pairs, want = {}, set(), set()
    for i, s, t, k, c in sorted(rel, key=lambda x: (-gr.RELATION_PRIORITY[x[3]], -x[4], x[0])):
        pair = tuple(sorted((s, t)))
        if (k == "related" and pair in pairs) or counts.get(s, 0) >= 3:
            continue
        counts[s] = counts.get(s, 0) + 1
        pairs.add(pair)
        want.add(i)
    assert {r["id"] for r in kept.collect()} == want
    assert omitted.count() == len(rel) - len(want)


def test_hierarchy_depth_limit(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(14)], "id string, parent string")
    edges = spark.createDataFrame([("e", "n1", "n1")], "edge_id string, source string, target string")
    got = {(r["problem"], r["id"]) for r in gr.hierarchy_problems(nodes, edges).collect()}
    assert got == {("too_deep", "n12"), ("too_deep", "n13"), ("bad_edge", "e")}


def _brute_front(rows):
    def dom(a, b):
        d = [(a[i] - b[i]) * s for i, s in zip(range(1, 5), po.DIRECTIONS.values())]
        return all(x >= -1e-12 for x in d) and any(x > 1e-12 for x in d)
    return {b[0] for b in rows if not any(dom(a, b) for a in rows if a is not b)}


def test_front_in_one_task_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"h{i:03d}", *[float(round(x, 1)) for x in rng.random(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "identity string, gain double, stability double, novelty double, complexity double").repartition(4)
    want = _brute_front(rows)
    assert {r["identity"] for r in po.pareto_front(df).collect()} == want
    monkeypatch.setattr(po, "BLOCK_ROWS", 10)
    assert {r["identity"] for r in po.pareto_front(df).collect()} == want


def test_rotation_and_freeze_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"h{i:03d}", *[float(round(x, 2)) for x in rng.random(4)]) for i in range(60)] + [("z0", None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "identity string, gain double, stability double, novelty double, complexity double")
    picked, short = po.freeze_selection(df, cap=50, incomplete_last=False)
    left, want = rows[:-1], []
    layer = 0
    while left and len(want) < 50 and layer < 10:
        front = [r for r in left if r[0] in _brute_front(left)]
        i, taken = 0, set()
        while len(want) < 50 and len(taken) < len(front):
            d = i % 4
            sign = list(po.DIRECTIONS.values())[d]
            best = min((r for r in front if r[0] not in taken), key=lambda r: (-sign * r[1 + d], r[0]))
            taken.add(best[0])
            want.append((best[0], layer))
            i += 1
        left = [r for r in left if r[0] not in {f[0] for f in front}]
        layer += 1
    got = [(r["identity"], r["layer"]) for r in picked.orderBy("slot").collect()]
    assert got == want and short == 50 - len(want)


def test_acquisition_skips_and_continues(spark):
    rows = [(f"o{i}", c, False, 10.0 - i, 10.0 - i) for i, c in enumerate([5.0, 4.0, 1.0])]
    df = spark.createDataFrame(rows, "obs string, cost double, near_boundary boolean, divergence double, heuristic double")
    got = {r["obs"]: r["state"] for r in aq.acquisition_plan(df, 5, 6.0).collect()}
    assert got == {"o0": "selected", "o1": "over_budget", "o2": "selected"}


@pytest.mark.parametrize(("limit", "budget", "bits"), [(12, 30.0, 16), (1000, 30.0, 3), (1000, 75.5, 4), (5, None, 3), (0, 9.0, 3), (1000, 0.0, 3)])
def test_acquisition_brute_force(spark, monkeypatch, limit, budget, bits):
    monkeypatch.setattr(aq, "_BLOCK_BITS", bits)
    random.seed(5)
    rows = [(f"o{i:03d}", random.choice([None, 0.0, 0.25, 1.0, 2.5, 4.0, 9.0, 29.5]), random.random() < 0.5, random.choice([None, 0.0, 1.0, 2.0, 3.0])) for i in range(120)]
    full = [(o, c, n, d, None if d is None or not c else d / c) for o, c, n, d in rows]
    df = spark.createDataFrame(full, "obs string, cost double, near_boundary boolean, divergence double, heuristic double")
    order = sorted(full, key=lambda e: (e[4] is None, -(e[4] or 0.0), e[1] is None, not e[2], e[0]))
    want, spent, taken = {}, 0.0, 0
    for o, c, _, d, _h in order:
        if d is None:
            want[o] = ("undetermined", None)
        elif c is None:
            want[o] = ("unknown_cost", None)
        elif taken >= limit:
            want[o] = ("over_limit", None)
        elif budget is not None and spent + c > budget + 1e-12:
            want[o] = ("over_budget", None)
        else:
            want[o], spent, taken = ("selected", taken), spent + c, taken + 1
    got = {r["obs"]: (r["state"], r["position"]) for r in aq.acquisition_plan(df, limit, budget).collect()}
    assert got == want


def test_acquisition_rounds_follow_the_budget(spark, monkeypatch):
    """Tiny entries between ones that just do not fit any more: an entry a round would take hundreds of rounds."""
    rounds, plain = [], aq._running
    monkeypatch.setattr(aq, "_running", lambda *a: rounds.append(1) or plain(*a))
    costs = [c for i in range(200) for c in (0.001, 10.0 - 0.001 * i - 0.0005)]
    df = spark.createDataFrame([(i, c, False, 1.0, 1000.0 - i) for i, c in enumerate(costs)], "obs int, cost double, near_boundary boolean, divergence double, heuristic double")
    got = aq.acquisition_plan(df, 10_000, 10.0).filter("state = 'selected'")
    spent, want = 0.0, []
    for i, c in enumerate(costs):
        if spent + c <= 10.0 + 1e-12:
            spent, want = spent + c, [*want, i]
    assert [r["obs"] for r in got.orderBy("position").collect()] == want
    assert len(rounds) <= 16


def test_divergence_needs_two_values(spark):
    pred = spark.createDataFrame([("a", "h1", 1.0), ("a", "h2", 1.0), ("b", "h1", 2.0), ("b", "h2", None)], "obs string, hyp string, value double")
    obs = spark.createDataFrame([("a", 2.0, True), ("b", 1.0, False), ("c", None, False)], "obs string, cost double, near_boundary boolean")
    got = {r["obs"]: (r["divergence"], r["heuristic"]) for r in aq.divergence(pred, obs).collect()}
    assert got == {"a": (0.0, 0.0), "b": (None, None), "c": (None, None)}


def test_statement_tokens(spark):
    got = spark.createDataFrame([("Gas law2 比例关系 gas",)], "s string").select(cd.statement_tokens(F.col("s")).alias("t")).first()["t"]
    assert set(got) == {"gas", "law2", "比", "例", "关", "系", "比例", "例关", "关系"}


TEXT = "intro line\n# One\nalpha beta\n\n~~~\n# not a heading\n```\n~~~\n## Two ##\nmore ß text\n#### \nend"


def test_headings_and_sections(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "# A\nx"), (3, "  \n# B\n \n# C\ny")], "id int, t string")
    heads = {r["id"]: [(h["offset"], h["level"], h["title"]) for h in r["h"]] for r in df.select("id", dc.headings(F.col("t")).alias("h")).collect()}
    assert heads[1] == [(TEXT.index("# One"), 1, "One"), (TEXT.index("## Two"), 2, "Two ##")]
    secs = {r["id"]: [(s["id"], s["title"], s["start"], s["end"]) for s in r["s"]] for r in df.select("id", dc.sections(F.col("t")).alias("s")).collect()}
    assert secs[2] == [("s1", "A", 0, 5)] and [s[1] for s in secs[3]] == ["B", "C"]
    assert secs[1][0][:2] == ("s1", dc.DOCUMENT_START) and secs[1][-1][3] == len(TEXT)


@pytest.mark.parametrize("body", ["a" * 95, "p one\n\np two\n\n" * 12, "x\n\n" + "y" * 70, ""])
def test_overlap_chunks_brute_force(spark, body):
    got = [(r["start"], r["end"], r["text"]) for r in dc.overlap_chunks(spark.createDataFrame([("d", body)], "id string, t string"), "id", "t", 30, 8).orderBy("chunk_no").collect()]
    want, start = [], 0
    while start < len(body):
        end = min(start + 30, len(body))
        if end < len(body):
            cut = body.rfind("\n\n", start + 15, end)
            end = cut + 2 if cut >= 0 else end
        want.append((start, end, body[start:end]))
        if end == len(body):
            break
        start = max(start + 1, end - 8)
    assert got == want


def test_section_chunks_cover_the_text(spark):
    body = "# T\n" + "line of words\n" * 40 + "# U\nshort"
    rows = dc.section_chunks(spark.createDataFrame([(1, body)], "id int, t string"), "id", "t", 100).collect()
    covered = set()
    for r in rows:
        assert body[r["start"]:r["end"]] == r["text"] and len(r["text"]) <= 100
        covered |= set(range(r["start"], r["end"]))
    assert covered == set(range(len(body))) and {r["section_id"] for r in rows} == {"s1", "s2"}


def test_pack_lines_and_errors(spark):
    df = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", "x" * 50)], "id string, t string")
    chunks, errors = dc.pack_lines(df, "id", "t", 20)
    assert [r["text"] for r in chunks.orderBy("chunk_no").collect()] == ["a:1: one\na:2: two\n", "a:3: three\n"]
    assert [r["id"] for r in errors.collect()] == ["b"]


def test_masking_round_trip(spark):
    text = "x $a+b$ y `code` \\(z\\) ![i](u)\n```py\n$no$\n```\n$$\nq\n$$ <img src=1> tail \\$5 $"
    df = spark.createDataFrame([(text,)], "t string").withColumn("m", dc.mask_spans(F.col("t")))
    r = df.select("m.*", dc.restore_spans(F.col("m.masked"), F.col("m.kept")).alias("back"), dc.restore_spans(F.concat("m.masked", F.lit("⟦BT_KEEP_00099⟧")), F.col("m.kept")).alias("bad")).first()
    assert r["back"] == text and r["bad"] is None and not r["reserved"]
    assert r["kept"][:4] == ["$a+b$", "`code`", "\\(z\\)", "![i](u)"] and "<img src=1>" in r["kept"]


def test_chapter_cleaning_respects_fences(spark):
    text = "# 12\nkeep\n~~~\n# 3\n```\n~~~\nThis page intentionally left blank.\n## 7 \nend\n```\n# 9"
    got = spark.createDataFrame([(text,)], "t string").select(dc.clean_chapter(F.col("t")).alias("x")).first()["x"]
    assert got == "keep\n~~~\n# 3\n```\n~~~\nend\n```\n# 9"


def test_quote_location_with_white_space(spark):
    docs = spark.createDataFrame([(1, "# H\nalpha  beta\n gamma. (x)\n# K\nz")], "id int, t string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma. (x)"), (1, "gamma."), (1, "z"), (1, "absent"), (2, "alpha")], "id int, quote string")
    got = {(r["id"], r["quote"]): (r["start"], r["end"], r["line_start"], r["line_end"], r["section_id"]) for r in dc.locate_quotes(quotes, docs, "id", "quote", "t").collect()}
    assert got[(1, "alpha beta gamma. (x)")] == (4, 27, 2, 3, "s1") and got[(1, "gamma.")] == (17, 23, 3, 3, "s1")
    for k in ((1, "z"), (1, "absent"), (2, "alpha")):
        assert got[k] == (None, None, None, None, None)


def test_secrets_allow_list_and_patterns(spark):
    text = "sk-" + "a" * 24 + " ghp_" + "B" * 30 + " -----BEGIN RSA PRIVATE KEY----- sk-short"
    df = spark.createDataFrame([("d", text)], "id string, t string")
    hits = dc.scan_secrets(df, "id", "t")
    assert sorted(r["pattern"] for r in hits.collect()) == ["github", "pem", "sk"]
    allow = hits.filter("pattern = 'sk'").select("digest")
    assert sorted(r["pattern"] for r in dc.scan_secrets(df, "id", "t", allow).collect()) == ["github", "pem"]


def test_markup_lint_rules(spark):
    text = "{{a}} {{b\n= one\n== open\n=== x ==\n== y = ==\nsee [[Category:z]]\n[[Category:z]]"
    got = {(r["line"], r["issue"]) for r in dc.markup_lint(spark.createDataFrame([("p", text)], "id string, t string"), "id", "t").collect()}
    assert got == {(0, "braces"), (2, "level_one_heading"), (3, "heading_not_closed"), (4, "heading_runs_differ"), (5, "heading_extra_mark"), (6, "category_not_alone")}


def test_csv_defaults_and_numbers(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿batch,X1,Y,event_time\nb1,1,2,\nb2,oops,3,2026-02-01T00:00:00+00:00\n", encoding="utf-8")
    good, bad = readers.scan_observations_csv(spark, str(tmp_path / "o.csv"), ["X1"], "Y", "batch", ["lab"])
    g = good.first()
    assert (g["record_id"], g["environment"], str(g["event_time"]), g["X1"]) == ("row-2", "lab", "2026-01-01 00:00:00", 1.0)
    assert [(r["record_id"], r["reason"]) for r in bad.collect()] == [("row-3", "not_a_number:X1")]
    with pytest.raises(ValueError):
        readers.scan_observations_csv(spark, str(tmp_path / "o.csv"), ["X9"], "Y", "batch", ["lab"])


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"Pm_1": "K_a",\n "Pm_2" : "K_b"}')
    assert {tuple(r) for r in readers.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {("Pm_1", "K_a"), ("Pm_2", "K_b")}
    (tmp_path / "g.json").write_text('{"K_a": ["Pm_1", "Pm_2"],\n"K_b": []}')
    assert {tuple(r) for r in readers.read_json_groups(spark, str(tmp_path / "g.json"), True).collect()} == {("K_a", "Pm_1"), ("K_a", "Pm_2")}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n{"a": 2}\n')
    good, bad = readers.scan_jsonl(spark, str(tmp_path / "l.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and sorted(r["reason"] for r in bad.collect()) == ["blank", "not_object", "unparsable"]


def test_text_files_and_omissions(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("print(1)")
    (tmp_path / "sub" / "b.py").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "big.py").write_text("x" * 300_000)
    (tmp_path / "c.bin").write_text("skip")
    texts, omitted = readers.scan_text_files(spark, str(tmp_path), [".py"], max_bytes=256_000)
    assert [r["content"] for r in texts.collect()] == ["print(1)"]
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in omitted.collect()) == [("b.py", "not readable UTF-8"), ("big.py", "file exceeds the size limit")]


def test_confirmation_append_guards(spark, tmp_path):
    path = str(tmp_path / "c")
    batch = spark.createDataFrame([(1,)], "a int")
    sinks.append_confirmation(batch, path, "C1")
    for df, purpose in ((batch, "C1"), (batch.limit(0), "C2")):
        with pytest.raises(ValueError):
            sinks.append_confirmation(df, path, purpose)


def test_table_digest_ignores_order_and_partitions(spark):
    df = spark.range(500).withColumn("d", sinks.row_digest("id"))
    one = sinks.table_digest(df, "d").first()
    assert one == sinks.table_digest(df.orderBy(F.desc("id")).repartition(9), "d").first()
    assert one["digest"] != sinks.table_digest(df.filter("id > 0"), "d").first()["digest"]


def test_stream_equals_batch_out_of_order(spark, tmp_path):
    random.seed(6)
    rows = [(random.choice(["hot", "hot", "u1", "u2", "u3"]), random.randrange(1, 2000), i, None if i % 7 == 0 else i, None if i % 5 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, t long, event_id long, note long, tie int").withColumn("ts", F.timestamp_seconds("t"))
    arrival = sorted(rows, key=lambda row: row[1] + (row[2] * 37) % 300)
    for i in range(0, 300, 60):
        part = spark.createDataFrame(arrival[i:i + 60], "user_id string, t long, event_id long, note long, tie int")
        part.withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: gap.run_gap_stream(
        spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), 20, ["tie", "event_id"], 1, delay="300 seconds")
    part = run().count()
    # What the watermark has not passed waits in the state, in order and whole, for the next run.
    assert 0 < part < 300
    gap.closing_row(df, 400).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in run().select("event_id", "t", "gap", "outcome", F.coalesce("note", F.lit(-1))).collect()), key=str)
    kept, fast = ev.gap_filter(df, 20, ["tie", "event_id"])
    columns = ["event_id", "t", "gap", F.coalesce("note", F.lit(-1))]
    want = [(*r[:3], "kept", r[3]) for r in kept.select(*columns).collect()] + [(*r[:3], "too_fast", r[3]) for r in fast.select(*columns).collect()]
    assert got == sorted(want, key=str)


def test_stream_sets_one_timer_per_user_and_batch():
    """Not one per second with a row: 1,000 rows of a user waiting are one stored part and one timer."""
    import pandas as pd
    from types import SimpleNamespace as Space
    held, timers, last = [], [], []
    row = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("t", T.LongType()), T.StructField("event_id", T.LongType())])
    work = gap._Gaps(row, 20, ["event_id"], None)
    lists = Space(appendList=held.extend, get=lambda: iter(list(held)), exists=lambda: bool(held), clear=held.clear,
                  put=lambda v: (held.clear(), held.extend(v)))
    value = Space(get=lambda: last[0], exists=lambda: bool(last), update=lambda v: (last.clear(), last.append(v)), clear=last.clear)
    work.init(Space(getListState=lambda *_: lists, getValueState=lambda *_: value, registerTimer=timers.append))
    rows = pd.DataFrame({"user_id": "u", "t": range(1000), "event_id": range(1000)})
    assert not list(work.handleInputRows(("u",), iter([rows[500:], rows[:500]]), None))
    assert timers == [0] and len(held) == 2
    at = Space(getCurrentWatermarkInMs=lambda: 600_000)
    out = list(work.handleExpiredTimer(("u",), at, Space(getExpiryTimeInMs=lambda: 0)))
    assert [len(o) for o in out] == [601] and out[0]["t"].tolist() == list(range(601))
    assert timers == [0, 601_000] and len(held) == 1 and last == [(600,)]
    assert not list(work.handleExpiredTimer(("u",), at, Space(getExpiryTimeInMs=lambda: 500_000)))


@pytest.mark.parametrize("forget", [None, 100])
def test_stream_state_shrinks(spark, tmp_path, forget):
    rows = [(f"u{i}", 100 + t, i * 10 + t) for i in range(5) for t in (0, 5, 50)] + [("u0", 5000, 900), ("u9", 9000, 901)]
    df = spark.createDataFrame(rows, "user_id string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
    for lo, hi in ((0, 1000), (1000, 6000), (6000, 10_000)):
        df.filter(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = gap.run_gap_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), 20, ["event_id"], 1, "10 seconds", forget)
    got = {r["event_id"]: (r["gap"], r["outcome"]) for r in out.collect()}
    assert got[5] == (5, "too_fast") and got[50] == (45, "kept") and 901 not in got
    assert got[900] == ((4850, "kept") if forget is None else (None, "kept"))
    state = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", name).load().count()
    assert state("open") == 1 and state("last") == (5 if forget is None else 0)



def test_quality_joins_carry_rule_numbers_and_are_made_once(spark):
    from veritab.plans import archive
    from veritab.plans.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = archive.assessed(t)
    whole, apart = q.quality_report(rows, archive.SPEC), q.quality_report(rows, archive.SPEC, q.identify(archive.records(t), archive.SPEC))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins(whole) == 6 and joins(apart) == 2


def test_text_tasks_hold_one_piece_of_a_batch_as_strings(spark, monkeypatch):
    """A batch of any size is handled piece by piece, with the rows of the whole batch; nulls and empty texts too."""
    import pyarrow as pa
    texts = [None, "", "# A\n" + "wort \n" * 90, "ﬁ ẞ\n\n" * 40, "x" * 500] * 6
    monkeypatch.setattr(dc, "PIECE_BYTES", 700)
    batch = pa.RecordBatch.from_pydict({"k": list(range(30)), "t": texts})
    parts = list(dc._by_piece(iter([batch]), "t"))
    assert len(parts) > 10 and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert max(p.column("t").nbytes for p in parts) < 2000
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    jobs = lambda: [sorted(map(tuple, d.collect()), key=str) for d in (
        dc.overlap_chunks(df, "k", "t", 100, 10), dc.section_chunks(df.filter("t is not null"), "k", "t", 100), dc.pack_lines(df, "k", "t", 600)[0],
        df.select("k", dc.rule_key(F.col("t"))))]
    small = jobs()
    monkeypatch.setattr(dc, "PIECE_BYTES", 4 << 20)
    assert small == jobs() and [len(j) > 12 for j in small] == [True] * 4
    assert small[3][0] == (0, None) and {r[1] for r in small[3] if r[0] % 5 == 3} == {"fiss" * 40}


def test_pages_of_many_headings_and_labels_are_one_fold(spark):
    import time
    n = 2400
    heads = "".join(f"# Head {i}\ntext {i}\n" for i in range(n))
    labels = "".join(f":label:`fig_{i}`\n:eqlabel:`eq_{i}`\n" for i in range(n // 2))
    df = spark.createDataFrame([("p", heads, labels)], "page string, heads string, labels string")
    start = time.time()
    found = df.select(F.inline(dc.sections(F.col("heads")))).collect()
    assert len(found) == n and found[-1]["id"] == f"s{n}" and found[-1]["title"] == f"Head {n - 1}"
    assert all(a["end"] == b["start"] for a, b in zip(found, found[1:])) and found[-1]["end"] == len(heads)
    table = {r["label"]: (r["type"], r["num"]) for r in dc.label_table(df, "page", "labels").collect()}
    assert table[f"fig_{n // 2 - 1}"] == ("fig", n // 2) and table["eq_0"] == ("eq", 1) and len(table) == n
    assert time.time() - start < 20


def test_split_counts_leaves_rows_where_they_are(spark):
    """Few (node, feature) keys hold all rows, so the join with their thresholds must not shuffle by them."""
    from veritab.operators import trials as tr
    rows = spark.range(400).selectExpr("id % 2 as node", "cast(id % 37 as double) as x", "id % 3 as label", "if(id % 4 = 0, 'val', 'train') as part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, wide = tr.split_counts(rows, "node", ["x"], "label", "part")
        assert "BroadcastHashJoin" in wide._jdf.queryExecution().executedPlan().toString()
        total = wide.groupBy("node", "i").agg({"left": "sum", "right": "sum"}).collect()
        assert all(r["sum(left)"] + r["sum(right)"] == 200 for r in total)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counterexamples_sort_only_what_they_return(spark, monkeypatch):
    from veritab.functions.exprs import Candidate
    from veritab.operators import relations as rel
    seen = []
    scan = rel.ordered_scan
    monkeypatch.setattr(rel, "ordered_scan", lambda df, *a, **k: seen.append(df.columns) or scan(df, *a, **k))
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 9.0), ("d", 5.0)], "record_id string, x1 double")
    _, worst = rel.invariant_check(rows, [Candidate("x", ("var", "x1"))], 0.1)
    assert [(r.record_id, r.position) for r in worst.orderBy("position").collect()] == [("c", 1), ("a", 2), ("b", 3), ("d", 4)]
    assert seen == [["cand", "record_id", "z", "deviation"]]
