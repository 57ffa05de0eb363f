"""Text and vector operators on small tables: odd rows, brute force, exact round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle_check import compare, connect
from veritab.llm import ctw, language, lines, minhash, packing, quality, secrets, textkit, tokens, vectors
from veritab.llm.decontaminate import decontaminate, items_digest
from veritab.llm.language import identify
from veritab.llm.lengths import length_histogram, quantile, total_at
from veritab.llm.lines import dedup_lines, within_one_word
from veritab.llm.links import components
from veritab.llm.minhash import near_duplicates
from veritab.llm.packing import pack
from veritab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in ("id", "path", "rest", "drop", "h", "key", "n_lines", "component")]])
BODY = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(60_000))
TEXTS = {
    0: BODY, 1: BODY, 2: None, 3: "", 4: " \n\t ", 5: LONG, 6: BODY.replace("kappa", "kapp"), 7: "Zwei Wörter", 8: "token = 'abcdef1234' \U0001f600 secret:xyzxyz",
    9: f"first line of nine words that stays here alone\n{BODY}\n\nfirst line of nine words that stays here alone", 10: "deadbeef" * 4 + " AKIA" + "Q7" * 9,
}


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([tuple(r) + (None,) * (len(schema) - len(r)) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, a repeated row, clashing extra columns."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 1 else f"s{i % 2}", None if t is None else len(t), *["x"] * 8) for i, t in TEXTS.items()]
    return table(spark, [*rows, rows[0], (None, "A row without an id", None, None, None), (None, None, None, None, None)]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    note, ok = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


# -- words and hashes ---------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \n\té漢.-\x00", max_size=30), min_size=1, max_size=8))
def test_words_match_the_pattern(texts):
    data, off = textkit.buffers(pa.array(texts))
    for table_, pattern in ((textkit.SPACED, r"[^\x20\x09-\x0D]+"), (textkit.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        value, start, end, first = textkit.words(data, off, table_)
        raw = data.tobytes()
        got = [[raw[s:e].decode().translate(LOWER) for s, e in zip(start[first[i]:first[i + 1]], end[first[i]:first[i + 1]])] for i in range(len(texts))]
        assert got == [words(t, pattern) for t in texts]
        flat = [w for t in got for w in t]
        assert len(set(value.tolist())) == len(set(flat))


def test_long_texts_cut_between_words_hash_alike(monkeypatch):
    data, off = textkit.buffers(pa.array([LONG[:5000], "", LONG[:3000]]))
    whole = textkit.words(data, off, textkit.SPACED)
    monkeypatch.setattr(textkit, "PIECE_BYTES", 64)
    parts = textkit.words(data, off, textkit.SPACED)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


# -- 1 decontamination ---------------------------------------------------------------------------------------------

def brute_contamination(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {(i, tuple(w[j:j + 10])) for i, t in items for w in [words(t, pattern)] if w for j in range(max(1, len(w) - 9))}
    out = []
    for i, t in docs:
        w, hit, names = words(t, pattern), set(), set()
        for item, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j:j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    names |= {item} - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return Counter(out)


def test_decontamination_brute_force(spark, odd, empty):
    items = [(7, BODY.upper()), (8, "mu nu"), (9, None), (10, "..."), (None, "pi rho sigma"), (11, " ".join(BODY.split()[3:14])), (8, "mu nu"), (12, "absent words only here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in items_digest(decontaminate(odd, bench)).collect())
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == brute_contamination(docs, items)
    assert items_digest(decontaminate(empty, bench)).count() == 0
    assert not any(r.contaminated for r in items_digest(decontaminate(odd, bench.limit(0))).collect())


def test_decontamination_in_blocks_gives_the_same(spark, odd, monkeypatch):
    import veritab.llm.decontaminate as module
    bench = spark.createDataFrame([(7, BODY), (8, "mu nu"), (9, " ".join(BODY.split()[5:17]))], "item_id long, text string")
    short = odd.filter("doc_id <> 5")
    want = Counter(tuple(r) for r in items_digest(decontaminate(short, bench)).collect())
    monkeypatch.setattr(module, "BLOCK_BYTES", 500)
    assert Counter(tuple(r) for r in items_digest(decontaminate(short, bench)).collect()) == want


# -- 2 secrets -----------------------------------------------------------------------------------------------------

def brute_spans(text):
    text, out = text or "", []
    for rank, (kind, pattern, group, least) in enumerate((
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets(spark, odd, empty):
    key = "Zx81kQpLm29vRt5Yw0Bn"
    more = [(100 + i, f"key {key} and \U0001f600 token=secret=abcdef password=ab token = cdefgh12", None, f"o{i}", None) for i in range(4)]
    own = [(200, f"only here: {key[::-1]} passwd: 'hunter22'", None, None, None)]
    docs = odd.union(table(spark, [*more, *own]))
    found = {(r.doc_id, r.text): r for r in secrets.span_digest(secrets.scan(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()}
    for (_, text), r in found.items():
        base = brute_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    by = {k[0]: r for k, r in found.items()}
    assert "owned" not in by[100].spans and by[100].n_examples > 0  # four owners: a copied example
    assert f"owned:11:{11 + len(key)}" in by[200].spans.split(",")
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty).count() == 0


# -- 3 quality, 5 language: held-out accuracy -------------------------------------------------------------------------

def test_quality_held_out_and_odd_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.rank_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    marks = spark.createDataFrame([(0, 1, None), (6, 0, 1), (None, 1, 0), (7, None, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    out = quality.rank_quality(odd, marks).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.predicted == 1 for r in quality.rank_quality(odd, marks.limit(0)).collect())
    assert quality.rank_quality(empty, marks).count() == 0


def test_small_language_beside_two_million_grams():
    """Each language's probabilities are those of its own model, whatever others hold."""
    rng = np.random.default_rng(3)
    many = rng.integers(0x4E00, 0x9000, (2_000_000, language.ORDER)).astype(np.int32)
    few = np.array([[32, 32, 97 + i, 97 + j] for i in range(20) for j in range(20)], np.int32)
    lang = np.repeat([0, 1], [len(many), len(few)])
    both = language.Models(["a", "b"], lang, np.concatenate([many, few]), np.ones(len(lang)))
    assert len(both.orders[-1][0][0]) > 2_000_000
    alone = language.Models(["b"], np.zeros(len(few), int), few, np.ones(len(few)))
    # Only the uniform part knows the other language's symbols.
    alone.uniform = both.uniform
    columns = list(few.T.astype(np.uint32))
    assert np.allclose(both.log2(columns)[:, 1], alone.log2(columns)[:, 0], rtol=1e-12, atol=0)


def test_letters_of_all_planes():
    text = "\U00030001\U000313AF a".encode()
    *_, count = language.letters(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert count.tolist() == [3]


def test_language_held_out_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.02
    out = {r.doc_id: r for r in identify(odd).collect() if r.doc_id is not None}
    assert all(out[i].lang_pred == "und" and out[i].rejected and out[i].score == 0 for i in (2, 3, 4))
    assert out[7].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(empty).count() == 0


def test_kneser_ney_sums_to_one_and_matches_the_formula():
    text = "abab cab abba "
    seq = [" "] * (language.ORDER - 1) + list(text)
    grams = Counter(tuple(map(ord, seq[i:i + language.ORDER])) for i in range(len(text)))
    model = language.Models(["x"], np.zeros(len(grams), int), np.array(list(grams), np.int32), np.array(list(grams.values())))

    def p(gram, counts):
        if not gram:
            return 1 / (len(set(text)) + 1)
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        lower = Counter(g[1:] for g in counts) if len(gram) > 1 else None
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        below = p(gram[1:], lower)
        return (max(counts.get(gram, 0) - d, 0) + d * len(after) * below) / sum(after) if after else below

    for context in ([97, 98, 97], [32, 99, 97], [120, 120, 98], [120, 121, 122]):
        symbols = [*map(ord, sorted(set(text))), 0x7777]
        got = 2 ** model.log2([np.array([c] * len(symbols)) for c in context] + [np.array(symbols)])[:, 0]
        assert np.allclose(got, [p((*context, s), grams) for s in symbols]) and abs(got.sum() - 1) < 1e-9


# -- 4 vectors ------------------------------------------------------------------------------------------------------

def test_vectors_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1):
        for size in (1, 1, 2, 3, 40):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((i, (centre + 0.03 * rng.standard_normal(16)).tolist(), label))
                i += 1
    rows += [(i + j, rows[2][1], 0) for j in range(3)] + [(i + 3, (np.array(rows[2][1]) * 3).tolist(), 0), (i + 4, rows[2][1], 1)]
    n = i + 5
    odd_rows = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, [float("nan")] * 16, 0),
                (n + 5, [float("inf")] * 16, 0), (n + 6, rows[2][1], None), (None, rows[2][1], 0), (n + 7, rows[2][1][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd_rows], "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    links = {a: set() for a, *_ in rows + odd_rows if a is not None}
    for a, x, la in rows:
        for b, y, lb in rows:
            if a < b and la == lb and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            todo += [y for y in links[todo.pop()] if y not in seen and not seen.add(y)]
        assert (got[a].n_links, got[a].component_id, got[a].kept) == (len(links[a]), min(seen), min(seen) == a)
    assert got[None].component_id is None and got[None].n_links == 0 and got[None].kept
    assert vectors.near_vectors(df.limit(0)).count() == 0


def hot_pairs():
    """One label of pairs beside many labels of one row."""
    rng = np.random.default_rng(8)
    one = rng.standard_normal((3000, 48))
    two = one + 0.16 * rng.standard_normal(one.shape)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([one, two]))]
    rows += [(len(rows) + j, one[0].tolist(), j + 1) for j in range(2000)]
    unit = np.concatenate([one, two]) / np.linalg.norm(np.concatenate([one, two]), axis=1, keepdims=True)
    return rows, {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1)), strict=True)}


@pytest.mark.parametrize("orders", [None, 1])
def test_pairs_of_a_hot_label_are_found(spark, monkeypatch, orders):
    """With one order only the audit has to notice and the label is compared whole."""
    if orders:
        monkeypatch.setattr(vectors, "_order_counts", lambda size, threshold: np.full(len(size), orders))
        monkeypatch.setattr(vectors, "AUDIT_TRIES", 1)
    rows, links = hot_pairs()
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(links) > 2000 and len({x for p in links for x in p}) == 2 * len(links)
    assert {(r.component_id, r.vec_id) for r in got if not r.kept} == links
    assert sum(r.n_links for r in got) == 2 * len(links)


# -- 6 lengths, 9 packing: exact round trip --------------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab'sZ19 .,\n\t\r\x0b\x1c\x85\xa0 　é漢\U0001f600|<>", max_size=40), min_size=1, max_size=6))
def test_ids_are_the_tokenizers_ids(texts):
    path = tokens.default_path()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = [ids[first[i]:first[i + 1]].tolist() for lo, hi, ids, first in tokens.encoded(batch, 0, path) for i in range(hi - lo)]
    assert got == [e.ids for e in tokens.tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark, odd, empty):
    rows = pack(odd, capacity=64, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert 0 < r.length <= 64 and r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault((r.doc_id, r.ids_crc32 if r.doc_id is None else 0), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    token = tokens.tokenizer(tokens.default_path())
    for i, text in TEXTS.items():
        want = token.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted({(r.piece, r.start, tuple(r.ids)) for r in by_doc[(i, 0)]})
        assert [x for *_, ids in pieces for x in ids] == want and all(len(ids) == 64 for *_, ids in pieces[1:])
    assert len(by_seq) <= 1.02 * -(-sum(r.length for r in rows) // 64) + 2
    assert pack(empty).count() == 0


def test_length_histogram(spark, odd, empty):
    token = tokens.tokenizer(tokens.default_path())
    sizes = [len(token.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    hist = length_histogram(odd).cache()
    for r in hist.collect():
        assert (r.n_docs, r.docs_at_least, r.docs_below) == (sizes.count(r.n_tokens), sum(s >= r.n_tokens for s in sizes), sum(s < r.n_tokens for s in sizes))
        assert (r.tokens_at_least, r.tokens_below) == (sum(s for s in sizes if s >= r.n_tokens), sum(s for s in sizes if s < r.n_tokens))
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes)
    assert hist.agg(F.sum("n_docs")).first()[0] == len(sizes)
    assert total_at(hist, 7).first()[0] == sum(min(s, 7) for s in sizes)
    assert quantile(hist, 0.5).first()[0] == sorted(sizes)[math.ceil(len(sizes) / 2) - 1]
    assert length_histogram(empty).count() == 0 and total_at(length_histogram(empty), 7).first()[0] == 0


# -- 7 near-duplicates -----------------------------------------------------------------------------------------------

def brute_near(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_rows(count=150, seed=3):
    """Random texts, and one group of copies with a few changed words each, larger than a small node."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(count):
        text = list(base) if i % 2 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4) if i % 2 else 0):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((i * 7 % count * 7, " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, k, percent):
    rows = near_rows()
    got = near_duplicates(table(spark, rows), shingle=k, percent=percent).collect()
    want = brute_near(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("whole", [None, 200])
def test_pairs_inside_a_family_under_the_threshold(spark, monkeypatch, whole):
    """Different texts around one long passage, less similar than the threshold, and true pairs among them."""
    monkeypatch.setattr(minhash, "BLOCK", 64, raising=False)
    if whole:
        monkeypatch.setattr(minhash, "WHOLE_NODE", whole, raising=False)
    shared = [f"s{i}" for i in range(203)]
    rows = []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(24)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own[:-16] + [f"p{i}x{j}" for j in range(16)]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), shingle=3, percent=85).collect()}
    assert got == brute_near(rows, 3, 85) and len({c for _, c in got.values()}) == 300


def test_near_duplicates_odd_rows(spark, odd, empty):
    out = near_duplicates(odd, shingle=3, percent=85).collect()
    assert len(out) == odd.count()
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    want = brute_near([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert near_duplicates(empty).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + [(500, 500)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 131)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 8 lines ----------------------------------------------------------------------------------------------------------

def brute_lines(docs):
    first, order = {}, []
    for i, text in sorted((i, t) for i, t in docs if i is not None and t is not None):
        for j, line in enumerate(text.split("\n")):
            w = tuple(words(line))
            if len(w) >= lines.MIN_WORDS:
                order.append((i, j, w))
                first.setdefault(w, (i, j))
    gone = {(i, j) for i, j, w in order if (i, j) != first[w]}
    for w, at in first.items():
        if len(w) >= lines.MIN_FUZZY and any(len(v) >= lines.MIN_FUZZY and when < at and within_one_word(list(v), list(w)) for v, when in first.items() if v != w):
            gone |= {(i, j) for i, j, v in order if v == w}
    return gone


def test_line_dedup_brute_force(spark, odd, empty):
    rnd = random.Random(9)
    base = [[f"v{rnd.randrange(60)}" for _ in range(rnd.randint(1, 14))] for _ in range(12)]
    made = []
    for i in range(40):
        text = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(base))
            edit = rnd.randrange(5)
            at = rnd.randrange(len(line))
            if edit == 0:
                line[at] = "changed"
            elif edit == 1:
                del line[at]
            elif edit == 2:
                line.insert(at, f"new{rnd.randrange(3)}")
            text.append(" ".join(line).upper() if rnd.random() < 0.2 else " ".join(line))
        made.append((1000 + i, "\n".join(text)))
    docs = odd.union(table(spark, made))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone = brute_lines(rows)
    out = dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in out.collect())
    want = Counter()
    for i, t in rows:
        if t is None:
            want[(i, None, 0)] += 1
        else:
            kept = [s for j, s in enumerate(t.split("\n")) if (i, j) not in gone]
            want[(i, "\n".join(kept), t.count("\n") + 1 - len(kept))] += 1
    assert got == want
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize(("a", "b", "near"), [("abcd", "abcd", True), ("abcd", "abxd", True), ("abcd", "abd", True), ("abd", "abcd", True),
                                              ("abcd", "badc", False), ("abcd", "bcda", False), ("abc", "abcde", False), ("", "a", True), ("ab", "ba", False)])
def test_within_one_word(a, b, near):
    assert within_one_word(list(a), list(b)) == near


# -- 10 context trees -------------------------------------------------------------------------------------------------

def test_scores_against_a_plain_model(spark, odd, empty, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    train = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*words(t), "\0end"])
    total, distinct = sum(count.values()), len(count)

    def base(t):
        return sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in [*words(t), "\0end"])

    def check():
        out = ctw.score_texts(odd).collect()
        assert len(out) == len(docs)
        texts = dict(docs)
        for r in out:
            t = texts[r.doc_id] if r.doc_id is not None else None
            if r.doc_id is not None:
                w = [*words(t), "\0end"]
                assert r.n_tokens == len(w) and r.n_known == sum(count[x] > 0 for x in w) and r.train_tokens == total
                assert r.base_score == pytest.approx(base(t)) and r.score < 0 and r.bits_per_byte > 0
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        return {r.doc_id: r.score for r in out if r.doc_id is not None}

    want = check()
    monkeypatch.setattr(ctw, "MAX_WORDS", 0)
    assert check() == pytest.approx(want)
    assert ctw.score_texts(empty).count() == 0


def test_context_tree_matches_recursion():
    text = [0, 0] + list(b"abracadabra abra")
    depth = 2
    grams = np.array([text[i] | text[i - 1] << 8 | text[i - 2] << 16 for i in range(2, len(text))], np.uint64)
    keys, n = np.unique(grams, return_counts=True)
    tree = ctw.Tree(keys, n, depth)
    seen = Counter()
    for i in range(2, len(text)):
        for d in range(depth + 1):
            for bit in range(8):
                seen[(tuple(text[i - d:i]), text[i] >> (8 - bit), bit, text[i] >> (7 - bit) & 1)] += 1

    def kt(a, b):
        return math.exp(math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi))

    def weighted(context, prefix, bit):
        a, b = (seen[(context, prefix, bit, x)] for x in (0, 1))
        if len(context) == depth:
            return kt(a, b)
        longer = {c for c, p, k, _ in seen if len(c) == len(context) + 1 and c[1:] == context and (p, k) == (prefix, bit)}
        return 0.5 * kt(a, b) + 0.5 * math.prod(weighted(c, prefix, bit) for c in longer)

    def predict(context, prefix, bit, d=0):
        own = context[len(context) - d:]
        a, b = (seen[(own, prefix, bit, x)] for x in (0, 1))
        if a + b == 0:
            return None
        estimate = (b + 0.5) / (a + b + 1)
        deeper = predict(context, prefix, bit, d + 1) if d < depth else None
        if deeper is None:
            return estimate
        share = 0.5 * kt(a, b) / weighted(own, prefix, bit)
        return share * estimate + (1 - share) * deeper

    for context, byte in ((b"ab", ord("r")), (b"ra", ord("c")), (b"zz", ord("a")), (b"a ", ord("q"))):
        want = 0.0
        for bit in range(8):
            p = predict(tuple(context), byte >> (8 - bit), bit)
            p = 0.5 if p is None else p
            want += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        got = tree.log10(np.array([byte | context[1] << 8 | context[0] << 16], np.uint64))[0]
        assert got == pytest.approx(want)
    everything = np.array([b | ord("b") << 8 | ord("a") << 16 for b in range(256)], np.uint64)
    assert (10 ** tree.log10(everything)).sum() == pytest.approx(1)


# -- pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    odd_rows = [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, "1234 5678", None, "s", 9), (None, rows[0].text, "en", None, 1)]
    df = docs.union(spark.createDataFrame(odd_rows, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, df, SF).write.parquet(path)
        seen[name], df = df, spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
    after = spark.read.parquet(str(tmp_path / "language_id"))
    kept = {r.doc_id for r in after.collect()}
    assert not kept & {10_000, 10_001, 10_002} and len(kept) > 0.95 * len(rows)
    before = [(r.doc_id, r.text) for r in seen["minhash_near_dedup"].collect() if r.doc_id is not None]
    want = {i for i, (_, c) in brute_near(before, 5, 80).items() if i == c}
    assert {r.doc_id for r in seen["benchmark_decontamination"].collect()} - {None} == want
    clean = {r.doc_id for r in seen["best_fit_packing"].collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in seen["benchmark_decontamination"].collect()], items)
    assert clean == {i for i, *_, bad in found if not bad}
    assert {r.doc_id for r in df.collect()} == clean
