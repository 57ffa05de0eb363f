"""Alignment of two tokenizers against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from veritab.llm import alignment, textkit, tokens
from veritab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, id string, links string, row string, pair string, n long, rest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", 1, "x") for i, t in rows], KIND)


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_piece_path())


def byte_of_char():
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = byte_of_char()


def _upto(side, end):
    for at, i in side:
        yield str(i)
        if at == end:
            return


def brute(models, text):
    """(a ids, b ids, groups, links) of a text, or None."""
    if not text:
        return None
    a, b = models
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(BYTES[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (left, right)):
        return None
    ends = []
    for side in (left, right):
        at, out = 0, {}
        for i, raw in side:
            at += len(raw)
            out[at] = i
        ends.append(out)
    groups, links, sides = [], [], [iter(sorted(side.items())) for side in ends]
    for end in sorted(ends[0].keys() & ends[1].keys()):
        groups.append("|".join(",".join(_upto(side, end)) for side in sides))
        links.append((ends[0][end], ends[1][end]))
    return len(left), len(right), groups, links


def brute_rows(models, rows):
    found = {t: brute(models, t) for t in {t for _, t in rows}}
    count, best = Counter(), defaultdict(int)
    for _, t in rows:
        count.update(found[t][3] if found[t] else [])
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = Counter()
    for i, t in rows:
        if not found[t]:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_a, n_b, groups, links = found[t]
        out[i, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


ALPHABET = ["a", "B", " ", "  ", "   ", "\n", "\t", "é", "漢", "😀", "\x00", "<s>", "</s>", "<|endoftext|>", "1", "23", ".", "'s", "　", "ß", "\r\n", "<0x0A>", "word", " the", "ing", "‍", "ﬁ", "\xa0"]


def odd_texts():
    rng = random.Random(5)
    return [*("".join(rng.choices(ALPHABET, k=rng.randint(1, 30))) for _ in range(400)), "a▁b", "▁", " ", "   ", "\n", "x " * 40_000, "pre <|endoftext|> post <s>"]


def test_brute_force_on_odd_rows(spark, models, monkeypatch):
    rows = [*enumerate(odd_texts()), (900, None), (901, ""), (None, "no id here"), (902, "again the word"), (902, "again the word"), (None, None)]
    want = brute_rows(models, rows)
    assert Counter(map(tuple, alignment.alignments(table(spark, rows)).collect())) == want
    # Fewer pairs sent to the tasks: the rest meets its counts by a join, with the same result.
    monkeypatch.setattr(alignment, "SENT_PAIRS", 60)
    assert Counter(map(tuple, alignment.alignments(table(spark, rows)).collect())) == want
    assert not alignment.alignments(table(spark, [])).collect()
    only = alignment.alignments(table(spark, [(1, None), (2, "▁")])).collect()
    assert {tuple(r) for r in only} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_small_caches_and_pieces_change_nothing(models, monkeypatch):
    texts = odd_texts()[:150]
    monkeypatch.setattr(tokens, "KEPT_SEGMENTS", 20)
    monkeypatch.setattr(alignment, "_ENCODERS", {})
    data, off = textkit.buffers(pa.array(texts))
    for lo, hi in textkit.chunks(off, 200):
        rows, found = alignment.align(data, off[lo:hi + 1], tokens.default_path(), alignment.default_piece_path())
        names = dict(zip((lo + rows).tolist(), found.digests())) if found else {}
        for i in range(lo, hi):
            want = brute(models, texts[i])
            assert names.get(i) == (want and hashlib.sha256(";".join(want[2]).encode()).hexdigest())


def test_counts_yield_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "COMPACT", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array([[i, i + 1, 7], [], [i]], pa.list_(pa.int32()))], names=["links"]) for i in range(20)]
    total = Counter()
    for out in alignment._count_pairs(iter(batches)):
        total.update(dict(zip(out.column("pair").to_pylist(), out.column("n").to_pylist())))
    want = Counter(x for b in batches for row in b.column("links").to_pylist() for x in row)
    assert total == want


def test_query_against_brute_force(spark, models):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if not t or len(t) < 4000]
    got = {r.doc_id: r for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in short:
        found = brute(models, t)
        want = (found[0], found[1], len(found[2]), hashlib.sha256(";".join(found[2]).encode()).hexdigest()) if found else (0, 0, 0, "")
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].groups_sha256) == want
    # Corpus counts over all documents, long ones too.
    assert Counter(map(tuple, got.values())) == brute_rows(models, docs)
