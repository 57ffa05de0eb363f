"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ``window`` words in a row (an item of fewer words is one
window). A window counts only when all of it occurs, so of its shingles one, the rarest in
the corpus, is a sufficient prefix: only documents that hold this shingle can hold the window.
Each occurrence of a prefix shingle fixes where its window would begin; it must lie inside the
document (position and length bounds), then its words are compared one by one, as bytes.
Documents are scanned twice (rarity, join) and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import textkit
from veritab.llm.links import stored

# Windows are sent to the executors in blocks of at most so many bytes; each block is one more pass.
BLOCK_BYTES = 16 << 20


def _windows(size: int):
    def run(batches):
        for batch in batches:
            ids, data, off = batch.column(0), *textkit.buffers(batch.column(1))
            for lo, hi in textkit.chunks(off):
                raw = data[off[lo]:off[hi]]
                _, start, end, first = textkit.words(raw, off[lo:hi + 1], textkit.ALNUM)
                low = textkit.ALNUM[raw].tobytes()
                for d in range(hi - lo):
                    own = [low[s:e] for s, e in zip(start[first[d]:first[d + 1]], end[first[d]:first[d + 1]], strict=True)]
                    found = {b" ".join(own[i:i + size]).decode() for i in range(max(1, len(own) - size + 1))} if own else set()
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + d].as_py()] * len(found), pa.int64()), pa.array(sorted(found))], names=["item", "words"])
    return run


def _grams(value: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, whatever document they belong to."""
    out = np.zeros(max(len(value) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(textkit.seeds(k, 7)):
            out += value[j:j + len(out)] * factor
    return textkit.mix(out)


class _Index:
    """One block of windows: their words as bytes and hashes, items, and shingles by length."""

    def __init__(self, words: list[str], items: list[int | None], shingle: int):
        self.texts = sorted(set(words))
        place = {w: i for i, w in enumerate(self.texts)}
        pairs = sorted({(place[w], i) for w, i in zip(words, items, strict=True) if i is not None})
        self.item_of = np.array([i for _, i in pairs], np.int64)
        self.item_first = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(self.texts) + 1))
        self.bytes = [t.encode() for t in self.texts]
        data = np.frombuffer(b"".join(self.bytes), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])]).astype(np.int64)
        self.value, _, _, self.first = textkit.words(data, off, textkit.ALNUM)
        self.length = np.diff(self.first)
        self.widths = sorted({int(min(shingle, m)) for m in self.length})
        self.shingle = shingle
        self.keys, self.filters = {}, {}
        for width in self.widths:
            grams = _grams(self.value, width)
            inside = np.concatenate([np.arange(self.first[i], self.first[i + 1] - width + 1) for i in self._of(width)])
            self.keys[width] = np.unique(grams[inside])
            self._filter(width)

    def _of(self, width: int) -> np.ndarray:
        return np.flatnonzero(np.minimum(self.length, self.shingle) == width)

    def _filter(self, width: int) -> None:
        bits = np.zeros(1 << 20, bool)
        bits[(self.keys[width] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.filters[width] = bits

    def meet(self, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, key number) of the words from which a known shingle runs."""
        grams, keys = _grams(value, width), self.keys[width]
        maybe = np.flatnonzero(self.filters[width][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
        same = keys[at] == grams[maybe]
        return maybe[same], at[same]

    def prefixes(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep, of each window, its rarest shingle (the earliest of equals), with its place in the window."""
        self.post = {}
        for width in self.widths:
            grams, chosen = _grams(self.value, width), []
            for i in self._of(width):
                span = np.arange(self.first[i], self.first[i + 1] - width + 1)
                keys = np.searchsorted(self.keys[width], grams[span])
                best = min(range(len(span)), key=lambda j: (counts.get((width, int(keys[j])), 0), j))
                chosen.append((int(keys[best]), best, int(i)))
            chosen.sort()
            key, place, window = (np.array(c, np.int64) for c in zip(*chosen, strict=True))
            distinct, first = np.unique(key, return_index=True)
            self.keys[width] = self.keys[width][distinct]
            self._filter(width)
            self.post[width] = (np.append(first, len(key)), place, window)

    def occurrences(self, raw: np.ndarray, value, start, end, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every window that occurs, each once."""
        n, doc_of, low, found = len(first) - 1, None, None, []
        for width in self.widths:
            at, key = self.meet(value, width)
            if not len(at):
                continue
            doc_of = np.repeat(np.arange(n), np.diff(first)) if doc_of is None else doc_of
            begin, place, window = self.post[width]
            fan = np.diff(begin)[key]
            at, which = np.repeat(at, fan), np.repeat(begin[key], fan) + _ramp(fan)
            doc, word, win = doc_of[at], at - place[which], window[which]
            fits = (word >= first[doc]) & (word + self.length[win] <= first[doc + 1])
            doc, word, win = doc[fits], word[fits], win[fits]
            for j in range(int(self.length[win].max()) if len(win) else 0):
                still = j >= self.length[win]
                keep = still | (value[np.where(still, 0, word + j)] == self.value[np.where(still, 0, self.first[win] + j)])
                doc, word, win = doc[keep], word[keep], win[keep]
            if len(doc) and low is None:
                low = textkit.ALNUM[raw].tobytes()
            exact = [b" ".join([low[start[i]:end[i]] for i in range(w, w + self.length[x])]) == self.bytes[x] for w, x in zip(word.tolist(), win.tolist(), strict=True)]
            exact = np.array(exact, bool)
            found.append((doc[exact], word[exact], win[exact]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ramp(fan: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count, one after the other."""
    ends = np.cumsum(fan)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - fan, fan)


def _rarity(index: _Index):
    """How often each shingle of the index occurs, one row per shingle and task."""
    def run(batches):
        counts = {w: np.zeros(len(index.keys[w]), np.int64) for w in index.widths}
        for batch in batches:
            data, off = textkit.buffers(batch.column(0))
            for lo, hi in textkit.chunks(off):
                value, _, _, first = textkit.words(data[off[lo]:off[hi]], off[lo:hi + 1], textkit.ALNUM)
                for width in index.widths:
                    counts[width] += np.bincount(index.meet(value, width)[1], minlength=len(counts[width]))
        for width, n in counts.items():
            key = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), width), pa.int64()), pa.array(key), pa.array(n[key])], names=["width", "key", "n"])
    return run


def _spans(doc: np.ndarray, word: np.ndarray, length: np.ndarray, first: np.ndarray, old: list) -> list[list[tuple[int, int]]]:
    """Merged word ranges per document, earlier passes included."""
    n = len(first) - 1
    out = [list(o) for o in old]
    for d, w, m in zip(doc.tolist(), (word - first[doc]).tolist(), length.tolist(), strict=True):
        out[d].append((w, w + m))
    for d in range(n):
        if len(out[d]) > 1:
            merged = []
            for s, e in sorted(out[d]):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            out[d] = merged
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark(index: _Index):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textkit.buffers(batch.column("text"))
            for lo, hi in textkit.chunks(off):
                raw, part = data[off[lo]:off[hi]], batch.slice(lo, hi - lo)
                value, start, end, first = textkit.words(raw, off[lo:hi + 1], textkit.ALNUM)
                doc, word, win = index.occurrences(raw, value, start, end, first)
                old = [[(s["start"], s["end"]) for s in x] for x in part.column("spans").to_pylist()]
                spans = _spans(doc, word, index.length[win], first, old)
                items = [set(x) for x in part.column("items").to_pylist()]
                for d, w in set(zip(doc.tolist(), win.tolist(), strict=True)):
                    items[d].update(index.item_of[index.item_first[w]:index.item_first[w + 1]].tolist())
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("text"), part.column("rest"), pa.array(np.diff(first), pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPAN),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], names=["id", "text", "rest", "n_words", "spans", "items"])
    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, shingle: int = 3,
                  carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, text, n_words, spans, items) and the columns to ``carry``.

    ``spans`` are the merged word ranges covered by occurring windows, ``items`` the sorted ids of
    the items they come from. Null and empty texts have no words and no hit; an item without
    words has no window; an item without id marks words but is not named; repeated items count once,
    repeated documents each keep their row. Other columns are ignored.
    """
    source = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    wins = stored(source.mapInArrow(_windows(window), "item long, words string").distinct())
    total = wins.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    carry = carry or []
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(1).alias("_"), *carry).alias("rest"))
    none = F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>")
    state = base.select("id", "text", "rest", F.lit(0).cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<long>").alias("items"))
    kind = f"id {dict(base.dtypes)['id']}, text string, rest {dict(base.dtypes)['rest']}, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
    for block in range(max(blocks, 1)):
        rows = wins.filter(F.pmod(F.xxhash64("words", "item"), F.lit(max(blocks, 1))) == block).collect()
        index = _Index([r.words for r in rows], [r.item for r in rows], shingle)
        if rows:
            counted = base.select("text").mapInArrow(_rarity(index), "width long, key long, n long").groupBy("width", "key").agg(F.sum("n").alias("n"))
            index.prefixes({(r.width, r.key): r.n for r in counted.collect()})
        state = (state if block == 0 else stored(state)).mapInArrow(_mark(index), kind)
    return state.select(F.col("id").alias("doc_id"), "text", *[F.col("rest")[c].alias(c) for c in carry], "n_words", "spans", "items")


def items_digest(items: DataFrame) -> DataFrame:
    """The flat columns of a decontamination: hit words, item count and digest of the item ids."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return items.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
