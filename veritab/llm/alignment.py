"""Alignment of two tokenizers over a corpus: groups of tokens that span the same bytes, and which ids go together.

A is the byte-level vocabulary, B the piece vocabulary with byte fallback. Tokens of both are intervals of bytes; sorted by
start, a group ends where the next start reaches the greatest end so far. Pieces never hold a blank behind another
character, so texts are cut there, each different segment is encoded once, and the rest is array work on
whole Arrow batches. Tokens that end together are links; how often the corpus links two ids then ranks them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import textkit, tokens
from veritab.llm.links import stored

# Id pairs sent to the tasks: the most frequent ones, 17 bytes each. Links of the others are joined by a shuffle.
SENT_PAIRS = 2_000_000
COMPACT = 500_000
# Links that a task looks up at a time.
LINKS_AT_ONCE = 250_000
BLANK = "▁"


def default_piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _pieces(path: str):
    """(processor, bytes of each id)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]


@lru_cache(maxsize=2)
def _byte_sizes(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: one for each character of its entry."""
    entries = tokens.tokenizer(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(entries.values()) + 1, np.int64)
    for entry, i in entries.items():
        out[i] = len(entry)
    return out


class PieceEncoder(tokens.Encoder):
    """Piece ids of texts that begin with the blank the vocabulary puts before them."""

    def __init__(self, path: str):
        self.model, self.bytes_of = _pieces(path)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.lone = self.model.piece_to_id(BLANK)
        super().__init__(path)

    def _reset(self) -> None:
        super()._reset()
        self.exact = np.zeros(0, bool)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        # The blank in front is the processor's own; a segment of nothing else has no text left.
        lists = [found or [self.lone] for found in self.model.encode([t[1:] for t in texts])]
        exact = [b"".join(map(self.bytes_of.__getitem__, ids)) == t.encode() for ids, t in zip(lists, texts, strict=True)]
        count = np.array([len(x) for x in lists], np.int64)
        entry = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.keys, self.exact = np.concatenate([self.count, count]), np.concatenate([self.keys, keys]), np.concatenate([self.exact, exact])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))])
        for which in range(2):
            slot = self._slot(keys, which)
            free = self.slots[which][slot] < 0
            self.slots[which][slot[free]] = entry[free]

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each document, whether a document's pieces are its bytes)."""
        blank = data == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[off[:-1]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        value = tokens._segment_hashes(data, begin, end)
        if len(self.keys) > tokens.KEPT_SEGMENTS:
            self._reset()
        at = self._find(value)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            keys, sample, inverse = np.unique(value[miss], return_index=True, return_inverse=True)
            raw, old = data.tobytes(), len(self.keys)
            self._learn(keys, [raw[begin[i]:end[i]].decode() for i in miss[sample].tolist()])
            at[miss] = old + inverse
        count, first = self.count[at], np.searchsorted(begin, off, side="left")
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[tokens.spread(self.start[at], count)], total[first], np.logical_and.reduceat(self.exact[at], first[:-1])


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a piece vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``top``, from the left, and their number."""
    n = np.arange(top + 1)
    size = np.ones(top + 1, np.int64)
    for power in range(1, len(str(top))):
        size += n >= 10**power
    digits = np.zeros((top + 1, int(size.max())), np.uint8)
    for place in range(digits.shape[1]):
        held = size > place
        digits[held, place] = 0x30 + n[held] // 10 ** (size[held] - 1 - place) % 10
    return digits, size


@lru_cache(maxsize=2)
def _decimals_of(top: int):
    return _decimals(top)


class Aligned:
    """Both encodings of consecutive texts, each with its blank in front, and their groups and links."""

    def __init__(self, data: np.ndarray, off: np.ndarray, a: np.ndarray, first_a: np.ndarray, end_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, end_b: np.ndarray):
        self.a, self.b, self.first_a, self.first_b = a, b, first_a, first_b
        start = np.concatenate([[0], end_a[:-1], [0], end_b[:-1]])
        end, side = np.concatenate([end_a, end_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        broken = np.append(True, start[order][1:] >= reach[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(broken) - 1
        self.group_a, self.group_b, self.groups = group[:len(a)], group[len(a):], int(broken.sum())
        # Groups never span documents: each begins and ends with tokens of both.
        self.first_group = np.append(self.group_a[first_a[:-1]], self.groups)
        low, high = np.searchsorted(end_b, end_a, "left"), np.searchsorted(end_b, end_a, "right")
        count = high - low
        self.link_a, self.link_b = np.repeat(np.arange(len(a)), count), tokens.spread(low, count)
        self.first_link = np.concatenate([[0], np.cumsum(count)])[first_a]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups written as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a) + len(self.b)
        per_a, per_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        # A token stands behind all tokens of earlier groups, B's behind their group's of A.
        at_a = np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(per_a)[self.group_b]
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        ends = np.cumsum(per_a + per_b)
        mark[ends - 1] = ord(";")
        mark[ends - per_b - 1] = ord("|")
        digits, sizes = _decimals_of(int(ids.max(initial=0)) | 0xFFFF)
        size = sizes[ids]
        start = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.zeros(int(start[-1]), np.uint8)
        for place in range(digits.shape[1]):
            held = np.flatnonzero(size > place)
            text[start[held] + place] = digits[ids[held], place]
        text[start[1:] - 1] = mark
        view, bounds = memoryview(text), start[self.first_a + self.first_b]
        return [hashlib.sha256(view[s:e - 1]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _with_blanks(data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of some rows, each behind a blank: (bytes, offsets)."""
    size = off[rows + 1] - off[rows]
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(bounds[-1]), 0x20, np.uint8)
    out[tokens.spread(bounds[:-1] + 1, size)] = data[tokens.spread(off[rows], size)]
    return out, bounds


def align(data: np.ndarray, off: np.ndarray, path_a: str, path_b: str) -> tuple[np.ndarray, Aligned | None]:
    """(rows that have tokens, their alignment); empty texts and those whose tokens do not spell the text have none."""
    rows = np.flatnonzero(np.diff(off) > 0)
    b_encoder, sizes_a = piece_encoder(path_b), _byte_sizes(path_a)
    while len(rows):
        joined, bounds = _with_blanks(data, off, rows)
        b, first_b, exact = b_encoder.pieces(joined, bounds)
        a, first_a = tokens.encoder(path_a).encode(joined, bounds)
        end_a = np.cumsum(sizes_a[a])
        spelled = np.concatenate([[0], end_a])[first_a] == bounds
        exact &= spelled[1:] & spelled[:-1]
        if exact.all():
            return rows, Aligned(joined, bounds, a, first_a, end_a, b, first_b, np.cumsum(b_encoder.sizes[b]))
        rows = rows[exact]
    return rows, None


def _documents(path_a: str, path_b: str, wide: bool):
    """Counts, digest and packed links per document."""
    base = len(_pieces(path_b)[1])
    kind = np.int64 if wide else np.int32

    def run(batches):
        for batch in batches:
            data, off = textkit.buffers(batch.column("text"))
            for lo, hi in textkit.chunks(off):
                n = hi - lo
                rows, found = align(data, off[lo:hi + 1], path_a, path_b)
                counts, names, links, bounds = np.zeros((4, n), np.int64), np.full(n, "", object), np.zeros(0, kind), np.zeros(n + 1, np.int64)
                if found is not None:
                    for out, first in zip(counts, (found.first_a, found.first_b, found.first_group, found.first_link), strict=True):
                        out[rows] = np.diff(first)
                    names[rows] = found.digests()
                    links = (found.a[found.link_a].astype(np.int64) * base + found.b[found.link_b]).astype(kind)
                    bounds[1:] = np.cumsum(counts[3])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, n), *map(pa.array, counts), pa.array(names, pa.string()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(links))],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
    return run


def _link_ranges(batch: pa.RecordBatch):
    """(first row, last row + 1, links, links before each row) by ranges of bounded size."""
    column = batch.column("links")
    links, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    for lo, hi in textkit.chunks(bounds, LINKS_AT_ONCE):
        yield lo, hi, links[bounds[lo]:bounds[hi]].astype(np.int64), bounds[lo:hi + 1] - bounds[lo]


def _forget() -> None:
    """Workers live on from stage to stage: give back what encoding held."""
    _ENCODERS.clear()
    tokens._ENCODERS.clear()
    pa.default_memory_pool().release_unused()


def _count_pairs(batches):
    """(pair, n) per task, counted as often as memory asks for."""
    _forget()
    parts, held = [], 0
    for batch in batches:
        for *_, links, _ in _link_ranges(batch):
            parts.append(np.unique(links, return_counts=True))
            held += len(parts[-1][0])
            if held > COMPACT:
                parts = [_added(parts)]
                held = len(parts[0][0])
                if held > COMPACT // 2:
                    yield _pair_batch(*parts.pop())
                    held = 0
    if parts:
        yield _pair_batch(*_added(parts))


def _added(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _pair_batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])


def _sum_links(table):
    """Sums of each document over its links to pairs of the table, and its links to others."""
    def run(batches):
        _forget()
        keys, n, best = table.value
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "links"]
            for lo, hi, links, bounds in _link_ranges(batch):
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                met = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                each = lambda v: np.concatenate([[0], np.cumsum(v)])[bounds]
                # Whole numbers all the way: sums of counts outgrow a double's 53 bits.
                count, top = (np.diff(each(np.where(met, v[at], 0) if len(keys) else np.zeros(len(links), np.int64))) for v in (n, best))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(top), pa.array(count), pa.ListArray.from_arrays(pa.array(each(~met), pa.int32()), pa.array(links[~met]))],
                                                 names=[*keep, "n_best", "count_sum", "rest"])
    return run


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether its B id has no pair of more."""
    made = aligned.select("links").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # One B id has at most as many pairs as A has ids.
    return made.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % base)))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Both encode the text behind one blank, without special tokens; their strings inside a text are plain text. Texts that are
    null or empty, or whose tokens do not spell the blank and the text, have no tokens: zeros and an empty digest. Null and repeated ids keep
    their rows, repeated rows count as often as they occur, other columns are ignored, an empty table gives no row. A text is
    handled as one value, so memory follows the longest one.
    """
    path_a, path_b = path_a or tokens.default_path(), path_b or default_piece_path()
    base, spark = len(_pieces(path_b)[1]), docs.sparkSession
    wide = base * len(_byte_sizes(path_a)) >= 1 << 31
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    kind = f"id {dict(source.dtypes)['id']}, {counts}"
    made = source.mapInArrow(_documents(path_a, path_b, wide), f"{kind}, links array<{'long' if wide else 'int'}>")
    aligned = stored(made.withColumn("row", F.monotonically_increasing_id()))
    pairs = stored(pair_counts(aligned, base))
    total, sent = pairs.count(), pairs
    if total > SENT_PAIRS:
        least = pairs.agg(F.percentile_approx("n", 1 - 0.9 * SENT_PAIRS / total, 100_000)).first()[0]
        sent = pairs.filter(F.col("n") > least)
    held = sent.toArrow().sort_by("pair")
    arrays = [held.column(c).to_numpy() for c in ("pair", "n", "best")]
    summed = aligned.mapInArrow(_sum_links(spark.sparkContext.broadcast(arrays)), f"{kind}, row long, n_best long, count_sum long, rest array<long>")
    if total > SENT_PAIRS:
        summed = stored(summed)
        each = summed.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("m"))
        more = each.join(pairs.filter(F.col("n") <= least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        summed = summed.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + zero(F.col("more_best")), "count_sum": F.col("count_sum") + zero(F.col("more"))})
    return summed.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
