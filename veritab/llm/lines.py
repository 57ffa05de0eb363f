"""Corpus-wide line dedup by a deletion-neighbourhood join.

A line is its sequence of lower-cased words. A repeated line stays where it occurs first, by
(doc_id, line number). A line of MIN_FUZZY words or more also goes if one within an edit of one word
(changed, inserted or left out) occurs earlier: every line emits, as hashed keys, what is left of it
without one word; lines that share a key are verified word by word against the earliest of them.
Before that, lines are sorted out that cannot have a partner: one edit leaves one half of a line
whole, so only lines that share a half with another line emit their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import textkit
from veritab.llm.links import stored

# Lines of fewer words are left alone: blank lines, brackets, list marks.
MIN_WORDS = 2
# One word of eight or more may differ.
MIN_FUZZY = 8
# Bits of each of the two filters of shared halves that go to every task: 8 MB, whatever the corpus.
FILTER_BITS = 26
_N, _LEFT, _RIGHT, _AT = textkit.seeds(4, 21)


class _Lines:
    """Lines of consecutive documents with hashes of any run of their words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        off = off - off[0]
        begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))
        begin = begin[begin < len(raw)]
        bounds = np.append(begin, len(raw))
        self.value, _, _, self.first = textkit.words(raw, bounds, textkit.SPACED)
        self.size = np.diff(self.first)
        # Of documents that begin at one byte all but the last are empty.
        self.doc = np.searchsorted(off, begin, side="right") - 1
        self.number = np.arange(len(begin)) - np.searchsorted(begin, off[:-1])[self.doc] if len(begin) else begin
        self.power, self.inverse = textkit._powers(len(self.value) + 2)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value * self.power[:len(self.value)], dtype=np.uint64)])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial of the words from start to end."""
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def whole(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's words."""
        with np.errstate(over="ignore"):
            x = self.run(self.first[line], self.first[line + 1])
            n = self.size[line].astype(np.uint64)
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(self.value ^ _LEFT) * self.power[:len(self.value)], dtype=np.uint64)])
            y = (other[self.first[line + 1]] - other[self.first[line]]) * self.inverse[self.first[line]]
            return textkit.mix(x + n * _N), textkit.mix(y + n * _N)

    def halves(self, line: np.ndarray) -> np.ndarray:
        """(lines, 4) keys: both halves, for partners of the same length and of one word less."""
        s, e, out = self.first[line], self.first[line + 1], []
        with np.errstate(over="ignore"):
            for less in (0, 1):
                size = self.size[line] - less
                half, tag = size // 2, size.astype(np.uint64) * _N
                out.append(textkit.mix(self.run(s, s + half) * _LEFT + tag))
                out.append(textkit.mix(self.run(e - (size - half), e) * _RIGHT + tag))
        return np.stack(out, axis=1) if len(line) else np.zeros((0, 4), np.uint64)

    def variants(self, line: np.ndarray, same: np.ndarray, less: np.ndarray):
        """(line, role, key): 0 one word left open at its place, 1 left out, 2 the line itself.

        ``same`` and ``less`` tell, per line and half, whether a line of the same length, or one of a word less or
        more, may share this half; then the edit lies in the other one.
        """
        n = self.size[line]
        row = np.repeat(np.arange(len(line)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        half, half_less = n // 2, (n - 1) // 2
        change = np.where(at >= half[row], same[row, 0], same[row, 1])
        leave = ((at >= half_less[row]) & less[row, 2]) | ((at <= half_less[row]) & less[row, 3])
        own = line[less[:, 0] | less[:, 1]]
        out = []
        with np.errstate(over="ignore"):
            for role, keep in ((0, change), (1, leave)):
                of, i = line[row[keep]], at[keep]
                s, e, size = self.first[of], self.first[of + 1], self.size[of].astype(np.uint64)
                left, right = self.run(s, s + i), self.run(s + i + 1, e)
                key = left * _LEFT + right * _RIGHT + size * _N + i.astype(np.uint64) * _AT if role == 0 else left + self.power[i] * right + (size - np.uint64(1)) * _N
                out.append((of, np.full(len(of), role, np.int32), textkit.mix(key)))
            key = textkit.mix(self.run(self.first[own], self.first[own + 1]) + self.size[own].astype(np.uint64) * _N)
        out.append((own, np.full(len(own), 2, np.int32), key))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _each(batch: pa.RecordBatch):
    data, off = textkit.buffers(batch.column(1))
    for lo, hi in textkit.chunks(off):
        if off[hi] > off[lo]:
            yield batch.column(0).slice(lo, hi - lo), _Lines(data[off[lo]:off[hi]], off[lo:hi + 1])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _line_rows(batches):
    for batch in batches:
        for ids, lines in _each(batch):
            line = np.flatnonzero(lines.size >= MIN_WORDS)
            h, g = lines.whole(line)
            fuzzy = lines.size[line] >= MIN_FUZZY
            keys = lines.halves(line[fuzzy]).view(np.int64).ravel()
            first = np.concatenate([[0], np.cumsum(fuzzy * 4)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(lines.doc[line])), _long(lines.number[line]), _long(h), _long(g),
                                              pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys))], names=["id", "line", "h", "g", "halves"])


def _variant_rows(same_bits: np.ndarray, less_bits: np.ndarray):
    def run(batches):
        for batch in batches:
            for ids, lines in _each(batch):
                line = np.flatnonzero(lines.size >= MIN_FUZZY)
                place = (lines.halves(line) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                same, less = (((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool) for bits in (same_bits, less_bits))
                possible = np.flatnonzero(same[:, :2].any(axis=1) | less.any(axis=1))
                # Of equal lines of this range only the first occurrence goes on: the others are repeated lines.
                h = lines.whole(line[possible])[0]
                doc = ids.to_numpy(zero_copy_only=False)[lines.doc[line[possible]]]
                order = np.lexsort((lines.number[line[possible]], doc, h))
                first = order[np.r_[True, h[order][1:] != h[order][:-1]]] if len(order) else order
                chosen = possible[first]
                line, same, less, h = line[chosen], same[chosen], less[chosen], h[first]
                of, role, key = lines.variants(line, same, less)
                place_of = np.full(len(lines.size), -1)
                place_of[line] = np.arange(len(line))
                at = place_of[of]
                # A line's words go with its first row.
                lead = np.zeros(len(of), bool)
                lead[np.unique(at, return_index=True)[1]] = True
                count = np.where(lead, lines.size[of], 0)
                words = lines.value.view(np.int64)
                flat = np.concatenate([words[lines.first[i]:lines.first[i + 1]] for i in of[lead]]) if lead.any() else words[:0]
                yield pa.RecordBatch.from_arrays([
                    _long(key), pa.array(role), _long(h[at]), ids.take(pa.array(lines.doc[of])), _long(lines.number[of]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat))],
                    names=["key", "role", "h", "id", "line", "words"])
    return run


def within_one_word(a: list, b: list) -> bool:
    """Whether one changed, inserted or left-out word at most lies between two lists."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long_ = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(short, long_, strict=False)) if x != y), len(short))
    return long_[same + 1:] == (short[same + 1:] if len(a) == len(b) else short[same:])


def _verified(batches):
    for batch in batches:
        ok = [within_one_word(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["id", "line"]).filter(pa.array(ok, pa.bool_()))


def _bits(keys: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of the keys, built by the executors in slices."""
    place = F.expr(f"(key & {(1 << FILTER_BITS) - 1}) + 1")
    slices = keys.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("slice")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    # Place p >= 1 is bit p - 1 of slices of 32768 bits, numbered from 1.
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in slices.collect():
        out[(row.slice - 1) * 4096:row.slice * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the lines that stay, all other columns, and (n_lines, n_dropped).

    Lines end at a line feed. A document that loses all lines stays with an empty text; a null text stays null,
    with no lines. A row without id takes no part and keeps its text. Rows that repeat an id and a
    text lose the same lines and neither loses what only they share. Order of occurrence: doc_id, then line.
    Columns named n_lines or n_dropped in the input are replaced.
    """
    own = {id_col, text_col, "n_lines", "n_dropped"}
    rest = [c for c in docs.columns if c not in own]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(1).alias("_"), *rest).alias("rest"))
    texts = base.filter("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    lines = stored(texts.mapInArrow(_line_rows, "id long, line long, h long, g long, halves array<long>"))
    repeated = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line")).alias("first")).filter("n > 1")
    halves = lines.select(F.posexplode("halves").alias("which", "key"), "h")
    own = F.when(F.col("which") < 2, F.col("h"))
    shared = halves.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.max("which").alias("most"))
    shared = stored(shared.filter("lo is not null and (lo <> hi or most > 1)"))
    longer = stored(shared.filter("most > 1").select("key"))
    variants = stored(texts.mapInArrow(_variant_rows(_bits(shared.filter("lo <> hi").select("key")), _bits(longer)),
                                       "key long, role int, h long, id long, line long, words array<long>"))
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("id", "line", "h"))).alias(f"m{role}")
    met = variants.groupBy("key").agg(least(0), least(1), least(2), F.min("h").alias("lo"), F.max("h").alias("hi"))
    met = stored(met.filter("lo <> hi").drop("lo", "hi"))
    other = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.drop("words").join(met.hint("merge"), "key").select("id", "line", "h", other.alias("o"))
    pairs = pairs.filter((F.struct("o.id", "o.line") < F.struct("id", "line")) & (F.col("o.h") != F.col("h")))
    pairs = stored(pairs.select("id", "line", "h", F.col("o.h").alias("h2")).distinct())
    words = stored(variants.filter(F.size("words") > 0).groupBy("h").agg(F.first("words").alias("x")))
    both = pairs.join(words, "h").join(words.toDF("h2", "y"), "h2")
    near = both.select("id", "line", "x", "y").mapInArrow(_verified, "id long, line long")
    again = lines.select("id", "line", "h", "g").join(stored(repeated.select("h", "g", "first")).hint("merge"), ["h", "g"]).filter(F.struct("id", "line") != F.col("first"))
    gone = near.union(again.select("id", "line"))
    drops = stored(gone.groupBy("id").agg(F.collect_set("line").alias("drop")))
    # Sort-merge joins at every size: the lists of lines to drop grow with the corpus.
    out = base.join(drops.withColumn("id", F.col("id").cast(dict(base.dtypes)["id"])).hint("merge"), "id", "left").select("id", "text", "drop", "rest")
    out = out.mapInArrow(_cut, f"id {dict(base.dtypes)['id']}, text string, rest {dict(base.dtypes)['rest']}, n_lines long, n_dropped long")
    named = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("rest")[c] for c in rest}
    return out.select(*[named[c].alias(c) for c in docs.columns if c in named], "n_lines", "n_dropped")


def _cut(batches):
    for batch in batches:
        data, off = textkit.buffers(batch.column("text"))
        feeds = np.concatenate([[0], np.cumsum(data[off[0]:off[-1]] == 10)])[off - off[0]]
        n = np.where(np.asarray(batch.column("text").is_null()), 0, np.diff(feeds) + 1)
        drop = batch.column("drop")
        count = np.nan_to_num(np.asarray(drop.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        changed = np.flatnonzero(count)
        text = batch.column("text")
        if len(changed):
            kept = []
            for i in changed.tolist():
                gone = set(drop[i].as_py())
                kept.append("\n".join([s for j, s in enumerate(text[i].as_py().split("\n")) if j not in gone]))
            mask = np.zeros(len(batch), bool)
            mask[changed] = True
            text = pa.compute.replace_with_mask(text, pa.array(mask), pa.array(kept, text.type))
        yield pa.RecordBatch.from_arrays([batch.column("id"), text, batch.column("rest"), pa.array(n), pa.array(count)],
                                         names=["id", "text", "rest", "n_lines", "n_dropped"])
