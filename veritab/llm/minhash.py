"""MinHash near-duplicates by a chosen-path set similarity join.

Each document is the set of its distinct word shingles. Equal sets are one node (their least
doc_id). A tree sends a node down a path of chosen minwise tokens: the root takes two
coordinates of the sketch, every further branch three more, picked by the hash of the path.
Nodes of a tree with few members are compared exhaustively; larger ones first compare all
members with a few hubs. Where these leave several components, members are compared with members
in blocks, on the full sets; nodes too large for that first branch again, several times per level
so that a similar pair keeps meeting. Independent trees repeat this until the target recall is
met. Sketches only sort out candidates; a link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import textkit
from veritab.llm.links import components, stored

SKETCH = 128
TREES = 10
SMALL_NODE = 24
HUBS = 3
# Ids up to this many (8 bytes each) go to every task of the scan that builds their sets; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
# Nodes up to this many members are compared in blocks; larger ones branch first, for at most so many levels. Then they are compared in blocks at any size.
WHOLE_NODE = 4096
MAX_LEVELS, BRANCHES = 3, 3
BLOCK = 256
# Shingles counted at a time inside a pair of blocks.
COLUMNS = 8192
# A pair of the threshold's similarity falls this far below it in a sketch of 128 with chance under one in 100,000.
SKETCH_MARGIN = 0.15


def _sets(batch: pa.RecordBatch, words: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = textkit.buffers(batch.column(1))
    for lo, hi in textkit.chunks(off):
        value, _, _, first = textkit.words(data[off[lo]:off[hi]], off[lo:hi + 1], words)
        hashed, doc, _ = textkit.shingles(value, first, k)
        yield lo, hi, *textkit.distinct(hashed, doc, hi - lo)


def _minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, SKETCH) minwise values of 31 bits; documents without shingles keep the largest value."""
    n = len(first) - 1
    out = np.full((n, SKETCH), 0x7FFFFFFF, np.int32)
    held = np.flatnonzero(np.diff(first) > 0)
    if not len(held):
        return out
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    a, b = textkit.seeds(SKETCH, 3).astype(np.uint32) | np.uint32(1), (textkit.seeds(SKETCH, 4) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    at = first[held]
    with np.errstate(over="ignore"):
        for j in range(SKETCH):
            mixed = low * a[j] + high * b[j]
            mixed ^= mixed >> np.uint32(15)
            mixed *= b[j]
            out[held, j] = np.minimum.reduceat(mixed, at) >> np.uint32(1)
    return out


def _signatures(words: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, values, first in _sets(batch, words, k):
                count = np.diff(first)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                    held = np.flatnonzero(count > 0)
                    for s, salt in zip(sums, textkit.seeds(2, 5), strict=True):
                        if len(held):
                            s[held] = np.add.reduceat(textkit.mix(values ^ salt), first[held])
                sketch = _minima(values, first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * SKETCH, pa.int32()), pa.array(sketch.ravel()))],
                    names=["id", "n", "f1", "f2", "sketch"])
    return run


def _full_sets(words: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, values, first in _sets(batch, words, k):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "items"])
    return run


def _estimate(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / float(SKETCH)


def _near(n_a: Column, n_b: Column, s_a: Column, s_b: Column, percent: int) -> Column:
    """Whether sizes allow the similarity and sketches do not speak against it."""
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & (_estimate(s_a, s_b) >= percent / 100 - SKETCH_MARGIN)


def _pair(x: Column, y: Column) -> Column:
    first = x["id"] < y["id"]
    pick = lambda f: [F.when(first, x[f]).otherwise(y[f]), F.when(first, y[f]).otherwise(x[f])]
    (a, b), (n_a, n_b) = pick("id"), pick("n")
    return F.struct(a.alias("a"), b.alias("b"), n_a.alias("n_a"), n_b.alias("n_b"))


def _inner_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of different groups inside each small node."""
    ahead = lambda x, y: (y["id"] > x["id"]) & (y["comp"] != x["comp"]) & _near(x["n"], y["n"], x["sketch"], y["sketch"], percent)
    own = F.struct("id", "n", "comp", "sketch")
    groups = nodes.groupBy("path").agg(F.collect_list(own).alias("m")).select("m", F.explode("m").alias("x"))
    return groups.select(F.explode(F.transform(F.filter("m", lambda y: ahead(F.col("x"), y)), lambda y: _pair(F.col("x"), y))).alias("p")).select("p.*").distinct()


def _shared(items: pa.Array) -> np.ndarray:
    """Numbers of shared elements between all pairs of sets."""
    n, size = len(items), items.value_lengths().to_numpy(zero_copy_only=False)
    _, column, often = np.unique(items.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    row, held = np.repeat(np.arange(n), size), often[column] > 1
    row, column = row[held], column[held]
    order = np.argsort(column, kind="stable")
    row, column = row[order], (np.cumsum(often > 1) - 1)[column[order]]
    out = np.zeros((n, n), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, int(column[b - 1]) + 1 - lo), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += np.rint(part @ part.T).astype(np.int64)
    return out


def _block_links(percent: int):
    """Links that join the components inside each run of equal (path, p, q), counted on the full sets; fewer than the run has rows."""
    def links(rows: pa.Table):
        rows = rows.combine_chunks()
        ids, n, comp = (rows.column(c).to_numpy() for c in ("id", "n", "comp"))
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
        like = np.zeros((len(ids), len(ids)), np.int16)
        for j in range(SKETCH):
            like += sketch[:, j][:, None] == sketch[:, j]
        near = (like >= SKETCH * (percent / 100 - SKETCH_MARGIN)) & (comp[:, None] != comp)
        near &= np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent
        some = np.flatnonzero(near.any(axis=1))
        shared = _shared(rows.column("items").combine_chunks().take(pa.array(some)))
        near = near[np.ix_(some, some)] & (shared * 100 >= (n[some][:, None] + n[some] - shared) * percent)
        ids, free, pairs = ids[some], np.ones(len(some), bool), []
        for i in range(len(ids)):
            todo = [i] if free[i] else []
            free[i] = False
            while todo:
                x = todo.pop()
                hit = np.flatnonzero(near[x] & free)
                free[hit] = False
                pairs += [(ids[x], ids[y]) for y in hit]
                todo += hit.tolist()
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in ("path", "p", "q")], axis=1)
            start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
            for lo, hi in zip(start[:-1], start[1:], strict=True):
                yield links(table.slice(lo, hi - lo))
            tail = table.slice(start[-1]) if len(start) else None
        if tail is not None and len(tail):
            yield links(tail)
    return run


class _Join:
    """One run: the nodes, and confirmation of candidate pairs on full sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: np.ndarray, k: int, percent: int):
        self.docs, self.reps, self.words, self.k, self.percent = docs, reps, words, k, percent

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs of at least the asked similarity, counted on the full sets."""
        pairs = stored(pairs)
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        one = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        both = one.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        return stored(both.filter(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * self.percent).select("a", "b"))

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full sets of these ids."""
        ids = stored(ids.distinct())
        few = ids.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text")
        return stored(texts.mapInArrow(_full_sets(self.words, self.k), "id long, items array<long>"))

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Links between components inside nodes of (path, top, own, rest) rows, members against members.

        The ``own`` members of a node's largest component ``top`` have the first blocks, which are not compared with each other.
        """
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        mine = lambda c: F.pmod(F.xxhash64("id", "path"), blocks(c)).cast("int")
        in_top, last = F.col("comp") == F.col("top"), blocks("own") + blocks("rest") - 1
        held = rows.withColumn("mine", F.when(in_top, mine("own")).otherwise(blocks("own") + mine("rest")))
        dealt = held.withColumn("o", F.explode(F.sequence(F.when(in_top, blocks("own")).otherwise(F.lit(0)), last))).select(
            "path", "id", "n", "comp", "sketch", F.least("mine", "o").alias("p"), F.greatest("mine", "o").alias("q"))
        met = dealt.join(self.sets(rows.select("id")), "id").repartition("path", "p", "q").sortWithinPartitions("path", "p", "q")
        return stored(met.mapInArrow(_block_links(self.percent), "a long, b long").distinct())

    def hub_pairs(self, rows: DataFrame) -> DataFrame:
        """Each member of a large node with the node's hubs, where sizes and sketches allow a link of two groups.

        Some hubs are any members; the others are the members most similar to those, which
        finds the text in the middle from which many copies were made.
        """
        own = F.struct("id", "n", "comp", "sketch")
        some = stored(rows.groupBy("path").agg(F.array(*[F.min_by(own, F.xxhash64("path", "id", F.lit(h))) for h in range(HUBS)]).alias("some")))
        met = rows.join(some, "path")
        central = F.aggregate("some", F.lit(0.0), lambda s, h: s + _estimate(h["sketch"], F.col("sketch")))
        share = lambda h: F.when(F.pmod(F.xxhash64("id"), F.lit(HUBS)) == h, central)
        hubs = stored(met.groupBy("path").agg(F.first("some").alias("some"), F.array(*[F.max_by(own, share(h)) for h in range(HUBS)]).alias("more"))
                      .select("path", F.filter(F.concat("some", "more"), lambda h: h["id"].isNotNull()).alias("hubs")))
        allowed = lambda h: (h["comp"] != F.col("comp")) & _near(F.col("n"), h["n"], F.col("sketch"), h["sketch"], self.percent)
        met = rows.join(hubs, "path").select("id", "n", F.explode(F.array_distinct(F.transform(
            F.filter("hubs", allowed), lambda h: F.struct(h["id"].alias("id"), h["n"].alias("n"))))).alias("h"))
        return met.select(_pair(F.struct("id", "n"), F.col("h")).alias("p")).select("p.*").distinct()

    def links(self) -> DataFrame:
        tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(
            t, F.element_at("sketch", t * 2 + 1), F.element_at("sketch", t * 2 + 2)))).alias("path")
        roots = self.reps.select("id", tree)
        sizes = stored(roots.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        nodes = stored(roots.join(sizes, "path"))
        rows = stored(nodes.join(self.reps.select("id", "n", "sketch"), "id").withColumn("comp", F.col("id")))
        pairs = stored(_inner_pairs(rows.filter(F.col("size") <= SMALL_NODE), self.percent))
        rows = rows.filter(F.col("size") > SMALL_NODE).drop("size")
        if rows.isEmpty():
            return self.confirm(pairs)
        found = self.confirm(self.hub_pairs(rows))
        comps = stored(components(found))
        named = lambda df, col, out: df.join(comps.select(F.col("node").alias(col), F.col("component").alias("_c")), col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")
        rows = stored(named(rows.drop("comp"), "id", "comp"))
        pairs = stored(named(named(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b", "n_a", "n_b"))
        whole = None
        for level in range(MAX_LEVELS + 1):
            open_ = stored(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                           .filter("size > 1 and lo < hi").select("path", "size"))
            rows = stored(rows.join(open_, "path"))
            small = rows.filter(F.col("size") <= SMALL_NODE)
            if level:
                pairs = pairs.union(stored(_inner_pairs(small, self.percent)))
                rows = rows.filter(F.col("size") > SMALL_NODE)
            held = rows.filter(F.col("size") <= WHOLE_NODE) if level < MAX_LEVELS else rows
            whole = held if whole is None else whole.union(held)
            rows = rows.filter(F.col("size") > WHOLE_NODE).drop("size")
            if level == MAX_LEVELS or rows.isEmpty():
                break
            # Several branches, so that a pair of the least similarity keeps meeting.
            pick = lambda b, j: F.element_at("sketch", (F.pmod(F.xxhash64("path", b, F.lit(j)), F.lit(SKETCH)) + 1).cast("int"))
            child = lambda b: F.xxhash64("path", F.lit(b), *[pick(F.lit(b), j) for j in range(3)])
            kids = rows.withColumn("next", F.explode(F.array(*[child(b) for b in range(BRANCHES)])))
            rows = stored(kids.select("id", "n", "sketch", "comp", F.col("next").alias("path")))
        found = found.union(self.confirm(pairs.distinct()))
        # What the small nodes have linked need not be compared again.
        comps = stored(components(found))
        whole = named(whole.drop("comp"), "id", "comp").select("path", "id", "n", "comp", "sketch")
        several = whole.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("c"))
        several = stored(several.select("path", F.col("m.comp").alias("top"), F.col("m.c").alias("own"), (F.col("c") - F.col("m.c")).alias("rest")).filter("rest > 0"))
        whole = stored(whole.join(several, "path"))
        return found if whole.isEmpty() else found.union(self.block_links(whole))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    shingle: int = 5, percent: int = 80, words: np.ndarray = textkit.SPACED,
) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Documents with 100 * |A and B| >= percent * |A or B| of their shingle sets are linked;
    component_id is the least doc_id that links reach and kept tells whether it is the row's own.
    Words are lower-cased (A-Z) runs between the separators of ``words``; a text of fewer words than
    a shingle is one shingle. A null, empty or blank text has no shingle and links with nothing.
    A row without doc_id is returned with a null component and kept. Rows that repeat a doc_id
    count as one document. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = stored(docs.mapInArrow(_signatures(words, shingle), "id long, n long, f1 long, f2 long, sketch array<int>"))
    reps = stored(sig.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(
        F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    links = _Join(docs.filter("id is not null"), reps, words, shingle, percent).links()
    # The same id under several texts is one document: its classes share their least node.
    groups = stored(components(links))
    named = stored(reps.select("f1", "f2", "n", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "f1", "f2", "n", F.coalesce("component", "id").alias("component")))
    out = sig.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
