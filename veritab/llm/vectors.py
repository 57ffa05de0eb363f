"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. A neighbour graph starts from random projections: in each of several
orders (label, hyperplane signs, projection) every node meets the few before it. Signs are sorted like the
paths of a tree, so that rows side by side share as many as their label's size asks for; larger labels get
more orders. The graph is then refined by joining neighbours of neighbours; lists that hold nothing but
links are saturated and get longer. An audit compares some nodes of each large label, and some of all, with
the whole label and asks for more orders while links are missing; a label that still misses some is at last
compared in blocks. Edges of at least the threshold give the components; a count in blocks inside each
component then finds every link of it, so that no list length bounds the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.links import components, stored

ORDERS = 8
REACH = 12
LIST, LONGEST_LIST = 6, 24
ROUNDS = 4
# Neighbours below this lead to no link: two of them are more than twice a link's angle apart.
FLOOR = 0.92
# Signs sorted by, and the rows of one path that surely meet; orders are repeated until a pair of the threshold's cosine is missed with chance MISS.
SIGNS, LEAF, MISS = 62, 8, 0.001
BLOCK = 512
# Probes of all rows, and again of each label of more than one row in LARGE. Tries with more orders before a label is compared whole.
AUDIT_ROWS, AUDIT_RECALL, AUDIT_TRIES, LARGE = 64, 0.995, 3, 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # The largest component is taken out first, so that squares neither overflow nor vanish.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array):
    """(row numbers, unit vectors) for each vector length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _matrix(column.take(pa.array(at)))


def _order_counts(size: np.ndarray, threshold: float) -> np.ndarray:
    """Orders that a label of so many rows needs."""
    signs = np.ceil(np.log2(np.maximum(size / LEAF, 1)))
    stay = np.clip((1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** signs, 1e-6, 1 - 1e-6)
    return np.maximum(ORDERS, np.ceil(np.log(MISS) / np.log1p(-stay))).astype(int)


def _orders(salt: int, threshold: float):
    """Each node once per order of its label: (order, signs, projection) of its vector."""
    def run(batches):
        for batch in batches:
            for at, unit in _by_size(batch.column("vec")):
                rows = batch.take(pa.array(at))
                wanted = _order_counts(rows.column("size").to_numpy(), threshold)
                rows = rows.select(["grp", "vec", "id"])
                for order in range(wanted.max()):
                    go = np.flatnonzero(wanted > order)
                    planes = np.random.default_rng([salt, order, unit.shape[1]]).standard_normal((unit.shape[1], SIGNS + 1))
                    side = unit[go] @ planes
                    signs = (side[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), order), pa.int32()), pa.array(signs), pa.array(side[:, SIGNS]), *rows.take(pa.array(go)).columns],
                                                     names=["order", "signs", "side", *rows.schema.names])
    return run


def _meet(batches):
    """Every row with the REACH rows before it of its order and group: (a, b, cosine) from FLOOR on."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
        old = 0 if tail is None else len(tail)
        group = np.array(table.column("grp").to_pylist(), object)
        order, ids = table.column("order").to_numpy(), table.column("id").to_numpy()
        same = np.zeros(len(table), bool)
        same[1:] = (group[1:] == group[:-1]) & (order[1:] == order[:-1])
        run_of = np.cumsum(~same)
        vec = table.column("vec").combine_chunks()
        unit = np.zeros((len(table), int(vec.value_lengths().to_numpy(zero_copy_only=False).max(initial=1))))
        for at, part in _by_size(vec):
            unit[at, :part.shape[1]] = part
        out = []
        for step in range(1, min(REACH, len(table) - 1) + 1):
            i = np.arange(max(step, old), len(table))
            i = i[run_of[i] == run_of[i - step]]
            cosine = (unit[i] * unit[i - step]).sum(axis=1)
            near = cosine >= FLOOR
            out.append((ids[i[near]], ids[i[near] - step], cosine[near]))
        if out:
            x, y, c = (np.concatenate(p) for p in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(c)], names=["a", "b", "cosine"])
        tail = table.slice(max(0, len(table) - REACH))


def _cosines(batches):
    for batch in batches:
        x = batch.column("x")
        for at, unit in _by_size(x):
            rows = batch.take(pa.array(at))
            c = (unit * _matrix(rows.column("y"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(c)], names=["a", "b", "cosine"])


def _audit(probes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float):
    """Links of the probes (ids, components, unit vectors of each label) with all nodes: those inside one component, and all."""
    def run(batches):
        for batch in batches:
            group, own, comp = np.array(batch.column("grp").to_pylist(), object), batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            for g, (ids, comps, units) in probes.items():
                at = np.flatnonzero(group == g)
                if not len(at):
                    continue
                near = (_matrix(batch.column("vec").take(pa.array(at))) @ units.T >= threshold) & (own[at][:, None] != ids)
                hit = near & (comp[at][:, None] == comps)
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([int(hit.sum())]), pa.array([int(near.sum())])], names=["grp", "hit", "total"])
    return run


def _count_links(threshold: float):
    """Links per node inside a block pair."""
    def count(rows: pa.Table):
        unit = _matrix(rows.column("vec"))
        ids, weight, mine = rows.column("id").to_numpy(), rows.column("copies").to_numpy(), rows.column("mine").to_numpy()
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        near = unit @ unit.T >= threshold
        if p == q:
            np.fill_diagonal(near, False)
        else:
            near &= mine[:, None] != mine[None, :]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ weight)], names=["id", "links"])
    return count


def _link_forest(threshold: float):
    """Links that connect whatever links connect inside a block pair, fewer than it has rows."""
    def forest(rows: pa.Table):
        unit, ids = _matrix(rows.column("vec")), rows.column("id").to_numpy()
        near, free, pairs = unit @ unit.T >= threshold, np.ones(len(ids), bool), []
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
    return forest


def _each_block(work):
    """``work`` on runs of equal (comp, p, q), which sorted rows bring together; each run is bounded."""
    def run(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in ("comp", "p", "q")], axis=1)
            start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
            for lo, hi in zip(start[:-1], start[1:], strict=True):
                yield work(table.slice(lo, hi - lo))
            tail = table.slice(start[-1]) if len(start) else None
        if tail is not None and len(tail):
            yield work(tail)
    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of (comp, size, id, copies, vec) once per pair of blocks of their comp, sorted by (comp, p, q)."""
    held = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    held = held.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = held.select("comp", "id", "copies", "vec", "mine", other.alias("o")).select(
        "comp", "id", "copies", "vec", "mine", F.least("mine", "o").alias("p"), F.greatest("mine", "o").alias("q"))
    return dealt.repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q")


def _missed(nodes: DataFrame, comps: DataFrame, probe: list, threshold: float) -> list[str]:
    """Labels of which the audit finds links between components."""
    if not probe:
        return []
    comp = {r.node: r.component for r in comps.filter(F.col("node").isin(sorted({r.id for r in probe}))).collect()}
    by: dict[str, list] = {}
    for r in probe:
        by.setdefault(r.grp, []).append(r)
    probes = {g: (np.array([r.id for r in some]), np.array([comp.get(r.id, r.id) for r in some]), _matrix(pa.array([list(r.vec) for r in some], pa.list_(pa.float64())))) for g, some in by.items()}
    named = nodes.join(comps.withColumnRenamed("node", "id"), "id", "left").select("grp", "vec", "id", F.coalesce("component", "id").alias("comp"))
    met = named.mapInArrow(_audit(probes, threshold), "grp string, hit long, total long").groupBy("grp").agg(F.sum("hit").alias("hit"), F.sum("total").alias("total"))
    return [r.grp for r in met.collect() if r.hit < AUDIT_RECALL * r.total]


def _top_lists(edges: DataFrame, threshold: float, size: int) -> DataFrame:
    """Best neighbours per node: LIST of them, up to ``size`` where the list is saturated with links."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "cosine")
    rank = Window.partitionBy("u").orderBy(F.desc("cosine"), F.xxhash64("u", "v"))
    ranked = both.select("e.u", "e.v", "cosine").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= size)
    # Equal cosines make no order of their own; past the first LIST only links go on.
    return ranked.filter((F.col("rank") <= LIST) | (F.col("cosine") >= threshold)).select("u", "v")


def _refine(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until one finds no new neighbour."""
    size = LIST
    for _ in range(ROUNDS):
        lists = stored(_top_lists(edges, threshold, size))
        left, right = lists.select("u", F.col("v").alias("a")), lists.select("u", F.col("v").alias("b"))
        pairs = left.join(right, "u").filter("a < b").select("a", "b").distinct().join(edges, ["a", "b"], "left_anti")
        side = lambda x, name: nodes.select(F.col("id").alias(x), F.col("vec").alias(name))
        met = stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
                     .mapInArrow(_cosines, "a long, b long, cosine double").filter(F.col("cosine") >= FLOOR))
        if met.isEmpty():
            break
        edges = stored(edges.unionByName(met))
        size = min(2 * size, LONGEST_LIST)
    return edges


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.98) -> DataFrame:
    """One row per row: (vec_id, n_links, component_id, kept).

    Vectors of equal label and length are linked from cosine ``threshold`` on. A vector that is null, empty,
    zero or holds a null or non-finite component, or has a null label, links with nothing and is its own
    component. A row without id links with nothing, has a null component and is kept. Repeated rows are
    vectors of their own, linked like any equal ones. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(sound, F.col("vec")).alias("vec"), F.when(sound, F.concat_ws(":", F.size("vec").cast("string"), "label")).alias("grp"))
    nodes = stored(rows.filter("grp is not null").groupBy("grp", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    # One id under several vectors stays one node of the graph; its vectors are compared one by one.
    sizes = stored(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
    sized = nodes.join(sizes, "grp")
    n = max(nodes.count(), 1)
    share = F.when(F.col("size") * LARGE > n, AUDIT_ROWS * (1 + n / F.col("size"))).otherwise(AUDIT_ROWS)
    probe = sized.filter(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(n)) < share).select("grp", "vec", "id").limit(2 * LARGE * AUDIT_ROWS).collect()
    found = None
    for attempt in range(AUDIT_TRIES):
        kind = f"order int, signs long, side double, grp string, vec {dict(nodes.dtypes)['vec']}, id long"
        dealt = sized.mapInArrow(_orders(attempt, threshold), kind)
        key = ["order", "grp", "signs", "side", "id"]
        met = dealt.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_meet, "a long, b long, cosine double")
        edges = met if found is None else met.unionByName(found)
        found = _refine(nodes, stored(edges.filter("a <> b").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))), threshold)
        links = found.filter(F.col("cosine") >= threshold).select("a", "b")
        comps = stored(components(links))
        missed = _missed(nodes, comps, probe, threshold)
        if not missed:
            break
    if missed:
        whole = sized.filter(F.col("grp").isin(missed)).withColumn("comp", F.array_position(F.array(*map(F.lit, missed)), F.col("grp")))
        pairs = _dealt(whole).mapInArrow(_each_block(_link_forest(threshold)), "a long, b long").filter("a <> b")
        comps = stored(components(stored(links.union(pairs))))
    held = nodes.join(comps.withColumnRenamed("node", "id").withColumnRenamed("component", "comp"), "id")
    sizes = stored(held.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    counted = _dealt(held.join(sizes, "comp")).mapInArrow(_each_block(_count_links(threshold)), "id long, links long").groupBy("id").agg(F.sum("links").cast("long").alias("links"))
    named = stored(nodes.select("grp", "vec", "id", "copies").join(counted, "id", "left").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
                   .select("grp", "vec", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.join(named, ["grp", "vec"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
