"""Mutual information by k nearest neighbours, exact, from cells of bounded size.

Points of two numbers are cut into stripes and each stripe into cells by quantiles. A cell bounds its points' k-th distance; only
points whose square of that size reaches into other cells look there too. Counts within the final distance come from a running
count over each axis. Against a class, neighbours lie on one axis: points are sorted by class and value and look at k on each side, then sorted
by value, where a task counts within the distances of its own points and asks other tasks' blocks only for ends that leave its range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import ordered_scan
from veritab.session import cut_lineage, sized_join

CELL, MAX_CELLS = 512, 1_000_000
ACCURACY = 10_000
JITTER = 1e-10
# Sorted values of one group that are stored as one row.
BLOCK = 1 << 14
# Values of an axis that a task holds at once, while it counts what lies inside bounds.
WINDOW = 1 << 20


def digamma(n: Column) -> Column:
    """Digamma of a positive number: ten steps up, then the asymptotic series."""
    n = n.cast("double")
    x = n + 10
    steps = sum((1 / (n + i) for i in range(1, 10)), 1 / n)
    y = 1 / (x * x)
    return F.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - steps


def _jittered(value: Column, spread: Column, level: Column, salt: Column) -> Column:
    """Scaled to unit deviation, ties parted by a hash: at most JITTER of the mean size."""
    unit = F.conv(F.substring(F.md5(salt), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1
    scale = F.when(spread > 0, spread).otherwise(1.0)
    return value / scale + JITTER * F.greatest(F.lit(1.0), level / scale) * unit


def _bounds(points: DataFrame, cells: dict[str, int], k: int) -> dict[str, tuple[np.ndarray, list[np.ndarray]]]:
    """Per feature: bounds between stripes, and in each stripe bounds between cells; at most MAX_CELLS numbers in all."""
    # Stripes are ranges of y, cells are ranges of x.
    edges = {}
    for f, s in cells.items():
        q = [i / s for i in range(1, s)]
        got = points.filter(F.col("feature") == f).agg(F.percentile_approx("y", q, ACCURACY).alias("q")).first().q if q else []
        edges[f] = np.unique(np.array(got, float))
    table = points.sparkSession.createDataFrame([(f, e.tolist()) for f, e in edges.items()], "feature string, _e array<double>")
    striped = points.join(F.broadcast(table), "feature").withColumn("stripe", F.size(F.filter("_e", lambda e: e <= F.col("y"))))
    sizes = striped.groupBy("feature", "stripe").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", [i / 64 for i in range(1, 64)], ACCURACY).alias("q64"))
    out = {f: (edges[f], [np.zeros(0)] * (len(edges[f]) + 1)) for f in cells}
    wanted = {}
    for r in sizes.collect():
        # A cell holds well over k points: its own bound is never missing.
        parts = int(max(1, r.n // max(CELL, 8 * (k + 1), _cell_size(r.n))))
        wanted.setdefault(parts, []).append((r.feature, r.stripe))
        if parts <= 64:
            out[r.feature][1][r.stripe] = np.unique(np.array(r.q64, float)[(np.arange(1, parts) * 64 // parts) - 1]) if parts > 1 else np.zeros(0)
    for parts, places in wanted.items():
        if parts > 64:
            some = striped.join(F.broadcast(points.sparkSession.createDataFrame(places, "feature string, stripe int")), ["feature", "stripe"])
            for r in some.groupBy("feature", "stripe").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 4 * parts + ACCURACY).alias("q")).collect():
                out[r.feature][1][r.stripe] = np.unique(np.array(r.q, float))
    return out


def _cell_size(n: int) -> int:
    return n // 1000


class _Grid:
    """Cells by number: stripes one after the other."""

    def __init__(self, bounds: tuple[np.ndarray, list[np.ndarray]]):
        self.edges, self.cuts = bounds
        self.base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])

    def stripe(self, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, y, side="right")

    def cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, stripe = np.zeros(len(x), np.int64), self.stripe(y)
        for s in np.unique(stripe):
            at = stripe == s
            out[at] = self.base[s] + np.searchsorted(self.cuts[s], x[at], side="right")
        return out

    def reached(self, x: float, y: float, r: float) -> np.ndarray:
        """Cells that the square around a point touches."""
        low, high = np.searchsorted(self.edges, [y - r, y + r], side="right")
        return np.concatenate([np.arange(self.base[s] + np.searchsorted(self.cuts[s], x - r, side="right"), self.base[s] + np.searchsorted(self.cuts[s], x + r, side="right") + 1) for s in range(low, high + 1)])


def _distances(ax, ay, bx, by) -> np.ndarray:
    return np.maximum(np.abs(ax[:, None] - bx[None, :]), np.abs(ay[:, None] - by[None, :]))


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    k = min(k, d.shape[1])
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1) if k else d[:, :0]


def _first_within(x: np.ndarray, r: np.ndarray, sign: int) -> np.ndarray:
    """The number farthest from x on one side whose difference, as rounded, is still below r: by halving, to the last digit."""
    inside, outside = x.copy(), x + sign * 2 * r
    # The number looked for is a few digits from x + r; where that bracket holds, few halvings are left.
    step = 4 * np.spacing(np.abs(x) + r)
    low, high = x + sign * (r - step), x + sign * (r + step)
    inside, outside = np.where(np.abs(low - x) < r, low, inside), np.where(np.abs(high - x) < r, outside, high)
    for _ in range(200):
        middle = inside + (outside - inside) / 2
        if ((middle == inside) | (middle == outside)).all():
            break
        near = np.abs(middle - x) < r
        inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
    return inside


def _radii(points: DataFrame, k: int, counts: dict[str, int]) -> DataFrame:
    """(feature, id, x, y, near): the k least distances to other points, fewer where there are fewer."""
    cells = {f: max(1, min(int(math.sqrt(n / CELL)), int(math.sqrt(MAX_CELLS)))) for f, n in counts.items()}
    grids = {f: _Grid(b) for f, b in _bounds(points, cells, k).items()}

    def place(batches):
        for batch in batches:
            feature = np.array(batch.column("feature").to_pylist(), object)
            x, y, cell = batch.column("x").to_numpy(), batch.column("y").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for f in set(feature):
                at = feature == f
                cell[at] = grids[f].cell(x[at], y[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    kind = dict(points.dtypes)["id"]
    data = cut_lineage(points.select("feature", "id", "x", "y").mapInArrow(place, f"feature string, id {kind}, x double, y double, cell long"))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        x, y, near = pdf["x"].to_numpy(), pdf["y"].to_numpy(), []
        for i in range(0, len(pdf), 256):
            d = _distances(x[i:i + 256], y[i:i + 256], x, y)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near += list(_nearest(d, min(k, len(pdf) - 1)))
        return pdf.assign(near=near)

    first = cut_lineage(data.groupBy("feature", "cell").applyInPandas(own, f"feature string, id {kind}, x double, y double, cell long, near array<double>"))

    def ask(batches):
        for batch in batches:
            rows, cells_ = [], []
            columns = [batch.column(c).to_pylist() for c in ("feature", "x", "y", "cell", "near")]
            for i, (f, x, y, cell, near) in enumerate(zip(*columns, strict=True)):
                r = near[-1] if len(near) == k else np.inf
                more = grids[f].reached(x, y, r)
                more = more[more != cell]
                rows += [i] * len(more)
                cells_ += more.tolist()
            got = batch.take(pa.array(rows, pa.int64()))
            limit = pa.array([v[-1] if len(v) == k else np.inf for v in got.column("near").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([got.column("feature"), pa.array(cells_, pa.int64()), got.column("id"), got.column("x"), got.column("y"), limit], names=["feature", "cell", "qid", "qx", "qy", "limit"])

    asked = first.mapInArrow(ask, f"feature string, cell long, qid {kind}, qx double, qy double, limit double")

    def other(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"feature": [], "id": [], "near": []}, dtype=object)
        x, y, out = a["x"].to_numpy(), a["y"].to_numpy(), []
        for i in range(0, len(b), 256):
            part = b.iloc[i:i + 256]
            d = _nearest(_distances(part["qx"].to_numpy(), part["qy"].to_numpy(), x, y), k)
            out += [row[row < limit] for row, limit in zip(d, part["limit"].to_numpy(), strict=True)]
        return pd.DataFrame({"feature": b["feature"].to_numpy(), "id": b["qid"].to_numpy(), "near": out})

    sides = data.select("feature", "cell", "x", "y"), asked.withColumnRenamed("feature", "qf").withColumnRenamed("cell", "qc").withColumn("feature", F.col("qf"))
    found = sides[0].groupBy("feature", "cell").cogroup(sides[1].groupBy("qf", "qc")).applyInPandas(other, f"feature string, id {kind}, near array<double>")
    more = found.filter(F.size("near") > 0).groupBy("feature", "id").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = F.slice(F.array_sort(F.concat("near", F.coalesce("more", F.array().cast("array<double>")))), 1, k)
    return first.join(more, ["feature", "id"], "left").select("feature", "id", "x", "y", both.alias("near"))


def _limits(batches):
    """Bounds of the values that lie nearer than the last of ``near``, on both axes."""
    for batch in batches:
        near = batch.column("near")
        size = near.value_lengths().to_numpy(zero_copy_only=False)
        r = near.flatten().to_numpy(zero_copy_only=False)[np.cumsum(size) - 1]
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        ends = [pa.array(_first_within(v, r, s)) for v in (x, y) for s in (-1, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("feature"), batch.column("id"), batch.column("x"), batch.column("y"), pa.array(size, pa.int32()), *ends],
                                         names=["feature", "id", "x", "y", "k", "x_low", "x_high", "y_low", "y_high"])


def _counted(points: DataFrame, axes: list[str]) -> DataFrame:
    """(feature, axis, id, n): values of each axis inside a point's bounds, itself included."""
    cells = []
    for axis in axes:
        cells += [F.struct(F.lit(axis).alias("axis"), F.col(c).alias("v"), F.lit(o).alias("o"), F.lit(p).alias("p"), F.lit(s).alias("s")) for c, o, p, s in (
            (f"{axis}_low", 0, 0, -1), (axis, 1, 1, 0), (f"{axis}_high", 2, 0, 1))]
    long = points.select("feature", "id", F.inline(F.array(*cells)))
    # At equal values a lower bound comes before the points, an upper one behind.
    scanned = ordered_scan(long, ["feature", "axis"], ["v", "o"], sums={"_c": "p"})
    return scanned.filter("s <> 0").groupBy("feature", "axis", "id").agg(F.sum(F.col("s") * F.col("_c")).alias("n"))


def _sorted_blocks(points: DataFrame, keys: list[str]) -> DataFrame:
    """(part, place, keys, xs): values in the order of keys and x, by runs of at most BLOCK; part and place number them in that order. Stored."""
    def run(batches):
        held, size, place = None, 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *[pa.array([k]) for k in held[0]], pa.array([np.concatenate(held[1])], pa.list_(pa.float64()))], names=["place", *keys, "xs"])

        for batch in batches:
            columns, x = [batch.column(k).to_numpy() for k in keys], batch.column("x").to_numpy()
            new = np.zeros(len(x), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            bounds = np.append(np.flatnonzero(new), len(x))
            start = 0
            for end in bounds.tolist():
                while start < end:
                    key = tuple(c[start] for c in columns)
                    if held is not None and (held[0] != key or size == BLOCK):
                        yield row()
                        held, size, place = None, 0, place + 1
                    held = held or (key, [])
                    take = min(end - start, BLOCK - size)
                    held[1].append(x[start:start + take])
                    size, start = size + take, start + take
        if held is not None:
            yield row()

    kinds = dict(points.dtypes)
    made = points.select(*keys, "x").orderBy(*keys, "x").mapInArrow(run, ", ".join(["place int", *[f"{k} {kinds[k]}" for k in keys], "xs array<double>"]))
    return cut_lineage(made.withColumn("part", F.spark_partition_id()))


def _class_limits(points: DataFrame, k: int) -> DataFrame:
    """(f, k, x, low, high) of points (f, y, x): how many neighbours of its class a point has, up to k, and the bounds of what lies nearer than the last.

    Rows come in ranges of f and x, sorted in each task.
    """
    blocks = _sorted_blocks(points, ["f", "y"])

    def edges(batches):
        # A part's first and last k values, with their class.
        first, last = [], []
        for batch in batches:
            for part, f, y, head, tail in zip(*[batch.column(c).to_pylist() for c in ("part", "f", "y", "head", "tail")], strict=True):
                first += [(f, y, v) for v in head[:max(0, k - len(first))]]
                last = (last + [(f, y, v) for v in tail])[-k:]
        if first:
            rows = [(part, end, *v) for end, side in ((0, first), (1, last)) for v in side]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "end", "f", "y", "x"])

    # At most 2 k rows per task.
    ends: dict[int, tuple[list, list]] = {}
    short = blocks.select("part", "f", "y", F.slice("xs", 1, k).alias("head"), F.when(F.size("xs") <= k, F.col("xs")).otherwise(F.slice("xs", -k, k)).alias("tail"))
    for r in short.mapInArrow(edges, "part int, end int, f int, y double, x double").collect():
        ends.setdefault(r.part, ([], []))[r.end].append((r.f, r.y, r.x))
    parts = sorted(ends)
    around: dict[int, tuple[list, list]] = {}
    held: list = []
    for p in parts:
        around[p] = (held, [])
        held = (held + ends[p][1])[-k:]
    held = []
    for p in reversed(parts):
        around[p] = (around[p][0], held)
        held = (ends[p][0] + held)[:k]

    # Ranges for the tasks that count: bounds among the middles of blocks, each standing for its values. Equal values stay together.
    middles = blocks.select("f", F.element_at("xs", (F.size("xs") / 2 + 1).cast("int")).alias("x"), F.size("xs").alias("n")).orderBy("f", "x").collect()
    share = sum(m.n for m in middles) / int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds: dict[int, list[float]] = {}
    first_task: dict[int, int] = {}
    tasks = held = 0
    for m in middles:
        if m.f not in bounds:
            bounds[m.f], first_task[m.f] = [], tasks
            tasks, held = tasks + 1, 0
        elif held >= share:
            bounds[m.f].append(m.x)
            tasks, held = tasks + 1, 0
        held += m.n

    def solve(f, y, xs, before, behind):
        same = lambda rows: [v for g, c, v in rows if g == f and c == y]
        left, right = same(before), same(behind)
        n = len(xs)
        wide = np.concatenate([np.full(k - len(left), np.nan), left, xs, right, np.full(k - len(right), np.nan)])
        d = np.stack([np.abs(wide[k + s:k + s + n] - xs) for s in range(-k, k + 1) if s])
        d[np.isnan(d)] = np.inf
        d.sort(axis=0)
        size = np.minimum(np.isfinite(d).sum(axis=0), k)
        at = size > 0
        x, size = xs[at], size[at]
        r = d[size - 1, np.flatnonzero(at)]
        task = first_task[f] + np.searchsorted(bounds[f], x, side="right")
        return pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(np.full(len(x), f, np.int32)), pa.array(size.astype(np.int32)), *[pa.array(v) for v in (x, _first_within(x, r, -1), _first_within(x, r, 1))]], names=["task", "f", "k", "x", "low", "high"])

    def run(batches):
        # A block is solved once k values behind it are known.
        waiting, before, part = [], [], None
        for batch in batches:
            for p, f, y, xs in zip(*[batch.column(c).to_pylist() for c in ("part", "f", "y")], batch.column("xs"), strict=True):
                if part is None:
                    part, before = p, around[p][0]
                waiting.append((f, y, xs.values.to_numpy()))
                while len(waiting) > 1 and (waiting[0][:2] != waiting[1][:2] or sum(len(w[2]) for w in waiting[1:]) >= k):
                    f0, y0, x0 = waiting.pop(0)
                    yield solve(f0, y0, x0, before, [(g, c, v) for g, c, values in waiting for v in values[:k].tolist()][:k])
                    before = (before + [(f0, y0, v) for v in x0[-k:].tolist()])[-k:]
        while waiting:
            f0, y0, x0 = waiting.pop(0)
            behind = ([(g, c, v) for g, c, values in waiting for v in values[:k].tolist()] + around[part][1])[:k]
            yield solve(f0, y0, x0, before, behind)
            before = (before + [(f0, y0, v) for v in x0[-k:].tolist()])[-k:]

    made = blocks.select("part", "f", "y", "xs").mapInArrow(run, "task int, f int, k int, x double, low double, high double")
    return made.repartitionById(max(tasks, 1), "task").drop("task").sortWithinPartitions("f", "x")


def _axis_blocks(batches):
    """(f, k, x, low, high) of rows sorted by f and x, by runs of BLOCK of one f; the last run of an f is shorter."""
    names, f, held, size = ("k", "x", "low", "high"), None, [], 0
    for batch in batches:
        fs, *columns = (batch.column(c).to_numpy() for c in ("f", *names))
        bounds = np.append(np.flatnonzero(fs[1:] != fs[:-1]) + 1, len(fs)) if len(fs) else []
        start = 0
        for end in bounds:
            while start < end:
                if held and (fs[start] != f or size == BLOCK):
                    yield f, *(np.concatenate(c) for c in zip(*held, strict=True))
                    held, size = [], 0
                f, take = int(fs[start]), min(int(end) - start, BLOCK - size)
                held.append([c[start:start + take] for c in columns])
                size, start = size + take, start + take
    if held:
        yield f, *(np.concatenate(c) for c in zip(*held, strict=True))


def _within(limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((f, n, points), (f, k, points)): how many points have n values of x inside their bounds, themselves included, and how many have k neighbours.

    ``limits`` lies in ranges of f and x, sorted in each task.
    """
    def run(batches):
        # One task's range of x, by blocks; the last WINDOW values are held, bounds that reach beyond them are placed among the blocks.
        counts: dict[tuple, int] = {}
        f, held, gone, blocks = None, np.empty(0), 0, 0
        low, high, left, at = (np.empty(0) for _ in range(4))

        def counted(kind, values, times):
            for v, c in zip(values.tolist(), times.tolist(), strict=True):
                counts[kind, f, v] = counts.get((kind, f, v), 0) + c

        def inside(ready):
            n = gone + np.searchsorted(held, high[ready], side="right") - left[ready].astype(np.int64)
            counted(2, *np.unique(n, return_counts=True))

        def flush():
            keys = np.array(list(counts), np.int64).reshape(-1, 3)
            yield _kind(keys[:, 0], keys[:, 1], keys[:, 2], np.array(list(counts.values()), np.int64))
            counts.clear()

        def finish():
            # Equal values are all in one task, so ends inside its range are counted here.
            mine = high <= held[-1]
            inside(mine)
            if not mine.all():
                yield far(low[~mine], high[~mine])

        def far(a, b):
            return _kind(np.full(len(a), 3), np.full(len(a), f), np.zeros(len(a)), np.ones(len(a)), a, b)

        for g, ks, xs, lows, highs in _axis_blocks(batches):
            if g != f:
                if f is not None:
                    yield from finish()
                f, held, gone, blocks = g, np.empty(0), 0, 0
                low, high, left, at = (np.empty(0) for _ in range(4))
            yield _kind(np.zeros(1), np.array([f]), np.array([blocks]), np.array([len(xs)]), xs[:1], xs[-1:], xs)
            blocks += 1
            counted(1, *np.unique(ks, return_counts=True))
            drop = max(0, len(held) + len(xs) - max(WINDOW, len(xs)))
            held, gone = np.concatenate([held[drop:], xs]), gone + drop
            # What is no longer held may equal the first value that is.
            known = lows > held[0] if gone else lows >= held[0]
            if not known.all():
                yield far(lows[~known], highs[~known])
            low, high = np.concatenate([low, lows[known]]), np.concatenate([high, highs[known]])
            left = np.concatenate([left, gone + np.searchsorted(held, lows[known], side="left")])
            at = np.concatenate([at, np.full(known.sum(), gone + len(held))])
            ready = high < held[-1]
            inside(ready)
            late = ~ready & (at < gone + len(held) - WINDOW // 2)
            if late.any():
                yield far(low[late], high[late])
            low, high, left, at = (v[~ready & ~late] for v in (low, high, left, at))
            if len(counts) > BLOCK:
                yield from flush()
        if f is not None:
            yield from finish()
            yield from flush()

    def _kind(kind, f, n, points, low=None, high=None, xs=None):
        ends = [pa.nulls(len(kind), pa.float64()) if v is None else pa.array(v) for v in (low, high)]
        values = pa.nulls(len(kind), pa.list_(pa.float64())) if xs is None else pa.array([xs], pa.list_(pa.float64()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([*[pa.array(np.asarray(v).astype(np.int64), pa.int64()).cast(t) for v, t in zip((kind, f, n, points), kinds, strict=True)], *ends, values], names=["kind", "f", "n", "points", "low", "high", "xs"])

    made = limits.mapInArrow(run, "kind int, f int, n long, points long, low double, high double, xs array<double>")
    made = cut_lineage(made.withColumn("id", F.monotonically_increasing_id()))
    blocks = made.filter("kind = 0")
    # One row for every BLOCK values.
    index: dict[int, list] = {}
    for r in blocks.select("f", "id", "points", "low", "high").orderBy("f", "low", "id").collect():
        index.setdefault(r.f, []).append((r.low, r.high, r.points, r.id))
    starts = {f: np.array([b[0] for b in v]) for f, v in index.items()}
    last = {f: np.array([b[1] for b in v]) for f, v in index.items()}
    upto = {f: np.concatenate([[0], np.cumsum([b[2] for b in v])]) for f, v in index.items()}
    names = {f: np.array([b[3] for b in v]) for f, v in index.items()}

    def place(batches):
        # Values below an end: those of whole blocks before it, and a share of the one or more blocks it falls into.
        for batch in batches:
            rows = []
            for f, i, low, high in zip(*[batch.column(c).to_pylist() for c in ("f", "id", "low", "high")], strict=True):
                # Equal values may fill several blocks, so every block that holds the end is asked.
                whole = int(np.searchsorted(last[f], low, side="left"))
                rows.append((f, i, int(-upto[f][whole]), None, None, 0))
                rows += [(f, i, 0, int(names[f][b]), low, -1) for b in range(whole, int(np.searchsorted(starts[f], low, side="left")))]
                whole = int(np.searchsorted(last[f], high, side="right"))
                rows.append((f, i, int(upto[f][whole]), None, None, 0))
                rows += [(f, i, 0, int(names[f][b]), high, 1) for b in range(whole, int(np.searchsorted(starts[f], high, side="right")))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["f", "point", "base", "id", "v", "sign"])

    asked = made.filter("kind = 3").select("f", "id", "low", "high").mapInArrow(place, "f int, point long, base long, id long, v double, sign int")
    asked = cut_lineage(asked)
    below = F.size(F.filter("xs", lambda x: F.when(F.col("sign") > 0, x <= F.col("v")).otherwise(x < F.col("v"))))
    inside = sized_join(blocks.select("id", "xs"), asked.filter("sign <> 0").select("id", "f", "point", "v", "sign"), "id").select("f", "point", (F.col("sign") * below).cast("long").alias("base"))
    far = asked.filter("sign = 0").select("f", "point", "base").unionByName(inside).groupBy("f", "point").agg(F.sum("base").alias("n")).select("f", "n", F.lit(1).cast("long").alias("points"))
    return made.filter("kind = 2").select("f", "n", "points").unionByName(far), made.filter("kind = 1").select("f", F.col("n").alias("k"), "points")


def _class_information(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """(feature, n, score) of rows (id, _y, features): no row is repeated before it is a point, and only numbers are sorted."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = rows.filter(finite("_y"))
    sizes = cut_lineage(rows.groupBy("_y").agg(*[F.count_if(finite(f)).alias(f) for f in features]))
    alone = sizes.select("_y", F.array(*[F.col(f) == 1 for f in features]).alias("_alone")).filter(F.exists("_alone", lambda a: a))
    if not alone.isEmpty():
        rows = sized_join(rows, alone, "_y", "left").select("id", "_y", *[F.when(~F.coalesce(F.get("_alone", F.lit(i)), F.lit(False)), F.col(f)).alias(f) for i, f in enumerate(features)])
    kept = [F.when(finite(f), F.col(f)) for f in features]
    stats = rows.agg(*[F.struct(F.count(c).alias("n"), F.stddev_pop(c).alias("s"), F.avg(F.abs(c)).alias("a")).alias(f"s{i}") for i, c in enumerate(kept)]).first()
    name = F.col("id").cast("string")
    cells = [F.struct(F.lit(i).alias("f"), F.col("_y").alias("y"), _jittered(c, F.lit(s.s), F.lit(s.a), F.concat_ws("|", F.lit(f), name)).alias("x"))
             for i, (f, c, s) in enumerate(zip(features, kept, stats, strict=True)) if s.n > 1]
    names = rows.sparkSession.createDataFrame(list(enumerate(features)), "f int, feature string")
    if not cells:
        return names.select("feature", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"))
    counts, near = _within(_class_limits(rows.select(F.inline(F.array(*cells))).filter("x is not null"), k))
    axes = counts.groupBy("f").agg(F.sum(F.col("points") * digamma(F.col("n"))).alias("psi"))
    base = near.groupBy("f").agg(F.sum("points").alias("n"), F.sum(F.col("points") * digamma(F.col("k"))).alias("pk"))
    labels = sizes.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("size")) for i, f in enumerate(features)]))).filter("size > 1").groupBy("f").agg(
        F.sum(F.col("size") * digamma(F.col("size"))).alias("pl"))
    score = base.join(axes, "f").join(labels, "f").select("f", "n", (digamma(F.col("n")) + (F.col("pk") - F.col("pl") - F.col("psi")) / F.col("n")).alias("score"))
    return names.join(score, "f", "left").select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def knn_mutual_information(df: DataFrame, features: list[str], y: str, key: str, *, k: int = 3, discrete: bool | None = None) -> DataFrame:
    """(feature, n, score): mutual information in nats of each feature with y, never below 0.

    Numbers: distances are the greater of both axes' differences; psi(n) + psi(k) - mean psi(nx) - mean psi(ny), counts being of values
    strictly nearer than the k-th neighbour, the point included. Classes (``discrete``; by the task inference of D7 if not given): the k-th
    neighbour of its class in x, classes of one row left out. Columns are scaled to unit deviation; ties are parted by a hash of ``key``, which is
    unique, as small as 1e-10. Null and non-finite values take no part, feature by feature. Fewer than two usable rows give 0.
    """
    from veritab.operators.relevance import infer_task, melt
    rows = df.filter(F.col(y).isNotNull())
    if discrete is None:
        discrete = infer_task(rows, y).first().task == "classification"
    target = F.col(y).cast("double")
    if discrete:
        return _class_information(rows.select(F.col(key).alias("id"), target.alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]), features, k)
    long = melt(rows.withColumn("_y", target), features, [F.col(key).alias("id"), "_y"])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    long = cut_lineage(long.filter(finite("x") & finite("_y")))
    stats = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("_y").alias("sy"), F.avg(F.abs("x")).alias("ax"), F.avg(F.abs("_y")).alias("ay"))
    stats = cut_lineage(stats)
    joined = long.join(F.broadcast(stats), "feature")
    name = F.col("id").cast("string")
    x = _jittered(F.col("x"), F.col("sx"), F.col("ax"), F.concat_ws("|", "feature", name))
    points = joined.filter("n > 1").select("feature", "id", x.alias("x"), _jittered(F.col("_y"), F.col("sy"), F.col("ay"), F.concat_ws("|", F.lit("y"), name)).alias("y"))
    points = cut_lineage(points)
    counts = {r.feature: r.n for r in stats.collect() if r.n > 1}
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    if not counts:
        return names.select("feature", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"))
    kind = f"feature string, id {dict(points.dtypes)['id']}, x double, y double, k int, x_low double, x_high double, y_low double, y_high double"
    found = cut_lineage(_radii(points, k, counts).filter(F.size("near") > 0).mapInArrow(_limits, kind))
    axes = _counted(found, ["x", "y"]).groupBy("feature").agg(F.sum(digamma(F.col("n"))).alias("psi"))
    base = found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(digamma(F.col("k"))).alias("pk"))
    score = base.join(axes, "feature").select("feature", "n", digamma(F.col("n")) + (F.col("pk") - F.col("psi")) / F.col("n"))
    score = score.toDF("feature", "n", "score")
    return names.join(score, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))).alias("score"))
