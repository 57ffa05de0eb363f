"""K-means with choice of k, for any number of draws at once.

Rows are stored once, each with the draws it belongs to. Every step (scaling, seeding, Lloyd rounds, silhouettes) is one
pass that serves all draws and all k: tasks return sums per (draw, k, cluster), and only those reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.session import cut_lineage, sized_join

EPS = 1e-12
DIGITS = 12


@dataclass
class Draw:
    """One sample of the rows: how it is scaled, the centres found for each k, and the choice."""

    n: int
    mean: np.ndarray
    std: np.ndarray
    seeds: list[np.ndarray] = field(default_factory=list)
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: dict[int, np.ndarray] = field(default_factory=dict)
    scores: dict[int, float] = field(default_factory=dict)
    k: int | None = None

    @property
    def kept(self) -> np.ndarray:
        """Columns that vary: the others tell nothing apart."""
        return self.std > EPS

    def scale(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.kept] - self.mean[self.kept]) / self.std[self.kept]

    def nearest(self, z: np.ndarray, k: int) -> np.ndarray:
        """Cluster of each row; of equally near ones the first."""
        return np.argmin(_squared(z, self.centres[k]), axis=1)


def _squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((z - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _members(batch: pa.RecordBatch):
    """(matrix of the rows, {draw: its rows}) by pieces of bounded size."""
    for i in range(0, batch.num_rows, 8192):
        part = batch.slice(i, 8192)
        x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
        draws = part.column("draws")
        rows, names = np.repeat(np.arange(part.num_rows), draws.value_lengths().to_numpy(zero_copy_only=False)), draws.flatten().to_numpy(zero_copy_only=False)
        yield part, x, {int(d): rows[names == d] for d in np.unique(names)}


def _summed(points: DataFrame, each) -> dict[tuple, np.ndarray]:
    """Sums over all rows of the vectors that ``each(draw, x)`` yields as ((k, c), vector), by (draw, k, c)."""
    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for _, x, members in _members(batch):
                for d, rows in members.items():
                    for key, v in each(d, x[rows]):
                        held[d, *key] = held[d, *key] + v if (d, *key) in held else v
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], names=["d", "k", "c", "v"])

    parts = points.mapInArrow(run, "d int, k int, c int, v array<double>").select("d", "k", "c", F.posexplode("v").alias("i", "v"))
    out: dict[tuple, dict[int, float]] = {}
    for r in parts.groupBy("d", "k", "c", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r.d, r.k, r.c), {})[r.i] = r.v
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


def _farthest(points: DataFrame, wanted: dict[tuple[int, int], int], distance) -> dict[tuple[int, int], list[np.ndarray]]:
    """For each (draw, k) of ``wanted`` so many rows of greatest ``distance(draw, k, x)`` (ties: least id), farthest first.

    Rows at no distance are none. Tasks send no more rows than are wanted.
    """
    def run(batches):
        for batch in batches:
            for part, x, members in _members(batch):
                for (d, k), count in wanted.items():
                    if d not in members:
                        continue
                    rows = members[d]
                    far = distance(d, k, x[rows])
                    order = pa.table({"d": -far, "id": part.column("id").take(pa.array(rows)), "row": rows}).sort_by([("d", "ascending"), ("id", "ascending")]).slice(0, count)
                    at = order.column("row").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(-order.column("d").to_numpy()),
                                                      order.column("id").combine_chunks(), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["d", "k", "far", "id", "x"])

    made = points.mapInArrow(run, f"d int, k int, far double, id {dict(points.dtypes)['id']}, x array<double>").filter(F.col("far") > EPS)
    most = max(wanted.values())
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("a"), "id", "x"))), 1, most)
    return {(r.d, r.k): [np.array(s.x) for s in r.top][:wanted[r.d, r.k]] for r in made.groupBy("d", "k").agg(top.alias("top")).collect()}


def _seed(points: DataFrame, draws: dict[int, Draw], most: int) -> None:
    """Farthest-first: a draw's row of least id, then again and again the row farthest from all seeds (ties: least id)."""
    first = points.select("id", "x", F.explode("draws").alias("d")).groupBy("d").agg(F.min_by("x", "id").alias("x"))
    for r in first.collect():
        draws[r.d].seeds = [draws[r.d].scale(np.array([r.x], float))[0]]
    open_ = {d for d, s in draws.items() if s.seeds and s.kept.any()}
    for _ in range(most - 1):
        if not open_:
            break
        found = _farthest(points, {(d, 0): 1 for d in open_}, lambda d, _, x: _squared(draws[d].scale(x), np.array(draws[d].seeds)).min(axis=1))
        open_ &= {d for d, _ in found}
        for d in open_:
            draws[d].seeds.append(draws[d].scale(found[d, 0][0][None, :])[0])


def _lloyd(points: DataFrame, draws: dict[int, Draw], ks: list[int], rounds: int) -> None:
    """Rounds until no centre moves. A cluster left empty takes the row farthest from its own centre."""
    for s in draws.values():
        s.centres = {k: np.array(s.seeds[:k]) for k in ks if k <= len(s.seeds)}
    open_ = {(d, k) for d, s in draws.items() for k in s.centres}
    for _ in range(rounds):
        if not open_:
            break

        def each(d: int, x: np.ndarray):
            z = draws[d].scale(x)
            for k in sorted(k for e, k in open_ if e == d):
                label = draws[d].nearest(z, k)
                for c in np.unique(label):
                    at = label == c
                    yield (k, int(c)), np.append(z[at].sum(axis=0), at.sum())

        sums = _summed(points, each)
        empty = {(d, k): k - len([c for c in range(k) if (d, k, c) in sums]) for d, k in open_}
        if wanted := {key: n for key, n in empty.items() if n}:
            moved = _farthest(points, wanted, lambda d, k, x: _squared(draws[d].scale(x), draws[d].centres[k]).min(axis=1))
            for (d, k), rows in moved.items():
                for c, row in zip([c for c in range(k) if (d, k, c) not in sums], rows, strict=False):
                    z = draws[d].scale(row[None, :])
                    old = (d, k, int(draws[d].nearest(z, k)[0]))
                    if sums[old][-1] > 1:
                        sums[old] = sums[old] - np.append(z[0], 1)
                        sums[d, k, c] = np.append(z[0], 1)
        for d, k in list(open_):
            centres = draws[d].centres[k].copy()
            sizes = np.zeros(k, np.int64)
            for c in range(k):
                if (d, k, c) in sums:
                    centres[c], sizes[c] = sums[d, k, c][:-1] / sums[d, k, c][-1], sums[d, k, c][-1]
            if np.abs(centres - draws[d].centres[k]).max() <= EPS and not empty[d, k]:
                open_.discard((d, k))
            draws[d].centres[k], draws[d].sizes[k] = centres, sizes
    for s in draws.values():
        for k, centres in s.centres.items():
            # Numbers follow the centres, not the seeds.
            order = sorted(range(k), key=lambda c: tuple(np.round(centres[c], DIGITS)))
            s.centres[k] = centres[order]


def _count_sizes(points: DataFrame, draws: dict[int, Draw]) -> None:
    """Rows per cluster under the final centres."""
    def each(d: int, x: np.ndarray):
        z = draws[d].scale(x)
        for k in draws[d].centres:
            yield (k, 0), np.bincount(draws[d].nearest(z, k), minlength=k).astype(float)

    found = _summed(points, each)
    for d, s in draws.items():
        s.sizes = {k: found[d, k, 0].astype(np.int64) for k in s.centres}


def _squared_scores(points: DataFrame, draws: dict[int, Draw]) -> None:
    """Silhouettes with squared distances: a cluster's size, sum and sum of squares say all about it."""
    def sums(d: int, x: np.ndarray):
        z = draws[d].scale(x)
        for k in draws[d].centres:
            label = draws[d].nearest(z, k)
            for c in np.unique(label):
                own = z[label == c]
                yield (k, int(c)), np.concatenate([[len(own), (own * own).sum()], own.sum(axis=0)])

    table = _summed(points, sums)

    def each(d: int, x: np.ndarray):
        z = draws[d].scale(x)
        for k in draws[d].centres:
            label = draws[d].nearest(z, k)
            total = np.full((len(z), k), np.nan)
            size = np.zeros(k)
            for c in range(k):
                if (d, k, c) in table:
                    n, square, *s = table[d, k, c]
                    total[:, c], size[c] = n * (z * z).sum(axis=1) - 2 * z @ np.array(s) + square, n
            yield (k, 0), np.array([_silhouettes(np.maximum(total, 0), size, label).sum()])

    for (d, k, _), v in _summed(points, each).items():
        draws[d].scores[k] = v[0] / draws[d].n


def _silhouettes(total: np.ndarray, size: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Per row, from its summed distances to each cluster; 0 where there is one cluster only."""
    own = np.arange(len(label)), label
    a = np.where(size[label] > 1, total[own] / np.maximum(size[label] - 1, 1), 0.0)
    rest = np.where(size > 0, total / np.maximum(size, 1), np.inf)
    rest[own] = np.inf
    b = np.nan_to_num(rest, nan=np.inf).min(axis=1)
    top = np.maximum(a, b)
    with np.errstate(invalid="ignore"):
        return np.where(~np.isfinite(b) | (top <= EPS), 0.0, (b - a) / top)


# Rows of a packed chunk; the rows one task may hold against all others, and the number of tasks up to which it holds fewer.
CHUNK, HELD, TASKS = 500, 1 << 15, 48


def distances(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    size = (z ** 2).sum(1)[:, None] + (w ** 2).sum(1)[None, :]
    far = np.maximum(size - 2 * z @ w.T, 0.0)
    # Rows close together, and a row with itself, lose all digits there.
    close = np.nonzero(far <= 1e-6 * size)
    far[close] = ((z[close[0]] - w[close[1]]) ** 2).sum(axis=1)
    return np.sqrt(far)


def against_all(rows: DataFrame, total: int, block: int, start, step, end, schema: str) -> DataFrame:
    """Rows (x, tag: equally long lists) in blocks, each block in one task that reads all rows by chunks, in the order of ``rows``.

    ``start(x, tag)`` makes a block's state, ``step(state, x, tag)`` takes one chunk, ``end(state)`` gives the rows of ``schema``. Every row is sent once
    to each block: up to TASKS of them at any number of rows, then one for every HELD rows. No pair of rows and no sum per pair of blocks is sent.
    """
    blocks = max(1, min(math.ceil(total / block), max(TASKS, math.ceil(total / HELD))))

    def pack(batches):
        seq = 0
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
                small = x.astype(np.float32)
                # Single precision where it says the same.
                x = small if (small == x).all() else x
                tag = part.column("tag").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([x.dtype.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([tag.tobytes()], pa.binary())],
                                                 names=["seq", "n", "width", "x", "tag"])
                seq += 1

    chunks = rows.select("x", "tag").mapInArrow(pack, "seq int, n int, width int, x binary, tag binary")
    chunks = cut_lineage(chunks.withColumn("part", F.spark_partition_id()))
    columns = ["part", "seq", "n", "width", "x", "tag"]
    own = chunks.select(F.pmod(F.xxhash64("part") + F.col("seq"), F.lit(blocks)).cast("int").alias("i"), F.lit(0).alias("side"), *columns)
    other = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.lit(1).alias("side"), *columns)
    met = own.unionByName(other).repartitionByRange(blocks, "i").sortWithinPartitions("i", "side", "part", "seq")

    def run(batches):
        number, mine, state = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                i, side, n, width = (batch.column(c)[r].as_py() for c in ("i", "side", "n", "width"))
                x = np.frombuffer(batch.column("x")[r].as_py(), np.float32 if width == 4 else np.float64).astype(float).reshape(n, -1)
                tag = np.frombuffer(batch.column("tag")[r].as_py(), np.int32).reshape(n, -1)
                if i != number:
                    if state is not None:
                        yield end(state)
                    number, mine, state = i, [], None
                if side == 0:
                    mine.append((x, tag))
                elif mine:
                    if state is None:
                        state = start(np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]))
                    step(state, x, tag)
        if state is not None:
            yield end(state)

    return met.select("i", "side", "n", "width", "x", "tag").mapInArrow(run, schema)


# Rows of a slab whose distances to a chunk stay in a core's cache; unit of rounding of single precision.
SLAB, UNIT = 256, 2.0 ** -24


def _near_distances(z: np.ndarray, w: np.ndarray, z4: np.ndarray, z2: np.ndarray, w4: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """``distances`` in single precision, each of them to 8 (columns + 4) units. Rows close together are taken in double precision.

    ``z2`` and ``w2`` are squared lengths; ``z4`` and ``w4`` are rows whose product is the squared distance: (z, z2, 1) and (-2 w, 1, w2).
    """
    far = z4 @ w4.T
    # One bound for all pairs first, which finds too many rather than too few.
    flat = far.reshape(-1)
    close = np.flatnonzero(flat < (z2.max(initial=0) + w2.max(initial=0)) / 8)
    if len(close):
        i, j = np.divmod(close, len(w))
        if len(close) > far.size // 50:
            at = flat[close] < (z2[i] + w2[j]) / 8
            close, i, j = close[at], i[at], j[at]
            if len(close) > far.size // 50:
                return distances(z, w).astype(np.float32)
        flat[close] = ((z[i] - w[j]) ** 2).sum(axis=1)
    return np.sqrt(far, out=far)


def _euclidean_scores(points: DataFrame, draws: dict[int, Draw], block: int, wanted: dict[int, list[int]], near: bool = False) -> dict[tuple[int, int], float]:
    """Silhouettes as defined of the ``wanted`` k of each draw, quadratic in its rows: a task holds a block of rows against all, and returns one sum per draw and k.

    ``near`` takes distances in single precision, several times as fast.
    """
    names = sorted(d for d in wanted if wanted[d])
    member = F.transform(F.array(*[F.lit(d) for d in names]), lambda d: F.array_contains("draws", d).cast("int"))
    total = points.count()

    def narrow(z: np.ndarray, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if not near:
            return z, z
        size, one = (z ** 2).sum(axis=1)[:, None], np.ones((len(z), 1))
        return np.concatenate([-2 * z, one, size] if other else [z, size, one], axis=1).astype(np.float32), size[:, 0].astype(np.float32)

    def start(x: np.ndarray, tag: np.ndarray) -> dict:
        held = {}
        for j, d in enumerate(names):
            z = draws[d].scale(x[tag[:, j] > 0])
            held[d] = z, narrow(z), {k: draws[d].nearest(z, k) for k in wanted[d]}, np.zeros((len(z), sum(wanted[d])))
        return held

    def step(held: dict, x: np.ndarray, tag: np.ndarray) -> None:
        for j, d in enumerate(names):
            z, (z4, z2), _, sums = held[d]
            w = draws[d].scale(x[tag[:, j] > 0])
            if not (len(z) and len(w)):
                continue
            w4, w2 = narrow(w, other=True)
            marks = np.concatenate([np.eye(k, dtype=w4.dtype)[draws[d].nearest(w, k)] for k in wanted[d]], axis=1)
            for lo in range(0, len(z), SLAB):
                at = slice(lo, lo + SLAB)
                sums[at] += (_near_distances(z[at], w, z4[at], z2[at], w4, w2) if near else distances(z[at], w)) @ marks

    def end(held: dict) -> pa.RecordBatch:
        out = []
        for d, (z, _, label, sums) in held.items():
            parts = np.split(sums, np.cumsum(wanted[d])[:-1], axis=1)
            out += [(d, k, float(_silhouettes(v, draws[d].sizes[k].astype(float), label[k]).sum())) for k, v in zip(wanted[d], parts, strict=True) if len(z)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["d", "k", "s"])

    per = against_all(points.select("x", member.alias("tag")), total, block, start, step, end, "d int, k int, s double")
    return {(r.d, r.k): r.s / draws[r.d].n for r in per.groupBy("d", "k").agg(F.sum("s").alias("s")).collect()}


def _contenders(s: Draw, scores: dict[int, float], slack: float, min_size: int, accept: float) -> list[int]:
    """The k that may be chosen, given that no score is off by more than ``slack``; empty if none can be accepted."""
    able = {k: v for k, v in scores.items() if s.sizes[k].min() >= min_size and v + slack >= accept}
    return sorted(k for k, v in able.items() if v + slack >= max(able.values()) - slack)


class ClusterSearch:
    """K-means of points for several draws and k, with the k of best silhouette for each draw.

    ``points`` (id, x): ids are unique, x are equally long lists; rows with a null id, or a list that is null or holds a null or non-finite
    value, take no part. ``draws`` (draw, group) with ``group`` a column of ``points`` names the samples; without it, all rows are draw 0.
    Columns are scaled by their mean and population deviation in the draw, constant ones are left out. k is feasible if the draw
    has rows for it and all clusters hold ``min_size``; the best silhouette wins if it reaches ``accept`` (ties: the smaller k).
    ``distance`` is ``euclidean`` (as defined, quadratic in the rows) or ``squared`` (linear). With ``choice`` only k is asked for: Euclidean silhouettes
    are taken in single precision first, with a bound on their error, and as defined only for those k that this bound leaves open.
    """

    def __init__(self, points: DataFrame, key: str, vector: str, ks: tuple[int, ...] = (2, 3, 4), *, draws: DataFrame | None = None, group: str | None = None,
                 min_size: int = 2, accept: float = 0.1, rounds: int = 100, distance: str = "euclidean", choice: bool = False, block: int = 2000):
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        rows = points.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), x.alias("x"), *([F.col(group).alias("_g")] if draws is not None else [])).filter(sound)
        if draws is None:
            rows = rows.withColumn("draws", F.array(F.lit(0)))
        else:
            named = draws.select(F.col("draw").cast("int").alias("draw"), F.col(group).alias("_g")).distinct().groupBy("_g").agg(F.array_sort(F.collect_list("draw")).alias("draws"))
            rows = sized_join(rows, named, "_g").drop("_g")
        self.points = cut_lineage(rows)
        self.draws = self._scaled()
        ks = tuple(sorted(ks))
        if self.draws:
            _seed(self.points, self.draws, max(ks))
            self._search(ks, min_size, accept, rounds, distance, choice, block)

    def _scaled(self) -> dict[int, Draw]:
        first = _summed(self.points, lambda d, x: [((0, 0), np.append(x.sum(axis=0), len(x)))])
        found = {d: Draw(int(v[-1]), v[:-1] / v[-1], np.zeros(len(v) - 1)) for (d, *_), v in first.items()}
        for (d, *_), v in _summed(self.points, lambda d, x: [((0, 0), ((x - found[d].mean) ** 2).sum(axis=0))]).items():
            found[d].std = np.sqrt(v / found[d].n)
        return found

    def _search(self, ks, min_size, accept, rounds, distance, choice, block) -> None:
        _lloyd(self.points, self.draws, [k for k in ks], rounds)
        for s in self.draws.values():
            s.centres = {k: c for k, c in s.centres.items() if k <= s.n // max(min_size, 1)}
        if not any(s.centres for s in self.draws.values()):
            return
        _count_sizes(self.points, self.draws)
        if distance == "squared":
            _squared_scores(self.points, self.draws)
        else:
            wanted = {d: sorted(s.centres) for d, s in self.draws.items()}
            if choice:
                wanted = self._open(wanted, min_size, accept, block)
            if any(wanted.values()):
                for (d, k), v in _euclidean_scores(self.points, self.draws, block, wanted).items():
                    self.draws[d].scores[k] = v
        for s in self.draws.values():
            if s.k:
                continue
            good = [(round(s.scores[k], DIGITS), -k) for k in s.scores if s.sizes[k].min() >= min_size]
            if good and max(good)[0] >= accept:
                s.k = -max(good)[1]

    def _open(self, wanted: dict[int, list[int]], min_size: int, accept: float, block: int) -> dict[int, list[int]]:
        """Sets k where it is certain from distances in single precision; the k of other draws that may still be chosen."""
        near: dict[int, dict[int, float]] = {}
        for (d, k), v in _euclidean_scores(self.points, self.draws, block, wanted, near=True).items():
            near.setdefault(d, {})[k] = v
        left = {}
        for d, scores in near.items():
            s = self.draws[d]
            # Distances and their sums over a chunk are off by so much of themselves; (b - a) / max(a, b) by twice that.
            off = (8 * (int(s.kept.sum()) + 4) + CHUNK + 16) * UNIT
            slack = 2 * off / (1 - off) + 10.0 ** -DIGITS if off < 1 else np.inf
            able = _contenders(s, scores, slack, min_size, accept)
            if len(able) == 1 and scores[able[0]] - slack >= accept:
                s.k = able[0]
            else:
                left[d] = able
        return left

    def chosen(self) -> DataFrame:
        """(draw, k, silhouette): k is null where no structure is accepted; silhouette is that of k, null where it was not needed as defined."""
        rows = [(d, s.k, float(s.scores[s.k]) if s.k in s.scores else None) for d, s in sorted(self.draws.items())]
        return self.points.sparkSession.createDataFrame(rows, "draw int, k int, silhouette double")

    def candidates(self) -> DataFrame:
        """(draw, k, silhouette, sizes) of every k that was tried."""
        rows = [(d, k, float(s.scores[k]), s.sizes[k].tolist()) for d, s in sorted(self.draws.items()) for k in sorted(s.scores)]
        return self.points.sparkSession.createDataFrame(rows, "draw int, k int, silhouette double, sizes array<long>")

    def labels(self) -> DataFrame:
        """(draw, id, cluster): clusters are numbered in the order of their centres; 0 for all rows where no k is accepted."""
        draws = self.draws

        def run(batches):
            for batch in batches:
                for part, x, members in _members(batch):
                    for d, rows in members.items():
                        k = draws[d].k
                        label = draws[d].nearest(draws[d].scale(x[rows]), k) if k else np.zeros(len(rows), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d), pa.int32()), part.column("id").take(pa.array(rows)), pa.array(label, pa.int32())], names=["draw", "id", "cluster"])
        return self.points.mapInArrow(run, f"draw int, id {dict(self.points.dtypes)['id']}, cluster int")
