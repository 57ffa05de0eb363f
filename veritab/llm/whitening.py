"""Whitening of embeddings: distributed exact sums and centred covariance, eigenpairs of it, projection in tasks.

Components of a vector become integers, floor(64c) + 1000000, so that sums and deviations are exact. Tasks add up
sums, then products of deviations from the exact mean; the eigenpairs are found from that one matrix, whose side is
the vector length. The projection goes to every task, and a further pass measures the covariance of its result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.spectrum import leading_pairs

SCALE, SHIFT = 64, 1_000_000
# Components beyond this size (as integers) are held there: sums of them stay exact.
LIMIT = 1 << 53
ROWS = 4096
# Results of tasks meet in so many tasks before the driver adds up.
MERGE_TASKS = 16


def _integers(batch: pa.RecordBatch):
    """(row numbers, integer matrix) for pieces of rows of equal vector length."""
    column = batch.column("vec")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        of_size = np.flatnonzero(sizes == size)
        for i in range(0, len(of_size), ROWS):
            at = of_size[i:i + ROWS]
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            # 64c may leave the doubles; what is held at the limit is held before it.
            x = np.floor(np.clip(flat, -LIMIT / SCALE, LIMIT / SCALE) * SCALE).astype(np.int64) + SHIFT
            yield at, x.reshape(len(at), int(size))


def _sums(batches):
    """(dim, j, n, s) per task: rows of that vector length and the exact sum of component j."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _integers(batch):
            # High and low halves apart, so that no sum overflows.
            total = [(int(h) << 26) + int(low) for h, low in zip((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0), strict=True)]
            held = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            held[0] += len(x)
            held[1] = [a + b for a, b in zip(held[1], total, strict=True)]
    for dim, (n, s) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n)),
                                          pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["dim", "j", "n", "s"])


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n*x - S, exact: 64-bit integers where they hold it, else Python's."""
    if n * (int(np.abs(x).max()) + max(map(abs, s)) // n + 1) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _square_sums(dev: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exact; None where a long cannot hold it."""
    if dev.dtype != object and dev.shape[1] * int(np.abs(dev).max()) ** 2 < 1 << 63:
        return (dev * dev).sum(axis=1).tolist()
    wide = dev.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def _products(means):
    """(dim, i, row) per task: row i, from its diagonal on, of the sum of products of deviations from the mean."""
    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _integers(batch):
                n, s = means.value[x.shape[1]]
                c = _deviations(x, n, s).astype(float) / n
                found[x.shape[1]] = found.get(x.shape[1], 0) + c.T @ c
        for dim, held in found.items():
            rows = [held[i, i:] for i in range(dim)]
            bounds = np.cumsum([0, *map(len, rows)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()),
                                              pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(rows)))], names=["dim", "i", "row"])
    return run


def _add_rows(batches):
    """One row per (dim, i): the sum of its arrays. A task holds its rows of the matrix, whatever the number of parts."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for key, row in zip(zip(batch.column("dim").to_pylist(), batch.column("i").to_pylist(), strict=True), batch.column("row"), strict=True):
            values = row.values.to_numpy(zero_copy_only=False)
            found[key] = found[key] + values if key in found else values.astype(float)
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                      pa.array([found[k] for k in keys], pa.list_(pa.float64()))], names=["dim", "i", "row"])


class _Moments:
    """Count, means and centred products; parts are added by their means' distance, so nothing is squared uncentred."""

    def __init__(self, n: int, mean: np.ndarray, product: np.ndarray):
        self.n, self.mean, self.product = n, mean, product

    @classmethod
    def of(cls, w: np.ndarray) -> _Moments:
        mean = w.mean(axis=0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def plus(self, other: _Moments | None) -> _Moments:
        if other is None:
            return self
        n, gap = self.n + other.n, other.mean - self.mean
        return _Moments(n, self.mean + gap * (other.n / n), self.product + other.product + np.outer(gap, gap) * (self.n * other.n / n))

    def error(self) -> float:
        """Largest entry of covariance minus identity."""
        return float(np.abs(self.product / self.n - np.eye(len(self.mean))).max())


def _moment_batch(found: dict[int, _Moments]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([m.n for m in found.values()], pa.int64()),
                                       pa.array([m.mean for m in found.values()], pa.list_(pa.float64())),
                                       pa.array([m.product.ravel() for m in found.values()], pa.list_(pa.float64()))], names=["dim", "n", "mean", "product"])


_MOMENT_KIND = "dim int, n long, mean array<double>, product array<double>"


def _project(model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, whitened components) of integer vectors."""
    dev = _deviations(x, model.n, model.s)
    return dev, (dev.astype(float) / model.n) @ model.projection


def _moments(models):
    def run(batches):
        found: dict[int, _Moments] = {}
        for batch in batches:
            for _, x in _integers(batch):
                if (model := models.value[x.shape[1]]).projection.shape[1]:
                    found[x.shape[1]] = _Moments.of(_project(model, x)[1]).plus(found.get(x.shape[1]))
        yield _moment_batch(found)
    return run


def _read_moments(dims, counts, means, products) -> dict[int, _Moments]:
    found: dict[int, _Moments] = {}
    for dim, n, mean, product in zip(dims, counts, means, products, strict=True):
        m = np.array(mean, float)
        found[dim] = _Moments(n, m, np.array(product, float).reshape(len(m), len(m))).plus(found.get(dim))
    return found


def _merge_moments(batches):
    found: dict[int, _Moments] = {}
    for batch in batches:
        for dim, m in _read_moments(*(batch.column(c).to_pylist() for c in ("dim", "n", "mean", "product"))).items():
            found[dim] = m.plus(found.get(dim))
    yield _moment_batch(found)


class Model:
    """What whitens vectors of one length: exact sums and the projection, whose columns are divided by sqrt(eigenvalue)."""

    def __init__(self, n: int, s: list[int], covariance: np.ndarray, count: int):
        self.n, self.s = n, s
        values, self.components = leading_pairs(covariance, count)
        self.values = values
        self.projection = self.components / np.sqrt(values)
        self.explained = values / np.trace(covariance) if len(values) else values
        self.identity_error = 0.0


def fit(vectors: DataFrame, count: int) -> dict[int, Model]:
    """Models by vector length from a table (id, vec) of finite vectors."""
    spark = vectors.sparkSession.sparkContext
    sums = vectors.mapInArrow(_sums, "dim int, j int, n long, s decimal(38,0)").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(sums.collect()):
        totals.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    if not totals:
        return {}
    kind = "dim int, i int, row array<double>"
    parts = vectors.mapInArrow(_products(spark.broadcast(totals)), kind).repartition("dim", "i").mapInArrow(_add_rows, kind)
    matrices = {dim: np.zeros((dim, dim)) for dim in totals}
    for r in parts.toLocalIterator():
        matrices[r.dim][r.i, r.i:] = matrices[r.dim][r.i:, r.i] = r.row
    return {dim: Model(n, s, matrices[dim] / n, count) for dim, (n, s) in totals.items()}


def _measure(vectors: DataFrame, models: dict[int, Model]) -> None:
    """Fill in the identity errors from a pass over the vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    merged = vectors.mapInArrow(_moments(sent), _MOMENT_KIND).repartition(MERGE_TASKS).mapInArrow(_merge_moments, _MOMENT_KIND).collect()
    for dim, m in _read_moments(*zip(*((r.dim, r.n, r.mean, r["product"]) for r in merged), strict=True)).items() if merged else ():
        models[dim].identity_error = m.error()


def _rows(models):
    def run(batches):
        for batch in batches:
            for at, x in _integers(batch):
                model = models.value[x.shape[1]]
                k = model.projection.shape[1]
                if not k:
                    continue
                dev, white = _project(model, x)
                rows, component = np.repeat(at, k), np.tile(np.arange(k), len(at))
                deviation = pa.array(_square_sums(dev), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(rows), model.n)), deviation,
                     pa.array(white.ravel()), pa.array(model.explained[component]), pa.array(np.full(len(rows), model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 32) -> DataFrame:
    """One row per usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null, empty or hold a null or non-finite component are dropped. Vectors of different lengths are
    different spaces: each length has its own fit, n and identity_error. Components with an eigenvalue
    that cannot be told from zero are left out, so vectors that are all equal, or a single one, give no row. ``deviation`` is
    null where a long cannot hold it; components beyond 2**53 / 64 are held there. Rows with a null id keep it,
    repeated rows count and appear as often as they occur, other columns are ignored, an empty table gives no row.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    models = fit(rows, components)
    _measure(rows, models)
    kind = f"vec_id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_rows(vectors.sparkSession.sparkContext.broadcast(models)), kind)
