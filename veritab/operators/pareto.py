"""Pareto fronts, layers and rotating selection over evaluated hypotheses."""

from __future__ import annotations

import math
import uuid
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import ordered_scan
from veritab.session import cut_lineage, ensure_checkpoint_dir, sized_join, stored

# Dimensions in rotation order and their direction.
DIRECTIONS = {"gain": 1, "stability": 1, "novelty": 1, "complexity": -1}
TOLERANCE = 1e-12
MAX_FREEZE = 50
# Rows of a block that meets another in a task, and cells per axis.
BLOCK_ROWS, MAX_PARTS = 20_000, 8
# Layers: points a cell is to hold, parts of an axis and cells beyond which cells are not used.
CELL_ROWS, MOST_PARTS, MOST_CELLS = 2_000, 64, 1 << 14


def _points(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([pdf[d].to_numpy(float) * sign for d, sign in DIRECTIONS.items()])


def _dominated(points: np.ndarray, against: np.ndarray) -> np.ndarray:
    """True where some row of ``against`` is no worse everywhere and better somewhere."""
    out = np.zeros(len(points), bool)
    for i in range(0, len(points), 256):
        diff = against[None, :, :] - points[i:i + 256, None, :]
        out[i:i + 256] = ((diff >= -TOLERANCE).all(2) & (diff > TOLERANCE).any(2)).any(1)
    return out


def _skyline(pdf: pd.DataFrame) -> pd.DataFrame:
    """Non-dominated rows of one batch; rows are met in falling order of their sum, so
    only rows already kept can dominate."""
    if pdf.empty:
        return pdf
    pts = _points(pdf)
    order = np.argsort(-pts.sum(1), kind="stable")
    keep: list[int] = []
    front = np.empty((0, pts.shape[1]))
    for start in range(0, len(order), 512):
        idx = order[start:start + 512]
        cand = idx[~_dominated(pts[idx], front)] if len(front) else idx
        cand = cand[~_dominated(pts[cand], pts[cand])]
        keep.extend(cand.tolist())
        front = pts[keep]
    keep_arr = np.array(keep)
    keep_arr = keep_arr[~_dominated(pts[keep_arr], pts[keep_arr])]
    return pdf.iloc[np.sort(keep_arr)]


def pareto_front(rows: DataFrame, identity: str = "identity", version: str | None = None) -> DataFrame:
    """Non-dominated complete rows; with ``version``, rows of more than one version are refused.

    Each partition first drops what its own rows dominate. Survivors are placed in a grid of quantile cells; a cell's rows
    are compared with those of cells that lie no lower on any axis, in blocks of bounded size, and cells below another one on all
    axes are gone at once. Rows of equal values are one point. The same steps serve any number of survivors.
    """
    if version is not None and one_version(rows, version).limit(2).count() > 1:
        raise ValueError(f"rows of several {version} cannot be compared")
    dims = list(DIRECTIONS)
    values = [(F.col(d).cast("double") + 0.0).alias(d) for d in dims]
    complete = rows.dropna(subset=dims).select(*values)

    def local(batches):
        kept = None
        for pdf in batches:
            kept = _skyline(pdf if kept is None else pd.concat([kept, pdf]).drop_duplicates())
        if kept is not None:
            yield kept

    survivors = cut_lineage(complete.mapInPandas(local, complete.schema).distinct())
    front = _grid_front(survivors)
    same = [F.col(d).cast("double") + 0.0 == F.col(f"_f_{d}") for d in dims]
    # Points of the front are few next to the rows; equal rows are all kept.
    return rows.join(front.select(*[F.col(d).alias(f"_f_{d}") for d in dims]), same, "left_semi")


def _grid_front(points: DataFrame) -> DataFrame:
    """Non-dominated ones of distinct points."""
    dims, spark = list(DIRECTIONS), points.sparkSession
    better = [F.col(d) * sign for d, sign in DIRECTIONS.items()]
    total = points.count()
    parts = min(MAX_PARTS, math.ceil(max(total / BLOCK_ROWS, 1) ** (1 / len(dims))))
    cuts: list[list[float]] = [[] for _ in dims]
    if parts > 1:
        row = points.agg(*[F.percentile_approx(v, [i / parts for i in range(1, parts)], 1000).alias(f"q{i}") for i, v in enumerate(better)]).first()
        cuts = [sorted(set(q)) for q in row]

    def cell(shift: float):
        """Number of the cell of a row, each value moved up by ``shift``; a bound belongs to the cell above it."""
        number = F.lit(0)
        for v, cut in zip(better, cuts, strict=True):
            number = number * (MAX_PARTS + 1) + sum((F.when(v + shift >= F.lit(float(c)), 1).otherwise(0) for c in cut), F.lit(0))
        return number.cast("long")

    # What is no worse up to the tolerance never lies lower once it is moved up by it.
    placed = points.withColumns({"cell": cell(0.0), "up": cell(TOLERANCE), "b": F.pmod(F.xxhash64(*dims), F.lit(1 << 20)).cast("int")})
    if not total:
        return points
    # At most MAX_PARTS ** 4 cells, whatever the number of points; without bounds there is one.
    count = lambda c: {r[0]: r[1] for r in placed.groupBy(c).count().collect()} if any(cuts) else {0: total}
    own, high = count("cell"), count("up")
    place = lambda ids: np.array(ids)[:, None] // (MAX_PARTS + 1) ** np.arange(len(dims) - 1, -1, -1) % (MAX_PARTS + 1)
    cells, ups = sorted(own), sorted(high)
    at, above = place(cells), place(ups)
    edge = [np.append(c, np.inf) for c in cuts]
    meets, kept = [], []
    for i, d in enumerate(cells):
        apart = any(at[i, x] + 1 < len(edge[x]) and edge[x][at[i, x] + 1] - edge[x][at[i, x]] > TOLERANCE for x in range(len(dims)))
        if apart and (at >= at[i] + 2).all(axis=1).any():
            continue
        kept.append(d)
        # Cells that may hold better rows, several small ones to a chunk.
        chunk, held = 0, 0
        for c in np.array(ups)[(above >= at[i]).all(axis=1)].tolist():
            for j in range(math.ceil(high[c] / BLOCK_ROWS)):
                size = min(BLOCK_ROWS, high[c])
                if held and held + size > BLOCK_ROWS:
                    chunk, held = chunk + 1, 0
                held += size
                meets.append((d, math.ceil(own[d] / BLOCK_ROWS), c, math.ceil(high[c] / BLOCK_ROWS), j, chunk))
    pairs = spark.createDataFrame(meets, "cell long, blocks int, up long, others int, j int, chunk int")
    mine = pairs.select("cell", "blocks", "chunk").distinct()
    # Bounded by the number of cells and blocks, not by their rows.
    left = placed.join(F.broadcast(mine), "cell").select(*dims, F.col("cell").alias("d"), (F.col("b") % F.col("blocks")).alias("i"), "chunk")
    theirs = pairs.select(F.col("cell").alias("rd"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ri"), "up", "others", "j", F.col("chunk").alias("rc"))
    right = placed.withColumn("ub", F.col("b")).join(F.broadcast(theirs), "up").filter(F.col("ub") % F.col("others") == F.col("j")).select(
        *[F.col(x).alias(f"r_{x}") for x in dims], "rd", "ri", "rc")

    def judge(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if a.empty or c.empty:
            return a.reindex(columns=dims).iloc[:0].astype(float)
        return a.loc[_dominated(_points(a), _points(c.rename(columns={f"r_{x}": x for x in dims}))), dims]

    lost = left.groupBy("d", "i", "chunk").cogroup(right.groupBy("rd", "ri", "rc")).applyInPandas(judge, ", ".join(f"{x} double" for x in dims)).distinct()
    return placed.filter(F.col("cell").isin(kept)).select(*dims).join(lost, dims, "left_anti")


def pareto_layers(rows: DataFrame, max_layers: int | None = None, identity: str = "identity") -> DataFrame:
    """(identity, layer, dims): the front is layer 0; it is removed and the next follows.

    Rows of equal values are one point, and its layer is one more than the greatest of the points that dominate it. Points lie in a grid of
    quantile cells; cells are solved in waves of falling sum of their numbers, all cells of a wave at once, as none of them lies above another.
    Where a grid leaves too many points in one cell, points are taken by falling sum, in blocks: a block is compared with all earlier points in
    parallel, then with itself in one task.
    """
    dims = list(DIRECTIONS)
    complete = rows.dropna(subset=dims)
    named = [(F.col(d).cast("double") + 0.0).alias(f"_f_{d}") for d in dims]
    points = cut_lineage(complete.select(*named).distinct().toDF(*dims))
    layers = _peeled(points, max_layers) if _near_values(points) else _wave_layers(points)
    if max_layers is not None:
        layers = layers.filter(F.col("layer") < max_layers)
    keyed = complete.select(*rows.columns, *named)
    return sized_join(keyed, layers.toDF(*[f"_f_{d}" for d in dims], "layer"), [f"_f_{d}" for d in dims]).select(*rows.columns, "layer")


def _near_values(points: DataFrame) -> bool:
    """Whether different values of some axis are equal up to the tolerance, or infinite: dominance is no order then."""
    dims = list(DIRECTIONS)
    values = points.select(F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(d).alias("v")) for i, d in enumerate(dims)])).alias("s")).select("s.*").distinct()
    # Twice the tolerance, as differences are rounded.
    close = F.col("v") - F.col("before") <= 2 * TOLERANCE
    return not ordered_scan(values, ["axis"], ["v"], prevs={"before": "v"}).filter(close | (F.abs("v") == float("inf"))).isEmpty()


def _peeled(points: DataFrame, max_layers: int | None) -> DataFrame:
    """(dims, layer) of distinct points, front by front."""
    dims = list(DIRECTIONS)
    remaining, out = points, points.withColumn("layer", F.lit(0)).limit(0)
    for layer in count() if max_layers is None else range(max_layers):
        if remaining.isEmpty():
            break
        front = cut_lineage(_grid_front(remaining))
        out = out.unionByName(front.withColumn("layer", F.lit(layer)))
        if max_layers is None or layer + 1 < max_layers:
            remaining = cut_lineage(remaining.join(front, dims, "left_anti"))
    return out


def _highest(points: np.ndarray, against: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Greatest layer of a row of ``against`` that is no worse than the point anywhere, -1 without one; highest layers are met first."""
    out = np.full(len(points), -1)
    open_ = np.arange(len(points))
    order = np.argsort(-layer, kind="stable")
    for start in range(0, len(order), 512):
        if not len(open_):
            break
        some = order[start:start + 512]
        for i in range(0, len(open_), 2048):
            at = open_[i:i + 2048]
            no_worse = np.logical_and.reduce([against[some, x][None, :] >= points[at, x][:, None] for x in range(points.shape[1])])
            # The first hit has the greatest layer of the slab.
            hit = no_worse.any(axis=1)
            out[at[hit]] = layer[some[no_worse[hit].argmax(axis=1)]]
        open_ = open_[out[open_] < 0]
    return out


def _layers_inside(points: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Layers of distinct points in falling order, not below ``least``; no point is dominated by a later one."""
    layer = least.copy()
    for start in range(0, len(points), 256):
        own = points[start:start + 256]
        found = layer[start:start + 256]
        np.maximum(found, _highest(own, points[:start], layer[:start]) + 1, out=found)
        no_worse = np.logical_and.reduce([own[None, :, x] >= own[:, None, x] for x in range(own.shape[1])])
        for i in range(1, len(own)):
            found[i] = max(found[i], (found[:i][no_worse[i, :i]] + 1).max(initial=0))
    return layer


def _raise(points: np.ndarray, against: np.ndarray, layer: np.ndarray, least: np.ndarray) -> None:
    """Lifts ``least`` above the greatest layer of a row of ``against`` that is no worse than the point anywhere; highest layers are met first."""
    order = np.argsort(-layer, kind="stable")
    open_ = np.arange(len(points))
    for start in range(0, len(order), 512):
        some = order[start:start + 512]
        open_ = open_[least[open_] <= layer[some[0]]]
        if not len(open_):
            break
        left = []
        for i in range(0, len(open_), 1024):
            at = open_[i:i + 1024]
            no_worse = np.logical_and.reduce([against[some, x][None, :] >= points[at, x][:, None] for x in range(points.shape[1])])
            hit = no_worse.any(axis=1)
            least[at[hit]] = np.maximum(least[at[hit]], layer[some[no_worse[hit].argmax(axis=1)]] + 1)
            left.append(at[~hit])
        open_ = np.concatenate(left)


def _face(points: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Rows that no other one beats by a layer and values that are no smaller; of equal ones one stays."""
    order = np.lexsort([*(-points[:, x] for x in range(points.shape[1])), -points.sum(axis=1), -layer])
    if points.shape[1] == 1:
        # By falling layer, only greater values than all before stay.
        v = points[order, 0]
        return order[np.concatenate([[True], v[1:] > np.maximum.accumulate(v)[:-1]])]
    keep = order[:0]
    for start in range(0, len(order), 256):
        some = order[start:start + 256]
        for i in range(0, len(keep), 2048):
            some = some[~np.logical_and.reduce([points[keep[i:i + 2048], x][None, :] >= points[some, x][:, None] for x in range(points.shape[1])]).any(axis=1)]
        inside = np.logical_and.reduce([points[some, x][None, :] >= points[some, x][:, None] for x in range(points.shape[1])])
        keep = np.append(keep, some[~np.tril(inside, -1).any(axis=1)])
    return keep


def _grid(points: DataFrame) -> tuple[DataFrame, np.ndarray] | None:
    """Points with the number of their cell on each axis (higher is better), and the cells; None if some cell stays too full."""
    dims = list(DIRECTIONS)
    total = points.count()
    better = [F.col(d) * sign for d, sign in DIRECTIONS.items()]
    # What fits one cell needs no waves.
    parts = 1 if total <= BLOCK_ROWS else math.ceil((total / min(CELL_ROWS, BLOCK_ROWS)) ** (1 / len(dims)))
    while parts <= MOST_PARTS:
        cuts: list[list[float]] = [[] for _ in dims]
        if parts > 1:
            row = points.agg(*[F.percentile_approx(v, [i / parts for i in range(1, parts)], 1000).alias(f"q{i}") for i, v in enumerate(better)]).first()
            cuts = [sorted(set(q)) for q in row]
        # A bound belongs to the cell above it.
        placed = points.withColumns({f"c{i}": sum((F.when(v >= F.lit(float(c)), 1).otherwise(0) for c in cut), F.lit(0)) for i, (v, cut) in enumerate(zip(better, cuts, strict=True))})
        sizes = placed.groupBy(*[f"c{i}" for i in range(len(dims))]).count()
        cells = sizes.limit(MOST_CELLS + 1).collect()
        if len(cells) > MOST_CELLS:
            return None
        if max((c[-1] for c in cells), default=0) <= BLOCK_ROWS:
            return placed, np.array([c[:-1] for c in cells], np.int64).reshape(len(cells), len(dims))
        parts = math.ceil(parts * 1.5)
    return None


def _wave_layers(points: DataFrame) -> DataFrame:
    """(dims, layer) of distinct points whose values are equal or apart.

    A point is dominated only from cells that lie no lower on any axis. One that lies higher on all axes counts by its highest layer; on the axes a cell
    shares, only the points of its face matter: those that no other one beats by layer and values there. A cell and each of its faces is one packed row.
    """
    dims, spark = list(DIRECTIONS), points.sparkSession
    width = len(dims)
    found = _grid(points)
    if found is None:
        return _block_layers(points)
    placed, cells = found
    at = [f"c{i}" for i in range(width)]
    masks = {sum(1 << x for x in axes): list(axes) for n in range(1, width) for axes in combinations(range(width), n)}
    base = MOST_PARTS + 1

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _points(pdf)
        # Rounded sums of no smaller values are no smaller; among equal ones the greater values come first.
        x = x[np.lexsort([*(-x[:, i] for i in reversed(range(width))), -(x[:, 0] + x[:, 1] + x[:, 2] + x[:, 3])])]
        return pd.DataFrame([[*key, sum(key), x.tobytes()]], columns=[*at, "level", "x"])

    packed = stored(placed.groupBy(*at).applyInPandas(pack, ", ".join(f"{c} int" for c in at) + ", level int, x binary"))
    schema = "mask int, " + ", ".join(f"{c} int" for c in at) + ", key long, top int, x binary, layer binary"

    def solve(batches):
        own, met = None, {}

        def close():
            place, x, least = own
            least = np.full(len(x), least, np.int32)
            # Few axes first: what they say leaves less to compare on more of them.
            for m in sorted(met, key=lambda m: len(masks[m])):
                axes = masks[m]
                against, layer = np.concatenate([a for a, _ in met[m]]), np.concatenate([b for _, b in met[m]])
                kept = _face(against, layer) if len(axes) < 3 else slice(None)
                _raise(x[:, axes], against[kept], layer[kept], least)
            layer = _layers_inside(x, least)
            rows = [(0, *place, 0, int(layer.max()), x.tobytes(), layer.astype(np.int32).tobytes())]
            for m, axes in masks.items() if len(cells) > 1 else ():
                kept = _face(x[:, axes], layer)
                rows.append((m, *place, sum(place[a] * base ** a for a in axes), None, x[kept][:, axes].tobytes(), layer[kept].astype(np.int32).tobytes()))
            kinds = [*[pa.int32()] * (1 + width), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["mask", *at, "key", "top", "x", "layer"])

        for batch in batches:
            for r in range(batch.num_rows):
                place = tuple(batch.column(c)[r].as_py() for c in at)
                m, x = batch.column("mask")[r].as_py(), batch.column("x")[r].as_py()
                if own is not None and place != own[0]:
                    yield close()
                    own, met = None, {}
                if m == 0:
                    own = place, np.frombuffer(x, float).reshape(-1, width), batch.column("top")[r].as_py()
                else:
                    met.setdefault(m, []).append((np.frombuffer(x, float).reshape(-1, len(masks[m])), np.frombuffer(batch.column("layer")[r].as_py(), np.int32)))
        if own is not None:
            yield close()

    folder = f"{ensure_checkpoint_dir(spark)}/layers-{uuid.uuid4().hex}"
    paths: list[str] = []
    level, top = cells.sum(axis=1), np.full(len(cells), -1)
    number = {tuple(c): i for i, c in enumerate(cells.tolist())}
    for wave in sorted(set(level.tolist()), reverse=True):
        mine = np.flatnonzero(level == wave)
        # Bounded by the number of cells, not by their points.
        least = [int(top[(cells > cells[i]).all(axis=1)].max(initial=-1)) + 1 for i in mine]
        own = spark.createDataFrame([(*cells[i].tolist(), n) for i, n in zip(mine, least, strict=True)], ", ".join(f"{c} int" for c in at) + ", top int")
        rows = packed.filter(F.col("level") == wave).join(F.broadcast(own), at).select(
            F.lit(0).alias("mask"), *at, "top", "x", F.lit(None).cast("binary").alias("layer"))
        if paths:
            asked = [(m, *cells[i].tolist(), int(sum(cells[i][a] * base ** a for a in axes))) for i in mine for m, axes in masks.items()]
            asked = spark.createDataFrame(asked, "mask int, " + ", ".join(f"t{i} int" for i in range(width)) + ", key long")
            faces = spark.read.schema(schema).parquet(*paths).filter("mask > 0").join(F.broadcast(asked), ["mask", "key"])
            for i, c in enumerate(at):
                faces = faces.filter((F.col("mask").bitwiseAND(1 << i) > 0) | (F.col(c) > F.col(f"t{i}")))
            rows = rows.unionByName(faces.select("mask", *[F.col(f"t{i}").alias(c) for i, c in enumerate(at)], F.lit(0).alias("top"), "x", "layer"))
        tasks = min(len(mine), 4 * spark.sparkContext.defaultParallelism)
        solved = rows.repartition(tasks, *at).sortWithinPartitions(*at, "mask").mapInArrow(solve, schema)
        solved.write.parquet(f"{folder}/{wave}")
        paths.append(f"{folder}/{wave}")
        for r in spark.read.schema(schema).parquet(paths[-1]).filter("mask = 0").select(*at, "top").collect():
            top[number[tuple(r[:width])]] = r.top

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[r].as_py(), float).reshape(-1, width)
                layer = np.frombuffer(batch.column("layer")[r].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i] * sign + 0.0) for i, sign in enumerate(DIRECTIONS.values())], pa.array(layer)], names=[*dims, "layer"])

    kind = ", ".join(f"{d} double" for d in dims) + ", layer int"
    return spark.read.schema(schema).parquet(*paths).filter("mask = 0").select("x", "layer").mapInArrow(unpack, kind) if paths else points.withColumn("layer", F.lit(0))


def _block_layers(points: DataFrame) -> DataFrame:
    """(dims, layer) of distinct points whose values are equal or apart. A block and its layers are one packed row of bounded size."""
    dims = list(DIRECTIONS)
    width = len(dims)
    better = [F.col(d) * sign for d, sign in DIRECTIONS.items()]
    # Rounded sums of no smaller values are no smaller; among equal ones the greater values come first.
    falling = [(better[0] + better[1] + better[2] + better[3]).desc(), *[v.desc() for v in better]]
    ranked = ordered_scan(points, [], falling, number="n").withColumn("b", F.floor((F.col("n") - 1) / BLOCK_ROWS).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "x": [_points(pdf.sort_values("n")).tobytes()]})

    packed = cut_lineage(ranked.groupBy("b").applyInPandas(pack, "b int, x binary"))
    read = lambda batch, c, r: np.frombuffer(batch.column(c)[r].as_py(), float).reshape(-1, width)
    layers_of = lambda batch, c, r: np.frombuffer(batch.column(c)[r].as_py(), np.int32)

    def compare(batches):
        most = None
        for batch in batches:
            for r in range(batch.num_rows):
                found = _highest(read(batch, "x", r), read(batch, "rx", r), layers_of(batch, "rl", r)) + 1
                most = found if most is None else np.maximum(most, found)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array([most.astype(np.int32).tobytes()], pa.binary())], names=["least"])

    def merge(batches):
        most = None
        for batch in batches:
            for r in range(batch.num_rows):
                most = layers_of(batch, "least", r) if most is None else np.maximum(most, layers_of(batch, "least", r))
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array([most.tobytes()], pa.binary())], names=["least"])

    def inside(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, least = read(batch, "x", r), batch.column("least")[r].as_py()
                least = np.zeros(len(x), np.int32) if least is None else np.frombuffer(least, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([_layers_inside(x, least).tobytes()], pa.binary())], names=["x", "layer"])

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = read(batch, "x", r)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i] * sign + 0.0) for i, sign in enumerate(DIRECTIONS.values())], pa.array(layers_of(batch, "layer", r))], names=[*dims, "layer"])

    done = points.sparkSession.createDataFrame([], "x binary, layer binary")
    for b in range(packed.count()):
        block = packed.filter(F.col("b") == b).select("x")
        least = block.withColumn("least", F.lit(None).cast("binary"))
        if b:
            # One block meets each finished one where that lies; layers come back as one number a point.
            met = done.select(F.col("x").alias("rx"), F.col("layer").alias("rl")).crossJoin(F.broadcast(block)).mapInArrow(compare, "least binary")
            least = block.crossJoin(F.broadcast(met.repartition(1).mapInArrow(merge, "least binary")))
        part = cut_lineage(least.mapInArrow(inside, "x binary, layer binary").coalesce(1))
        done = part if not b else done.union(part)
    return done.mapInArrow(unpack, ", ".join(f"{d} double" for d in dims) + ", layer int")


def one_version(rows: DataFrame, version: str = "knowledge_version") -> DataFrame:
    """Versions present; rows may be compared only when this has one row."""
    return rows.select(version).distinct()


def rotate(layer: DataFrame, limit: int, rotation: list[str] | None = None, identity: str = "identity") -> list[dict]:
    """Slot i takes the best remaining row on rotation[i mod 4], ties by identity.

    A slot can only take one of the ``limit`` best rows of its dimension, so at
    most 4 x limit rows (limit <= 50) are looked at on the driver.
    """
    rotation = rotation or list(DIRECTIONS)
    limit = min(limit, MAX_FREEZE)
    if limit <= 0:
        return []
    pool = {}
    for d in dict.fromkeys(rotation):
        best = layer.orderBy(F.col(d).desc() if DIRECTIONS[d] > 0 else F.col(d).asc(), F.asc(identity)).limit(limit)
        pool[d] = best.select(identity, d).collect()
    picked: list[dict] = []
    taken: set = set()
    while len(picked) < limit:
        d = rotation[len(picked) % len(rotation)]
        free = next((row for row in pool[d] if row[identity] not in taken), None)
        if free is None:
            break
        taken.add(free[identity])
        picked.append({identity: free[identity], "slot": len(picked), "dimension": d})
    return picked


def freeze_selection(
    rows: DataFrame, cap: int = 5, lower_layers: bool = True, incomplete_last: bool = False,
    identity: str = "identity",
) -> tuple[DataFrame, int]:
    """(selected rows with layer, slot and dimension, shortfall): front first, then lower layers."""
    cap = min(cap, MAX_FREEZE)
    remaining = cut_lineage(rows.dropna(subset=list(DIRECTIONS)))
    chosen: list[tuple] = []
    for layer in count() if lower_layers else range(1):
        if len(chosen) >= cap or remaining.isEmpty():
            break
        front = cut_lineage(pareto_front(remaining, identity))
        for p in rotate(front, cap - len(chosen), identity=identity):
            chosen.append((p[identity], layer, len(chosen), p["dimension"]))
        remaining = cut_lineage(remaining.join(front.select(identity), identity, "left_anti"))
    if incomplete_last and len(chosen) < cap:
        gap = F.lit(False)
        for d in DIRECTIONS:
            gap = gap | F.col(d).isNull()
        for row in rows.filter(gap).orderBy(identity).limit(cap - len(chosen)).select(identity).collect():
            chosen.append((row[identity], -1, len(chosen), "incomplete"))
    kind = dict(rows.dtypes)[identity]
    picked = rows.sparkSession.createDataFrame(chosen, f"{identity} {kind}, layer int, slot int, dimension string")
    return picked, cap - len(chosen)


