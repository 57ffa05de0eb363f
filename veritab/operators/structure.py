"""Structure in ordered series and point sets: change-points, clusters, stability."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import exact_quantiles, hash_rank, ordered_scan
from veritab.operators.clusters import ClusterSearch, against_all, distances
from veritab.session import cut_lineage, sized_join

EPS = 1e-12


def _sse(n: Column, s: Column, ss: Column) -> Column:
    return F.when(n > 0, F.greatest(F.lit(0.0), ss - s * s / n)).otherwise(0.0)


def changepoints(df: DataFrame, series: list[str], order: list[str], value: str, min_segment: int = 3, max_points: int = 3, penalty: float = 3.0) -> DataFrame:
    """(series, position, gain): binary segmentation on prefix sums.

    Prefix sums are computed once over all series; each of the at most
    ``max_points`` rounds is one join with the segment table, which is sent
    to the rows where it is small, and one aggregation. ``position`` is the
    index of the first row to the right.
    """
    squared = df.withColumn("_v2", F.col(value) * F.col(value))
    pre = cut_lineage(ordered_scan(squared, series, order, number="_i", sums={"_s": value, "_ss": "_v2"}).select(
        *series, F.col("_i").alias("i"), F.col("_s").alias("s"), F.col("_ss").alias("ss")))
    ends = pre.groupBy(*series).agg(F.max("i").alias("high"), F.max_by("s", "i").alias("s_high"), F.max_by("ss", "i").alias("ss_high"))
    zero = F.lit(0.0)
    segs = cut_lineage(ends.select(*series, F.lit(0).cast("long").alias("low"), zero.alias("s_low"), zero.alias("ss_low"), "high", "s_high", "ss_high"))
    found = None
    for _ in range(max_points):
        n = F.col("high") - F.col("low")
        parent = _sse(n, F.col("s_high") - F.col("s_low"), F.col("ss_high") - F.col("ss_low"))
        live = segs.filter(n >= 2 * min_segment)
        inside = sized_join(pre, live, series).filter((F.col("i") >= F.col("low") + min_segment) & (F.col("i") <= F.col("high") - min_segment))
        gain = parent - _sse(F.col("i") - F.col("low"), F.col("s") - F.col("s_low"), F.col("ss") - F.col("ss_low")) \
            - _sse(F.col("high") - F.col("i"), F.col("s_high") - F.col("s"), F.col("ss_high") - F.col("ss"))
        threshold = penalty * parent / n * F.ln(n.cast("double"))
        best = inside.withColumn("gain", gain).withColumn("_t", threshold).filter(F.col("gain") > F.col("_t") + EPS).groupBy(*series).agg(
            F.max_by(F.struct("low", "i", "s", "ss", "gain"), F.struct(F.col("gain"), (-F.col("low")).alias("l"), (-F.col("i")).alias("i"))).alias("b"))
        best = cut_lineage(best)
        if best.isEmpty():
            break
        points = best.select(*series, F.col("b.i").alias("position"), F.col("b.gain").alias("gain"))
        found = points if found is None else found.unionByName(points)
        j = segs.join(best, series, "left")
        hit = F.col("b").isNotNull() & (F.col("low") == F.col("b.low"))
        mid = lambda c: F.when(hit, F.col(f"b.{c}"))
        left = j.select(*series, "low", "s_low", "ss_low", F.coalesce(mid("i"), "high").alias("high"),
                        F.coalesce(mid("s"), "s_high").alias("s_high"), F.coalesce(mid("ss"), "ss_high").alias("ss_high"))
        right = j.filter(hit).select(*series, F.col("b.i").alias("low"), F.col("b.s").alias("s_low"), F.col("b.ss").alias("ss_low"), "high", "s_high", "ss_high")
        segs = cut_lineage(left.unionByName(right))
    if found is None:
        return segs.select(*series, F.col("low").alias("position"), F.lit(0.0).alias("gain")).limit(0)
    return found


def silhouette_squared(points: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean silhouette with squared distances, linear in the rows.

    The mean squared distance of a point to a cluster follows from the cluster's
    size, sum vector and sum of squared norms; only those are shared.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = points.select(F.monotonically_increasing_id().alias("_id"), F.col(cluster).alias("c"), v.alias("v")).withColumn(
        "nn", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dims = rows.select("c", "nn", F.posexplode("v").alias("i", "x"))
    sums = dims.groupBy("c", "i").agg(F.sum("x").alias("sx"))
    vec = sums.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sx"))), lambda s: s["sx"]).alias("sv"))
    size = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("nn").alias("sn"))
    # One row per cluster; collected into one array that rides along as a scalar.
    table = size.join(vec, "c").agg(F.collect_list(F.struct("c", "n", "sn", "sv")).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    j = rows.withColumn("t", table.scalar())
    dist = F.transform("t", lambda k: F.struct(
        k["c"].alias("c"),
        F.when(k["c"] == F.col("c"), F.when(k["n"] > 1, (k["n"] * F.col("nn") - 2 * dot(F.col("v"), k["sv"]) + k["sn"]) / (k["n"] - 1)).otherwise(0.0))
        .otherwise((k["n"] * F.col("nn") - 2 * dot(F.col("v"), k["sv"]) + k["sn"]) / k["n"]).alias("d")))
    d = j.select("c", dist.alias("d"))
    a = F.array_max(F.transform(F.filter("d", lambda s: s["c"] == F.col("c")), lambda s: s["d"]))
    b = F.array_min(F.transform(F.filter("d", lambda s: s["c"] != F.col("c")), lambda s: s["d"]))
    m = F.greatest(a, b)
    score = F.when(b.isNull() | (m <= EPS), 0.0).otherwise((b - a) / m)
    return d.select(score.alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_exact(points: DataFrame, key: str, vector: str, cluster: str, block: int = 4000) -> DataFrame:
    """Mean silhouette with Euclidean distances, as defined (quadratic in the rows).

    Rows are read in the order of their clusters, so a task that holds a block of rows keeps one sum a row for the cluster at hand, the mean
    to its own cluster and the least mean to another. Use the squared form for large tables.
    """
    total = points.count()
    c = F.col(cluster).cast("int")
    rows = points.select(F.col(vector).cast("array<double>").alias("x"), F.array(c.isNotNull().cast("int"), F.coalesce(c, F.lit(0))).alias("tag"))
    rows = rows.orderBy("tag")

    def start(x: np.ndarray, tag: np.ndarray) -> dict:
        return {"x": x, "own": tag, "a": np.full(len(x), np.nan), "b": np.full(len(x), np.inf), "sum": np.zeros(len(x)), "n": 0, "c": None}

    def close(s: dict) -> None:
        if s["n"]:
            same = (s["own"][:, 0] > 0) & (s["own"][:, 1] == s["c"])
            s["a"][same] = s["sum"][same] / max(s["n"] - 1, 1) if s["n"] > 1 else 0.0
            rest = (s["own"][:, 0] > 0) & ~same
            s["b"][rest] = np.minimum(s["b"][rest], s["sum"][rest] / s["n"])
        s["sum"], s["n"] = np.zeros(len(s["x"])), 0

    def step(s: dict, x: np.ndarray, tag: np.ndarray) -> None:
        known = tag[:, 0] > 0
        x, tag = x[known], tag[known, 1]
        for c in np.unique(tag).tolist():
            if c != s["c"]:
                close(s)
                s["c"] = c
            of = x[tag == c]
            for lo in range(0, len(s["x"]), 2048):
                s["sum"][lo:lo + 2048] += distances(s["x"][lo:lo + 2048], of).sum(axis=1)
            s["n"] += len(of)

    def end(s: dict) -> pa.RecordBatch:
        close(s)
        top = np.fmax(s["a"], s["b"])
        alone = ~np.isfinite(s["b"]) | (top <= EPS)
        score = np.zeros(len(top))
        score[~alone] = (s["b"][~alone] - s["a"][~alone]) / top[~alone]
        return pa.RecordBatch.from_arrays([pa.array([float(score.sum())]), pa.array([len(score)], pa.int64())], names=["s", "n"])

    per = against_all(rows, total, block, start, step, end, "s double, n long")
    return per.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def rand_index(a: DataFrame, b: DataFrame, key: str, la: str, lb: str, keys: list[str] | None = None) -> DataFrame:
    """Rand index of two labelings from the contingency table, never from pairs."""
    keys = keys or []
    return rand_of_cells(a.join(b, [*keys, key]).groupBy(*keys, la, lb).agg(F.count(F.lit(1)).alias("n")), la, lb, keys)


def rand_of_cells(cells: DataFrame, la: str, lb: str, keys: list[str]) -> DataFrame:
    """(keys, n, rand) of a contingency table (keys, la, lb, n)."""
    cells = cut_lineage(cells)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cells.groupBy(*keys).agg(pairs("n").alias("_both"), F.sum("n").alias("_n"))
    left = cells.groupBy(*keys, la).agg(F.sum("n").alias("m")).groupBy(*keys).agg(pairs("m").alias("_left"))
    right = cells.groupBy(*keys, lb).agg(F.sum("n").alias("m")).groupBy(*keys).agg(pairs("m").alias("_right"))
    if keys:
        j = both.join(left, keys).join(right, keys)
    else:
        j = both.withColumn("_left", left.scalar()).withColumn("_right", right.scalar())
    total = F.col("_n") * (F.col("_n") - 1) / 2
    return j.select(*keys, F.col("_n").alias("n"), F.when(total > 0, (2 * F.col("_both") + total - F.col("_left") - F.col("_right")) / total).otherwise(1.0).alias("rand"))


def group_draws(df: DataFrame, group: str, draws: int, seed: str, fraction: float = 0.8) -> DataFrame:
    """(draw, group): per draw ceil(fraction * G) groups without replacement, by hash rank."""
    groups = df.select(group).distinct()
    size = groups.count()
    each = groups.select(group, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(group).cast("string"))))
    return hash_rank(each, ["draw"], "_h", [group]).filter(F.col("rk") <= math.ceil(fraction * size)).select("draw", group)


def _drawn(rows: DataFrame, draws: DataFrame, group: str) -> DataFrame:
    """Rows once for each draw of their group and once as draw -1, the full sample; rows are multiplied where they lie."""
    named = draws.groupBy(group).agg(F.collect_list("draw").alias("_draws"))
    every = F.concat(F.coalesce("_draws", F.array().cast("array<int>")), F.array(F.lit(-1)))
    return sized_join(rows, named, group, "left").select(*rows.columns, F.explode(every).alias("draw"))


def invariant_stability(rows: DataFrame, draws: DataFrame, group: str, z: str, tolerance: float, min_conformity: float = 0.9, shift: float = 0.1) -> DataFrame:
    """Per draw: does the invariant of ``z`` still hold with nearly the same centre?"""
    every = _drawn(rows.select(group, z), draws, group).select("draw", z)
    centre = exact_quantiles(every, ["draw"], z, {"centre": 0.5})
    scale = F.when(F.abs("centre") > EPS, F.abs("centre")).otherwise(1.0)
    ok = F.abs(F.col(z) - F.col("centre")) <= tolerance * scale + EPS
    agg = sized_join(every, centre, "draw").groupBy("draw").agg(
        F.first("centre").alias("centre"), (F.count_if(ok) / F.count(z)).alias("conformity"))
    full = agg.filter("draw = -1").select("centre")
    j = agg.filter("draw >= 0").withColumn("_full", full.scalar())
    moved = F.abs(F.col("centre") - F.col("_full")) / F.greatest(F.abs("_full"), F.lit(EPS))
    return j.select("draw", "centre", "conformity", ((F.col("conformity") >= min_conformity) & (moved <= shift)).alias("reproduced"))


def changepoint_stability(rows: DataFrame, draws: DataFrame, group: str, series: list[str], order: list[str], value: str, shift: float = 0.1, **kw) -> DataFrame:
    """Per (series, draw): same number of change-points at nearly the same relative place.

    The draw is one more series key, so all draws run in the same jobs; the full
    sample is draw -1.
    """
    every = _drawn(rows, draws, group)
    keys = [*series, "draw"]
    sizes = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pts = changepoints(every, keys, order, value, **kw).join(sizes, keys).withColumn("rel", F.col("position") / F.col("_n"))
    lists = sizes.select(*keys).join(pts.groupBy(*keys).agg(F.array_sort(F.collect_list("rel")).alias("_p")), keys, "left").withColumn(
        "_p", F.coalesce("_p", F.array().cast("array<double>")))
    full = lists.filter("draw = -1").select(*series, F.col("_p").alias("_full"))
    j = lists.filter("draw >= 0").join(full, series)
    near = F.forall(F.zip_with("_p", "_full", lambda a, b: F.abs(a - b)), lambda d: d <= shift)
    return j.select(*keys, F.size("_p").alias("points"), ((F.size("_p") == F.size("_full")) & near).alias("reproduced"))


def cluster_stability(points: DataFrame, key: str, vector: str, group: str, draws: DataFrame, agreement: float = 0.8, **search) -> DataFrame:
    """(draw, k, rand, reproduced) per draw: same number of clusters and a Rand index of at least ``agreement`` with the full labels.

    The full sample is one more draw, so one search serves all; nothing is reproduced where the full sample shows no clusters.
    """
    every = draws.select("draw", group).unionByName(points.select(group).distinct().select(F.lit(-1).alias("draw"), group))
    found = ClusterSearch(points, key, vector, draws=every, group=group, choice=True, **search)
    labels = cut_lineage(found.labels())
    full = labels.filter("draw = -1").select("id", F.col("cluster").alias("full"))
    cells = labels.filter("draw >= 0").join(full, "id").groupBy("draw", "cluster", "full").agg(F.count(F.lit(1)).alias("n"))
    k_full = found.draws[-1].k if -1 in found.draws else None
    same = (F.col("k") == F.lit(k_full)) & (F.col("rand") >= agreement)
    return rand_of_cells(cells, "cluster", "full", ["draw"]).join(found.chosen().select("draw", "k"), "draw").select(
        "draw", "k", "rand", F.coalesce(same, F.lit(False)).alias("reproduced"))
