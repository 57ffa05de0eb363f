"""Feature relevance, dataset meta-features and method selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.exprs import is_finite
from veritab.functions.ordered import average_rank, ordered_scan, sorted_runs, top_rows
from veritab.session import cut_lineage, sized_join

TINY = 1e-12


def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Long form (keep.., feature, x)."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))


def pearson_abs(df: DataFrame, features: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """|r| per feature, missing values at the column mean; one aggregation pass.

    A value at the mean adds nothing to the moments, so imputing only rescales
    them by the share of present values.
    """
    by = by or []
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop(y).alias("_sy"),
        *[F.struct(F.count(f).alias("n"), F.covar_pop(f, y).alias("c"), F.var_pop(f).alias("v")).alias(f"_f_{f}") for f in features])
    share = lambda f: F.col(f"_f_{f}.n") / F.col("_n")
    cells = [F.struct(
        F.lit(f).alias("feature"),
        F.abs(share(f) * F.col(f"_f_{f}.c") / ((F.sqrt(share(f) * F.col(f"_f_{f}.v")) + TINY) * (F.col("_sy") + TINY))).alias("score"))
        for f in features]
    return agg.select(*by, F.inline(F.array(*cells)))


def spearman_abs(df: DataFrame, features: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """|rho| per feature with average ranks, optionally within the keys ``by``.

    Rows are grouped by feature value before anything is ordered: a value only
    needs its count and the sum of its rows' y-ranks.
    """
    by = by or []
    ranked = df.join(average_rank(df, by, y).select(*by, y, F.col("avg_rank").alias("_ry")), [*by, y])
    means = df.groupBy(*by).agg(F.struct(*[F.avg(f).alias(f) for f in features]).alias("_m"))
    ranked = sized_join(ranked, means, by) if by else ranked.withColumn("_m", means.scalar())
    filled = ranked.select(*by, "_ry", *[F.coalesce(F.col(f).cast("double"), F.col(f"_m.{f}")).alias(f) for f in features])
    key = [*by, "feature"]
    values = melt(filled, features, [*by, "_ry"]).groupBy(*key, "x").agg(
        F.count(F.lit(1)).alias("ties"), F.sum("_ry").alias("_sry"), F.sum(F.col("_ry") * F.col("_ry")).alias("_sry2"))
    scanned = ordered_scan(values, key, ["x"], sums={"_cum": "ties"})
    rx = F.col("_cum") - (F.col("ties") - 1) / 2.0
    agg = scanned.groupBy(*key).agg(
        F.sum("ties").alias("n"), F.sum(rx * F.col("_sry")).alias("xy"), F.sum(rx * rx * F.col("ties")).alias("xx"),
        F.sum("_sry2").alias("yy"))
    mean = (F.col("n") + 1) / 2.0
    var = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col(s) / F.col("n") - mean * mean)) + TINY
    return agg.select(*key, F.abs((F.col("xy") / F.col("n") - mean * mean) / (var("xx") * var("yy"))).alias("score"))


def quantile_cuts(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, cuts): exact upper bounds of equal-count bins, at most ``bins - 1`` per key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    scanned = ordered_scan(counts, keys, [value], sums={"_cum": "_t"})
    # Counted apart from the values: one row per key and task is shuffled.
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        marked = scanned.join(total, keys)
    else:
        marked = scanned.withColumn("_n", total.scalar())
    # A value closes its bin when the next value starts in a later one.
    bin_at = lambda c: F.floor(c * bins / F.col("_n"))
    closes = (bin_at(F.col("_cum")) > bin_at(F.col("_cum") - F.col("_t"))) & (F.col("_cum") < F.col("_n"))
    return marked.filter(closes).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("cuts"))


def bin_of(value: Column, cuts: Column, bins: int) -> Column:
    """Number of cuts below the value, of at most ``bins - 1``; comparisons one by one are compiled, a filter of the array is not."""
    return sum((F.when(F.get(cuts, F.lit(i)) < value, 1).otherwise(0) for i in range(bins - 1)), F.lit(0))


def binned_mutual_information(df: DataFrame, features: list[str], y: str, bins: int = 8, by: list[str] | None = None) -> DataFrame:
    """MI (nats) of quantile bins; the k-NN estimator of the usual definition is replaced."""
    by = by or []
    key, empty = [*by, "feature"], F.array().cast("array<double>")
    ycuts = quantile_cuts(df.select(*by, y), by, y, bins).withColumnRenamed("cuts", "_yc")
    placed = sized_join(df, ycuts, by, "left") if by else df.withColumn("_yc", ycuts.scalar())
    # The target is placed once a row, not once a feature.
    placed = placed.withColumn("_yb", bin_of(F.col(y), F.coalesce("_yc", empty), bins))
    cuts = quantile_cuts(melt(df, features, by).filter(F.col("x").isNotNull()), key, "x", bins)
    rows = sized_join(melt(placed, features, [*by, "_yb"]).filter(F.col("x").isNotNull()), cuts, key, "left")
    cells = rows.select(*key, bin_of(F.col("x"), F.coalesce("cuts", empty), bins).alias("bx"), F.col("_yb").alias("by")).groupBy(
        *key, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    return mutual_information(cells, key, "bx", "by")


def mutual_information(cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    cells = cut_lineage(cells)
    na = cells.groupBy(*keys, a).agg(F.sum("n").alias("_na"))
    nb = cells.groupBy(*keys, b).agg(F.sum("n").alias("_nb"))
    tot = cells.groupBy(*keys).agg(F.sum("n").alias("_n"))
    j = cells.join(na, [*keys, a]).join(nb, [*keys, b]).join(tot, keys)
    term = F.col("n") / F.col("_n") * F.ln(F.col("n") * F.col("_n") / (F.col("_na") * F.col("_nb")))
    return j.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(term)).alias("score"))


def infer_task(df: DataFrame, y: str, numeric: bool = True) -> DataFrame:
    """task, y_unique, y_is_integer of a target column."""
    if not numeric:
        return df.agg(F.lit("classification").alias("task"), F.count_distinct(y).alias("y_unique"), F.lit(False).alias("y_is_integer"))
    near = F.abs(F.col(y) - F.rint(y)) <= 1e-8 + 1e-5 * F.abs(F.rint(y))
    agg = df.agg(F.count_distinct(y).alias("y_unique"), F.bool_and(near).alias("y_is_integer"), F.count(F.lit(1)).alias("_n"))
    few = F.col("y_unique") <= F.greatest(F.lit(20), (F.lit(0.1) * F.col("_n")).cast("int"))
    return agg.select(F.when(F.col("y_is_integer") & few, "classification").otherwise("regression").alias("task"), "y_unique", "y_is_integer")


def meta_features(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Shape, missing and zero rates, task and mean |corr| between features; one pass and one for the distinct count
    (the mean keeps the n/(n-1) factor of its definition)."""
    p = len(features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    near = F.abs(F.col(y) - F.rint(y)) <= 1e-8 + 1e-5 * F.abs(F.rint(y))
    agg = df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.bool_and(near).alias("y_is_integer"),
        sum((F.count_if(F.col(f).isNull()) for f in features), F.lit(0)).alias("_miss"),
        sum((F.count_if(F.abs(F.coalesce(F.col(f), F.lit(0.0))) <= TINY) for f in features), F.lit(0)).alias("_zero"),
        *[F.struct(F.count(f).alias("n"), F.var_pop(f).alias("v")).alias(f"_v_{f}") for f in features],
        *[F.struct(F.regr_count(a, b).alias("n"), F.covar_pop(a, b).alias("c"),
                   F.regr_avgy(F.col(a), F.col(b)).alias("ma"), F.regr_avgx(F.col(a), F.col(b)).alias("mb")).alias(f"_c_{a}_{b}")
          for a, b in pairs],
        *[F.avg(f).alias(f"_m_{f}") for f in features])
    # Beside the moments a distinct count would shuffle all their buffers once per value of y.
    agg = agg.crossJoin(df.agg(F.count_distinct(y).alias("y_unique")))
    n = F.col("n_samples")
    std = {f: F.sqrt(F.col(f"_v_{f}.n") / n * F.col(f"_v_{f}.v")) + TINY for f in features}
    corr = []
    for a, b in pairs:
        # Sum of products about the column means over rows where both are present.
        c = F.col(f"_c_{a}_{b}")
        cross = c["n"] * (c["c"] + (c["ma"] - F.col(f"_m_{a}")) * (c["mb"] - F.col(f"_m_{b}")))
        corr.append(F.abs(cross / (std[a] * std[b]) / F.greatest(n - 1, F.lit(1))))
    few = F.col("y_unique") <= F.greatest(F.lit(20), (F.lit(0.1) * n).cast("int"))
    return agg.select(
        "n_samples", F.lit(p).cast("long").alias("n_features"), (F.lit(p) / n).alias("p_over_n"),
        (F.col("_miss") / (n * p)).alias("missing_rate"), (F.col("_zero") / (n * p)).alias("sparsity_rate"),
        "y_unique", "y_is_integer", F.when(F.col("y_is_integer") & few, "classification").otherwise("regression").alias("task"),
        (sum(corr, F.lit(0.0)) * 2 / max(p * p - p, 1)).alias("mean_abs_corr"))


# Rows of a block whose pairs are summed in one task, and the number of blocks above which blocks grow instead.
PAIR_BLOCK, PAIR_BLOCKS = 1 << 17, 2048


def _sum_below(rank: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w * w' * (x - x') * (y - y') over pairs of rows with the row ' first in order and in ``rank`` (0, 1, ..).

    Every pair of ranks parts at one binary digit; rows are dealt to the halves digit by digit and keep their order.
    """
    size = 1 << max(1, (len(x) - 1).bit_length())
    pad = lambda v: np.concatenate([v, np.zeros(size - len(v))])
    rank = np.concatenate([rank, np.arange(len(rank), size)])
    x, y, w = pad(x - x.mean()), pad(y - y.mean()), pad(w)
    total, length = 0.0, size
    while length > 1:
        left = (rank // (length // 2) % 2 == 0).reshape(-1, length)
        running = lambda v: np.where(left, v.reshape(-1, length), 0.0).cumsum(axis=1).ravel()  # noqa: B023, E731
        wx = w * x
        below = x * y * running(w) - y * running(wx) - x * running(w * y) + running(wx * y)
        total += float((w * below)[~left.ravel()].sum())
        halves = [np.flatnonzero(side).reshape(-1, length // 2) for side in (left, ~left)]
        order = np.concatenate(halves, axis=1).ravel()
        rank, x, y, w, length = rank[order], x[order], y[order], w[order], length // 2
    return total


def _by_x(size: int):
    """Tasks over rows in x order: the block of each row, its x-distances to the block's rows before it as they enter a
    row sum, and, on the first row of each block, the block's own part of the cross term."""
    def run(batches):
        for block in sorted_runs(batches, "feature", size):
            x, y, w = (block.column(c).to_numpy() for c in ("x", "y", "w"))
            inner, rank = np.zeros(len(x)), np.empty(len(x), np.int64)
            rank[np.argsort(y, kind="stable")] = np.arange(len(x))
            inner[0] = _sum_below(rank, x, y, w)
            part = 2 * (x * np.cumsum(w) - np.cumsum(w * x))
            columns = [block.column("feature"), pa.array(np.full(len(x), block.column("seq")[0].as_py())), *(pa.array(v) for v in (x, y, w, part, inner))]
            yield from pa.table(columns, names=["feature", "bx", "x", "y", "w", "part", "inner"]).to_batches(max_chunksize=10_000)
    return run


_CELL = ["w", "wx", "wy", "wxy", "wxx", "wyy", "wa", "way", "wav", "waa", "wvv", "wvy", "wv", "inner"]


def _by_y(size: int):
    """Tasks over rows in y order: sums per block of this order and block of the x order."""
    def run(batches):
        for block in sorted_runs(batches, "feature", size):
            x, y, w, a, inner, bx = (block.column(c).to_numpy() for c in ("x", "y", "w", "ax", "inner", "bx"))
            v = 2 * (y * np.cumsum(w) - np.cumsum(w * y))
            ids, at = np.unique(bx, return_inverse=True)
            # Pairs of one x block are summed there: of these the later row comes first here.
            rank = np.empty(len(x), np.int64)
            rank[np.lexsort((-np.arange(len(x)), at))] = np.arange(len(x))
            sums = [np.bincount(at, weights=c, minlength=len(ids)) for c in (
                w, w * x, w * y, w * x * y, w * x * x, w * y * y, w * a, w * a * y, w * a * v, w * a * a, w * v * v, w * v * y, w * v, inner)]
            sums[-1][0] += _sum_below(rank, x, y, w)
            names = pa.array([block.column("feature")[0].as_py()] * len(ids), pa.string())
            columns = [names, pa.array(np.full(len(ids), block.column("seq")[0].as_py())), pa.array(ids), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "by", "bx", *_CELL])
    return run


def distance_correlation(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Exact distance correlation of each feature with y; two range sorts of the m distinct (x, y) pairs, which carry weights.

    Both orders are cut into blocks. Row sums of distances come from running sums inside a block and totals of the
    blocks before. The cross term needs pairs that lie below in both orders: those of one x block are summed in its
    task, those of one y block and different x blocks in that one's, and all others by sums of the cells (x block, y block).
    """
    pairs = cut_lineage(melt(df, features, [F.col(y).cast("double").alias("y")]).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    tot = cut_lineage(pairs.groupBy("feature").agg(
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my")))
    size = max(PAIR_BLOCK, (tot.agg(F.max("m")).first()[0] or 0) // PAIR_BLOCKS)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, *keys: F.coalesce(F.sum(c).over(before(*keys)), F.lit(0.0))

    # Distances do not change when means are taken off.
    centred = pairs.join(F.broadcast(tot), "feature").select("feature", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "w")
    rows = cut_lineage(centred.orderBy("feature", "x", "y").withColumn("seq", F.monotonically_increasing_id()).mapInArrow(
        _by_x(size), "feature string, bx long, x double, y double, w double, part double, inner double"))
    # One row per block.
    xs = rows.groupBy("feature", "bx").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    xs = xs.select("feature", "bx", earlier("w", "feature", "bx").alias("cw"), earlier("wx", "feature", "bx").alias("cx"), F.sum("w").over(Window.partitionBy("feature")).alias("n"),
                   F.sum("wx").over(Window.partitionBy("feature")).alias("sx"))
    ax = F.col("part") + F.col("x") * (2 * F.col("cw") - F.col("n")) + F.col("sx") - 2 * F.col("cx")
    placed = rows.join(F.broadcast(xs), ["feature", "bx"]).select("feature", "bx", "x", "y", "w", ax.alias("ax"), "inner")
    cells = cut_lineage(placed.orderBy("feature", "y", "x").withColumn("seq", F.monotonically_increasing_id()).mapInArrow(
        _by_y(size), "feature string, by long, bx long, " + ", ".join(f"{c} double" for c in _CELL)))

    ys = cells.groupBy("feature", "by").agg(*[F.sum(c).alias(c) for c in _CELL])
    ys = ys.select("*", earlier("w", "feature", "by").alias("cw"), earlier("wy", "feature", "by").alias("cy"),
                   F.sum("w").over(Window.partitionBy("feature")).alias("n"), F.sum("wy").over(Window.partitionBy("feature")).alias("sy"))
    # The row sum of y is wv's v + p * y + q.
    p, q, c = 2 * F.col("cw") - F.col("n"), F.col("sy") - 2 * F.col("cy"), F.col
    third = ys.groupBy("feature").agg(
        F.sum(c("wav") + p * c("way") + q * c("wa")).alias("ab"), F.sum("waa").alias("aa"), F.sum("wa").alias("a"),
        F.sum(c("wvv") + p * p * c("wyy") + q * q * c("w") + 2 * (p * c("wvy") + q * c("wv") + p * q * c("wy"))).alias("bb"),
        F.sum(c("wv") + p * c("wy") + q * c("w")).alias("b"), F.sum("wx").alias("sx"), F.sum("wxx").alias("sxx"), F.sum("wy").alias("sy"),
        F.sum("wyy").alias("syy"), F.sum("wxy").alias("sxy"), F.sum("inner").alias("inner"))
    four = ["w", "wx", "wy", "wxy"]
    grid = cells.select("feature", "bx").distinct().join(cells.select("feature", "by").distinct(), "feature").join(
        cells.select("feature", "bx", "by", *four), ["feature", "bx", "by"], "left").fillna(0.0, four)
    for keys in (("feature", "bx", "by"), ("feature", "by", "bx")):
        source = four if keys[2] == "by" else [f"_{c}" for c in four]
        grid = grid.withColumns({f"_{c}": earlier(s, *keys) for c, s in zip(four, source, strict=True)})
    apart = grid.groupBy("feature").agg(F.sum(c("wxy") * c("_w") - c("wy") * c("_wx") - c("wx") * c("_wy") + c("w") * c("_wxy")).alias("apart"))
    j = tot.select("feature", "n").join(third, "feature").join(apart, "feature")
    n = F.col("n")
    # Products over all pairs, and twice those of pairs that lie below in both orders.
    signed = n * c("sxy") - c("sx") * c("sy")
    s1 = 2 * (2 * (c("inner") + c("apart")) - signed) / n ** 2
    dcov = lambda s1_, ab, a, b: F.sqrt(F.greatest(F.lit(0.0), s1_ + a * b / n ** 4 - 2 * ab / n ** 3))
    sq = lambda s, ss: 2 * (n * F.col(ss) - F.col(s) ** 2) / n ** 2
    xy = dcov(s1, F.col("ab"), F.col("a"), F.col("b"))
    xx = dcov(sq("sx", "sxx"), F.col("aa"), F.col("a"), F.col("a")) + TINY
    yy = dcov(sq("sy", "syy"), F.col("bb"), F.col("b"), F.col("b")) + TINY
    return j.select("feature", n.cast("long").alias("n"), (xy / F.sqrt(xx * yy)).alias("score"))


# --- folds -----------------------------------------------------------------


def hash_fold(seed: str, key: Column, folds: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by size, largest first, each to the lightest fold.

    Groups of one size are interchangeable, so the greedy rule runs over the
    table of distinct sizes (with their counts) and yields, per size, a short
    list of folds for the levelling steps and then a repeating cycle.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("members"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = np.zeros(folds), []
        for size, members in pdf.sort_values("size", ascending=False)[["size", "members"]].itertuples(index=False):
            prefix = []
            while len(prefix) < members and load.max() - load.min() >= size:
                f = int(load.argmin())
                load[f] += size
                prefix.append(f)
            rest = members - len(prefix)
            cycle = [int(f) for f in np.argsort(load, kind="stable")]
            for i, f in enumerate(cycle):
                load[f] += size * (rest // folds + (1 if i < rest % folds else 0))
            out.append((size, prefix, cycle))
        return pd.DataFrame(out, columns=["size", "prefix", "cycle"])

    # One row per distinct group size: bounded by the square root of the row count.
    rule = classes.groupBy(F.lit(1).alias("_one")).applyInPandas(
        lambda pdf: plan(pdf), "size long, prefix array<int>, cycle array<int>")
    placed = ordered_scan(sizes, ["size"], [group], number="_i").join(rule, "size")
    i = F.col("_i") - 1
    fold = F.when(i < F.size("prefix"), F.get("prefix", i.cast("int"))).otherwise(
        F.get("cycle", ((i - F.size("prefix")) % folds).cast("int")))
    return placed.select(group, fold.alias("fold"))


def fold_moments(df: DataFrame, fold: str, features: list[str], y: str) -> DataFrame:
    """One row per fold with count, sums and cross products of centred (features, y)."""
    names = [*features, y]
    means = df.groupBy().agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("m"))
    c = df.withColumn("_m", means.scalar()).select(
        fold, *[(F.coalesce(F.col(v).cast("double"), F.col(f"_m.{v}")) - F.col(f"_m.{v}")).alias(v) for v in names])
    sums = [F.sum(v).alias(f"s_{v}") for v in names]
    prods = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return c.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)


def evaluate_folds(moments: DataFrame, features: list[str], y: str, k: int, scores: DataFrame | None = None,
                   metric: str = "r2", alpha: float = 1.0) -> DataFrame:
    """Per fold: top-k features chosen on the other folds and the ridge score on the fold.

    ``scores`` (fold, feature, score) replaces |r| as the relevance. The input
    is one row of moments per fold, so the solve touches no data rows.
    """
    names = [*features, y]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.drop(columns=["fold", "given"]).sum()
        rows = []
        for _, part in pdf.iterrows():
            test = part.drop(["fold", "given"]).astype(float)
            train = total.astype(float) - test

            def matrix(m):
                p = np.array([[m[f"p_{a}_{b}"] if f"p_{a}_{b}" in m.index else m[f"p_{b}_{a}"] for b in names] for a in names])
                s = np.array([m[f"s_{v}"] for v in names])
                return m["n"], s, p

            n, s, p = matrix(train)
            cov = p / n - np.outer(s, s) / n ** 2
            std = np.sqrt(np.maximum(np.diag(cov), 0)) + TINY
            given = part["given"]
            if given is not None and len(given):
                lookup = {g["feature"]: g["score"] for g in given}
                rel = np.array([lookup.get(f, 0.0) for f in features])
            else:
                rel = np.abs(cov[:-1, -1] / (std[:-1] * std[-1]))
            top = np.argsort(-rel, kind="stable")[:k]
            a = (cov * n)[np.ix_(top, top)] + alpha * np.eye(len(top))
            beta = np.linalg.solve(a, (cov * n)[top, -1])
            b0 = s[-1] / n - beta @ (s[top] / n)
            nt, st, pt = matrix(test)
            w = np.zeros(len(names))
            w[top], w[-1] = -beta, 1.0
            sse = w @ pt @ w - 2 * b0 * (w @ st) + nt * b0 ** 2
            sst = pt[-1, -1] - st[-1] ** 2 / nt
            value = 1 - sse / sst if metric == "r2" else -sse / nt
            rows.append((int(part["fold"]), [features[i] for i in top], float(value)))
        return pd.DataFrame(rows, columns=["fold", "top", "score"])

    if scores is None:
        given = moments.withColumn("given", F.lit(None).cast("array<struct<feature:string,score:double>>"))
    else:
        g = scores.groupBy("fold").agg(F.collect_list(F.struct("feature", "score")).alias("given"))
        given = moments.join(g, "fold", "left")
    return given.groupBy(F.lit(1).alias("_one")).applyInPandas(
        lambda pdf: solve(pdf.drop(columns=[c for c in ("_one",) if c in pdf])), "fold int, top array<string>, score double")


def fold_summary(per_fold: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population std of the scores and pairwise Jaccard stability of the top sets."""
    keys = keys or []
    base = per_fold.groupBy(*keys).agg(F.avg("score").alias("cv_score_mean"), F.stddev_pop("score").alias("cv_score_std"))
    a, b = per_fold.alias("a"), per_fold.alias("b")
    # At most folds^2 rows: one row per fold on each side.
    on = F.col("a.fold") < F.col("b.fold")
    for key in keys:
        on = on & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    jac = F.size(F.array_intersect("a.top", "b.top")) / F.greatest(F.size(F.array_union("a.top", "b.top")), F.lit(1))
    stab = a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.avg(jac).alias("stability_jaccard"))
    if keys:
        return base.join(stab, keys, "left")
    return base.withColumn("stability_jaccard", F.coalesce(stab.scalar(), F.lit(1.0)))


# --- experience tables -------------------------------------------------------


def flatten_features(meta: Column, traj: Column) -> Column:
    empty = F.create_map().cast("map<string,double>")
    prefixed = F.transform_keys(F.coalesce(traj, empty), lambda k, v: F.concat(F.lit("traj__"), k))
    return F.map_concat(F.coalesce(meta, empty), prefixed)


def normalize_method(name: Column) -> Column:
    """Canonical method name; empty names give null."""
    n = F.lower(F.trim(name))
    return (
        F.when(n.isNull() | (n == ""), None).when(n.startswith("mutual_info"), "mutual_info")
        .when(n == "dcor", "distance_correlation").when(n == "perm", "permutation_importance").otherwise(n))


def objective_j(cv: Column, stability: Column, runtime: Column, w_u: float = 1.0, w_s: float = 0.10, w_c: float = 0.15) -> Column:
    value = (w_u * cv + w_s * F.coalesce(stability, F.lit(0.0))
             - w_c * F.log1p(F.greatest(F.coalesce(runtime, F.lit(0.0)), F.lit(0.0))))
    return F.when(is_finite(cv), value).otherwise(float("-inf"))


def aggregate_experience(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, methods): per dataset the mean of each finite feature, and per
    (dataset, method) mean cv, runtime and J with the label of the best method.

    Datasets with fewer than two methods are dropped; ties go to the first name.
    """
    flat = records.select("dataset_id", F.explode(flatten_features(F.col("meta_features"), F.col("trajectory_features"))).alias("feature", "value"))
    features = flat.filter(is_finite(F.col("value"))).groupBy("dataset_id", "feature").agg(F.avg("value").alias("value"))
    ev = records.select("dataset_id", F.explode("evaluations").alias("raw", "e"))
    ev = ev.withColumn("method", normalize_method(F.col("raw"))).filter(F.col("method").isNotNull())
    scored = ev.withColumn("j", objective_j(F.col("e.cv_score_mean"), F.col("e.stability_jaccard"), F.col("e.runtime_sec")))
    per = scored.filter(is_finite(F.col("j"))).groupBy("dataset_id", "method").agg(
        F.avg(F.coalesce("e.runtime_sec", F.lit(0.0))).alias("runtime_sec"), F.avg("e.cv_score_mean").alias("cv"), F.avg("j").alias("j"))
    label = per.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_methods"), F.min_by("method", F.struct((-F.col("j")).alias("j"), "method")).alias("label"))
    return features, per.join(label.filter("n_methods >= 2"), "dataset_id")


def low_runtime_choice(predictions: DataFrame, p_sure: float = 0.60, margin: float = 0.15) -> DataFrame:
    """Run one method when the first is sure enough, else two."""
    agg = predictions.groupBy("dataset_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("probability"))).alias("p1"),
        F.max(F.when(F.col("position") == 2, F.col("probability"))).alias("p2"),
        F.max(F.when(F.col("position") == 1, F.col("method"))).alias("m1"),
        F.max(F.when(F.col("position") == 2, F.col("method"))).alias("m2"))
    sure = (F.col("p1") >= p_sure) | (F.col("p1") - F.coalesce("p2", F.lit(0.0)) >= margin)
    return agg.select("dataset_id", F.when(sure, F.array("m1")).otherwise(F.array_compact(F.array("m1", "m2"))).alias("methods"))


def selector_report(predictions: DataFrame, methods: DataFrame, top_n: int) -> DataFrame:
    """Per fold: top-1 accuracy, top-N hit, regrets in cv and J, and time ratios."""
    truth = methods.groupBy("dataset_id").agg(
        F.first("label").alias("label"), F.max("cv").alias("best_cv"), F.max("j").alias("best_j"), F.sum("runtime_sec").alias("t_full"))
    j = predictions.filter(F.col("position") <= top_n).join(methods.select("dataset_id", "method", "cv", "j", "runtime_sec"), ["dataset_id", "method"], "left")
    per = j.groupBy("fold", "dataset_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("method"))).alias("first"), F.collect_set("method").alias("offered"),
        F.max(F.when(F.col("position") == 1, F.col("cv"))).alias("cv1"), F.max("j").alias("jn"),
        F.max(F.when(F.col("position") == 1, F.col("j"))).alias("j1"),
        F.sum(F.when(F.col("position") == 1, F.col("runtime_sec"))).alias("t1"), F.sum("runtime_sec").alias("tn")).join(truth, "dataset_id")
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return per.groupBy("fold").agg(
        F.count(F.lit(1)).alias("datasets"), hit(F.col("first") == F.col("label")).alias("top1_accuracy"),
        hit(F.array_contains("offered", F.col("label"))).alias("topn_hit"),
        F.avg(F.col("best_cv") - F.col("cv1")).alias("regret_cv"), F.avg(F.col("best_j") - F.col("j1")).alias("regret_j"),
        F.avg(F.col("best_j") - F.col("jn")).alias("regret_j_topn"),
        (F.sum("t1") / F.sum("t_full")).alias("time_ratio_top1"), (F.sum("tn") / F.sum("t_full")).alias("time_ratio_topn"))


def best_method(methods: DataFrame, dataset: str) -> DataFrame:
    """Order by J, cv score, stability, then shorter runtime; one row per dataset."""
    order = F.struct((-F.col("j")).alias("a"), (-F.col("cv")).alias("b"), (-F.col("stability")).alias("c"), F.col("runtime_sec"), F.col("method"))
    best = methods.groupBy(dataset).agg(F.min_by(F.struct("method", "j", "cv", "stability", "runtime_sec"), order).alias("m"))
    return best.select(dataset, "m.*")


def feature_top_k(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k highest scores, ties by column position; none for k <= 0."""
    if k <= 0:
        return scores.limit(0).withColumn("rn", F.lit(0))
    return top_rows(scores, keys, [F.desc("score"), F.asc("position")], k)


def encode_by_first_appearance(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Integer codes in order of first appearance; missing is -1."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first"))
    codes = ordered_scan(first, [], ["_first", column], number="_code").select(column, (F.col("_code") - 1).alias(out))
    return sized_join(df, codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def drop_rare_classes(df: DataFrame, label: str, min_count: int = 2) -> DataFrame:
    common = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).select(label)
    return df.join(common, label, "left_semi")


def dataset_candidates(catalogue: DataFrame, bounds: dict[str, tuple[float, float]], n: int, multiplier: int, seed: str) -> DataFrame:
    """Datasets whose qualities lie within bounds (unknown or zero passes), in seeded
    hash order, first n * multiplier (the limit is the feature)."""
    q = F.map_from_entries("qualities")
    rows = catalogue.select("dataset_id", q.alias("q"))
    for name, (lo, hi) in bounds.items():
        v = F.coalesce(F.col("q")[name], F.lit(0.0))
        rows = rows.filter((v <= 0) | v.between(lo, hi))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("dataset_id").cast("string")))
    return rows.dropDuplicates(["dataset_id"]).select("dataset_id", digest.alias("_h")).orderBy("_h", "dataset_id").limit(n * multiplier).drop("_h")
