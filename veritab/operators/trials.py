"""Trajectories, training trials and split candidates."""

from __future__ import annotations

from itertools import count, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.ordered import exact_quantiles, ordered_scan
from veritab.session import cut_lineage, sized_join

TINY = 1e-12


def complete_labels(df: DataFrame) -> DataFrame:
    """Missing labels become 0; the length is always the real array length."""
    return df.withColumn("retrieval_time", F.coalesce("retrieval_time", F.lit(0.0))).withColumn(
        "decision_effect", F.coalesce("decision_effect", F.lit(0.0))).withColumn(
        "trajectory_length", F.coalesce(F.size("tendency"), F.size("sequence"), F.lit(0)).cast("long"))


def trajectory_features(df: DataFrame, series: list[str], order: list[str], value: str, normalize: bool = False) -> DataFrame:
    """Length, ends, minimum, area, early and late slope, spread of differences per series."""
    rows = df
    if normalize:
        stats = df.groupBy(*series).agg(F.avg(value).alias("_mu"), (F.stddev_pop(value) + TINY).alias("_sd"), F.count(F.lit(1)).alias("_k"))
        rows = df.join(stats, series).withColumn(value, F.when(F.col("_k") > 1, (F.col(value) - F.col("_mu")) / F.col("_sd")).otherwise(F.col(value)))
    scanned = ordered_scan(rows.select(*series, *order, value), series, order, number="_pos", prevs={"_prev": value})
    sizes = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("length"))
    j = scanned.join(sizes, series)
    m = F.greatest(F.lit(2), F.floor(F.col("length") * 0.2))
    pos, v = F.col("_pos"), F.col(value)
    early = F.when(pos <= m, v)
    late = F.when(pos > F.col("length") - m, v)
    agg = j.groupBy(*series).agg(
        F.max("length").alias("length"), F.min_by(value, "_pos").alias("start"), F.max_by(value, "_pos").alias("end"),
        F.min(value).alias("min_value"), (F.min_by("_pos", F.struct(v.alias("v"), pos.alias("p"))) - 1).alias("min_index"),
        F.sum(v).alias("_sum"), F.regr_slope(early, pos.cast("double")).alias("_early"),
        F.regr_slope(late, pos.cast("double")).alias("_late"), F.stddev_pop(v - F.col("_prev")).alias("_dstd"))
    single = F.col("length") == 1
    return agg.select(
        *series, "length", "start", "end", "min_value", "min_index",
        F.when(single, F.col("start")).otherwise(F.col("_sum") - (F.col("start") + F.col("end")) / 2).alias("auc"),
        F.when(single, 0.0).otherwise(F.col("_early")).alias("early_slope"),
        F.when(single, 0.0).otherwise(F.col("_late")).alias("late_slope"),
        F.when(single, 0.0).otherwise(F.col("_dstd")).alias("diff_std"))


def quality_tables(df: DataFrame, category: str, effect: str, length: str, time: str) -> DataFrame:
    """The three summary tables (category, quality band, length band) from one scan."""
    band = F.when(F.col(effect) >= 0.70, "high").when(F.col(effect) >= 0.50, "medium").otherwise("low")
    lband = F.when(F.col(length) <= 5, "2-5").when(F.col(length) <= 15, "6-15").when(F.col(length) <= 25, "16-25").otherwise("26+")
    rows = df.select(F.col(category).alias("category"), band.alias("band"), lband.alias("length_band"),
                     F.col(effect).alias("e"), F.col(length).alias("l"), F.col(time).alias("t"))
    keys = [F.col("category"), F.col("band"), F.col("length_band")]
    return rows.groupingSets([[keys[0]], [keys[1]], [keys[2]]], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_effect"), F.min("e").alias("min_effect"), F.max("e").alias("max_effect"),
        F.avg("l").alias("mean_length"), F.min("l").alias("min_length"), F.max("l").alias("max_length"), F.avg("t").alias("mean_time")
    ).select(F.when(F.col("category").isNotNull(), "category").when(F.col("band").isNotNull(), "band").otherwise("length_band").alias("grouping"),
             F.coalesce("category", "band", "length_band").alias("item"), "n", "mean_effect", "min_effect", "max_effect",
             "mean_length", "min_length", "max_length", "mean_time")


def summary_features(df: DataFrame, series: list[str], values: list[str]) -> DataFrame:
    """mean, population std, min, max and exact median of each value per series."""
    agg = df.groupBy(*series).agg(F.count(F.lit(1)).alias("length"), *[
        f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"),
                                    F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))])
    for v in values:
        agg = agg.join(exact_quantiles(df, series, v, {f"{v}_median": 0.5}), series, "left")
    return agg


def fit_quality_regressor(features: DataFrame, target: str, trees: int = 20, seed: int = 0):
    """Random forest on the summary columns; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    inputs = [c for c, t in features.dtypes if t in ("double", "bigint", "int") and c != target]
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_x"),
                            RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, seed=seed)]).fit(features)


def stable_code(text: Column, modulus: int = 1000) -> Column:
    """Process-independent integer code of a label."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % modulus


def decision_objective(effect: Column, length: Column, time: Column, w_effect: float = 1.0, w_length: float = 0.05, w_time: float = 0.10) -> Column:
    return w_effect * effect - w_length * length - w_time * F.log1p(F.greatest(time, F.lit(0.0)))


def mixed_matrix(df: DataFrame, traj: list[str], order: list[str], method: str, normalize: bool = False) -> DataFrame:
    """Rows of the mixed matrix (t, s, sel and derived columns) per trajectory.

    Statistics are aggregated per trajectory and joined back, and the label
    codes are ranks of the trajectory's distinct labels.
    """
    labels = df.select(*traj, "selection").distinct()
    codes = ordered_scan(labels, traj, ["selection"], number="_c").withColumn("sel", (F.col("_c") - 1).cast("double")).drop("_c")
    rows = df.join(codes, [*traj, "selection"]).select(
        *traj, *order, F.col("tendency").cast("double").alias("t"), F.col("sequence").cast("double").alias("s"), "sel")
    names = ["t", "s", "sel"]
    if normalize:
        span = rows.groupBy(*traj).agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in names])
        rows = rows.join(span, traj).select(*traj, *order, *[
            ((F.col(c) - F.col(f"_{c}.lo")) / (F.col(f"_{c}.hi") - F.col(f"_{c}.lo") + 1e-8)).alias(c) for c in names])
    out = [F.col(c) for c in names]
    if method in ("with_interaction", "full"):
        out += [(F.col("t") * F.col("s")).alias("t_s"), (F.col("t") * F.col("sel")).alias("t_sel"), (F.col("s") * F.col("sel")).alias("s_sel")]
    if method in ("with_statistics", "full"):
        stats = rows.groupBy(*traj).agg(*[F.struct(F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd")).alias(f"_{c}") for c in names])
        rows = rows.join(stats, traj)
        out += [(F.col(c) - F.col(f"_{c}.mu")).alias(f"{c}_centred") for c in names]
        for c in names:
            sd = F.col(f"_{c}.sd")
            scale = sd + 1e-8 if method == "with_statistics" else F.when(sd == 0, 1.0).otherwise(sd)
            out.append(((F.col(c) - F.col(f"_{c}.mu")) / scale).alias(f"{c}_std"))
    elif method not in ("concatenate", "with_interaction"):
        raise ValueError(f"unknown method {method!r}")
    return rows.select(*traj, *order, *out)


# --- successive halving ------------------------------------------------------


def resource_levels(min_resource: int, max_resource: int, eta: int) -> list[int]:
    """Powers of eta times the least resource (1 at least), below the greatest one, and that one."""
    first, step = max(1, min_resource), max(2, eta)
    top = max(first, max_resource)
    return [*takewhile(lambda r: r < top, (first * step**i for i in count())), top]


def promote(trials: DataFrame, eta: int) -> DataFrame:
    """Adds ``position`` (by score, best first) and ``promoted`` = best ceil(n/eta) of each rung."""
    ranked = ordered_scan(trials, ["rung"], [F.desc("score"), F.asc("config")], number="position")
    sizes = trials.groupBy("rung").agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") / eta))
    return ranked.join(sizes, "rung").withColumn("k", k.cast("long")).withColumn("promoted", F.col("position") <= F.col("k")).drop("_n")


def halving_run(trials: DataFrame, eta: int, rungs: int) -> DataFrame:
    """Replays successive halving on a table of trials: only promoted configs enter the next rung."""
    out, alive = None, None
    for rung in range(rungs):
        current = trials.filter(F.col("rung") == rung)
        if alive is not None:
            current = current.join(alive, "config", "left_semi")
        step = cut_lineage(promote(current, eta))
        alive = step.filter("promoted").select("config")
        out = step if out is None else out.unionByName(step)
    return out


def guided_promotion(
    trials: DataFrame, eta: int, mode: str = "rerank", shortlist: int | None = None, alpha: float = 0.6,
    max_swaps: int | None = None, margin: float = 0.0, min_proba: float = 0.0,
) -> DataFrame:
    """Baseline and guided promotion per rung (columns baseline, guided).

    Extras sorted best first meet promoted rows sorted worst first; the gain of
    a swap falls with the pair number, so accepted swaps are a prefix and each
    pair can be judged alone after a join on the pair number.
    """
    ranked = cut_lineage(promote(trials, eta))
    pool = ranked.filter(F.col("position") <= shortlist) if mode == "rerank" and shortlist else ranked
    span = pool.groupBy("rung").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    close = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    norm = F.when(close, 0.0).otherwise((F.col("score") - lo) / (hi - lo + TINY))
    mixed = cut_lineage(pool.join(span, "rung").withColumn("mix", alpha * F.col("proba") + (1 - alpha) * norm).drop("_lo", "_hi"))
    inside = ordered_scan(mixed.filter("promoted"), ["rung"], [F.asc("mix"), F.asc("position")], number="pair")
    extras = mixed.filter(~F.col("promoted"))
    if min_proba > 0:
        extras = extras.filter(F.col("proba") >= min_proba)
    outside = ordered_scan(extras, ["rung"], [F.desc("mix"), F.asc("position")], number="pair")
    limit = F.col("k") if max_swaps is None else F.lit(max_swaps)
    pairs = inside.select("rung", "pair", "k", F.col("config").alias("old"), F.col("mix").alias("old_mix")).join(
        outside.select("rung", "pair", F.col("config").alias("new"), F.col("mix").alias("new_mix")), ["rung", "pair"])
    swaps = cut_lineage(pairs.filter((F.col("new_mix") > F.col("old_mix") + margin) & (F.col("pair") <= limit)))
    removed = swaps.select("rung", F.col("old").alias("config")).withColumn("_out", F.lit(True))
    added = swaps.select("rung", F.col("new").alias("config")).withColumn("_in", F.lit(True))
    j = ranked.join(removed, ["rung", "config"], "left").join(added, ["rung", "config"], "left")
    in_pool = F.col("position") <= shortlist if mode == "rerank" and shortlist else F.lit(True)
    guided = (F.col("promoted") & in_pool & F.col("_out").isNull()) | F.col("_in").isNotNull()
    return j.withColumn("baseline", F.col("promoted")).withColumn("guided", guided).drop("_out", "_in", "promoted")


def disagreement_rate(promotions: DataFrame) -> DataFrame:
    """Share of rungs whose guided set differs from the baseline set."""
    per = promotions.groupBy("rung").agg(F.bool_or(F.col("baseline") != F.col("guided")).alias("differs"))
    return per.agg(F.count(F.lit(1)).alias("rungs"), F.avg(F.when(F.col("differs"), 1.0).otherwise(0.0)).alias("disagree_rate"))


def promotion_labels(trials: DataFrame, positive_frac: float = 0.35, kind: str = "uplift") -> DataFrame:
    """Rows of rung r that also ran at r+1, labelled 1 in the top fraction of the signal."""
    later = trials.select("config", (F.col("rung") - 1).alias("rung"), F.col("score").alias("next_score"))
    pairs = trials.join(later, ["config", "rung"]).withColumn("uplift", F.col("next_score") - F.col("score"))
    signal = "next_score" if kind == "next_score" else "uplift"
    cut = exact_quantiles(pairs, ["rung"], signal, {"_q": 1.0 - positive_frac})
    return pairs.join(cut, "rung").withColumn("label", F.when(F.col(signal) >= F.col("_q") - 1e-12, 1).otherwise(0)).withColumnRenamed("_q", "cutoff")


# --- split candidates ----------------------------------------------------------


def split_counts(df: DataFrame, node: str, features: list[str], label: str, part: str, max_thresholds: int = 16) -> tuple[DataFrame, DataFrame]:
    """(thresholds, counts). Thresholds are mid-points of the train quantiles 0.05..0.95 per
    (node, feature); counts are per (node, feature, threshold, side, class, part) with side
    totals from running sums over at most ``max_thresholds`` bins."""
    long = df.select(node, label, part, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    train = long.filter((F.col(part) == "train") & F.col("x").isNotNull() & ~F.isnan("x"))
    step = 0.9 / (max_thresholds - 1)
    qs = {f"q{i}": 0.05 + step * i for i in range(max_thresholds)}
    cuts = exact_quantiles(train, [node, "feature"], "x", qs)
    uniq = F.array_sort(F.array_distinct(F.array(*[F.col(q) for q in qs])))
    mids = F.when(F.size(uniq) == 1, uniq).otherwise(F.array_distinct(F.zip_with(
        F.slice(uniq, 1, F.size(uniq) - 1), F.slice(uniq, 2, F.size(uniq) - 1), lambda a, b: (a + b) / 2)))
    thresholds = cut_lineage(cuts.select(node, "feature", mids.alias("thr")))
    # Few keys hold all rows: where the thresholds can be sent, the rows stay where they are.
    bins = sized_join(long.filter(F.col("x").isNotNull()), thresholds, [node, "feature"]).groupBy(
        node, "feature", part, label, F.size(F.filter("thr", lambda c: c < F.col("x"))).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # The bin table has at most (max_thresholds + 1) rows per node, feature, class and part.
    grid = thresholds.select(node, "feature", F.posexplode("thr").alias("i", "threshold"))
    wide = bins.join(grid, [node, "feature"]).groupBy(node, "feature", "i", "threshold", part, label).agg(
        F.sum(F.when(F.col("b") <= F.col("i"), F.col("n")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("b") > F.col("i"), F.col("n")).otherwise(0)).alias("right"))
    return thresholds, wide


def _spread_sum(kind: str, count: str) -> Column:
    """Aggregate that, with the total, gives the impurity of a class distribution."""
    c = F.col(count).cast("double")
    return F.sum(c * c) if kind == "gini" else F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0))


def _impurity(kind: str, spread: Column, total: Column) -> Column:
    value = 1 - spread / (total * total) if kind == "gini" else F.log2(total) - spread / total
    return F.when(total > 0, value).otherwise(0.0)


def split_gains(counts: DataFrame, node: str, part: str, criterion: str = "gini", min_samples_leaf: int = 1) -> DataFrame:
    """Gain of every (node, feature, threshold) on the train part."""
    train = counts.filter(F.col(part) == "train").withColumn("both", F.col("left") + F.col("right")).groupBy(node, "feature", "i", "threshold").agg(
        F.sum("left").cast("double").alias("n_left"), F.sum("right").cast("double").alias("n_right"),
        *[_spread_sum(criterion, c).alias(f"_{c}") for c in ("left", "right", "both")])
    nl, nr = F.col("n_left"), F.col("n_right")
    n = nl + nr
    gain = _impurity(criterion, F.col("_both"), n) - nl / n * _impurity(criterion, F.col("_left"), nl) - nr / n * _impurity(criterion, F.col("_right"), nr)
    return train.filter((nl >= min_samples_leaf) & (nr >= min_samples_leaf)).select(
        node, "feature", "threshold", gain.alias("gain"), (nl / n).alias("left_ratio"))


def validation_gains(counts: DataFrame, node: str, label: str, part: str) -> DataFrame:
    """Accuracy of the child majorities on validation minus that of the parent majority."""
    key = [node, "feature", "i", "threshold"]
    major = lambda c: F.max_by(label, F.struct(F.col(c), (-F.col("_ord")).alias("o")))
    # Class order decides majority ties: the smallest class wins.
    classes = ordered_scan(counts.select(label).distinct(), [], [label], number="_ord")
    c = counts.join(classes, label).withColumn("both", F.col("left") + F.col("right"))
    train = c.filter(F.col(part) == "train").groupBy(*key).agg(
        major("left").alias("_ml"), major("right").alias("_mr"), major("both").alias("_mp"),
        F.sum("left").alias("_nl"), F.sum("right").alias("_nr"))
    val = c.filter(F.col(part) == "val").join(train, key)
    hit = lambda side, m: F.sum(F.when(F.col(label) == F.col(m), F.col(side)).otherwise(0))
    agg = val.groupBy(*key).agg(
        F.sum("both").alias("n_val"), ((hit("left", "_ml") + hit("right", "_mr")) / F.sum("both")).alias("after"),
        (hit("both", "_mp") / F.sum("both")).alias("base"), F.first("_nl").alias("_nl"), F.first("_nr").alias("_nr"))
    empty = (F.col("_nl") == 0) | (F.col("_nr") == 0)
    return agg.select(node, "feature", "threshold", "n_val", F.when(empty, float("-inf")).otherwise(F.col("after") - F.col("base")).alias("val_gain"))


def tree_paths(samples: DataFrame, key: str, features: list[str], nodes: DataFrame, max_depth: int) -> DataFrame:
    """(key, depth, node, tendency, selection) of every sample's walk from the root.

    Nodes: id, feature, threshold, left, right, impurity, n. One equi-join on the
    node id per level; the walk is carried as a short array.
    """
    root_n = nodes.filter("id = 0").select(F.greatest(F.col("n"), F.lit(1)).cast("double"))
    table = cut_lineage(nodes.withColumn("_tend", F.col("impurity") * F.col("n") / root_n.scalar()))
    look = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    walk = samples.select(F.col(key), look.alias("_v"), F.lit(0).alias("_at"), F.array().cast(
        "array<struct<node:int,tendency:double,selection:string>>").alias("_path"))
    for _ in range(max_depth + 1):
        n = table.select(F.col("id").alias("_at"), "feature", "threshold", "left", "right", "_tend")
        j = walk.join(n, "_at", "left")
        leaf = F.col("left") == F.col("right")
        go_left = F.col("_v")[F.col("feature")] <= F.col("threshold")
        choice = F.when(leaf, "leaf").when(go_left, "left").otherwise("right")
        step = F.struct(F.col("_at").cast("int").alias("node"), F.col("_tend").alias("tendency"), choice.alias("selection"))
        walk = j.select(
            key, "_v", F.when(F.col("_tend").isNotNull() & ~leaf, F.when(go_left, F.col("left")).otherwise(F.col("right"))).alias("_at"),
            F.when(F.col("_tend").isNotNull(), F.concat("_path", F.array(step))).otherwise(F.col("_path")).alias("_path"))
    return walk.select(key, F.posexplode("_path").alias("depth", "s")).select(key, "depth", "s.*")


def signature_difference(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Positions that differ or exist on one side only, per key."""
    left = a.select(*keys, "position", F.struct(*fields).alias("_a"))
    right = b.select(*keys, "position", F.struct(*fields).alias("_b"))
    j = left.join(right, [*keys, "position"], "full_outer")
    return j.groupBy(*keys).agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differences"), F.count(F.lit(1)).alias("positions"))


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation over seeds per configuration."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def prediction_agreement(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per seed, overall) accuracy of two prediction columns and their agreement."""
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = df.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), hit(F.col("pred_a") == F.col("y")).alias("acc_a"), hit(F.col("pred_b") == F.col("y")).alias("acc_b"),
        hit(F.col("pred_a") == F.col("pred_b")).alias("agreement"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("acc_a", "acc_b", "agreement")])
    overall = per.select(F.inline(cells)).groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"))
    return per, overall


