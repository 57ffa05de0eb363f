"""Classification over folds: logistic fits of all folds at once, exact fold scores, permutation importance.

A fold's model is trained on the rows of the other folds. Newton steps need only sums over rows (loss, gradient, second
derivatives), so one pass per step serves all folds, and what reaches the driver are those sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.ordered import hash_rank, ordered_scan
from veritab.operators import relevance as rv
from veritab.session import cut_lineage

STEPS, TOLERANCE = 40, 1e-10


def stratified_folds(df: DataFrame, label: str, key: Column, folds: int, seed: str, out: str = "fold") -> DataFrame:
    """Rows of each class dealt in turn over the folds, in the order of a seeded hash; null labels are a class too."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    ranked = hash_rank(df.withColumn("_d", digest), [label], "_d", ["_d"], "_rk")
    return ranked.withColumn(out, ((F.col("_rk") - 1) % folds).cast("int")).drop("_d", "_rk")


def class_codes(df: DataFrame, label: str, out: str = "code", max_classes: int = 1000) -> tuple[DataFrame, list]:
    """(rows with the position of their label among the sorted classes, classes); rows without a label go."""
    classes = [x[0] for x in df.select(label).filter(F.col(label).isNotNull()).distinct().limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    classes.sort()
    found = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1 if classes else F.lit(None)
    return df.filter(F.col(label).isNotNull()).withColumn(out, found.cast("int")), classes


@dataclass
class FoldModel:
    """Linear scores of a fold: chosen feature positions, fill values of all features, weights (classes x (chosen + 1), intercept last)."""

    top: list[int]
    means: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = x[:, self.top]
        z = np.where(np.isnan(z), self.means[self.top], z)
        return np.column_stack([z, np.ones(len(z))])


def _sums(model: FoldModel, x: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives of some rows, one after the other."""
    z, w = model.design(x), model.weights
    if len(w) == 1:
        s = z @ w[0]
        p = np.exp(-np.logaddexp(0, -s))
        return np.concatenate([[(np.logaddexp(0, s) - code * s).sum()], z.T @ (p - code), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
    s = z @ w.T
    s -= s.max(axis=1, keepdims=True)
    log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
    p = np.exp(log_p)
    miss = p.copy()
    miss[np.arange(len(code)), code] -= 1
    second = np.einsum("nij,na,nb->iajb", p[:, :, None] * np.eye(len(w)) - p[:, :, None] * p[:, None, :], z, z, optimize=True)
    return np.concatenate([[-log_p[np.arange(len(code)), code].sum()], (miss.T @ z).ravel(), second.ravel()])


def _fold_sums(models: dict[int, FoldModel]):
    """(k, sums) per task and fold: over the task's rows that train fold k."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, code = batch.column("fold").to_numpy(), batch.column("code").to_numpy().astype(np.int64)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(len(fold), -1)
            for k, model in models.items():
                at = np.flatnonzero(fold != k)
                for i in range(0, len(at), 4096):
                    some = at[i:i + 4096]
                    held[k] = held.get(k, 0) + _sums(model, x[some], code[some])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["k", "v"])
    return run


def _penalised(model: FoldModel, v: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """(objective, Newton step) from a fold's sums; the intercept is free, other weights cost half their square."""
    n = model.weights.size
    free = np.ones(model.weights.shape[1])
    free[-1] = 0
    cost = np.tile(free, len(model.weights))
    w = model.weights.ravel()
    loss = c * v[0] + 0.5 * (cost * w * w).sum()
    grad = c * v[1:1 + n] + cost * w
    second = c * v[1 + n:].reshape(n, n) + np.diag(cost)
    # Classes share one free direction (all intercepts together): the least step leaves it alone.
    return loss, np.linalg.lstsq(second, grad, rcond=1e-12)[0].reshape(model.weights.shape)


def logistic_folds(rows: DataFrame, tops: dict[int, list[int]], means: dict[int, np.ndarray], classes: int, c: float = 1.0) -> dict[int, FoldModel]:
    """L2 logistic models by fold from rows (fold, code, x): two classes have one score, more have one each.

    A step that raises a fold's objective is halved. Null features take the training mean.
    """
    rows = rows.select("fold", "code", "x")
    models = {k: FoldModel(top, means[k], np.zeros((1 if classes == 2 else classes, len(top) + 1))) for k, top in tops.items()}
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    open_ = dict(models)
    for _ in range(STEPS):
        if not open_:
            break
        made = rows.mapInArrow(_fold_sums(open_), "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v"))
        sums: dict[int, dict[int, float]] = {}
        for r in made.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
            sums.setdefault(r.k, {})[r.i] = r.v
        for k in list(open_):
            if k not in sums:  # no rows train this fold
                del open_[k]
                continue
            model, v = models[k], np.array([sums[k][i] for i in range(len(sums[k]))])
            loss, step = _penalised(model, v, c)
            if k in best and loss > best[k][0] * (1 + 1e-12) + 1e-12:
                before, at, back = best[k]
                best[k] = (before, at, back / 2)
                model.weights = at - back / 2
                done = np.abs(back).max() < TOLERANCE
                model.weights = at if done else model.weights
            else:
                best[k] = (loss, model.weights, step)
                model.weights = model.weights - step
                done = np.abs(step).max() <= TOLERANCE * (1 + np.abs(model.weights).max())
            if done:
                del open_[k]
    return models


def _square_sums(models: dict[int, FoldModel]):
    """(k, sums) per task and fold: products of the training rows' centred features, one and centred target."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("code").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fold), -1)
            for k, model in models.items():
                at = fold != k
                z = np.column_stack([model.design(x[at]) - np.append(model.means, 0), y[at] - model.weights[0, -1]])
                held[k] = held.get(k, 0) + (z.T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["k", "v"])
    return run


def least_squares_folds(rows: DataFrame, means: dict[int, np.ndarray]) -> dict[int, FoldModel]:
    """Least-squares models by fold on all features, from rows (fold, code, x); null features take the training mean. One pass."""
    centre = rows.agg(F.avg("code")).first()[0]
    models = {k: FoldModel(list(range(len(m))), m, np.append(np.zeros(len(m)), centre)[None, :]) for k, m in means.items()}
    made = rows.select("fold", "code", "x").mapInArrow(_square_sums(models), "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v"))
    sums: dict[int, dict[int, float]] = {}
    for r in made.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.k, {})[r.i] = r.v
    for k, cells in sums.items():
        n = len(means[k]) + 2
        m = np.array([cells[i] for i in range(n * n)]).reshape(n, n)
        w = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-13)[0]
        models[k].weights = np.append(w[:-1], w[-1] + centre - w[:-1] @ means[k])[None, :]
    return {k: m for k, m in models.items() if k in sums}


def _scores(df: DataFrame, models: dict[int, FoldModel], x: str, fold: str, out: str) -> DataFrame:
    """``out``: one linear score per class (one in all for two classes) of a row under its own fold's model, in the JVM."""
    table = df.sparkSession.createDataFrame(
        [(k, m.top, [float(v) for v in m.means], [[float(v) for v in w] for w in m.weights]) for k, m in models.items()],
        "_k int, _top array<int>, _means array<double>, _w array<array<double>>")
    chosen = F.transform("_top", lambda i: F.coalesce(F.get(F.col(x), i), F.get("_means", i)))
    # The models are one row per fold, a chosen number.
    joined = df.join(F.broadcast(table), F.col(fold) == F.col("_k")).withColumn("_z", chosen)
    dot = lambda w: F.aggregate(F.zip_with("_z", F.slice(w, 1, F.size("_z")), lambda a, b: a * b), F.element_at(w, -1), lambda acc, t: acc + t)
    return joined.withColumn(out, F.transform("_w", dot)).drop("_k", "_top", "_means", "_w", "_z")


def roc_auc(scored: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, auc): exact area by rank sums, ties at their mean rank; null where a class is missing.

    Rows are counted by score before anything is ordered.
    """
    per = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(positive).alias("_p"))
    ranked = ordered_scan(per, keys, [score], sums={"_cum": "_n"})
    ranks = F.sum(F.col("_p") * (F.col("_cum") - (F.col("_n") - 1) / 2.0))
    agg = ranked.groupBy(*keys).agg(ranks.alias("_r"), F.sum("_p").alias("_pos"), F.sum(F.col("_n") - F.col("_p")).alias("_neg"))
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    return agg.select(*keys, F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def _class_score(scores: Column) -> Column:
    """Predicted class: the first of the greatest scores; with one score, whether it is above zero."""
    return F.when(F.size(scores) == 1, (scores[0] > 0).cast("int")).otherwise((F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _log_loss(scores: Column, code: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    margin = F.when(code == 1, -scores[0]).otherwise(scores[0])
    one = F.when(margin > 0, margin + F.log1p(F.exp(-margin))).otherwise(F.log1p(F.exp(margin)))
    return F.when(F.size(scores) == 1, one).otherwise(top + F.log(total) - F.get(scores, code))


def fold_scores(scored: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """(keys, score) of rows (keys, code, scores): ``roc_auc``, ``accuracy`` or ``neg_log_loss``."""
    if metric == "roc_auc":
        flat = scored.select(*keys, F.col("scores")[0].alias("_s"), F.col("code").alias("_y"))
        return roc_auc(flat, keys, "_s", "_y").withColumnRenamed("auc", "score")
    value = {"accuracy": (_class_score(F.col("scores")) == F.col("code")).cast("double"), "neg_log_loss": -_log_loss(F.col("scores"), F.col("code"))}[metric]
    return scored.groupBy(*keys).agg(F.avg(value).alias("score"))


def choose_metric(df: DataFrame, label: str) -> str:
    """Score of a target: area under the curve for two classes, accuracy for more, R2 for numbers (task inference as in D7)."""
    numeric = dict(df.dtypes)[label] in ("int", "bigint", "smallint", "tinyint", "float", "double") or dict(df.dtypes)[label].startswith("decimal")
    found = rv.infer_task(df.filter(F.col(label).isNotNull()), label, numeric).first()
    return "r2" if found.task == "regression" else "roc_auc" if found.y_unique == 2 else "accuracy"


def evaluate_selection(df: DataFrame, features: list[str], label: str, key: Column, k: int, folds: int, seed: str, *, metric: str | None = None,
                       scores: DataFrame | None = None, c: float = 1.0) -> DataFrame:
    """(fold, top, score, metric): the k most relevant features on the other folds, and how well a light model with them scores the fold.

    The metric follows the target's task unless given. Classes are dealt over the folds evenly and fitted by logistic regression, numbers are
    dealt by hash and fitted by ridge. ``scores`` (fold, feature, score) replaces \\|r\\| as the relevance. Rows without a label go; null
    features take the training mean. A fold whose training rows hold one class only has no score.
    """
    metric = metric or choose_metric(df, label)
    rows = df.filter(F.col(label).isNotNull())
    if metric == "r2":
        rows = rows.withColumn("fold", rv.hash_fold(seed, key, folds))
        return rv.evaluate_folds(rv.fold_moments(rows, "fold", features, label), features, label, k, scores).withColumn("metric", F.lit(metric))
    coded, classes = class_codes(rows, label)
    if len(classes) < 2:
        return df.sparkSession.createDataFrame([], "fold int, top array<string>, score double, metric string")
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = cut_lineage(stratified_folds(coded, "code", key, folds, seed).select("fold", "code", x.alias("x"), *[F.col(f).cast("double").alias(f) for f in features]))
    moments = cut_lineage(rv.fold_moments(rows.withColumn("_y", F.col("code").cast("double")), "fold", features, "_y"))
    chosen = rv.evaluate_folds(moments, features, "_y", k, scores)
    tops = {r.fold: [features.index(f) for f in r.top] for r in chosen.select("fold", "top").collect()}
    models = logistic_folds(rows, tops, training_means(rows, features), len(classes), c)
    scored = _scores(rows.select("fold", "code", "x"), models, "x", "fold", "scores")
    top_table = df.sparkSession.createDataFrame([(f, [features[i] for i in top]) for f, top in tops.items()], "fold int, top array<string>")
    trained = _classes_trained(rows, len(classes))
    return top_table.join(fold_scores(scored, metric, ["fold"]), "fold").select(
        "fold", "top", F.when(F.col("fold").isin(trained), F.col("score")).alias("score"), F.lit(metric).alias("metric"))


def _classes_trained(rows: DataFrame, classes: int) -> list[int]:
    """Folds whose training rows hold at least two classes."""
    count: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("fold", "code").count().collect():
        count.setdefault(r.fold, {})[r.code] = r["count"]
    total = {c: sum(f.get(c, 0) for f in count.values()) for c in range(classes)}
    return [k for k, own in count.items() if sum(total[c] > own.get(c, 0) for c in total) >= 2]


def training_means(rows: DataFrame, features: list[str], fold: str = "fold") -> dict[int, np.ndarray]:
    """Mean of each feature over the rows outside each fold (0 where all are null): one row of sums per fold is collected."""
    got = rows.groupBy(F.col(fold).alias("fold")).agg(*[F.struct(F.count(f).alias("n"), F.coalesce(F.sum(f), F.lit(0.0)).alias("s")).alias(f) for f in features]).collect()
    n, s = np.array([[r[f].n for f in features] for r in got], float), np.array([[r[f].s for f in features] for r in got], float)
    return {r.fold: (s.sum(0) - s[i]) / np.maximum(n.sum(0) - n[i], 1) for i, r in enumerate(got)}


def permutation_importance(df: DataFrame, features: list[str], label: str, key: str, folds: int, repeats: int, seed: str, *, metric: str | None = None,
                           c: float = 1.0) -> DataFrame:
    """(feature, importance_mean, importance_std): drop of a fold's score when a feature is permuted in it.

    Logistic models and accuracy for classes, least squares and R2 for numbers, as the target's task says unless ``metric``
    (``accuracy``, ``roc_auc``, ``neg_log_loss``, ``r2``) is given. A permutation reads each test row's features off the row that
    holds its place in another hash order; all folds, repeats and features are one job. Means and
    population deviations over repeats are averaged over folds. Nulls take the training mean; no row is left out but those
    without a label. Rows of equal key are told apart by their features.
    """
    guessed = metric or choose_metric(df, label)
    metric = "accuracy" if metric is None and guessed == "roc_auc" else guessed
    rows = df.filter(F.col(label).isNotNull()).withColumn("_key", F.col(key).cast("string"))
    if metric == "r2":
        rows = rows.withColumn("code", F.col(label).cast("double")).withColumn("fold", rv.hash_fold(seed, F.col("_key"), folds))
    else:
        coded, classes = class_codes(rows, label)
        rows = stratified_folds(coded, "code", F.col("_key"), folds, seed)
    rows = rows.select("fold", "_key", "code", *[F.col(f).cast("double").alias(f) for f in features])
    means = training_means(rows, features)
    table = df.sparkSession.createDataFrame([(f, [float(v) for v in m]) for f, m in means.items()], "fold int, _m array<double>")
    filled = lambda named: F.array(*[F.coalesce(F.col(c), F.get("_m", F.lit(i))) for i, c in enumerate(named)])
    rows = cut_lineage(rows.filter(F.col("fold").isin(list(means))))
    train = rows.select("fold", "code", F.array(*features).alias("x"))
    models = least_squares_folds(train, means) if metric == "r2" else logistic_folds(train, {k: list(range(len(features))) for k in means}, means, len(classes), c)
    # Rows of one digest have one key, so their features tell them apart: neither the key nor a digest in hex is sent.
    flat, order = [F.col(f).alias(f"f{i}") for i, f in enumerate(features)], [*[f"f{i}" for i in range(len(features))], "code"]
    digest = lambda text: F.unhex(F.md5(text)).alias("_h")
    base = hash_rank(rows.select("fold", "code", *flat, digest(F.col("_key"))), ["fold"], "_h", order, "rk").select("fold", "rk", *order)
    drawn = rows.select("fold", "code", "_key", *flat, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    drawn = drawn.select("fold", "rep", *order, digest(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), "_key")))
    other = hash_rank(drawn, ["fold", "rep"], "_h", order, "rk").select("fold", "rk", "rep", *[F.col(f"f{i}").alias(f"q{i}") for i in range(len(features))])
    swap = lambda i: F.transform("x", lambda v, at: F.when(at == i, F.get("q", F.lit(i))).otherwise(v))
    # Position -1 stands for the row as it is.
    variants = F.array(F.struct(F.lit(-1).alias("at"), F.col("x").alias("z")), *[F.struct(F.lit(i).alias("at"), swap(i).alias("z")) for i in range(len(features))])
    # One row of means per fold.
    met = base.join(other, ["fold", "rk"]).join(F.broadcast(table), "fold").select(
        "fold", "rep", "code", filled([f"f{i}" for i in range(len(features))]).alias("x"), filled([f"q{i}" for i in range(len(features))]).alias("q"))
    both = met.select("fold", "rep", "code", F.inline(variants))
    scored = _scores(both, models, "z", "fold", "scores")
    keys = ["fold", "rep", "at"]
    if metric == "r2":
        per = scored.groupBy(*keys).agg((1 - F.sum((F.col("code") - F.col("scores")[0]) ** 2) / (F.var_pop("code") * F.count(F.lit(1)))).alias("score"))
    else:
        per = fold_scores(scored, metric, keys)
    # One row per fold, repeat and feature.
    whole = F.max(F.when(F.col("at") == -1, F.col("score"))).over(Window.partitionBy("fold", "rep"))
    drops = per.withColumn("drop", whole - F.col("score")).filter("at >= 0")
    each = drops.groupBy("fold", "at").agg(F.avg("drop").alias("m"), F.stddev_pop("drop").alias("s")).groupBy("at").agg(F.avg("m").alias("importance_mean"), F.avg("s").alias("importance_std"))
    return each.select(F.get(F.array(*[F.lit(f) for f in features]), F.col("at")).alias("feature"), "importance_mean", "importance_std")
