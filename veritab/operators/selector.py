"""Method selector learnt from experience: features of numbers and texts, forests per dataset fold, held-out ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import is_finite
from veritab.operators import relevance as rv
from veritab.session import cut_lineage


def aggregate_features(records: DataFrame, order: str = "record_no") -> DataFrame:
    """(dataset_id, feature, value, text): the mean of a dataset's finite numbers, else its first text in ``order``.

    ``records`` has maps ``meta_features`` and ``trajectory_features`` (numbers) and ``text_features``; trajectory names are prefixed.
    A feature with neither has no row.
    """
    maps = rv.flatten_features(F.col("meta_features"), F.col("trajectory_features"))
    numbers = records.select("dataset_id", F.explode(maps).alias("feature", "x")).filter(is_finite(F.col("x"))).groupBy("dataset_id", "feature").agg(F.avg("x").alias("value"))
    said = records.select("dataset_id", F.col(order).alias("_o"), F.explode("text_features").alias("feature", "t")).filter("t is not null")
    texts = said.groupBy("dataset_id", "feature").agg(F.min_by("t", F.struct("_o", "t")).alias("text"))
    both = numbers.join(texts, ["dataset_id", "feature"], "full")
    return both.select("dataset_id", "feature", "value", F.when(F.col("value").isNull(), F.col("text")).alias("text"))


def dataset_folds(datasets: DataFrame, folds: int) -> DataFrame:
    """(dataset_id, fold): whole datasets dealt over the folds, all their records together."""
    return rv.group_folds(datasets.select("dataset_id").distinct(), "dataset_id", folds)


def prior_ranks(labels: DataFrame, folds: DataFrame, top_n: int) -> DataFrame:
    """(dataset_id, fold, position, method, probability) of a selector that knows only how often a method was best elsewhere.

    Ties go to the first name.
    """
    known = cut_lineage(labels.select("dataset_id", "label").join(folds, "dataset_id"))
    own = known.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    # Methods and folds are few: one row per (fold, method).
    whole = own.groupBy("label").agg(F.sum("n").alias("all")).withColumn("fold", F.explode(F.array(*[F.lit(r.fold) for r in known.select("fold").distinct().collect()] or [F.lit(None).cast("int")])))
    train = whole.join(own, ["fold", "label"], "left").withColumn("k", F.col("all") - F.coalesce("n", F.lit(0))).filter("k > 0")
    ranked = train.groupBy("fold").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("a"), F.col("label").alias("method")))), 1, top_n).alias("r"), F.sum("k").alias("s"))
    rows = known.select("dataset_id", "fold").join(ranked, "fold").select("dataset_id", "fold", "s", F.posexplode("r").alias("i", "m"))
    return rows.select("dataset_id", "fold", (F.col("i") + 1).cast("long").alias("position"), F.col("m.method").alias("method"), (-F.col("m.a") / F.col("s")).alias("probability"))


class Selector:
    """Fitted forest with what fills and encodes its features."""

    def __init__(self, numbers: list[str], texts: dict[str, str], stages, classes: list[str]):
        self.numbers, self.texts, self.stages, self.classes = numbers, texts, stages, classes

    def rank(self, wide: DataFrame, top_n: int) -> DataFrame:
        """(dataset_id, position, method, probability): the best ``top_n`` per dataset, ties by name."""
        from pyspark.ml.functions import vector_to_array
        if self.stages is None:
            p = wide.select("dataset_id", F.array(F.struct(F.lit(-1.0).alias("np"), F.lit(self.classes[0]).alias("method"))).alias("r"))
        else:
            made = self.stages.transform(_filled(wide, self.texts))
            pairs = F.arrays_zip(F.array(*[F.lit(c) for c in self.classes]).alias("m"), vector_to_array("probability").alias("p"))
            p = made.select("dataset_id", F.array_sort(F.transform(pairs, lambda s: F.struct((-s["p"]).alias("np"), s["m"].alias("method")))).alias("r"))
        return p.select("dataset_id", F.posexplode(F.slice("r", 1, top_n)).alias("i", "s")).select(
            "dataset_id", (F.col("i") + 1).cast("long").alias("position"), F.col("s.method").alias("method"), (-F.col("s.np")).alias("probability"))


def _filled(wide: DataFrame, texts: dict[str, str]) -> DataFrame:
    return wide.withColumns({f"t_{n}": F.coalesce(F.col(f"t_{n}"), F.lit(v)) for n, v in texts.items()}) if texts else wide


def wide_features(features: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(one row per dataset, number names, text names): a feature that is a text anywhere is one everywhere."""
    kinds = features.groupBy("feature").agg(F.max(F.col("text").isNotNull()).alias("is_text")).orderBy("feature").collect()
    numbers, texts = [r.feature for r in kinds if not r.is_text], [r.feature for r in kinds if r.is_text]
    said = F.coalesce("text", F.col("value").cast("string"))
    cells = [F.max(F.when(F.col("feature") == n, F.col("value"))).alias(f"n_{n}") for n in numbers] + [F.max(F.when(F.col("feature") == n, said)).alias(f"t_{n}") for n in texts]
    return features.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"), *cells).drop("_n"), numbers, texts


def fit_selector(wide: DataFrame, labels: DataFrame, numbers: list[str], texts: list[str], trees: int = 64, seed: int = 0) -> Selector:
    """Balanced random forest: numbers filled with the median, texts with the most frequent one (ties: the first), then one-hot.

    Features without a value in the training rows are left out; texts not met in training are a place of their own.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
    rows = cut_lineage(wide.join(labels.select("dataset_id", "label"), "dataset_id"))
    shares = rows.groupBy("label").agg(F.count(F.lit(1)).alias("k")).orderBy("label").collect()
    if not shares:
        raise ValueError("no labelled datasets to learn from")
    classes, total = [r.label for r in shares], sum(r.k for r in shares)
    if len(classes) == 1:
        return Selector([], {}, None, classes)
    held = rows.agg(F.count(F.lit(1)), *[F.count(f"n_{n}").alias(f"n_{n}") for n in numbers], *[F.mode(f"t_{n}", True).alias(f"t_{n}") for n in texts]).first()
    numbers = [n for n in numbers if held[f"n_{n}"]]
    fills = {n: held[f"t_{n}"] for n in texts if held[f"t_{n}"] is not None}
    weight = F.create_map(*[F.lit(x) for r in shares for x in (r.label, total / (len(classes) * r.k))])
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    train = _filled(rows, fills).withColumns({"_weight": weight[F.col("label")], "_label": code[F.col("label")]})
    stages = []
    if numbers:
        stages.append(Imputer(strategy="median", relativeError=1e-4, inputCols=[f"n_{n}" for n in numbers], outputCols=[f"f_{i}" for i in range(len(numbers))]))
    if fills:
        stages.append(StringIndexer(inputCols=[f"t_{n}" for n in fills], outputCols=[f"i_{i}" for i in range(len(fills))], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"i_{i}" for i in range(len(fills))], outputCols=[f"h_{i}" for i in range(len(fills))], dropLast=False))
    stages.append(VectorAssembler(inputCols=[f"f_{i}" for i in range(len(numbers))] + [f"h_{i}" for i in range(len(fills))], outputCol="_x"))
    stages.append(RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, seed=seed))
    if len(stages) == 2 and not numbers:
        # Nothing to tell datasets apart by.
        return Selector([], {}, None, [max(shares, key=lambda r: r.k).label])
    # Row order decides about a forest's draws.
    return Selector(numbers, fills, Pipeline(stages=stages).fit(train.repartitionByRange(1, "dataset_id").sortWithinPartitions("dataset_id") if total < 10_000 else train), classes)


def held_out_ranks(features: DataFrame, labels: DataFrame, folds: DataFrame, top_n: int, trees: int = 64, seed: int = 0) -> DataFrame:
    """(dataset_id, fold, position, method, probability): each dataset ranked by a forest that saw none of its fold."""
    wide, numbers, texts = wide_features(features)
    wide = cut_lineage(wide.join(folds, "dataset_id"))
    marked = cut_lineage(labels.select("dataset_id", "label").join(folds, "dataset_id"))
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        model = fit_selector(wide.filter(F.col("fold") != k).drop("fold"), marked.filter(F.col("fold") != k), numbers, texts, trees, seed)
        # Only datasets with a known best method can be judged.
        test = wide.filter(F.col("fold") == k).join(marked.select("dataset_id"), "dataset_id", "left_semi")
        got = model.rank(test, top_n).withColumn("fold", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out.select("dataset_id", "fold", "position", "method", "probability")


def selector_summary(report: DataFrame) -> DataFrame:
    """One row: means over the folds of a ``relevance.selector_report``."""
    return report.agg(F.count(F.lit(1)).alias("folds"), F.sum("datasets").alias("datasets"), *[F.avg(c).alias(c) for c in report.columns if c not in ("fold", "datasets")])
