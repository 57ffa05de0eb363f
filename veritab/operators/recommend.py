"""Which relevance method to use on a dataset: a selector learnt from other datasets, or the best one measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.selector import fit_selector, wide_features
from veritab.session import cut_lineage, sized_join

# Methods in the order that decides ties, and the datasets a history needs.
METHODS = ("pearson_abs", "spearman_abs", "mutual_info")
LEAST_DATASETS = 3


def usable_history(history: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Records of exploration evidence whose chosen method is known."""
    return history.filter((F.col("evidence_purpose") == "E") & F.col("selected_method").isin(*methods) & F.col("dataset_id").isNotNull())


def history_counts(history: DataFrame, targets: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Targets (dataset_id, source_hash) with ``historical_datasets``: other datasets that have a usable record of another source.

    All targets at once: a dataset is lost to a target only if it is the target or all its records share the target's source, so
    datasets are counted once and the lost ones are taken off. A null source equals no other.
    """
    own = F.count_distinct(F.coalesce("source_hash", F.concat(F.lit("no source "), F.col("dataset_id"))))
    per = cut_lineage(usable_history(history, methods).groupBy("dataset_id").agg(own.alias("_sources"), F.min("source_hash").alias("_only")))
    alone = per.filter("_sources = 1 and _only is not null").groupBy(F.col("_only").alias("source_hash")).agg(F.count(F.lit(1)).alias("_same"))
    mine = per.select("dataset_id", F.lit(1).alias("_own"), F.when(F.col("_sources") == 1, F.col("_only")).alias("_mine"))
    total = per.agg(F.count(F.lit(1)).alias("n"))
    j = sized_join(sized_join(targets, mine, "dataset_id", "left"), alone, "source_hash", "left").withColumn("_n", total.scalar())
    # The target itself is among those of its source if its records have no other.
    twice = F.coalesce((F.col("_mine") == F.col("source_hash")).cast("int"), F.lit(0))
    lost = F.coalesce("_own", F.lit(0)) + F.coalesce("_same", F.lit(0)) - twice
    return j.select(*targets.columns, (F.col("_n") - lost).alias("historical_datasets"))


def measured_best(methods: DataFrame, keys: list[str], order: tuple[str, ...] = METHODS) -> DataFrame:
    """(keys, measured_best_method, objective) of rows (keys, method, objective): the greatest; of equal ones the first in ``order``.

    Rows without a finite objective are none.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    good = methods.filter(F.col("objective").isNotNull() & ~F.isnan("objective") & (F.abs("objective") != float("inf")) & (place > 0))
    best = F.max_by(F.struct("method", "objective"), F.struct(F.col("objective"), (-place).alias("p")))
    return good.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.method").alias("measured_best_method"), F.col("b.objective").alias("objective"))


def recommend(measured: DataFrame, features: DataFrame, history: DataFrame, history_features: DataFrame, dataset_id: str, source_hash: str, *,
              trees: int = 64, seed: int = 0, top_n: int = 3) -> DataFrame:
    """One row: (dataset_id, selected_method, measured_best_method, mode, historical_datasets).

    ``measured`` (method, objective) comes from grouped folds of the dataset itself, ``features`` (feature, value, text) describe it.
    With at least three other datasets in the history a forest learnt from them chooses (``historical_meta_selector``); else, or if it names
    no known method, the measured best does (``cold_start_grouped_cv``). ``history`` has rows (dataset_id, source_hash, evidence_purpose, selected_method).
    """
    spark = measured.sparkSession
    other = cut_lineage(usable_history(history).filter((F.col("dataset_id") != dataset_id) & F.coalesce(F.col("source_hash") != source_hash, F.lit(True))))
    # One label per dataset: the method chosen most often, ties by name.
    votes = other.groupBy("dataset_id", "selected_method").agg(F.count(F.lit(1)).alias("n"))
    labels = cut_lineage(votes.groupBy("dataset_id").agg(F.min_by("selected_method", F.struct((-F.col("n")).alias("a"), "selected_method")).alias("label")))
    count, best = labels.count(), measured_best(measured, []).first()
    chosen = None
    if count >= LEAST_DATASETS:
        known = history_features.join(labels.select("dataset_id"), "dataset_id", "left_semi").select("dataset_id", "feature", "value", "text")
        both = known.unionByName(features.select(F.lit(dataset_id).alias("dataset_id"), "feature", "value", "text"))
        wide, numbers, texts = wide_features(both)
        wide = cut_lineage(wide)
        ranks = fit_selector(wide.filter(F.col("dataset_id") != dataset_id), labels, numbers, texts, trees, seed).rank(wide.filter(F.col("dataset_id") == dataset_id), top_n)
        first = ranks.filter(F.col("method").isin(*METHODS)).orderBy("position").first()
        chosen = first.method if first else None
    row = (dataset_id, chosen or (best.measured_best_method if best else None), best.measured_best_method if best else None,
           "historical_meta_selector" if chosen else "cold_start_grouped_cv", count)
    return spark.createDataFrame([row], "dataset_id string, selected_method string, measured_best_method string, mode string, historical_datasets long")
