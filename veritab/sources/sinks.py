"""Append-only stores, digests and purpose-partitioned batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veritab.functions.ordered import ordered_scan

# Fixed field names of the experience store.
EXPERIENCE_SCHEMA = (
    "dataset_id string, meta_features map<string,double>, trajectory_features map<string,double>, "
    "evaluations map<string,struct<cv_score_mean:double,stability_jaccard:double,runtime_sec:double>>, "
    "selected_method string, selection_reason string, created_at_utc string"
)


def append_experience(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; existing files are never rewritten."""
    stamped = records.withColumn("created_at_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_experience(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIENCE_SCHEMA).json(path)


def row_digest(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)


def table_digest(rows: DataFrame, digest: str, keys: list[str] | None = None, prefix: int = 2) -> DataFrame:
    """Order-free digest of a set of row digests.

    Digests are sorted and hashed inside hash buckets by count of equal rows,
    then the bucket hashes are hashed; no task sees more than one bucket.
    """
    keys = keys or []
    distinct = rows.groupBy(*keys, digest).agg(F.count(F.lit(1)).alias("_n"))
    per_bucket = distinct.groupBy(*keys, F.substring(digest, 1, prefix).alias("_b")).agg(
        F.sum("_n").alias("_n"),
        F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", digest, F.col("_n").cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("_x"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_n", "_x"))), lambda s: F.concat_ws(
        ":", s["_b"], s["_n"].cast("string"), s["_x"].cast("string")))
    return per_bucket.groupBy(*keys).agg(
        F.sha2(F.array_join(lines, "|"), 256).alias("digest"), F.sum("_n").alias("record_count"))


def write_artifact(df: DataFrame, run_dir: str, name: str) -> DataFrame:
    """Write a JSON artifact and return its manifest row (name, path, digest, rows)."""
    path = f"{run_dir}/{name}"
    df.write.mode("errorifexists").json(path)
    digests = df.select(row_digest(*sorted(df.columns)).alias("d"))
    return table_digest(digests, "d").select(
        F.lit(name).alias("name"), F.lit(path).alias("path"), "digest", "record_count")


def number_events(events: DataFrame, order: list[str]) -> DataFrame:
    """Journal sequence number from 1 in the given order."""
    return ordered_scan(events, [], order, number="seq")


def skip_ingested(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the store yet."""
    return batch.join(store.select(key).distinct(), key, "left_anti")


def append_confirmation(batch: DataFrame, path: str, purpose: str) -> None:
    """Append one sealed batch under a fresh purpose; refuses an empty or reused one."""
    spark = batch.sparkSession
    try:
        used = not spark.read.parquet(path).filter(F.col("purpose") == purpose).isEmpty()
    except AnalysisException:
        used = False
    if used:
        raise ValueError(f"purpose {purpose} already registered")
    if batch.isEmpty():
        raise ValueError("empty confirmation batch")
    batch.withColumn("purpose", F.lit(purpose)).write.mode("append").partitionBy("purpose").parquet(path)
