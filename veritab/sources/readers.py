"""Scans with explicit reject tables: CSV observations, JSON lines, JSON maps, text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import is_finite

# Fixed values of the observation format.
DEFAULT_EVENT_TIME = "2026-01-01T00:00:00+00:00"
FIRST_DATA_ROW = 2
TOO_LONG = "file exceeds the size limit"
NOT_UTF8 = "not readable UTF-8"


def _blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def scan_observations_csv(
    spark: SparkSession, path: str, features: Sequence[str], target: str, group: str, environments: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects). Declared values must be finite doubles, groups not blank,
    record ids unique; a missing id becomes ``row-N`` by position in its file."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    declared = [*features, target]
    missing = {*declared, group} - set(raw.columns)
    if missing:
        raise ValueError(f"declared columns not in the file: {sorted(missing)}")
    if "record_id" not in raw.columns:
        raw = _number_rows(raw)
    parsed = raw.select(
        "record_id", F.col(group).alias("grp"),
        (F.coalesce(F.nullif("environment", F.lit("")), F.lit(environments[0])) if "environment" in raw.columns
         else F.lit(environments[0])).alias("environment"),
        F.to_timestamp(F.coalesce(F.nullif("event_time", F.lit("")), F.lit(DEFAULT_EVENT_TIME)) if "event_time" in raw.columns
                       else F.lit(DEFAULT_EVENT_TIME)).alias("event_time"),
        *[F.col(c).try_cast("double").alias(c) for c in declared],
    )
    reason = F.when(_blank(F.col("grp")), "blank_group")
    for c in declared:
        reason = reason.when(F.col(c).isNull(), f"not_a_number:{c}").when(~is_finite(F.col(c)), f"nonfinite:{c}")
    checked = parsed.withColumn("reason", reason)
    copies = checked.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id")
    duplicate = checked.join(copies, "record_id", "left_semi").withColumn(
        "reason", F.coalesce("reason", F.lit("duplicate_record_id")))
    unique = checked.join(copies, "record_id", "left_anti")
    good = unique.filter(F.col("reason").isNull()).drop("reason")
    rejects = unique.filter(F.col("reason").isNotNull()).unionByName(duplicate)
    return good, rejects


def _number_rows(raw: DataFrame) -> DataFrame:
    """``row-N`` per file from the position inside each input block plus block totals."""
    cols = raw.columns
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_file", "_block").orderBy("_seq")
    numbered = rows.join(offsets, ["_file", "_block"]).withColumn(
        "record_id", F.concat(F.lit("row-"), (F.row_number().over(inside) + F.col("_off") + FIRST_DATA_ROW - 1).cast("string")))
    return numbered.select("record_id", *cols)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): one object per line; blank, non-object and broken lines are set aside."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).withColumn(
        "_row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    text = F.trim("value")
    tagged = lines.withColumn(
        "reason", F.when(text == "", "blank").when(~text.startswith("{"), "not_object")
        .when(F.col("_row._corrupt").isNotNull() | F.col("_row").isNull(), "unparsable"))
    good = tagged.filter(F.col("reason").isNull()).select(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    return good, tagged.filter(F.col("reason").isNotNull()).select("value", "reason")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of strings. The text is split at commas by the
    reader, so even a one-line object is read in parallel."""
    pieces = spark.read.option("lineSep", ",").text(path)
    pair = r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'
    return pieces.filter(F.col("value").rlike(pair)).select(
        F.regexp_extract("value", pair, 1).alias("key"), F.regexp_extract("value", pair, 2).alias("value"))


def read_json_groups(spark: SparkSession, path: str, one_object_per_file: bool = False) -> DataFrame:
    """(key, value) of JSON objects of string lists, one per line or, if asked, one per file."""
    parsed = spark.read.text(path, wholetext=one_object_per_file).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "values")).select("key", F.explode("values").alias("value"))


def scan_text_files(spark: SparkSession, path: str, suffixes: Sequence[str] | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, omissions) of a folder tree. With ``max_bytes`` longer files are dropped by the length
    filter that the file source evaluates before it reads any content; by default every file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if suffixes:
        files = files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    texts, bad = ingest_texts((files if max_bytes is None else files.filter(F.col("length") <= max_bytes)).select("path", "content"))
    if max_bytes is None:
        return texts, bad
    return texts, files.filter(F.col("length") > max_bytes).select("path", F.lit(TOO_LONG).alias("reason")).unionByName(bad)


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes without a leading byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def ingest_texts(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, sha256, n_chars, content) and (path, reason) from (path, content binary)."""
    too_long = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    reason = F.when(too_long, TOO_LONG).when(
        ~F.is_valid_utf8(F.col("content").cast("string")), NOT_UTF8)
    tagged = files.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).select("path", decoded(F.col("content")).alias("content"))
    return (
        good.select("path", F.sha2(F.col("content"), 256).alias("sha256"), F.length("content").alias("n_chars"), "content"),
        tagged.filter(F.col("reason").isNotNull()).select("path", "reason"),
    )
