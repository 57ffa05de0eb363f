"""Document pipeline: five stages, each written as Parquet and read again as the next one's documents.

All but the last stage return the columns of ``documents``. Filtering stages keep whole documents; line
dedup shortens texts and n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.decontaminate import decontaminate
from veritab.llm.language import identify
from veritab.llm.lines import dedup_lines
from veritab.llm.links import stored
from veritab.llm.minhash import near_duplicates
from veritab.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents whose id is among the verdicts; a document without id is kept, since no verdict names it."""
    named = docs.filter(F.col("doc_id").isNotNull()).join(verdicts.select("doc_id").distinct(), "doc_id", "left_semi")
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no learned language accepts go: without letters, or beyond the calibrated limit."""
    return _only(docs, identify(docs).filter(~F.col("rejected")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, up to one word, go; a document that loses all its lines goes too."""
    out = dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.coalesce(F.trim("text") != "", F.lit(True)))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id."""
    return _only(docs, near_duplicates(docs, shingle=5, percent=80).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate(docs, items, carry=["lang", "source", "n_chars"])
    return found.filter(F.size("spans") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_dedup),
          ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
