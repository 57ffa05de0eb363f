"""Exact token-length histogram of a corpus, with sums for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import tokens
from veritab.llm.links import stored

# Lengths per slice of the order; running sums go over slices first, then inside each.
SLICE = 1024


def _counts(path: str):
    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for *_, first in tokens.encoded(batch, 0, path):
                for n, c in zip(*(x.tolist() for x in np.unique(np.diff(first), return_counts=True)), strict=True):
                    seen[n] = seen.get(n, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])
    return run


def length_histogram(docs: DataFrame, text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """One row per distinct encoded length, with suffix sums.

    (n_tokens, n_docs, docs_at_least, tokens_at_least, docs_below, tokens_below, truncated_tokens):
    documents of that length; documents and tokens of this length or more; the same for shorter ones; and the
    corpus total if every document were cut to n_tokens. Lengths are counted inside each task, so
    one row per length and task is shuffled. A null text is empty (length 0); repeated
    rows count as often as they occur; an empty table gives no row. Other columns are ignored.
    """
    made = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(path or tokens.default_path()), "n_tokens long, n_docs long")
    # Stored, since sums per slice and rows both read it: the corpus is encoded once.
    hist = stored(made.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("slice", F.floor(F.col("n_tokens") / SLICE)))
    size = F.col("n_tokens") * F.col("n_docs")
    later = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    totals = hist.groupBy("slice").agg(F.sum("n_docs").alias("d"), F.sum(size).alias("t"))
    # One row per slice of lengths: the longest document decides their number, not the corpus.
    totals = totals.select("slice", zero(F.sum("d").over(later)).alias("later_d"), zero(F.sum("t").over(later)).alias("later_t"),
                           F.sum("d").over(Window.partitionBy()).alias("all_d"), F.sum("t").over(Window.partitionBy()).alias("all_t"))
    inside = Window.partitionBy("slice").orderBy(F.desc("n_tokens"))
    docs_up, tokens_up = F.sum("n_docs").over(inside) + F.col("later_d"), F.sum(size).over(inside) + F.col("later_t")
    return hist.join(totals, "slice").select(
        "n_tokens", "n_docs", docs_up.alias("docs_at_least"), tokens_up.alias("tokens_at_least"),
        (F.col("all_d") - docs_up).alias("docs_below"), (F.col("all_t") - tokens_up).alias("tokens_below"),
        (F.col("all_t") - tokens_up + F.col("n_tokens") * docs_up).alias("truncated_tokens"))


def total_at(hist: DataFrame, limit: int | Column) -> DataFrame:
    """One row: the corpus total when each document is cut to ``limit`` tokens (0 for an empty corpus)."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share ``q`` of the documents do not exceed (null if there is none)."""
    upto = F.col("docs_below") + F.col("n_docs")
    return hist.agg(F.min(F.when(upto >= q * (F.col("docs_below") + F.col("docs_at_least")), F.col("n_tokens"))).alias("length"))
