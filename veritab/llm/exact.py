"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest, in a folder that outlives the session. A delivery of
new rows becomes one entry per digest, counted before any shuffle; entries that the index lacks are found by a sort-merge anti-join
on its buckets, so the index itself is never shuffled, and are appended to it. What a row's digest says in the
index then decides about the row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.links import stored
from veritab.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Digests that at least one in HOT rows has go to every task, so that no task meets all their rows: fewer than HOT of them exist.
HOT = 1000


def digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of a text with A-Z in lower case; null is empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the row that stays: (digest, keep_id, keep_row, delivery).

    ``path`` is a folder all executors share. A new index takes ``buckets`` (the session's shuffle partitions if
    not given); an old one keeps what it has. Entries are only appended; a delivery that failed half-way may be given again under
    its name, since what is there already is not appended twice. Deliveries of one index run one after another.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path
        shape = f"{path}/shape"
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(shape)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(made).alias("buckets"), F.lit(id_type).alias("id_type")).coalesce(1).write.parquet(shape)
        kept = spark.read.parquet(shape).first()
        self.buckets, self.id_type = kept.buckets, kept.id_type
        self.name = f"digests_{uuid.uuid4().hex}"
        # The session's catalog only names the folder; buckets are known by their files.
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type}, keep_row BIGINT, delivery STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'")

    def entries(self) -> DataFrame:
        # Files of a delivery are new to the session's view of the folder.
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def fresh(self, entries: DataFrame) -> DataFrame:
        """Entries (digest, ..) that the index lacks: only they are shuffled, to the index's buckets."""
        return entries.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")

    def add(self, entries: DataFrame, delivery: str) -> None:
        """Append entries (digest, keep_id, keep_row), one per digest, that the index lacks."""
        new = self.fresh(entries).select("digest", "keep_id", "keep_row", F.lit(delivery).alias("delivery"))
        # One file per bucket and delivery.
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def _register(index: DigestIndex, docs: DataFrame, delivery: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Append a delivery's new digests: its rows (id, row, digest, delivery), and its rows per digest (digest, n).

    In a delivery the row of the largest id stays (ties: of the largest row number).
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest"), F.lit(delivery).alias("delivery")))
    best = F.max(F.struct("id", "row"))
    entries = stored(rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
                     .select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"))
    index.add(entries, delivery)
    return rows, entries.select("digest", "n")


def _decide(index: DigestIndex, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with what the index says of their digest; frequent digests meet that in every task, the others by sort-merge."""
    known = index.entries().select("digest", "keep_id", "keep_row", F.col("delivery").alias("first_delivery"))
    decided = stored(counts.hint("merge").join(known, "digest"))
    columns = ["n", "keep_id", "keep_row", "first_delivery"]
    least = F.lit(max(rows.count(), HOT) / HOT)
    hot = decided.filter(F.col("n") >= least).select(F.col("digest").alias("hot"), F.struct(*columns).alias("h"))
    held = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    frequent = held.filter("hot is not null").select(*rows.columns, *[F.col(f"h.{c}").alias(c) for c in columns])
    rest = held.filter("hot is null").select(*rows.columns).hint("merge").join(decided.filter(F.col("n") < least), "digest")
    own = (F.col("delivery") == F.col("first_delivery")) & (F.col("row") == F.col("keep_row"))
    return frequent.unionByName(rest).select("id", "digest", "n", "keep_id", "first_delivery", own.alias("kept"))


def deliver(index: DigestIndex, docs: DataFrame, delivery: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate one delivery against the index and append what is new: (id, digest, n, keep_id, first_delivery, kept).

    A row stays if no earlier delivery had its text and it has the largest id of the delivery's equal texts. ``n`` counts the
    delivery's rows of its digest; keep_id and first_delivery tell which row stayed when the text was first met.
    """
    return _decide(index, *_register(index, docs, delivery, id_col, text_col))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, deliveries: int = 2) -> DataFrame:
    """One row per row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. The table comes in deliveries of falling
    ids to an index at ``path`` (by default a new one in the checkpoint folder), so of equal texts the row with the largest id
    stays, and of equal ids one row. A null id is less than any other: it comes last, and stays where no row of its text has an id.
    Where ``path`` holds an index already, what it knows goes first: such rows are not kept. group_size
    counts the rows of this call. Ids that are no integers come in one delivery; other columns are ignored; an empty table
    gives no row.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    index = DigestIndex(spark, path or f"{ensure_checkpoint_dir(spark)}/digests-{run}", dict(docs.dtypes)[id_col])
    made, above = [], None
    for i, cut in enumerate([*_cuts(docs, id_col, deliveries), None]):
        below = F.lit(True) if above is None else F.coalesce(F.col(id_col) < F.lit(above), F.lit(True))
        here = docs.filter(below if cut is None else below & (F.col(id_col) >= F.lit(cut)))
        made.append(_register(index, here, f"{run}-{i}", id_col, text_col))
        above = cut
    rows, counts = (reduce(DataFrame.unionByName, parts) for parts in zip(*made, strict=True))
    found = _decide(index, rows, counts.groupBy("digest").agg(F.sum("n").alias("n")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _cuts(docs: DataFrame, id_col: str, deliveries: int) -> list[int]:
    """Falling ids that part the table into deliveries of about equal size; any cut gives the same result."""
    if deliveries < 2 or dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        return []
    shares = [1 - (i + 1) / deliveries for i in range(deliveries - 1)]
    found = docs.agg(F.percentile_approx(id_col, shares, 1000).alias("q")).first().q
    return sorted(set(found or []), reverse=True)
