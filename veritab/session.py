"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", app: str = "veritab", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the session's own setting wins.

    A temporary folder is made only in local mode; on a cluster a missing
    setting is an error, since executors could not share a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet in the shared checkpoint folder: for large tables, since checkpoints are not compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A table of this many bytes, measured as text, may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def sized_join(big: DataFrame, small: DataFrame, on: list[str] | str | Column, how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a derived table whose size is measured first.

    The small side is stored and its bytes are summed, however wide its rows are: within
    ``max_bytes`` it is broadcast, so the big side is not shuffled; beyond that the join
    shuffles both sides and the adaptive skew split applies.
    """
    stored = cut_lineage(small)
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return big.join(F.broadcast(stored) if size <= max_bytes else stored, on, how)


def spread(df: DataFrame, min_bytes: int = 1 << 18) -> DataFrame:
    """Local runs only: use all cores for a small single file, which is one split.

    On a cluster tables are read as they are split.
    """
    if not df.sparkSession.sparkContext.master.startswith("local["):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < min_bytes:
        return df
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores)
