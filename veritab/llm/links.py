"""Stored intermediate tables, and connected components of link tables, safe for hub nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared checkpoint folder.

    Cuts lineage like a checkpoint, but compressed, and the reader starts with a small plan: a checkpoint
    keeps the constraints of the plan it came from, which multiply over the rounds of a loop.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node that links reach; nodes without links are absent.

    Contraction: each round gives every node the member of least hash within two steps (a new hash
    each round), so stars and cliques fall together at once and a constant share of the nodes goes
    per round whatever the shape. Every join has a stored table on each side, so a hub's rows
    are split by the adaptive skew join; minima per node are combined before the shuffle.
    """
    cur = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    steps, seed = [], 0
    while not cur.isEmpty():
        both = cur.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                            F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("n"))
        near = stored(both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least("m", rank(F.col("u"))).alias("m")))
        far = both.join(near.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m"))
        # A node's own nearest is among its neighbours' ones: each of them sees the node and all that is least around itself.
        step = stored(far.select("u", F.least("m", rank(F.col("u")))["n"].alias("m")))
        cur = stored(cur.join(step.select(F.col("u").alias("a"), F.col("m").alias("x")), "a").select("x", "b")
                     .join(step.select(F.col("u").alias("b"), F.col("m").alias("y")), "b").filter("x <> y")
                     .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.append(step)
        seed += 1
    if not steps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].select(F.col("u").alias("node"), F.col("m").alias("label"))
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("u").alias("label"), "m"), "label", "left").select(
            "node", F.coalesce("m", "label").alias("label"))
    labels = stored(labels)
    least = stored(labels.groupBy("label").agg(F.min("node").alias("component")))
    return labels.join(least, "label").select("node", "component")
