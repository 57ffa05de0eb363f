"""Window values over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. The helpers
here keep each task to one slice of the order: rows are range-sorted (or hash
bucketed), the window runs inside a slice, and slice totals (a table with one
row per key and slice) carry the running values across slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.session import cut_lineage, sized_join

_SLICE, _SEQ = "_slice", "_seq"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    number: str | None = None,
    sums: dict[str, str] | None = None,
    maxs: dict[str, str] | None = None,
    prevs: dict[str, str] | None = None,
    keep_sequence: bool = False,
) -> DataFrame:
    """Position, running sums, running maxima and previous values per key.

    ``sums``, ``maxs`` and ``prevs`` map a new column to its input column; the
    running values include the row itself. One range shuffle by (keys, order),
    one shuffle by (keys, slice); no key is ever held by a single task.
    """
    keys = list(keys)
    sums, maxs, prevs = sums or {}, maxs or {}, prevs or {}
    # The sequence number depends on the physical order, so it is stored before reuse.
    rows = cut_lineage(
        df.orderBy(*keys, *order).withColumn(_SEQ, F.monotonically_increasing_id())
    ).withColumn(_SLICE, F.shiftright(_SEQ, 33))

    totals = [F.count(F.lit(1)).alias("_n")]
    totals += [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()]
    totals += [F.max(c).alias(f"_m_{o}") for o, c in maxs.items()]
    totals += [F.max_by(F.struct(F.col(c).alias("v")), _SEQ).alias(f"_l_{o}") for o, c in prevs.items()]
    per_slice = rows.groupBy(*keys, _SLICE).agg(*totals)
    before = Window.partitionBy(*keys).orderBy(_SLICE)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c_n")]
    carry += [F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_c_{o}") for o in sums]
    carry += [F.max(f"_m_{o}").over(earlier).alias(f"_c_{o}") for o in maxs]
    carry += [F.lag(f"_l_{o}").over(before)["v"].alias(f"_c_{o}") for o in prevs]
    per_slice = per_slice.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_SLICE).alias("_k_slice"), *carry)

    inside = Window.partitionBy(*keys, _SLICE).orderBy(_SEQ)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null keys are keys like any other.
    same = F.col(_SLICE) == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(per_slice, same)
    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.row_number().over(inside) + F.col("_c_n")).cast("long").alias(number))
    out += [(F.coalesce(F.sum(c).over(running), F.lit(0)) + F.col(f"_c_{o}")).alias(o) for o, c in sums.items()]
    out += [F.greatest(F.max(c).over(running), F.col(f"_c_{o}")).alias(o) for o, c in maxs.items()]
    out += [
        F.when(F.row_number().over(inside) == 1, F.col(f"_c_{o}")).otherwise(F.lag(c).over(inside)).alias(o)
        for o, c in prevs.items()
    ]
    if keep_sequence:
        out.append(F.col(_SEQ))
    return joined.select(*out)


def hash_rank(
    df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str] = (), out: str = "rk", prefix: int = 3
) -> DataFrame:
    """Rank by a digest, in hex or binary (uniform, so its prefix is an even bucket key).

    ``prefix`` hex digits give 16**prefix buckets per key; only the bucket
    counts are ranked across buckets. Rows are shuffled once, for the window, unless the counts are too many to broadcast.
    """
    keys = list(keys)
    text = F.hex(F.substring(digest, 1, prefix)) if dict(df.dtypes)[digest] == "binary" else F.col(digest)
    rows = df.withColumn("_b", F.substring(text, 1, prefix))
    earlier = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = (
        rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    )
    same = F.col("_b") == F.col("_k_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(digest, *ties)
    return (
        sized_join(rows, counts, same)
        .withColumn(out, (F.row_number().over(inside) + F.col("_off")).cast("long"))
        .drop("_b", "_off", "_k_b", *[f"_k_{k}" for k in keys])
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, avg_rank, ties): mean 1-based rank of each distinct value.

    Equal values are counted before any ordering, so a hot value is one row.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    return ordered_scan(counts, keys, [value], sums={"_cum": "ties"}).select(
        *keys, value, (F.col("_cum") - (F.col("ties") - 1) / 2.0).alias("avg_rank"), "ties"
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First k rows per key. The rank filter sits right on the window, so Spark
    prunes each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def sorted_runs(batches: Iterable[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Runs of at most ``size`` rows with one value of ``key``, inside a task that reads rows sorted by it first."""
    held: list[pa.RecordBatch] = []
    count, name = 0, None
    for batch in batches:
        while batch.num_rows:
            values = batch.column(key)
            first = values[0].as_py()
            if held and (first != name or count == size):
                yield pa.Table.from_batches(held)
                held, count = [], 0
            name = first
            same = batch.num_rows if values[-1].as_py() == first else pc.sum(pc.equal(values, values[0])).as_py()
            take = min(same, size - count)
            held.append(batch.slice(0, take))
            count += take
            batch = batch.slice(take)
    if held:
        yield pa.Table.from_batches(held)


# Groups of at most ALL values are ranked whole. In larger ones a sketch of relative rank error 1/ACCURACY brackets each
# quantile, and only values in the brackets are ranked: MARGIN exceeds the error and one rank of a group that large.
ALL, ACCURACY, MARGIN = 10_000, 20_000, 2e-4


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, one column per quantile), linear between order statistics; nulls take no part.

    One pass brackets each quantile by a sketch, a second one counts: values in a bracket one by one, all others by the
    gap between brackets they fall into. Per key at most ALL values, or some ten-thousandths of them for each quantile, are ranked, and no value is stored.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    order = sorted(qs.values())
    ends = [p for q in order for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    if keys:
        # Structs are equal where their nulls are: null keys are keys like any other.
        named = bounds.select(F.struct(*keys).alias("_key"), "_n", "_b")
        joined = sized_join(rows.withColumn("_key", F.struct(*keys)), named, "_key")
    else:
        joined = rows.withColumn("_s", bounds.agg(F.first(F.struct("_n", "_b")).alias("s")).scalar()).select("_v", "_s._n", "_s._b")
    low, high = [F.col("_b")[2 * i] for i in range(len(order))], [F.col("_b")[2 * i + 1] for i in range(len(order))]
    inside = F.col("_n") <= ALL
    for a, b in zip(low, high, strict=True):
        inside = inside | F.col("_v").between(a, b)
    gap = F.when(F.col("_n") <= ALL, 0).otherwise(sum((F.when(F.col("_v") >= a, 1).otherwise(0) for a in low), F.lit(0)))
    cells = joined.groupBy(*keys, gap.alias("_g"), F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_t"), F.first("_n").alias("_n"))
    # Of one gap, values in brackets come before the others.
    upto = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_g", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cells.withColumn("_cum", upto)
    before, parts = F.col("_cum") - F.col("_t"), []
    for name, q in qs.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        # Weighted sum of the two order statistics around position h.
        covers = lambda pos: (before <= pos) & (pos < F.col("_cum"))
        first, last, share = F.floor(h), F.ceil(h), h - F.floor(h)
        weight = F.when(covers(first), 1 - share).otherwise(0.0) + F.when(covers(last), share).otherwise(0.0)
        missed = F.when((weight > 0) & F.col("_v").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        parts.append(F.sum(F.when(weight > 0, F.coalesce(missed, weight * F.col("_v")))).alias(name))
    return ranked.groupBy(*keys).agg(*parts).select(*keys, *qs)
