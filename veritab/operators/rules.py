"""Rule checks of extracted documents: required fields, line amounts, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_PATTERN = r"^-?\d+(?:\.\d+)?$"


def money(text: Column) -> Column:
    """Unambiguous decimal string as decimal(38,6), null otherwise."""
    return F.when(text.rlike(MONEY_PATTERN), text.try_cast("decimal(38,6)"))


def line_amount_checks(items: DataFrame, key: str, tolerance: str) -> DataFrame:
    """Per document: round_half_up(quantity * price, 2) against the stated amount."""
    tol = F.lit(tolerance).cast("decimal(38,6)")
    q, p, a = (money(F.col(c)) for c in ("quantity", "unit_price", "line_amount"))
    expected = F.round((q.cast("decimal(18,6)") * p.cast("decimal(18,6)")).cast("decimal(38,6)"), 2)
    readable = q.isNotNull() & p.isNotNull() & a.isNotNull()
    off = F.coalesce(F.abs(expected - a) > tol, F.lit(False))
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(readable & off).alias("bad_lines"), F.bool_and(readable).alias("_ok")
    ).select(key, F.lit("line_amounts").alias("rule"), "bad_lines",
             F.when(~F.col("_ok"), "unknown").when(F.col("bad_lines") > 0, "fail").otherwise("pass").alias("status"))


def order_total_checks(headers: DataFrame, items: DataFrame, key: str, tolerance: str, full_formula: bool) -> DataFrame:
    """Sum of line amounts (plus tax and shipping, minus discount) against the total."""
    tol = F.lit(tolerance).cast("decimal(38,6)")
    amount = money(F.col("line_amount"))
    sums = items.groupBy(key).agg(F.sum(amount).alias("_sum"), F.bool_and(amount.isNotNull()).alias("_ok"))
    j = headers.join(sums, key, "left")
    total = F.col("_sum")
    if full_formula:
        total = total + money(F.col("tax")) + money(F.col("shipping")) - money(F.col("discount"))
    stated = money(F.col("total"))
    known = F.coalesce(F.col("_ok"), F.lit(False)) & total.isNotNull() & stated.isNotNull()
    return j.select(key, F.lit("order_total").alias("rule"), F.lit(0).cast("long").alias("bad_lines"),
                    F.when(~known, "unknown").when(F.abs(total - stated) <= tol, "pass").otherwise("fail").alias("status"))


def required_checks(headers: DataFrame, key: str, fields: list[str]) -> DataFrame:
    missing = sum((F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", 1).otherwise(0) for f in fields), F.lit(0))
    return headers.select(key, F.lit("required").alias("rule"), missing.cast("long").alias("bad_lines"),
                          F.when(missing > 0, "fail").otherwise("pass").alias("status"))


def accept(checks: DataFrame, key: str, error_rules: list[str]) -> DataFrame:
    """A document is accepted when every error-severity check passes."""
    strict = F.col("rule").isin(*error_rules)
    return checks.groupBy(key).agg(
        F.coalesce(F.bool_and(F.when(strict, F.col("status") == "pass")), F.lit(True)).alias("accepted"),
        F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "unknown").alias("unknown"))
