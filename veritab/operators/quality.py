"""Observation quality: severity lattice, reasons, duplicates, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import is_finite
from veritab.session import sized_join

# Severity order of the status lattice.
SEVERITY = {"usable": 0, "flagged": 1, "excluded": 2, "quarantined": 3}
_RANGE_STATUS = {"flag": "flagged", "exclude": "excluded", "quarantine": "quarantined"}
MISSING_TEXT = ("", "NA", "NAN", "NULL")


@dataclass(frozen=True)
class FieldSpec:
    type: str
    role: str = "feature"
    unit: str | None = None
    required: bool = True
    missing_allowed: bool = False
    minimum: float | None = None
    maximum: float | None = None
    range_action: str = "flag"
    categories: tuple = ()


@dataclass(frozen=True)
class ObservationSpec:
    """Declared schema of ``values.*`` plus group fields and environments in scope."""

    fields: dict[str, FieldSpec]
    group_fields: tuple[str, ...]
    environments: tuple[str, ...]
    missing_codes: tuple = ()
    source_required: bool = True
    namespace: str = "default"


_CODE_TYPES = {bool: (T.BooleanType,), int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
               float: (T.FloatType, T.DoubleType, T.DecimalType), str: (T.StringType,)}


def is_missing(df: DataFrame, name: str, codes: tuple) -> Column:
    """Null, or equal to a missing code of the same type (False is not 0)."""
    kind = df.schema["values"].dataType[name].dataType
    col = F.col(f"values.{name}")
    same = [c for c in codes if isinstance(kind, _CODE_TYPES[type(c)])]
    return col.isNull() | (F.coalesce(col.isin(*same), F.lit(False)) if same else F.lit(False))


def _valid_type(df: DataFrame, name: str, declared: str) -> Column:
    kind, col = df.schema["values"].dataType[name].dataType, F.col(f"values.{name}")
    numeric = isinstance(kind, T.NumericType)
    if declared == "number":
        return F.lit(numeric)
    if declared == "integer":
        return F.lit(True) if isinstance(kind, T.IntegralType) else (F.rint(col) == col if numeric else F.lit(False))
    wanted = {"string": T.StringType, "boolean": T.BooleanType, "object": (T.StructType, T.MapType), "array": T.ArrayType}
    return F.lit(isinstance(kind, wanted[declared]))


def _rules(df: DataFrame, spec: ObservationSpec) -> list[tuple[Column, str, str]]:
    """(condition, status, reason) for every record rule of the specification."""
    text_blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    group_bad = F.lit(False)
    for g in spec.group_fields:
        group_bad = group_bad | F.coalesce(F.trim(F.col("group_ids")[g]) == "", F.lit(True))
    env = F.col("environment")
    rules = [
        (text_blank("record_id"), "quarantined", "invalid_record_id"),
        (group_bad, "quarantined", "unresolved_group_identity"),
        (text_blank("environment"), "quarantined", "invalid_environment"),
        (~text_blank("environment") & ~env.isin(*spec.environments), "excluded", "environment_outside_scope"),
        (F.col("event_time").isNull(), "quarantined", "invalid_event_time"),
        (F.col("available_time").isNull(), "quarantined", "invalid_available_time"),
    ]
    if spec.source_required:
        rules.append((text_blank("source"), "quarantined", "missing_source"))
    for name, f in spec.fields.items():
        value = F.col(f"values.{name}")
        missing = is_missing(df, name, spec.missing_codes)
        unit = F.col("units")[name]
        supplied = unit.isNotNull() | ~missing
        rules.append((supplied & ~unit.eqNullSafe(F.lit(f.unit)), "quarantined", f"unit_conflict:{name}"))
        allowed = f.missing_allowed or not f.required
        rules.append((missing, "flagged" if allowed else "quarantined", f"missing:{name}"))
        valid = _valid_type(df, name, f.type)
        rules.append((~missing & ~valid, "quarantined", f"invalid_type:{name}"))
        if f.type in ("number", "integer") and (f.minimum is not None or f.maximum is not None):
            outside = F.lit(False)
            if f.minimum is not None:
                outside = outside | (value < f.minimum)
            if f.maximum is not None:
                outside = outside | (value > f.maximum)
            rules.append((~missing & valid & outside, _RANGE_STATUS[f.range_action], f"out_of_range:{name}"))
        if f.categories:
            rules.append((~missing & ~value.isin(*f.categories), "quarantined", f"unknown_category:{name}"))
        late = ~missing & F.coalesce(F.col("available_time") > F.col("prediction_time"), F.lit(False))
        if f.role == "feature":
            rules.append((late, "quarantined", f"feature_unavailable_at_prediction:{name}"))
        elif f.role == "target":
            rules.append((late, "flagged", f"target_available_after_prediction:{name}"))
    return rules


def identify(df: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Adds unit_keys, the sampling units of a record; none where a group field is not resolved."""
    keys = F.array_sort(F.array(*[
        F.concat_ws("|", F.lit(spec.namespace), F.lit(g), F.col("group_ids")[g]) for g in spec.group_fields]))
    resolved = F.lit(True)
    for g in spec.group_fields:
        resolved = resolved & F.coalesce(F.trim(F.col("group_ids")[g]) != "", F.lit(False))
    return df.withColumn("unit_keys", F.when(resolved, keys).otherwise(F.array().cast("array<string>")))


def assess_records(df: DataFrame, spec: ObservationSpec, content: Column) -> DataFrame:
    """Adds fingerprint, unit_keys, reasons (sorted) and status; rows are never changed.

    ``content`` is the canonical text of the record without its id. All copies
    of a repeated id or repeated content are quarantined.
    """
    rules = _rules(df, spec)
    # Joins carry the numbers of the rules a record breaks; their names are put in behind them.
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, (cond, _, _) in enumerate(rules)]))
    named = F.array(*[F.struct(F.lit(SEVERITY[status]).alias("sev"), F.lit(reason).alias("reason")) for _, status, reason in rules])
    base = identify(df, spec).withColumn("fingerprint", F.sha2(content, 256)).withColumn("_hits", hits)
    marked = mark_duplicates(base, "record_id", "fingerprint")
    dup = F.array_compact(F.array(
        F.when(F.col("dup_id"), F.struct(F.lit(3).alias("sev"), F.lit("duplicate_record_id").alias("reason"))),
        F.when(F.col("dup_content"), F.struct(F.lit(3).alias("sev"), F.lit("duplicate_content").alias("reason")))))
    all_hits = F.concat(F.transform("_hits", lambda i: F.get(named, i)), dup)
    worst = F.coalesce(F.array_max(F.transform("_all", lambda h: h["sev"])), F.lit(0))
    return (
        marked.withColumn("_all", all_hits)
        .withColumn("reasons", F.array_sort(F.transform("_all", lambda h: h["reason"])))
        .withColumn("status", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), worst + 1))
        .drop("_hits", "_all", "dup_id", "dup_content")
    )


def mark_duplicates(df: DataFrame, record_id: str, fingerprint: str) -> DataFrame:
    """dup_id and dup_content flags. Repeated values are found by pre-aggregated
    counts and joined back, so a value held by very many rows is never one task."""
    ids = df.groupBy(record_id).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(record_id, F.lit(True).alias("dup_id"))
    prints = df.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        fingerprint, F.lit(True).alias("dup_content"))
    out = sized_join(sized_join(df, ids, record_id, "left"), prints, fingerprint, "left")
    return out.withColumn("dup_id", F.coalesce("dup_id", F.lit(False))).withColumn(
        "dup_content", F.coalesce("dup_content", F.lit(False)))


def quality_report(assessed: DataFrame, spec: ObservationSpec, identified: DataFrame | None = None) -> DataFrame:
    """Long report (section, item, n): statuses, missing, unit conflicts, duplicates,
    identities and environments from one pass each.

    ``identified`` is ``identify`` of the same records: identities and environments then need no duplicates marked.
    """
    identified = assessed if identified is None else identified
    total = assessed.groupBy().agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("status") == s).alias(f"status:{s}") for s in SEVERITY],
        *[F.count_if(is_missing(assessed, n, spec.missing_codes)).alias(f"missing:{n}") for n in spec.fields],
        *[F.count_if(F.array_contains("reasons", f"unit_conflict:{n}")).alias(f"unit_conflict:{n}") for n in spec.fields],
        F.count_if(F.array_contains("reasons", "duplicate_record_id")).alias("duplicate_record_id"),
        F.count_if(F.array_contains("reasons", "duplicate_content")).alias("duplicate_content"),
        F.count_if(F.size("unit_keys") == 0).alias("unresolved_rows"),
    )
    names = total.columns
    wide = total.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("n")) for c in names])))
    identities = identified.select(F.explode("unit_keys").alias("k")).agg(
        F.lit("unique_identities").alias("item"), F.count_distinct("k").alias("n"))
    envs = identified.filter(F.col("environment").isNotNull()).groupBy(
        F.concat(F.lit("environment:"), F.col("environment")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return wide.unionByName(identities).unionByName(envs)


def prepare_sample(df: DataFrame, variables: list[str], target: str, status: str = "status") -> DataFrame:
    """First-cause deletion label per row: ``kept``, ``status:..``, ``missing:..`` or ``not_numeric:..``.

    Columns are raw text or numbers; kept rows also carry the parsed doubles
    under ``v_<name>``.
    """
    cause = F.when(F.col(status).isin("quarantined", "excluded"), F.concat(F.lit("status:"), F.col(status)))
    parsed = []
    for name in [*variables, target]:
        text = F.trim(F.col(name).cast("string"))
        number = text.try_cast("double")
        cause = cause.when(text.isNull() | F.upper(text).isin(*MISSING_TEXT), f"missing:{name}").when(
            ~is_finite(number), f"not_numeric:{name}")
        parsed.append(number.alias(f"v_{name}"))
    return df.select("*", *parsed, cause.alias("_c")).withColumn("cause", F.coalesce("_c", F.lit("kept"))).drop("_c")


def numeric_variables(df: DataFrame, payload: str, target: str, max_leaves: int | None = None) -> DataFrame:
    """Names in a map column whose values are all numbers and are identifiers; at most
    ``max_leaves`` in name order (the limit is the feature, names are schema-sized)."""
    pairs = df.select(F.explode(payload).alias("name", "value"))
    agg = pairs.groupBy("name").agg(F.bool_and(F.col("value").try_cast("double").isNotNull()).alias("numeric"))
    ok = F.col("numeric") & (F.col("name") != target) & F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    names = agg.filter(ok).select("name").orderBy("name")
    return names if max_leaves is None else names.limit(max_leaves)
