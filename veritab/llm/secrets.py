"""Secret scan with corpus-wide ownership of candidates. DataFrame functions only.

Three fixed patterns give the base spans. Longer mixed tokens are candidates besides them. Every
candidate value is hashed and counted by the distinct repositories and owners that hold it: a
value that several owners share is a copied example, one that stays with few owners and looks
random is taken for a live credential. Spans of live candidates are added to the base ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.links import stored

# The patterns of the base kinds, in their order, with the least length of the tested part.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# The same matches with the short ones left out by the pattern itself, as these runs are maximal.
_ACCESS_LONG = rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"
_HEX_LONG = rf"[0-9a-f]{{{HEX_LENGTH},}}"
# Candidates beside the base kinds: long runs with letters, digits and many different characters.
ADDED = "owned"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
TOKEN_CHARACTERS = 8
# Up to so many distinct owners a value counts as owner-specific; beyond, as a copied example.
LIVE_OWNERS = 2
_PATTERNS = {"assign": (ASSIGN, 1), "access": (_ACCESS_LONG, 0), "hex": (_HEX_LONG, 0), ADDED: (TOKEN, 0)}
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _located(kind: str) -> Column:
    """array of spans from the pieces between matches and the matches, which alternate: their lengths give all places.

    Places are in code points.
    """
    p, m, v = (f"_{part}_{kind}" for part in "pmv")
    rank = [*KINDS, ADDED].index(kind)

    def step(acc, x):
        start = acc["at"] + F.char_length(x[p])
        end = start + F.char_length(x[m])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x[v].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x[m].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.coalesce(F.aggregate(F.arrays_zip(p, m, v), first, step, lambda acc: acc["out"]), first["out"])


def _matches(text: Column) -> dict[str, Column]:
    """Pieces, matches and tested parts per kind; null where the pattern does not occur."""
    out = {}
    for kind, (pattern, group) in _PATTERNS.items():
        has = text.rlike(pattern)
        out[f"_p_{kind}"] = F.when(has, F.split(text, pattern, -1))
        out[f"_m_{kind}"] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out[f"_v_{kind}"] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return out


def _random_looking(value: Column) -> Column:
    kinds = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= TOKEN_CHARACTERS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per row: (doc_id, spans, n_owned, n_examples).

    ``spans`` is an array of (start, rank, kind, end, value, repos, owners), by start and kind: base kinds always,
    and ``owned`` tokens that no base span overlaps and that at most LIVE_OWNERS distinct owners hold.
    n_owned counts the added spans, n_examples the base spans whose value more owners share. A null text is
    empty. A null owner or repository is one unknown owner or repository. Repeated rows each get their
    row and add nothing to the distinct counts. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
                       F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"))
    found = base.withColumns(_matches(F.col("_text"))).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "_owner", "_repo", *[_located(k).alias(k) for k in _PATTERNS])
    long_enough = F.filter("assign", lambda s: F.char_length(s["value"]) >= ASSIGN_LENGTH)
    found = stored(found.withColumn("assign", long_enough))
    plain = F.concat(*KINDS)
    apart = F.filter(ADDED, lambda s: _random_looking(s["value"]) & ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = found.select("_row", "_owner", "_repo", plain.alias("_base"), ADDED).filter((F.size("_base") > 0) | (F.size(ADDED) > 0))
    spans = stored(rows.select("_row", "_owner", "_repo", F.explode(F.concat("_base", apart)).alias("s"))
                   .withColumn("_hash", F.sha2(F.col("s.value"), 256)))
    # Distinct first, then counts: each step is combined before its shuffle, however hot a value is.
    pairs = spans.groupBy("_hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    owned = stored(pairs.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("_hash").agg(
        F.sum("n").alias("repos"), F.count(F.lit(1)).alias("owners")))
    full = spans.join(owned, "_hash").filter((F.col("s.kind") != ADDED) | (F.col("owners") <= LIVE_OWNERS))
    per_row = full.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value", "repos", "owners"))).alias("spans"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    out = found.select("_row", "doc_id").join(per_row, "_row", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)))
    return out.select("doc_id", "spans", count(lambda s: s["kind"] == ADDED).alias("n_owned"),
                      count(lambda s: (s["kind"] != ADDED) & (s["owners"] > LIVE_OWNERS)).alias("n_examples"))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans as text."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(named(base), 256).alias("base_sha256"),
                        named(F.col("spans")).alias("spans"), "n_owned", "n_examples")
