"""Candidate tables: pruning, hypotheses from patterns, novelty, evaluation assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.session import cut_lineage

# Match weights of the novelty rule.
SAME_EXPRESSION, SAME_SKELETON, KNOWN_PART = 1.0, 0.85, 0.7
STATEMENT_CAP, STATEMENT_FLOOR = 0.6, 0.12


def prune_dominated(cands: DataFrame) -> DataFrame:
    """Within a skeleton drop a candidate when another is no larger and no costlier, one of
    them strictly. Columns: skeleton, nodes, depth, conditions.

    Only the lowest cost per size matters: a size is dominated when a smaller size has the
    same or a lower cost, or the same size a lower one. Costs per size are few per skeleton.
    """
    size = F.struct("nodes", "depth")
    least = cands.groupBy("skeleton", "nodes", "depth").agg(F.min("conditions").alias("_c"))
    a, b = least.alias("a"), least.alias("b")
    # Sizes of a skeleton are bounded by the node and depth limits of the grammar.
    smaller = F.struct("b.nodes", "b.depth") < F.struct("a.nodes", "a.depth")
    best_below = a.join(b, (F.col("a.skeleton") == F.col("b.skeleton")) & smaller, "left").groupBy(
        "a.skeleton", "a.nodes", "a.depth").agg(F.min("b._c").alias("_below"), F.first("a._c").alias("_here"))
    del size
    j = cands.join(best_below, ["skeleton", "nodes", "depth"])
    dominated = (F.col("_here") < F.col("conditions")) | F.coalesce(F.col("_below") <= F.col("conditions"), F.lit(False))
    return j.filter(~dominated).drop("_below", "_here")


def dedup_candidates(cands: DataFrame) -> DataFrame:
    """One row per expression, then per skeleton the smallest (nodes, depth, expression)."""
    rank = F.struct("nodes", "depth", "expression")
    exact = cands.groupBy("expression").agg(F.min_by(F.struct(*cands.columns), "cand_id").alias("r")).select("r.*")
    return exact.groupBy("skeleton").agg(F.min_by(F.struct(*cands.columns), rank).alias("r")).select("r.*")


def cut_pool(cands: DataFrame, max_candidates: int) -> DataFrame:
    """Pool cut of the pipeline: smallest first (the limit is the feature)."""
    return cands.orderBy("nodes", "depth", "expression").limit(max_candidates)


def complexity(nodes: Column, parameters: Column) -> Column:
    """Formula length: expression nodes plus parameters."""
    return nodes + parameters


def hypotheses_from_patterns(patterns: DataFrame) -> DataFrame:
    """Pattern rows (pattern_id, kind, content, skeleton, null_model) to hypotheses.

    Equal content merges first, then equal skeletons; the first pattern id names
    the hypothesis. Merged ids stay rows of :func:`merged_pattern_ids`.
    """
    kind = F.create_map(*[F.lit(x) for kv in {
        "relation": "functional_relation", "cluster": "group_structure", "changepoint": "regime_change", "invariant": "conservation"}.items() for x in kv])
    rows = patterns.withColumn("type", kind[F.col("kind")])
    exact = rows.groupBy("kind", "type", "content").agg(
        F.min("pattern_id").alias("pattern_id"), F.min("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("n"))
    return exact.groupBy("kind", "type", "skeleton").agg(
        F.min("pattern_id").alias("hypothesis_id"), F.min_by("content", "pattern_id").alias("content"), F.sum("n").alias("merged"))


def merged_pattern_ids(patterns: DataFrame) -> DataFrame:
    """(hypothesis_id, pattern_id): every pattern and the hypothesis it went into."""
    first = patterns.groupBy("kind", "skeleton").agg(F.min("pattern_id").alias("hypothesis_id"))
    return patterns.join(first, ["kind", "skeleton"]).select("hypothesis_id", "pattern_id")


def statement_tokens(text: Column) -> Column:
    """Distinct latin words (lower case), single CJK characters and their neighbouring pairs."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]*"), 0), lambda w: F.lower(w))
    cjk = F.regexp_extract_all(text, F.lit("[㐀-䶿一-鿿]"), 0)
    pairs = F.zip_with(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(latin, cjk, pairs))


def novelty(hyps: DataFrame, entries: DataFrame) -> DataFrame:
    """(hyp, similarity, entry, match, novelty) against one knowledge version.

    hyps: hyp, canonical, skeleton, subtrees, statement; entries: entry,
    canonical, skeleton, statement. The three structural rules are equi-joins.
    A structural match is worth more than any statement match can be, so only
    hypotheses without one go on to compare statements.
    """
    def best_of(j: DataFrame, weight: float, name: str) -> DataFrame:
        return j.groupBy("hyp").agg(F.min("entry").alias("entry")).select(
            "hyp", "entry", F.lit(weight).alias("similarity"), F.lit(name).alias("match"))

    by_expr = entries.groupBy("canonical").agg(F.min("entry").alias("entry"))
    by_skel = entries.groupBy("skeleton").agg(F.min("entry").alias("entry"))
    same = best_of(hyps.select("hyp", "canonical").join(by_expr, "canonical"), SAME_EXPRESSION, "equivalent_expression")
    skel = best_of(hyps.select("hyp", "skeleton").join(by_skel, "skeleton"), SAME_SKELETON, "equivalent_skeleton")
    parts = hyps.select("hyp", F.col("canonical").alias("_own"), F.explode("subtrees").alias("canonical")).filter("canonical <> _own")
    part = best_of(parts.join(by_expr, "canonical"), KNOWN_PART, "known_corollary")
    structural = cut_lineage(same.unionByName(skel).unionByName(part))
    words = statement_similarity(hyps.join(structural.select("hyp").distinct(), "hyp", "left_anti"), entries)
    ranked = structural.unionByName(words)
    best = ranked.groupBy("hyp").agg(F.min_by(F.struct("similarity", "entry", "match"), F.struct((-F.col("similarity")).alias("s"), "entry")).alias("b"))
    return hyps.select("hyp").join(best, "hyp", "left").select(
        "hyp", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"), F.col("b.entry").alias("entry"),
        F.coalesce("b.match", F.lit("none")).alias("match"), (1 - F.coalesce("b.similarity", F.lit(0.0))).alias("novelty"))


def statement_similarity(hyps: DataFrame, entries: DataFrame, steps: tuple[float, ...] = (STATEMENT_CAP, 0.3, STATEMENT_FLOOR)) -> DataFrame:
    """Best capped Jaccard of at least the floor per hypothesis.

    Equal token sets are compared once. The threshold falls step by step: sets
    that share a prefix of their rarest tokens are compared, a hypothesis that
    reaches the threshold is settled (its best match must be among them), and
    only the rest meets the next, longer prefix. So frequent words join late
    and for few sets.
    """
    def keyed(rows: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame]:
        t = rows.select(id_col, F.array_sort(statement_tokens(F.col("statement"))).alias("tokens")).filter(F.size("tokens") > 0)
        t = t.withColumn(name, F.md5(F.array_join("tokens", " ")))
        return t.select(id_col, name), cut_lineage(t.groupBy(name).agg(F.first("tokens").alias("tokens"), F.min(id_col).alias(id_col)))

    owner, hsets = keyed(hyps, "hyp", "hset")
    _, esets = keyed(entries, "entry", "eset")
    freq = hsets.select(F.explode("tokens").alias("w")).union(esets.select(F.explode("tokens").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def ranked(sets: DataFrame, name: str) -> DataFrame:
        long = sets.select(name, F.explode("tokens").alias("w")).join(freq, "w")
        return cut_lineage(long.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("ws")))

    def prefix(sets: DataFrame, name: str, floor: float) -> DataFrame:
        n = F.size("ws")
        return sets.select(name, n.alias(f"n_{name}"), F.explode(F.slice("ws", F.lit(1), (n - F.ceil(n * floor) + 1).cast("int"))).alias("t")).select(
            name, f"n_{name}", "t.w")

    open_h, ranked_e, found = ranked(hsets.select("hset", "tokens"), "hset"), ranked(esets.select("eset", "tokens"), "eset"), None
    for floor in steps:
        near = (F.col("n_eset") >= F.col("n_hset") * floor) & (F.col("n_hset") >= F.col("n_eset") * floor)
        pairs = prefix(open_h, "hset", floor).join(prefix(ranked_e, "eset", floor), "w").filter(near).select("hset", "eset").distinct()
        both = pairs.join(hsets.select("hset", F.col("tokens").alias("a")), "hset").join(esets.select("eset", F.col("tokens").alias("b"), "entry"), "eset")
        common = F.size(F.array_intersect("a", "b"))
        scored = both.withColumn("j", common / (F.size("a") + F.size("b") - common)).filter(F.col("j") >= floor)
        best = cut_lineage(scored.withColumn("similarity", F.least(F.lit(STATEMENT_CAP), "j")).groupBy("hset").agg(
            F.min_by(F.struct("similarity", "entry"), F.struct((-F.col("similarity")).alias("s"), "entry")).alias("b")))
        found = best if found is None else found.unionByName(best)
        open_h = open_h.join(best.select("hset"), "hset", "left_anti")
    return owner.join(found, "hset").select(
        "hyp", F.col("b.entry").alias("entry"), F.col("b.similarity").alias("similarity"), F.lit("statement_similarity").alias("match"))


def assemble_evaluations(hyp_patterns: DataFrame, pattern_cands: DataFrame, cands: DataFrame, fits: DataFrame, stability: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluations, skipped with reason); nothing is filled with a default.

    hyp_patterns: hyp, position, pattern_id. The first pattern of a hypothesis
    that has a candidate decides.
    """
    hyps = hyp_patterns.select("hyp").distinct()
    first = hyp_patterns.join(pattern_cands, "pattern_id").groupBy("hyp").agg(F.min_by("cand", "position").alias("cand"))
    j = (
        hyps.join(first, "hyp", "left")
        .join(cands.select("cand", "complexity", F.lit(True).alias("_known")), "cand", "left")
        .join(fits.select("cand", "gain"), "cand", "left").join(stability.select("cand", "stability"), "cand", "left"))
    reason = (
        F.when(F.col("cand").isNull(), "no_candidate").when(F.col("_known").isNull(), "candidate_not_in_pool")
        .when(F.col("gain").isNull(), "no_fit").when(F.abs("gain") == float("inf"), "gain_not_finite"))
    tagged = j.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).select("hyp", "cand", "gain", "stability", "complexity"),
            tagged.filter(F.col("reason").isNotNull()).select("hyp", "reason"))
