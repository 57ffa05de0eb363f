"""Graph jobs: components, hierarchies, concept and relation tables, backbone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.ordered import ordered_scan, top_rows
from veritab.operators.documents import fold
from veritab.session import cut_lineage, sized_join, stored

# Relation kinds by priority.
RELATION_PRIORITY = {
    "part_of": 8, "prerequisite": 7, "depends_on": 6, "causes": 5,
    "explains": 4, "applies_to": 3, "contrasts": 2, "related": 1,
}
SYMMETRIC = ("related", "contrasts")
MAX_DEPTH = 12
# Characters of a run by which texts that may contain another are found.
GRAM = 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node id reached.

    Alternating large-star and small-star contraction (logarithmic rounds).
    Each step is a min per node plus a join on that node, so a hub node is
    pre-aggregated and its edges are split by the skew join.
    """
    edges = cut_lineage(edges)
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    cur = cut_lineage(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur = cut_lineage(small.filter(F.col("u") != F.col("v")).distinct())
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def shared_key_components(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component) where nodes sharing any key fall together; input is distinct pairs.

    A key held by one node links nothing and is dropped. Every other key links
    its nodes to its least node, so a hot key costs one edge per node.
    """
    rows = pairs.select(F.col(node).alias("a"), F.col(key).alias("_k"))
    shared = rows.groupBy("_k").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    edges = sized_join(rows, shared, "_k").filter("a <> b").select("a", "b")
    labels = connected_components(edges)
    return sized_join(pairs.select(F.col(node).alias("node")).distinct(), labels, "node", "left").select(
        F.col("node").alias(node), F.coalesce("component", "node").alias("component"))


def ancestors(parents: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, distance) for (id, parent) rows, up to ``max_depth`` steps.

    One equi-join per level; stops at the first empty level.
    """
    edge = parents.filter(F.col("parent").isNotNull()).select("id", "parent")
    step = cut_lineage(edge.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    levels = [step]
    hop = edge.select(F.col("id").alias("ancestor"), "parent")
    for depth in range(2, max_depth + 1):
        step = cut_lineage(step.join(hop, "ancestor").select(
            "id", F.col("parent").alias("ancestor"), F.lit(depth).alias("distance")))
        if step.isEmpty():
            break
        levels.append(step)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def hierarchy_problems(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(problem, id): repeated ids, unknown parents, cycles, too deep, bad edge endpoints."""
    ids = nodes.select("id").distinct()
    repeated = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_id").alias("problem"), "id")
    orphan = nodes.filter(F.col("parent").isNotNull()).join(
        ids.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("unknown_parent").alias("problem"), "id")
    walk = cut_lineage(ancestors(nodes.select("id", "parent"), max_depth))
    cycle = walk.filter(F.col("id") == F.col("ancestor")).select(F.lit("cycle").alias("problem"), "id").distinct()
    deep = walk.filter(F.col("distance") >= max_depth).select(F.lit("too_deep").alias("problem"), "id").distinct()
    known_src = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    known_dst = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    loops = edges.filter(F.col("source") == F.col("target"))
    bad = known_src.select("edge_id").union(known_dst.select("edge_id")).union(loops.select("edge_id")).distinct()
    return repeated.unionByName(orphan).unionByName(cycle).unionByName(deep).unionByName(
        bad.select(F.lit("bad_edge").alias("problem"), F.col("edge_id").alias("id")))


def hierarchy_walk(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, depth, path): depth-first listing order is ``orderBy(path)``.

    Goes down level by level from the roots; ``sort_key`` orders siblings.
    """
    level = cut_lineage(nodes.filter(F.col("parent").isNull()).select(
        "id", F.lit(0).alias("depth"), F.array("sort_key").alias("path")))
    out = level
    children = nodes.filter(F.col("parent").isNotNull()).select("id", "parent", "sort_key")
    for depth in range(1, max_depth + 1):
        level = cut_lineage(children.join(level.select(F.col("id").alias("parent"), "path"), "parent").select(
            "id", F.lit(depth).alias("depth"), F.concat("path", F.array("sort_key")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.join(used, "id", "left_anti")


def priority(kind: Column) -> Column:
    expr = F.lit(0)
    for name, rank in RELATION_PRIORITY.items():
        expr = F.when(kind == name, rank).otherwise(expr)
    return expr


def sparse_relations(relations: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted with reason). ``related`` ranks last, so the specific kinds can be
    cut first and the budget left per source decides the ``related`` ones."""
    order = [F.desc(priority(F.col("kind"))), F.desc("confidence"), F.asc("id")]
    pair = F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target"))
    rel = cut_lineage(relations.withColumn("_pair", pair))
    specific = cut_lineage(top_rows(rel.filter("kind <> 'related'"), ["source"], order, limit, "_rn").drop("_rn"))
    used = specific.groupBy("source").agg(F.count(F.lit(1)).alias("_used"))
    kept_pairs = specific.select("_pair").distinct()
    related = rel.filter("kind = 'related'")
    free = related.join(kept_pairs, "_pair", "left_anti")
    # The first related edge of a pair in global order wins, if its source still has budget.
    # A pair shared by two directions makes the second depend on the first, so the choice is
    # repeated until no pair is taken twice.
    chosen = cut_lineage(_fill_related(free, used, order, limit))
    kept = specific.unionByName(chosen)
    kept_ids = kept.select("id")
    pairs_all = kept.select("_pair").distinct().withColumn("_dup", F.lit(True))
    omitted = rel.join(kept_ids, "id", "left_anti").join(pairs_all, "_pair", "left").withColumn(
        "reason", F.when((F.col("kind") == "related") & F.col("_dup"), "pair_already_related").otherwise("over_source_budget"))
    return kept.drop("_pair"), omitted.drop("_pair", "_dup")


def _fill_related(free: DataFrame, used: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Greedy choice of ``related`` edges in (confidence desc, id) order.

    An edge is settled when, with all earlier undecided edges counted against
    it, the answer cannot change: kept if its source has room even if every
    earlier open edge of the source is kept and no earlier open edge shares its
    pair; dropped once its pair or its source budget is taken.
    """
    spark = free.sparkSession
    budget = free.select("source").distinct().join(used, "source", "left").select(
        "source", (F.lit(limit) - F.coalesce("_used", F.lit(0))).alias("_room"))
    open_edges = cut_lineage(free)
    kept = spark.createDataFrame([], free.schema)
    columns = free.columns
    while not open_edges.isEmpty():
        taken = kept.groupBy("source").agg(F.count(F.lit(1)).alias("_taken"))
        room = budget.join(taken, "source", "left").select(
            "source", (F.col("_room") - F.coalesce("_taken", F.lit(0))).alias("_left"))
        live = open_edges.join(kept.select("_pair").distinct(), "_pair", "left_anti").join(room, "source").filter("_left > 0")
        head = live.groupBy("_pair").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id"))).alias("_h"))
        live = live.join(head, "_pair").withColumn("_first", F.col("_h.id") == F.col("id"))
        # Candidates: earliest edges of a source within its room; at most ``limit`` per source.
        front = top_rows(live, ["source"], order, limit, "_rn").filter(F.col("_rn") <= F.col("_left"))
        blocked = front.filter(~F.col("_first")).groupBy("source").agg(F.min("_rn").alias("_stop"))
        ready = cut_lineage(front.join(blocked, "source", "left").filter(
            F.col("_first") & (F.coalesce(F.col("_rn") < F.col("_stop"), F.lit(True)))).select(*columns))
        if ready.isEmpty():
            break
        kept = cut_lineage(kept.unionByName(ready))
        open_edges = cut_lineage(live.select(*columns).join(ready.select("id"), "id", "left_anti"))
    return kept


def spanning_backbone(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maximum spanning forest of (id, source, target, rank); a smaller rank is better and
    ranks are unique, so Boruvka rounds give the same forest as the greedy order.

    Edges are sorted by rank once and carry their place from then on: rounds move (place, component, component), of which
    the best is kept for each two components. Ids join again at the end.
    """
    proper = edges.filter(F.col("source") != F.col("target")).select("id", "rank", "source", "target")
    # Places follow the physical order, so they are stored before use.
    placed = stored(proper.orderBy("rank").select(F.monotonically_increasing_id().alias("n"), "id", "source", "target"))
    live = placed.select("n", F.col("source").alias("cs"), F.col("target").alias("cd"))
    chosen = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        ends = live.select(F.explode(F.array("cs", "cd")).alias("comp"), F.struct("n", "cs", "cd").alias("e"))
        best = cut_lineage(ends.groupBy("comp").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen = best.select("n") if chosen is None else chosen.union(best.select("n"))
        # Every component with an edge is in it: each has a best one.
        merged = connected_components(best.select(F.col("cs").alias("a"), F.col("cd").alias("b")))
        moved = sized_join(live, merged.select(F.col("node").alias("cs"), F.col("component").alias("ns")), "cs")
        moved = sized_join(moved, merged.select(F.col("node").alias("cd"), F.col("component").alias("nd")), "cd").filter("ns <> nd")
        live = stored(moved.groupBy(F.least("ns", "nd").alias("cs"), F.greatest("ns", "nd").alias("cd")).agg(F.min("n").alias("n")))
    return sized_join(placed, chosen, "n").select("id") if chosen is not None else edges.select("id").limit(0)


@F.pandas_udf(T.StringType())
def nfkc_fold(text: pd.Series) -> pd.Series:
    """NFKC and casefold; Spark has no built-in Unicode normal form."""
    return text.str.normalize("NFKC").str.casefold().str.strip()


def concept_key(title: Column, kind: Column, scope: Column) -> Column:
    """Identity of a concept: hash of its normalised title, kind and scope."""
    joined = F.concat_ws("|", nfkc_fold(title), nfkc_fold(kind), nfkc_fold(scope))
    return F.concat(F.lit("k-"), F.substring(F.sha2(joined, 256), 1, 16))


def merge_concepts(concepts: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, explanations). The first row of a key names the node; explanations are kept as rows (key, explanation, first_seen) without
    those that an earlier one of the key contains, so a concept with very many mentions never becomes one long value in one task."""
    keyed = concepts.withColumn("key", concept_key(F.col("title"), F.col("kind"), F.col("scope")))
    nodes = keyed.groupBy("key").agg(
        F.min_by(F.struct("title", "kind", "scope", "summary"), order).alias("_first"),
        F.count(F.lit(1)).alias("mentions"))
    texts = keyed.groupBy("key", "explanation").agg(F.min(order).alias("first_seen"))
    return nodes.select("key", "_first.*", "mentions"), drop_contained(texts)


def drop_contained(texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows (key, explanation, first_seen), distinct per key, that no earlier row of their key contains as a substring.

    An earlier text that is dropped itself lies in a still earlier one, so each row is judged alone. A text's rarest run
    of ``gram`` characters (of all its characters, if it is shorter) in the key finds the texts that may hold it; those are compared. Null
    texts stay; an empty text stays only as the first of its key. Texts seen first at one place are in the order of their length, longest first.
    """
    rows = cut_lineage(texts.withColumn("_id", F.monotonically_increasing_id()))
    whole = rows.filter(F.col("explanation").isNotNull()).withColumn("_n", F.char_length("explanation"))
    runs = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n") - n + 1), lambda i: F.substring(F.col("explanation"), i, n)))
    # Lengths of runs that texts of a key are found by: few, since all long texts share one.
    sizes = whole.select("key", F.least("_n", F.lit(gram)).alias("_l")).distinct()
    held = whole.join(sizes, "key").filter((F.col("_l") > 0) & (F.col("_n") >= F.col("_l")))
    grams = cut_lineage(held.select("key", "_id", "_l", (F.col("_l") == F.least("_n", F.lit(gram))).alias("_own"), F.explode(runs(F.col("_l"))).alias("_g")))
    often = grams.groupBy("key", "_l", "_g").agg(F.count(F.lit(1)).alias("_k"))
    pick = grams.filter("_own").join(often, ["key", "_l", "_g"]).groupBy("key", "_id", "_l").agg(F.min_by("_g", F.struct("_k", "_g")).alias("_g"))
    pairs = pick.join(grams.select("key", "_l", "_g", F.col("_id").alias("_in")), ["key", "_l", "_g"]).filter("_id <> _in").select("_id", "_in")
    of = lambda p, i: whole.select(F.col("_id").alias(i), F.col("explanation").alias(f"{p}t"), F.struct("first_seen", (-F.col("_n")).alias("n"), "_id").alias(f"{p}o"))
    met = pairs.join(of("a", "_id"), "_id").join(of("b", "_in"), "_in").filter((F.col("bo") < F.col("ao")) & F.contains("bt", "at"))
    first = rows.groupBy("key").agg(F.min(F.struct("first_seen", (-F.char_length("explanation")).alias("n"), "_id"))["_id"].alias("_id"))
    empty = rows.filter("explanation = ''").join(first, ["key", "_id"], "left_anti").select("_id")
    return rows.join(met.select("_id").union(empty).distinct(), "_id", "left_anti").drop("_id")


def merge_lists(concepts: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(key, field, value, position): values of list columns of all rows of a concept, each once, where it was first met."""
    keyed = concepts.withColumn("key", concept_key(F.col("title"), F.col("kind"), F.col("scope")))
    long = None
    for f in fields:
        part = keyed.select("key", F.lit(f).alias("field"), F.col(order).alias("_o"), F.posexplode(f).alias("_i", "value"))
        long = part if long is None else long.unionByName(part)
    met = long.groupBy("key", "field", "value").agg(F.min(F.struct("_o", "_i")).alias("_first"))
    return ordered_scan(met, ["key", "field"], ["_first", "value"], number="position").select("key", "field", "value", "position")


def validate_concepts(candidates: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). The normalised label must occur in the normalised evidence;
    equal (label, definition) merge into the first."""
    norm = candidates.withColumn("_label", fold(F.col("label"))).withColumn("_def", fold(F.col("definition")))
    grounded = F.contains(fold(F.col("quote")), F.col("_label"))
    ok = norm.filter(F.coalesce(grounded, F.lit(False)))
    rejected = norm.filter(~F.coalesce(grounded, F.lit(False))).withColumn("reason", F.lit("label_not_in_evidence"))
    kept = ok.groupBy("_label", "_def").agg(
        F.min_by(F.struct("id", "label", "definition"), order).alias("f"),
        F.count_distinct("section_id").alias("sections"), F.count(F.lit(1)).alias("merged"))
    return kept.select("f.*", "sections", "merged"), rejected.drop("_label", "_def")


def validate_relations(relations: DataFrame, concepts: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): known endpoints, no self loop, evidence names both
    labels; symmetric kinds have sorted ends; the first of equal edges is kept."""
    names = concepts.select("id", fold(F.col("label")).alias("label"))
    j = relations.join(names.select(F.col("id").alias("source"), F.col("label").alias("_ls")), "source", "left").join(
        names.select(F.col("id").alias("target"), F.col("label").alias("_lt")), "target", "left")
    quote = fold(F.col("quote"))
    reason = (
        F.when(F.col("_ls").isNull() | F.col("_lt").isNull(), "unknown_endpoint")
        .when(F.col("source") == F.col("target"), "self_loop")
        .when(F.length(quote) < 2, "no_evidence")
        .when(~(F.contains(quote, F.col("_ls")) & F.contains(quote, F.col("_lt"))), "evidence_misses_label"))
    tagged = j.withColumn("reason", reason)
    swap = F.col("kind").isin(*SYMMETRIC) & (F.col("source") > F.col("target"))
    good = tagged.filter(F.col("reason").isNull()).select(
        F.when(swap, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(swap, F.col("source")).otherwise(F.col("target")).alias("target"), "kind", order)
    kept = good.groupBy("source", "target", "kind").agg(F.min(order).alias(order))
    return kept, tagged.filter(F.col("reason").isNotNull()).drop("_ls", "_lt")


def choose_key(candidates: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, omitted, violations) for a selection of (id, merged_into) rows.

    Violations: unknown id, id used twice, merge of different labels.
    """
    names = candidates.select("id", fold(F.col("label")).alias("_label"))
    unknown = selection.join(names, "id", "left_anti").select("id", F.lit("unknown_id").alias("violation"))
    twice = selection.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("used_twice").alias("violation"))
    labels = selection.join(names, "id").join(
        names.select(F.col("id").alias("merged_into"), F.col("_label").alias("_into")), "merged_into", "left")
    mismatch = labels.filter(~F.col("_label").eqNullSafe(F.col("_into"))).select("id", F.lit("label_mismatch").alias("violation"))
    bad = unknown.unionByName(twice).unionByName(mismatch)
    clean = selection.join(bad.select("id").distinct(), "id", "left_anti")
    used = clean.groupBy("merged_into").agg(F.count(F.lit(1)).alias("members"))
    selected = used.withColumnRenamed("merged_into", "id")
    omitted = candidates.join(clean.select("id"), "id", "left_anti").withColumn("reason", F.lit("not_selected"))
    return selected, omitted, bad
