"""Clusters with choice of k, and their stability over group draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import structure as st
from veritab.operators.clusters import ClusterSearch
from veritab.plans.common import r
from veritab.plans.registry import Tables, query

KS, ROUNDS = (2, 3, 4), 30
DRAWS, GROUPS, SEED = 3, 20, "2"


def search_cte(members: str, ks: tuple[int, ...] = KS, rounds: int = ROUNDS, accept: float = 0.0) -> str:
    """CTEs of the whole search over ``members`` (d, id, e): scaling, farthest-first seeds, unrolled rounds, silhouettes, choice, labels."""
    most = max(ks)
    parts = [
        f"xi AS MATERIALIZED (SELECT d, id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM {members})",
        "mom AS (SELECT d, i, avg(x) AS m, stddev_pop(x) AS s FROM xi GROUP BY d, i)",
        "zi AS MATERIALIZED (SELECT d, id, i, (x - m) / s AS v FROM xi JOIN mom USING (d, i) WHERE s > 1e-12)",
        "z AS MATERIALIZED (SELECT d, id, list(v ORDER BY i) AS z FROM zi GROUP BY d, id)",
        "seed0 AS MATERIALIZED (SELECT d, 0 AS c, arg_min(z, id) AS z FROM z GROUP BY d)"]
    for j in range(1, most):
        before = " UNION ALL ".join(f"SELECT * FROM seed{i}" for i in range(j))
        parts.append(f"""seed{j} AS MATERIALIZED (SELECT d, {j} AS c, z FROM (
  SELECT d, id, any_value(z.z) AS z, min(list_distance(z.z, s.z)) AS far FROM z JOIN ({before}) s USING (d) GROUP BY d, id)
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY far DESC, id) = 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM seed{i}" for i in range(most))
    parts.append(f"c0 AS MATERIALIZED (SELECT d, k, c, z FROM ({every}), (VALUES {', '.join(f'({k})' for k in ks)}) t(k) WHERE c < k)")
    assign = "SELECT z.d, id, k, arg_min(c, (list_distance(z.z, c.z), c)) AS c FROM z JOIN {0} c ON c.d = z.d GROUP BY z.d, id, k"
    for t in range(rounds):
        parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT d, k, c, list(m ORDER BY i) AS z FROM (
  SELECT d, k, c, i, avg(v) AS m FROM ({assign.format(f"c{t}")}) JOIN zi USING (d, id) GROUP BY d, k, c, i) GROUP BY d, k, c)""")
    parts += [
        f"named AS MATERIALIZED (SELECT d, k, row_number() OVER (PARTITION BY d, k ORDER BY list_transform(z, lambda v: round(v, 12))) - 1 AS c, z FROM c{rounds})",
        f"lab AS MATERIALIZED ({assign.format('named')})",
        "size AS (SELECT d, k, c, count(*) AS n FROM lab GROUP BY ALL)",
        "far AS MATERIALIZED (SELECT a.d, a.id AS a, b.id AS b, list_distance(a.z, b.z) AS dist FROM z a JOIN z b USING (d))",
        "per AS (SELECT f.d, la.k, f.a, la.c AS own, lb.c, sum(dist) AS s, count(*) AS n FROM far f JOIN lab la ON la.d = f.d AND la.id = f.a JOIN lab lb ON lb.d = f.d AND lb.id = f.b AND lb.k = la.k GROUP BY ALL)",
        "ab AS (SELECT d, k, a, max(CASE WHEN own = c THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS inner_, min(CASE WHEN own <> c THEN s / n END) AS outer_ FROM per GROUP BY ALL)",
        "sil AS (SELECT d, k, avg(CASE WHEN outer_ IS NULL OR greatest(inner_, outer_) <= 1e-12 THEN 0 ELSE (outer_ - inner_) / greatest(inner_, outer_) END) AS silhouette FROM ab GROUP BY ALL)",
        "cand AS (SELECT sil.d, sil.k, silhouette, min(n) AS smallest FROM sil JOIN size USING (d, k) GROUP BY ALL)",
        f"best AS (SELECT d, k, silhouette FROM cand WHERE smallest >= 2 AND silhouette >= {accept} QUALIFY row_number() OVER (PARTITION BY d ORDER BY round(silhouette, 12) DESC, k) = 1)"]
    return ",\n".join(parts)


_WHOLE = f"WITH mem AS (SELECT 0 AS d, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),\n{search_cte('mem')}"


def whole_search(t: Tables) -> ClusterSearch:
    return ClusterSearch(t.embeddings, "vec_id", "embedding", KS, accept=0.0, rounds=ROUNDS)


@query("f5_kmeans_selection", f"""{_WHOLE}
SELECT c::INTEGER AS cluster, count(*) AS n, k, round(any_value(silhouette), 6) AS silhouette FROM lab JOIN best USING (d, k) GROUP BY c, k""")
def f5(t: Tables) -> DataFrame:
    found = whole_search(t)
    return found.labels().groupBy("draw", "cluster").agg(F.count(F.lit(1)).alias("n")).join(found.chosen(), "draw").select("cluster", "n", "k", r("silhouette").alias("silhouette"))


@query("f5_cluster_candidates", f"{_WHOLE} SELECT k, round(silhouette, 6) AS silhouette, smallest FROM cand")
def f5_candidates(t: Tables) -> DataFrame:
    return whole_search(t).candidates().select("k", r("silhouette").alias("silhouette"), F.array_min("sizes").alias("smallest"))


@query("f8_cluster_stability", f"""
WITH p AS (SELECT vec_id AS id, (vec_id % {GROUPS})::VARCHAR AS grp, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT d, grp FROM (SELECT DISTINCT grp FROM p), (VALUES {', '.join(f'({i})' for i in range(DRAWS))}) t(d)
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY md5('{SEED}|' || d || '|' || grp), grp) <= ceil(0.8 * count(*) OVER (PARTITION BY d))),
mem AS (SELECT -1 AS d, id, e FROM p UNION ALL SELECT d, id, e FROM p JOIN g USING (grp)),
{search_cte("mem")},
chosen AS (SELECT d, lab.k, id, c FROM lab JOIN best USING (d, k)),
cells AS (SELECT a.d, a.c, f.c AS full_, count(*) AS n FROM chosen a JOIN chosen f ON f.d = -1 AND f.id = a.id WHERE a.d >= 0 GROUP BY ALL),
both_ AS (SELECT d, sum(n * (n - 1) / 2) AS b, sum(n) AS n FROM cells GROUP BY d),
l AS (SELECT d, sum(m * (m - 1) / 2) AS v FROM (SELECT d, c, sum(n) AS m FROM cells GROUP BY ALL) GROUP BY d),
q AS (SELECT d, sum(m * (m - 1) / 2) AS v FROM (SELECT d, full_, sum(n) AS m FROM cells GROUP BY ALL) GROUP BY d),
rnd AS (SELECT d, (2 * b + n * (n - 1) / 2 - l.v - q.v) / (n * (n - 1) / 2) AS rand FROM both_ JOIN l USING (d) JOIN q USING (d))
SELECT d::INTEGER AS draw, k, round(rand, 6) AS rand, k = (SELECT k FROM best WHERE d = -1) AND rand >= 0.8 AS reproduced FROM rnd JOIN best USING (d)""")
def f8_clusters(t: Tables) -> DataFrame:
    """All draws and the full sample in one search."""
    points = t.embeddings.withColumn("grp", (F.col("vec_id") % GROUPS).cast("string"))
    draws = t.once("draws", lambda: st.group_draws(points, "grp", DRAWS, SEED))
    return st.cluster_stability(points, "vec_id", "embedding", "grp", draws, ks=KS, accept=0.0, rounds=ROUNDS).withColumn("rand", r("rand"))
