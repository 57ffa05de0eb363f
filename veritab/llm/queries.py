"""Queries of this subpackage over the shared tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.alignment import alignments
from veritab.llm.ctw import score_texts
from veritab.llm.decontaminate import decontaminate, items_digest
from veritab.llm.exact import exact_duplicates
from veritab.llm.language import identify
from veritab.llm.lengths import length_histogram
from veritab.llm.lines import dedup_lines
from veritab.llm.minhash import near_duplicates
from veritab.llm.packing import pack
from veritab.llm.quality import rank_quality
from veritab.llm.secrets import scan, span_digest
from veritab.llm.vectors import near_vectors
from veritab.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# A-Z in lower case, as all text operators here fold letters.
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS ws FROM {{docs}}),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {{k}} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {{k}} + 2), lambda i: array_to_string(ws[i:i + {{k}} - 1], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= {{percent}} * (na.n + nb.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = w.doc_id
"""


@_query("op7_minhash_near_dedup", NEAR_SQL.format(docs="documents", k=3, percent=85))
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


ALNUM_WORDS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# Windows of ten words of one list; fewer words are one window.
TEN = "list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: ws[i:i + 9])"


@_query("op1_benchmark_decontamination", rf"""
WITH dw AS (SELECT doc_id, {ALNUM_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, {ALNUM_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest({TEN}) AS w FROM iw WHERE len(ws) > 0),
m AS (SELECT DISTINCT len(w) AS m FROM win),
pos AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, m WHERE len(ws) >= m),
hit AS (SELECT p.doc_id, p.i, p.m, win.item_id FROM (SELECT doc_id, i, m, ws[i:i + m - 1] AS w FROM pos) p JOIN win ON win.w = p.w),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_digest(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


@_query("op6_length_histogram")
def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_table(spark, sf_dir, "documents"))


@_query("op9_sum_of_squares_packing")
def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return rf"""
SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, ms[i] AS m, vs[i] AS value,
  list_sum(list_transform(ps[1:i], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)::BIGINT AS s
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, source, regexp_split_to_array(coalesce(text, ''), '{quoted}') AS ps, regexp_extract_all(coalesce(text, ''), '{quoted}') AS ms,
    regexp_extract_all(coalesce(text, ''), '{quoted}', {group}) AS vs FROM documents))"""


# The patterns of the base kinds are fixed values, given here a second time on purpose.
SECRETS_SQL = rf"""
WITH base AS (
  SELECT * FROM ({_spans_sql('assign', 0, r'(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'.replace("''", "'"), 1)}) WHERE length(value) >= 6
  UNION ALL SELECT * FROM ({_spans_sql('access', 1, 'AKIA[A-Z0-9]+')}) WHERE length(value) >= 20
  UNION ALL SELECT * FROM ({_spans_sql('hex', 2, '[0-9a-f]+')}) WHERE length(value) >= 24),
tok AS (SELECT * FROM ({_spans_sql('owned', 3, '[A-Za-z0-9+/_-]{20,}={0,2}')}) t
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.s + length(t.m) AND t.s < b.s + length(b.m))),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tok),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM every GROUP BY value),
kept AS (SELECT *, kind || ':' || s || ':' || (s + length(m)) AS name FROM every JOIN owners USING (value) WHERE kind <> 'owned' OR owners <= 2),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  coalesce(string_agg(name, ',' ORDER BY s, rank) FILTER (kind <> 'owned'), '') AS base, string_agg(name, ',' ORDER BY s, rank) AS spans,
  count(*) FILTER (kind = 'owned') AS o, count(*) FILTER (kind <> 'owned' AND owners > 2) AS e FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(o, 0)::BIGINT AS n_owned, coalesce(e, 0)::BIGINT AS n_examples
FROM documents LEFT JOIN per USING (doc_id)
"""


@_query("op2_secret_ownership", SECRETS_SQL)
def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan(_table(spark, sf_dir, "documents")))


@_query("op3_quality_ranking")
def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op4_nn_descent", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN comp ON comp.node = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


LINES_SQL = rf"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line, regexp_extract_all({LOWER.format('ls[i]')}, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
occ AS (SELECT *, doc_id * 1000000 + line AS o FROM l WHERE len(ws) >= 2),
d AS (SELECT ws, min(o) AS o FROM occ GROUP BY ws),
f AS (SELECT ws, o, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 8),
v AS (SELECT o, n, i, list_concat(ws[1:i - 1], ws[i + 1:]) AS rest FROM f),
near AS (
  SELECT x.o FROM v x JOIN v y ON x.n = y.n AND x.i = y.i AND x.rest = y.rest AND y.o < x.o
  UNION SELECT x.o FROM v x JOIN d y ON x.rest = y.ws AND len(y.ws) >= 8 AND y.o < x.o
  UNION SELECT y.o FROM v x JOIN d y ON x.rest = y.ws AND len(y.ws) >= 8 AND x.o < y.o),
gone AS (SELECT doc_id, line FROM occ JOIN d USING (ws) WHERE occ.o <> d.o OR d.o IN (SELECT o FROM near)),
kept AS (SELECT doc_id, string_agg(ls[i], chr(10) ORDER BY i) AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw) r
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.line = r.i - 1) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_dropped,
  CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents t LEFT JOIN raw USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query("op8_line_dedup", LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op10_context_tree_scores")
def op10_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


@_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


@_query("op12_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER.format("text")} AS t FROM documents) WINDOW w AS (PARTITION BY t)
""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@_query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(_table(spark, sf_dir, "documents"))
