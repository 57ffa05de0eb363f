"""Fold evaluation and permutation importance for class labels and for numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import classify as cl
from veritab.operators.relevance import fold_summary
from veritab.plans.common import FEATURES, r
from veritab.plans.registry import Tables, query
from veritab.plans.selection import _TAB, table
from veritab.plans.sqlmath import logistic_cte, solve_cte

DOC_FEATURES = ["size", "digits", "blanks", "lines"]
FOLDS = 5


def labelled(t: Tables) -> DataFrame:
    """Labelled documents with numbers read off their whole texts; a text without digits has no digit share."""
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    digits = F.char_length(F.regexp_replace(text, "[^0-9]", ""))
    made = t.documents.select(
        "doc_id", F.log1p(n.cast("double")).alias("size"), F.when(digits > 0, F.log(digits / (1.0 + n))).alias("digits"),
        (n - F.char_length(F.regexp_replace(text, " ", ""))).cast("double").alias("b"),
        F.log1p((n - F.char_length(F.regexp_replace(text, "\n", ""))).cast("double")).alias("lines"), n.alias("n"))
    made = made.select("doc_id", "size", "digits", (10 * F.col("b") / (1.0 + F.col("n"))).alias("blanks"), "lines")
    return t.labels.select("doc_id", "quality", "toxic").join(made, "doc_id")


_DOCS = r"""
d0 AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
d1 AS (SELECT doc_id, ln(1.0 + n) AS f1, length(regexp_replace(t, '[^0-9]', '', 'g')) AS g, 10.0 * (n - length(replace(t, ' ', ''))) / (1.0 + n) AS f3,
  ln(1.0 + n - length(replace(t, chr(10), ''))) AS f4, n FROM d0),
doc AS (SELECT l.doc_id, quality AS y, toxic, f1, CASE WHEN g > 0 THEN ln(g / (1.0 + n)) END AS f2, f3, f4 FROM labels l JOIN d1 USING (doc_id)),
"""
_MEANS = ", ".join(f"coalesce((sum(sum(f{i})) OVER () - coalesce(sum(f{i}), 0)) / nullif(sum(count(f{i})) OVER () - count(f{i}), 0), 0) AS m{i}" for i in range(1, 5))


def _folded_sql(folds: int, seed: str) -> str:
    return f"""{_DOCS}
f AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5('{seed}|' || doc_id)) - 1) % {folds})::INT AS fold FROM doc),
mean AS (SELECT fold AS k, {_MEANS} FROM f GROUP BY fold),
ks AS (SELECT DISTINCT fold AS k FROM f)"""


def _evaluation_sql() -> str:
    """Two best features per fold by correlation (nulls at the overall mean), then Newton steps and rank sums."""
    score = " UNION ALL ".join(f"SELECT k, {i} AS i, abs(corr(coalesce(f{i}, g{i}), y)) AS s FROM tr GROUP BY k" for i in range(1, 5))
    pick = lambda c, a, b: f"CASE {c} " + " ".join(f"WHEN {i} THEN coalesce({a}f{i}, {b}m{i})" for i in range(1, 5)) + " END"
    return f"""
WITH {_folded_sql(FOLDS, "9")},
g AS (SELECT {", ".join(f"avg(f{i}) AS g{i}" for i in range(1, 5))} FROM f),
tr AS (SELECT ks.k, f.*, g.* FROM f JOIN ks ON f.fold <> ks.k, g),
top AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY s DESC, i) AS rn FROM ({score})),
two AS (SELECT a.k, a.i AS ia, b.i AS ib FROM top a JOIN top b USING (k) WHERE a.rn = 1 AND b.rn = 2),
rows_ AS MATERIALIZED (SELECT k, y, {pick("ia", "tr.", "mean.")} AS z_0, {pick("ib", "tr.", "mean.")} AS z_1 FROM tr JOIN two USING (k) JOIN mean USING (k)),
{logistic_cte("fit", "rows_", 2, 24)},
te AS (SELECT k, y, w_2 + w_0 * {pick("ia", "f.", "mean.")} + w_1 * {pick("ib", "f.", "mean.")} AS s FROM f JOIN two ON two.k = f.fold JOIN mean USING (k) JOIN fit USING (k)),
rk AS (SELECT k, y, s, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM te),
auc AS (SELECT k, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc,
  avg(CASE WHEN (s > 0) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy, -avg(ln(1 + exp(CASE WHEN y = 1 THEN -s ELSE s END))) AS neg_log_loss FROM rk GROUP BY k)"""


NAMES_SQL = "list_value(" + ", ".join(f"'{f}'" for f in DOC_FEATURES) + ")"


@query("d9_classification_folds", f"""{_evaluation_sql()}
SELECT k AS fold, {NAMES_SQL}[ia] || ',' || {NAMES_SQL}[ib] AS top, round(roc_auc, 6) AS roc_auc, round(accuracy, 6) AS accuracy, round(neg_log_loss, 6) AS neg_log_loss
FROM auc JOIN two USING (k)""")
def d9_folds(t: Tables) -> DataFrame:
    """All scores of each fold, for the same two features and model."""
    out = None
    for metric in ("roc_auc", "accuracy", "neg_log_loss"):
        got = t.once(metric, lambda m=metric: cl.evaluate_selection(labelled(t), DOC_FEATURES, "quality", F.col("doc_id"), 2, FOLDS, "9", metric=m))
        got = got.select("fold", F.concat_ws(",", "top").alias("top"), r("score").alias(metric))
        out = got if out is None else out.join(got, ["fold", "top"])
    return out


@query("d9_classification_evaluation", f"""{_evaluation_sql()},
jac AS (SELECT avg(len(list_intersect([a.ia, a.ib], [b.ia, b.ib])) / len(list_distinct([a.ia, a.ib, b.ia, b.ib]))) AS s FROM two a JOIN two b ON a.k < b.k)
SELECT 'roc_auc' AS metric, round(avg(roc_auc), 6) AS cv_score_mean, round(stddev_pop(roc_auc), 6) AS cv_score_std, round(any_value(s), 6) AS stability_jaccard FROM auc, jac""")
def d9_classes(t: Tables) -> DataFrame:
    per = t.once("per", lambda: cl.evaluate_selection(labelled(t), DOC_FEATURES, "quality", F.col("doc_id"), 2, FOLDS, "9"))
    return fold_summary(per, ["metric"]).select("metric", *[r(c).alias(c) for c in ("cv_score_mean", "cv_score_std", "stability_jaccard")])


def _drops_sql(pred: str, score: str) -> str:
    """Scores of the rows as they are and with each feature taken from the row of equal rank in another order."""
    swap = lambda place: [f"CASE WHEN place = {i} THEN q.v{i} ELSE b.v{i} END AS z_{i - 1}" for i in range(1, 5)]
    return f"""
base AS (SELECT fold, y, v1, v2, v3, v4, row_number() OVER (PARTITION BY fold ORDER BY md5(key), key) AS rk FROM te),
drawn AS (SELECT fold, rep, v1, v2, v3, v4, row_number() OVER (PARTITION BY fold, rep ORDER BY md5('6|' || rep || '|' || key), key) AS rk FROM te, (VALUES (0), (1)) p(rep)),
both_ AS (SELECT b.fold, rep, place, b.y, {", ".join(swap("place"))} FROM base b JOIN drawn q USING (fold, rk), (VALUES (0), (1), (2), (3), (4)) a(place)),
sc AS (SELECT fold, rep, place, {score} AS score FROM (SELECT b.*, {pred} AS pred FROM both_ b JOIN fit ON fit.k = b.fold) GROUP BY ALL),
drops AS (SELECT s.fold, s.place, w.score - s.score AS d FROM sc s JOIN sc w ON w.fold = s.fold AND w.rep = s.rep AND w.place = 0 WHERE s.place > 0),
each_ AS (SELECT fold, place, avg(d) AS m, stddev_pop(d) AS s FROM drops GROUP BY ALL)"""


@query("d6_permutation_importance", f"""
WITH {_TAB},
f AS (SELECT key, x1 AS f1, x2 AS f2, x3 AS f3, x4 AS f4, y, CAST('0x' || substr(md5('6|' || key), 1, 8) AS BIGINT) % 3 AS fold FROM tab),
mean AS (SELECT fold AS k, {_MEANS} FROM f GROUP BY fold),
tr AS (SELECT m.k, y, {", ".join(f"coalesce(f{i}, m{i}) AS v{i}" for i in range(1, 5))} FROM f JOIN mean m ON f.fold <> m.k),
cov AS (SELECT k, {", ".join(f"covar_pop(v{i + 1}, v{j + 1}) AS a_{i}_{j}" for i in range(4) for j in range(4))}, {", ".join(f"covar_pop(v{i + 1}, y) AS b_{i}" for i in range(4))},
  avg(y) AS my, {", ".join(f"avg(v{i}) AS c{i}" for i in range(1, 5))} FROM tr GROUP BY k),
{solve_cte("fit", "cov", 4)},
te AS (SELECT fold, key, y, {", ".join(f"coalesce(f{i}, m{i}) AS v{i}" for i in range(1, 5))} FROM f JOIN mean m ON f.fold = m.k),
{_drops_sql("my + x_0 * (z_0 - c1) + x_1 * (z_1 - c2) + x_2 * (z_2 - c3) + x_3 * (z_3 - c4)", "1 - sum(power(y - pred, 2)) / (var_pop(y) * count(*))")}
SELECT 'x' || place AS feature, round(avg(m), 6) AS importance_mean, round(avg(s), 6) AS importance_std FROM each_ GROUP BY place""")
def d6(t: Tables) -> DataFrame:
    return cl.permutation_importance(table(t), FEATURES, "y", "key", 3, 2, "6").select(
        "feature", r("importance_mean").alias("importance_mean"), r("importance_std").alias("importance_std"))


@query("d6_class_importance", f"""
WITH {_folded_sql(3, "6")},
rows_ AS MATERIALIZED (SELECT ks.k, y, {", ".join(f"coalesce(f{i}, m{i}) AS z_{i - 1}" for i in range(1, 5))} FROM f JOIN ks ON f.fold <> ks.k JOIN mean USING (k)),
{logistic_cte("fit", "rows_", 4, 24)},
te AS (SELECT fold, doc_id::VARCHAR AS key, y, {", ".join(f"coalesce(f{i}, m{i}) AS v{i}" for i in range(1, 5))} FROM f JOIN mean m ON f.fold = m.k),
{_drops_sql("w_4 + w_0 * z_0 + w_1 * z_1 + w_2 * z_2 + w_3 * z_3", "avg(CASE WHEN (pred > 0) = (y = 1) THEN 1.0 ELSE 0 END)")}
SELECT {NAMES_SQL}[place] AS feature, round(avg(m), 6) AS importance_mean, round(avg(s), 6) AS importance_std FROM each_ GROUP BY place""")
def d6_classes(t: Tables) -> DataFrame:
    return cl.permutation_importance(labelled(t), DOC_FEATURES, "quality", "doc_id", 3, 2, "6").select(
        "feature", r("importance_mean").alias("importance_mean"), r("importance_std").alias("importance_std"))


@query("d9_language_accuracy")
def d9_languages(t: Tables) -> DataFrame:
    """More than two classes: softmax models, scored by accuracy as the task inference says; checked against brute force on a fixture."""
    text = F.coalesce("text", F.lit(""))
    n = 1.0 + F.char_length(text)
    share = lambda chars: (100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{chars}]", ""))) / n)
    rows = t.documents.select("doc_id", "lang", *[share(c).alias(name) for name, c in (("wh", "wW"), ("vowel_a", "aA"), ("umlaut", "äöüß"), ("accent", "éèêàçñ"))])
    per = t.once("langs", lambda: cl.evaluate_selection(rows, ["wh", "vowel_a", "umlaut", "accent"], "lang", F.col("doc_id"), 4, 3, "9"))
    return per.select("fold", "metric", F.concat_ws(",", F.array_sort("top")).alias("top"), r("score").alias("score"))
