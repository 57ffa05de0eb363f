"""Document, page and conversation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators import documents as dc
from veritab.plans.registry import Tables, query
from veritab.sources import readers


def markdown() -> Column:
    """Documents as markdown: short lines become headings, lines starting with E are fences."""
    text = F.regexp_replace("text", r"(?m)^(.{1,24})$", "## $1")
    return F.regexp_replace(text, r"(?m)^E.*$", "```")


_MD = "md AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^(.{1,24})$', '## \\1', 'g'), '(?m)^E.*$', '```', 'g') AS t FROM documents)"
_LINES = _MD + """,
ln0 AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM md),
ln AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM ln0)"""


@query("g1_overlap_chunks", None)
def g1(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return dc.overlap_chunks(docs, "doc_id", "text", 1200, 150).select("doc_id", "chunk_id", "chunk_no", "start", "end", F.md5("text").alias("digest"))


_SECTIONS = _LINES + """,
hd AS (SELECT doc_id, ofs, trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS title FROM ln WHERE regexp_matches(line, '^#{1,6}\\s+.')),
bd AS (SELECT doc_id, ofs, title FROM hd UNION ALL SELECT doc_id, 0, '文档开头' FROM md WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = md.doc_id AND hd.ofs = 0)),
sp AS (SELECT bd.doc_id, title, ofs AS s, coalesce(lead(ofs) OVER (PARTITION BY bd.doc_id ORDER BY ofs), length(t)) AS e, t FROM bd JOIN md USING (doc_id)),
sec AS (SELECT doc_id, 's' || row_number() OVER (PARTITION BY doc_id ORDER BY s) AS id, title, s, e FROM sp WHERE trim(substr(t, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), chr(10) || ' ') <> '')"""


@query("g2_sections", f"WITH {_SECTIONS} SELECT doc_id, id, title, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM sec")
def g2(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", markdown().alias("t"))
    return docs.select("doc_id", F.inline(dc.sections(F.col("t")))).select(
        "doc_id", "id", "title", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("g2_section_chunks")
def g2_chunks(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", markdown().alias("t"))
    return dc.section_chunks(docs, "doc_id", "t", 1000).select("doc_id", "chunk_id", "section_id", "title", "start", "end", F.md5("text").alias("digest"))


@query("g3_headings", f"""
WITH {_LINES}, f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS fences FROM ln)
SELECT doc_id, CAST(ofs AS BIGINT) AS "offset", length(regexp_extract(line, '^(#{{1,7}})\\s+(.+)$', 1)) AS level,
       trim(regexp_replace(regexp_replace(regexp_extract(line, '^(#{{1,7}})\\s+(.+)$', 2), '^#+\\s*', ''), '\\*\\*|==|`', '', 'g')) AS title
FROM f WHERE fences % 2 = 0 AND line NOT LIKE '```%' AND regexp_matches(line, '^#{{1,7}}\\s+.')""")
def g3(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", markdown().alias("t"))
    return docs.select("doc_id", F.inline(dc.headings(F.col("t")))).select(
        "doc_id", F.col("offset").cast("long").alias("offset"), F.col("level").cast("long").alias("level"), "title")


@query("g4_line_packing")
def g4(t: Tables) -> DataFrame:
    chunks, errors = dc.pack_lines(t.documents, "doc_id", "text", 4000)
    return chunks.select("doc_id", "chunk_no", "first_line", "last_line", "n_chars").unionByName(
        errors.select("doc_id", F.lit(0).alias("chunk_no"), F.lit(0).alias("first_line"), F.lit(0).alias("last_line"), F.col("line_chars").alias("n_chars")))


@query("g5_protected_spans", """
WITH d AS (SELECT doc_id, replace(replace(text, '%%%', '$$'), '&&&', '`') AS t FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '(\\$\\$[\\s\\S]*?\\$\\$|`+[^`\\n]+`+)') AS kept FROM d)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS spans, CAST(coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS BIGINT) AS kept_chars,
       CAST(length(t) - coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) + 15 * len(kept) AS BIGINT) AS masked_chars, true AS round_trip FROM k""")
def g5(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.replace(F.replace("text", F.lit("%%%"), F.lit("$$")), F.lit("&&&"), F.lit("`")).alias("t"))
    m = docs.withColumn("m", dc.mask_spans(F.col("t")))
    back = dc.restore_spans(F.col("m.masked"), F.col("m.kept"))
    return m.select(
        "doc_id", F.size("m.kept").cast("long").alias("spans"),
        F.aggregate("m.kept", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("kept_chars"),
        F.length("m.masked").cast("long").alias("masked_chars"), (back == F.col("t")).alias("round_trip"))


@query("g6_numeric_consistency", r"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(x, '\d+(?:[.,]\d+)*(?:%|％)?')) AS a, regexp_extract_all(y, '\d+(?:[.,]\d+)*(?:%|％)?') AS b FROM p)
SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS numbers, CAST(len(list_filter(a, lambda v: NOT list_contains(b, v))) AS BIGINT) AS missing FROM n""")
def g6(t: Tables) -> DataFrame:
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = c.filter("role = 'user'").join(nxt, ["conv_id", "turn"])
    nums = F.array_distinct(F.regexp_extract_all("text", F.lit(dc.NUMBER), 0))
    return pairs.select("conv_id", "turn", F.size(nums).cast("long").alias("numbers"),
                        F.size(dc.missing_numbers(F.col("text"), F.col("reply"))).cast("long").alias("missing"))


_CHAPTER = r"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^A.*$', '# 12', 'g'), '(?m)^I.*$', 'This page intentionally left blank.', 'g'), '(?m)^E.*$', '```', 'g')"


@query("g7_boilerplate_removal", rf"""
WITH md AS (SELECT doc_id, {_CHAPTER} AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM md),
f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS fences FROM l),
k AS (SELECT * FROM f WHERE line LIKE '```%' OR fences % 2 = 1 OR NOT (regexp_matches(line, '^#{{1,7}}\s+\d+\s*$') OR regexp_matches(trim(line), '(?i)^This page intentionally left blank\.?$')))
SELECT md.doc_id, md5(trim(coalesce(x, ''), ' ' || chr(10) || chr(13) || chr(9))) AS digest FROM md LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS x FROM k GROUP BY 1) USING (doc_id)""")
def g7(t: Tables) -> DataFrame:
    text = F.regexp_replace("text", r"(?m)^A.*$", "# 12")
    text = F.regexp_replace(text, r"(?m)^I.*$", "This page intentionally left blank.")
    text = F.regexp_replace(text, r"(?m)^E.*$", "```")
    return t.documents.select("doc_id", F.md5(dc.clean_chapter(text)).alias("digest"))


@query("g8_normalisation_keys", r"""
SELECT doc_id, md5(replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')) AS grounding_key, md5(replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')) AS rule_key FROM documents""")
def g8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(dc.fold(F.col("text"))).alias("grounding_key"), F.md5(dc.rule_key(F.col("text"))).alias("rule_key"))


def citations(t: Tables) -> DataFrame:
    """Quotes cut from each document with altered white space; some point to the next document."""
    q = F.regexp_replace(F.substring("text", 6, 40), " ", "\n ")
    return t.documents.select((F.col("doc_id") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("doc_id"), F.col("doc_id").alias("cited_by"), q.alias("quote"))


_CIT = "ct AS (SELECT doc_id + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS doc_id, doc_id AS cited_by, replace(substr(text, 6, 40), ' ', chr(10) || ' ') AS quote FROM documents)"


@query("c5_quote_grounding", rf"""
WITH {_CIT} SELECT cited_by, coalesce(contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(quote, '\s+', '', 'g')), false) AS valid FROM ct LEFT JOIN documents d USING (doc_id)""")
def c5(t: Tables) -> DataFrame:
    return dc.check_citations(citations(t), t.documents, "doc_id", "quote", "text").select("cited_by", "valid")


@query("c6_quote_location", r"""
WITH q AS (SELECT doc_id, replace(substr(text, 6, 40), ' ', chr(10) || ' ') AS quote, substr(text, 6, 40) AS raw, text FROM documents WHERE doc_id % 5 <> 0
           UNION ALL SELECT doc_id, 'zq ' || substr(text, 6, 20), NULL, text FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT doc_id, text, CASE WHEN length(regexp_replace(raw, '\s+', '', 'g')) >= 2 THEN trim(regexp_replace(raw, '^\s+|\s+$', '', 'g')) END AS needle FROM q)
SELECT doc_id, CAST(instr(text, needle) - 1 AS BIGINT) AS start, CAST(instr(text, needle) - 1 + length(needle) AS BIGINT) AS "end",
       CAST(length(regexp_replace(left(text, instr(text, needle) - 1), '[^\n]', '', 'g')) + 1 AS BIGINT) AS line_start,
       CAST(length(regexp_replace(left(text, instr(text, needle) - 1 + length(needle)), '[^\n]', '', 'g')) + 1 AS BIGINT) AS line_end,
       CASE WHEN needle IS NOT NULL THEN 's1' END AS section_id FROM s""")
def c6(t: Tables) -> DataFrame:
    q = F.regexp_replace(F.substring("text", 6, 40), " ", "\n ")
    # A noncharacter, since repeated words may hold "zq " and the words after it: these quotes occur nowhere.
    fake = F.concat(F.lit("zq\uffff "), F.substring("text", 6, 20))
    quotes = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, q).otherwise(fake).alias("quote"))
    out = dc.locate_quotes(quotes, t.documents, "doc_id", "quote", "text")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "line_start", "line_end")], "section_id")


@query("c7_line_evidence", """
WITH rf AS (SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000 ELSE doc_id END AS p, doc_id % 6 + 1 AS line,
                   CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE substr(string_split(text, chr(10))[doc_id % 3 + 1], 3, 12) END AS quote FROM documents),
j AS (SELECT path, quote, line, d.text, string_split(d.text, chr(10))[line] AS ln_text FROM rf LEFT JOIN documents d ON d.doc_id = p)
SELECT path, CASE WHEN trim(coalesce(quote, '')) = '' THEN 'empty_quote' WHEN text IS NULL THEN 'unknown_path' WHEN ln_text IS NULL THEN 'no_such_line'
  WHEN NOT contains(ln_text, quote) THEN 'quote_not_in_line' ELSE 'ok' END AS reason FROM j""")
def c7(t: Tables) -> DataFrame:
    d = t.documents
    refs = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("path"),
        (F.col("doc_id") % 6 + 1).alias("line"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(
            F.substring(F.get(F.split("text", "\n"), (F.col("doc_id") % 3).cast("int")), 3, 12)).alias("quote"))
    out = dc.check_line_quotes(refs, d.withColumnRenamed("doc_id", "path"), "path", "line", "quote", "text")
    return out.select(F.col("id").alias("path"), "reason")


_WIKI = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^E(\w?).*$', ':label:`fig_\1`', 'g'), '(?m)^L(\w?).*$', ':eqlabel:`\1`', 'g'), '(?m)^D(\w?).*$', ':label:`\1`', 'g'), '(?m) (e[a-z])[^ \n]*', ' :numref:`fig_\1`', 'g')"


def _labelled(t: Tables) -> DataFrame:
    text = F.regexp_replace("text", r"(?m)^E(\w?).*$", ":label:`fig_$1`")
    text = F.regexp_replace(text, r"(?m)^L(\w?).*$", ":eqlabel:`$1`")
    text = F.regexp_replace(text, r"(?m)^D(\w?).*$", ":label:`$1`")
    text = F.regexp_replace(text, r"(?m) (e[a-z])[^ \n]*", " :numref:`fig_$1`")
    return t.documents.select("doc_id", F.regexp_replace(text, r"fig_e([a-z])", "fig_$1").alias("t"))


_LABELS = rf"""
w AS (SELECT doc_id, regexp_replace({_WIKI}, 'fig_e([a-z])', 'fig_\1', 'g') AS t FROM documents),
wl AS (SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM w),
lb AS (SELECT doc_id, no, regexp_extract(line, '^:(label|eqlabel):`([^`]+)`', 1) AS kind, regexp_extract(line, '^:(label|eqlabel):`([^`]+)`', 2) AS label FROM wl WHERE regexp_matches(line, '^:(label|eqlabel):`([^`]+)`')),
ty AS (SELECT *, CASE WHEN label LIKE 'fig%' THEN 'fig' WHEN kind = 'eqlabel' OR label LIKE 'eq%' THEN 'eq' WHEN label LIKE 'tbl%' OR label LIKE 'tab%' THEN 'tbl' ELSE 'sec' END AS type FROM lb),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY no) AS num FROM ty),
labels_t AS (SELECT label, arg_max(doc_id, (doc_id, no)) AS page, arg_max(type, (doc_id, no)) AS type, arg_max(num, (doc_id, no)) AS num FROM nu GROUP BY label)"""


@query("c8_label_table", f"WITH {_LABELS} SELECT label, page, type, num FROM labels_t")
def c8_labels(t: Tables) -> DataFrame:
    return dc.label_table(_labelled(t), "doc_id", "t").withColumn("num", F.col("num").cast("long"))


@query("c8_cross_references", rf"""
WITH {_LABELS}, rf AS (SELECT doc_id, trim(unnest(regexp_extract_all(t, ':(numref|eqref):`([^`]+)`', 2))) AS label FROM w)
SELECT doc_id AS from_page, label, page AS to_page, type, num, page IS NOT NULL AS resolved, count(*) AS n FROM rf LEFT JOIN labels_t USING (label) GROUP BY ALL""")
def c8(t: Tables) -> DataFrame:
    pages = _labelled(t)
    refs = dc.resolve_references(pages, dc.label_table(pages, "doc_id", "t"), "doc_id", "t")
    return refs.groupBy("from_page", "label", "to_page", "type", F.col("num").cast("long").alias("num"), "resolved").agg(F.count(F.lit(1)).alias("n"))


@query("b15_secret_scan", r"""
WITH d AS (SELECT doc_id, regexp_replace(text, 'token = "([0-9a-f]{40})"', 'sk-\1', 'g') AS t FROM documents),
h AS (SELECT doc_id, 'sk' AS pattern, sha256(unnest(regexp_extract_all(t, 'sk-[A-Za-z0-9_-]{20,}'))) AS digest FROM d),
a AS (SELECT DISTINCT sha256(unnest(regexp_extract_all(t, 'sk-[A-Za-z0-9_-]{20,}'))) AS digest FROM d WHERE doc_id % 20 = 0)
SELECT doc_id, pattern, digest, count(*) AS n FROM h ANTI JOIN a USING (digest) GROUP BY ALL""")
def b15(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.regexp_replace("text", r'token = "([0-9a-f]{40})"', "sk-$1").alias("t"))
    allow = dc.scan_secrets(docs.filter("doc_id % 20 = 0"), "doc_id", "t").select("digest").distinct()
    return dc.scan_secrets(docs, "doc_id", "t", allow)


@query("d34_corpus_audit", r"""
WITH p AS (SELECT regexp_extract(url, '\.([a-z]+)/', 1) AS corpus, html, regexp_extract_all(html, '<h[1-6]>(.+?)</h[1-6]>', 1) AS hs FROM pages)
SELECT corpus, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(html, '<script'))) AS BIGINT) AS code,
       CAST(sum(len(regexp_extract_all(html, '&amp;'))) AS BIGINT) AS formulas, CAST(sum(len(hs)) AS BIGINT) AS headings,
       CAST(sum(len(list_filter(hs, lambda x: regexp_matches(x, '[=<>|:∈⊆∑∏≥≤→←×·\\]') OR length(x) > 40))) AS BIGINT) AS suspicious FROM p GROUP BY corpus""")
def d34(t: Tables) -> DataFrame:
    pages = t.pages.withColumn("corpus", F.regexp_extract("url", r"\.([a-z]+)/", 1))
    return dc.corpus_audit(pages, "corpus", "html", "<script", "&amp;", r"<h[1-6]>(.+?)</h[1-6]>")


_WIKITEXT = "replace(replace(replace(replace(replace(text, '$$$', '{{'), '%%%', '}}'), '&&&', '<math>'), '***', '</math>'), '###', chr(10) || '== x ===' || chr(10))"


@query("d35_markup_lint", rf"""
WITH w AS (SELECT doc_id, {_WIKITEXT} AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM w),
i AS (
  SELECT doc_id AS page, 0 AS line, 'braces' AS issue FROM w WHERE len(regexp_extract_all(t, '\{{\{{')) <> len(regexp_extract_all(t, '\}}\}}'))
  UNION ALL SELECT doc_id, 0, 'math' FROM w WHERE len(regexp_extract_all(t, '<math>')) <> len(regexp_extract_all(t, '</math>'))
  UNION ALL SELECT doc_id, 0, 'table' FROM w WHERE len(regexp_extract_all(t, '(?m)^\{{\|')) <> len(regexp_extract_all(t, '(?m)^\|\}}'))
  UNION ALL SELECT doc_id, no, 'level_one_heading' FROM l WHERE regexp_matches(line, '^=[^=]')
  UNION ALL SELECT doc_id, no, 'heading_runs_differ' FROM l WHERE line = '== x ===')
SELECT page, CAST(line AS BIGINT) AS line, issue, count(*) AS n FROM i GROUP BY ALL""")
def d35(t: Tables) -> DataFrame:
    text = F.col("text")
    for a, b in (("$$$", "{{"), ("%%%", "}}"), ("&&&", "<math>"), ("***", "</math>"), ("###", "\n== x ===\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return dc.markup_lint(t.documents.select("doc_id", text.alias("t")), "doc_id", "t").groupBy(
        "page", F.col("line").cast("long").alias("line"), "issue").agg(F.count(F.lit(1)).alias("n"))


@query("e15_finding_priority", """
SELECT p_partkey, round(p_size * (p_retailprice / 1999) / ((p_partkey % 7 + 1) * CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.5 ELSE 2.5 END AS DOUBLE)), 3) AS priority_score FROM part""")
def e15(t: Tables) -> DataFrame:
    risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("p_partkey") % 3 + 1).cast("int"))
    score = dc.finding_priority(F.col("p_size"), F.col("p_retailprice") / 1999, F.col("p_partkey") % 7 + 1, risk)
    return t.part.select("p_partkey", score.alias("priority_score")).orderBy(F.desc("priority_score"), "p_partkey")


@query("a7_text_ingest", """
SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, length(text) AS n_chars, NULL::VARCHAR AS reason FROM documents""")
def a7(t: Tables) -> DataFrame:
    files = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    good, bad = readers.ingest_texts(files)
    return good.select("path", "sha256", F.col("n_chars").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("path", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("n_chars"), "reason"))


