"""Corpus jobs: sections, chunks, grounding, masking, audits.

A document is one row, so everything that looks at one document only stays in
that row as array expressions; nothing is exploded and shuffled to rebuild it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the text formats.
DOCUMENT_START = "文档开头"
SECTION_OVERLAP = 300
KEEP_TOKEN = "⟦BT_KEEP_"
KEEP_PATTERN = r"⟦BT_KEEP_\d+⟧"
PROTECTED = (
    r"(?mi)(^```[^\n]*\n[\s\S]*?^```[^\n]*(?:\n|$)|^~~~[^\n]*\n[\s\S]*?^~~~[^\n]*(?:\n|$)"
    r"|\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\\\([^\n]*?\\\)|(?<![\\$])\$(?!\$)[^$\n]+\$(?!\$)"
    r"|!\[[^\]]*\]\([^\n]*?\)|<img\b[^>]*>|`+[^`\n]+`+)"
)
NUMBER = r"\d+(?:[.,]\d+)*(?:%|％)?"
NUMBER_HEADING = r"^#{1,7}\s+\d+\s*$"
FILLER_LINE = (
    r"(?i)^(?:本页(?:有意|特意)留白[。.]?|此页故意留白[。.]?|"
    r"This page intentionally left blank\.?|www\.it-ebooks\.info)$"
)
SECRET_PATTERNS = {
    "sk": r"sk-[A-Za-z0-9_-]{20,}",
    "ujn": r"ujn-[A-Za-z0-9_-]{20,}",
    "github": r"(?:gh[pousr]_[A-Za-z0-9]{25,}|github_pat_[A-Za-z0-9_]{30,})",
    "pem": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
SUSPICIOUS_TITLE = r"[=<>|:∈⊆∑∏≥≤→←×·\\]"
SUSPICIOUS_WORDS = ("0", "1", "EV", "VE", "pk")

_HEADING = r"(?mdU)^#{1,6}\s+.+?\s*$"
_FENCED = r"(?m)^[^\S\n]*(?:```[^\n]*\n[\s\S]*?(?:^[^\S\n]*```[^\n]*$|\z)|~~~[^\n]*\n[\s\S]*?(?:^[^\S\n]*~~~[^\n]*$|\z))"


def compact(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def fold(text: Column) -> Column:
    """Grounding key: white space removed, case folded; the folds that change letters are spelled out."""
    return F.replace(F.replace(F.lower(compact(text)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


# Bytes of text that a Python task turns into strings at once; the Arrow batch it reads is bounded by Spark.
PIECE_BYTES = 4 << 20


def _pieces(text: pa.Array) -> list[tuple[int, int]]:
    """Bounds of runs of rows of PIECE_BYTES of text each, up to one text more."""
    number = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _by_piece(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _pieces(batch.column(text)):
            yield batch.slice(a, b - a)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


@F.arrow_udf(T.StringType())
def rule_key(text: pa.Array) -> pa.Array:
    """Rule key: NFKC, white space removed, case folded; there is no built-in NFKC."""
    key = lambda s: None if s is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", s)).casefold()
    parts = [pa.array(list(map(key, text[a:b].to_pylist())), pa.string()) for a, b in _pieces(text)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def sections(text: Column) -> Column:
    """array<struct<id, title, start, end>> cut at markdown headings; blank ones skipped.

    One fold over the pieces, which carries the place and the number reached.
    """
    pieces = F.split(text, r"(?mdU)(?=^#{1,6}\s+.+?\s*$)")
    headed = r"\A" + _HEADING.replace("(?mdU)^", "(?mdU)")
    none = F.array().cast("array<struct<id:string,title:string,start:int,end:int>>")

    def step(s: Column, p: Column) -> Column:
        keep = F.trim(compact(p)) != ""
        number = s["n"] + F.when(keep, 1).otherwise(0)
        end = s["at"] + F.length(p)
        title = F.when(p.rlike(headed), F.regexp_extract(p, r"(?mdU)\A#{1,6}\s+(.+?)\s*$", 1)).otherwise(F.lit(DOCUMENT_START))
        row = F.struct(F.concat(F.lit("s"), number.cast("string")).alias("id"), title.alias("title"), s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), number.alias("n"), F.when(keep, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("out")), step, lambda s: s["out"])


def _window_spans(text: str, start: int, end: int, size: int, overlap: int, boundary: str, low: int) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, cut after the last boundary past ``low``.

    Boundaries are found once; each span ends at the last one that ends inside it.
    """
    ends = [m.start() + len(boundary) for m in re.compile(f"(?={re.escape(boundary)})").finditer(text, start, end)]

    def span(at: int) -> tuple[int, int]:
        full = at + size
        last = ends[bisect_right(ends, full) - 1] if full < end and ends and ends[0] <= full else -1
        return at, end if full >= end else last if last - len(boundary) >= at + low else full

    spans = [span(start)] if start < end else []
    while spans and spans[-1][1] < end:
        spans.append(span(max(spans[-1][0] + 1, spans[-1][1] - overlap)))
    return spans


def overlap_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk_id, chunk_no, start, end, text): windows broken at blank lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_piece(batches, text):
            rows = [
                (k, f"{k}-c{i + 1:04d}", i + 1, a, b, body[a:b])
                for k, body in zip(part.column(key).to_pylist(), part.column(text).to_pylist()) if body
                for i, (a, b) in enumerate(_window_spans(body, 0, len(body), size, overlap, "\n\n", max(size // 2, overlap)))]
            yield _rows(rows, [key, "chunk_id", "chunk_no", "start", "end", "text"],
                        [part.column(key).type, pa.string(), *[pa.int32()] * 3, pa.string()])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_id string, chunk_no int, start int, end int, text string")


def section_chunks(df: DataFrame, key: str, text: str, size: int = 5000) -> DataFrame:
    """(key, chunk_id, section_id, title, start, end, text): sections cut at line ends past half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_piece(batches, text):
            rows = []
            for k, body, secs in zip(*(part.column(c).to_pylist() for c in (key, text, "_sections")), strict=True):
                number = 0
                for s in secs or []:
                    for a, b in _window_spans(body, s["start"], s["end"], size, min(SECTION_OVERLAP, size // 10), "\n", size // 2):
                        number += 1
                        rows.append((k, f"b{number}", s["id"], s["title"], a, b, body[a:b]))
            yield _rows(rows, [key, "chunk_id", "section_id", "title", "start", "end", "text"],
                        [part.column(key).type, *[pa.string()] * 3, *[pa.int32()] * 2, pa.string()])

    kind = dict(df.dtypes)[key]
    return df.select(key, text, sections(F.col(text)).alias("_sections")).mapInArrow(
        run, f"{key} {kind}, chunk_id string, section_id string, title string, start int, end int, text string")


def headings(text: Column) -> Column:
    """array<struct<offset, end, level, title>> of headings outside fences."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("fence"),
                     F.array().cast("array<struct<offset:int,end:int,level:int,title:string>>").alias("out"))
    rule = r"^(#{1,7})\s+(.+)$"

    def plain(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, r"^#+\s*", ""), r"\*\*|==|`", "")
        return F.trim(F.regexp_replace(t, r"\\([_()\[\]])", "$1"))

    def step(s: Column, line: Column) -> Column:
        mark = F.substring(F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1), 1, 1)
        hit = (s["fence"] == "") & (mark == "") & line.rlike(rule)
        fence = F.when(mark == "", s["fence"]).when(s["fence"] == "", mark).when(s["fence"] == mark, F.lit("")).otherwise(s["fence"])
        found = F.struct(s["at"].alias("offset"), (s["at"] + F.length(line)).alias("end"),
                         F.length(F.regexp_extract(line, rule, 1)).alias("level"), plain(F.regexp_extract(line, rule, 2)).alias("title"))
        return F.struct((s["at"] + F.length(line) + 1).alias("at"), fence.alias("fence"),
                        F.when(hit, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.split(text, "\n"), state, step, lambda s: s["out"])


def pack_lines(df: DataFrame, key: str, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors): numbered lines ``key:n: line`` packed per document up to ``limit``.

    A line over the limit is an error row; its document is not packed.
    """
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda ln, i: F.length(
        F.concat(F.col(key).cast("string"), F.lit(":"), (i + 1).cast("string"), F.lit(": "), ln, F.lit("\n")))))
    tagged = df.select(key, text, longest.alias("_max"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_piece(batches, text):
            rows = []
            for k, body in zip(part.column(key).to_pylist(), part.column(text).to_pylist()):
                items = [f"{k}:{n}: {line}\n" for n, line in enumerate(body.removesuffix("\n").split("\n"), 1)] if body else []
                ends = [0, *accumulate(map(len, items))]
                at, no = 0, 0
                while at < len(items):
                    # The furthest line whose cumulative length still fits.
                    stop, no = bisect_right(ends, ends[at] + limit) - 1, no + 1
                    rows.append((k, no, at + 1, stop, ends[stop] - ends[at], "".join(items[at:stop])))
                    at = stop
            yield _rows(rows, [key, "chunk_no", "first_line", "last_line", "n_chars", "text"],
                        [part.column(key).type, *[pa.int32()] * 4, pa.string()])

    kind = dict(df.dtypes)[key]
    chunks = tagged.filter(F.col("_max") <= limit).select(key, text).mapInArrow(
        run, f"{key} {kind}, chunk_no int, first_line int, last_line int, n_chars int, text string")
    return chunks, tagged.filter(F.col("_max") > limit).select(key, F.col("_max").alias("line_chars"))


def mask_spans(text: Column) -> Column:
    """struct<masked, kept, reserved>: protected spans replaced by numbered tokens."""
    pieces, kept = F.split(text, PROTECTED, -1), F.regexp_extract_all(text, F.lit(PROTECTED), 0)
    masked = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(
        F.lit(KEEP_TOKEN), F.lpad((i - 1).cast("string"), 5, "0"), F.lit("⟧"), p))), "")
    return F.struct(masked.alias("masked"), kept.alias("kept"), F.contains(text, F.lit(KEEP_TOKEN)).alias("reserved"))


def restore_spans(masked: Column, kept: Column) -> Column:
    """Inverse of :func:`mask_spans`; null when a token is unknown."""
    pieces = F.split(masked, KEEP_PATTERN, -1)
    numbers = F.transform(F.regexp_extract_all(masked, F.lit(r"⟦BT_KEEP_(\d+)⟧"), 1), lambda n: n.cast("int"))
    ahead = F.concat(F.array(F.lit(None).cast("int")), numbers)
    back = F.zip_with(pieces, ahead, lambda p, n: F.when(n.isNull(), p).otherwise(F.concat(F.get(kept, n), p)))
    return F.when(F.exists(back, lambda b: b.isNull()), None).otherwise(F.array_join(back, ""))


def same_tokens(source: Column, other: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(KEEP_PATTERN), 0) == F.regexp_extract_all(other, F.lit(KEEP_PATTERN), 0)


def missing_numbers(source: Column, other: Column) -> Column:
    """Distinct numbers of the source that the paired text lacks."""
    nums = lambda t: F.regexp_extract_all(F.regexp_replace(t, KEEP_PATTERN, ""), F.lit(NUMBER), 0)
    return F.array_except(F.array_distinct(nums(source)), nums(other))


def clean_chapter(text: Column) -> Column:
    """Number-only headings and filler lines removed outside fences, ends trimmed."""
    outside, fenced = F.split(text, _FENCED, -1), F.regexp_extract_all(text, F.lit(_FENCED), 0)
    drop = lambda ln: ln.rlike(NUMBER_HEADING) | F.trim(ln).rlike(FILLER_LINE)
    cleaned = F.transform(outside, lambda seg: F.array_join(F.filter(F.split(seg, "\n", -1), lambda ln: ~drop(ln)), "\n"))
    joined = F.array_join(F.zip_with(cleaned, fenced, lambda seg, f: F.concat(seg, F.coalesce(f, F.lit("")))), "")
    return F.regexp_replace(joined, r"(?U)\A\s+|\s+\z", "")


def check_citations(citations: DataFrame, chunks: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """Citations with ``valid``: the quote occurs in its chunk, white space ignored."""
    j = citations.join(chunks.select(key, F.col(text).alias("_text")), key, "left")
    ok = F.contains(compact(F.col("_text")), compact(F.col(quote)))
    return j.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_text")


def locate_quotes(quotes: DataFrame, documents: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """start, end, line_start, line_end and section of each quote in its document.

    Exact search first; then the quote's characters with optional white space
    between them, as one regular expression per row.
    """
    j = quotes.join(documents.select(key, F.col(text).alias("_t")), key, "left").withColumn(
        "_q", F.regexp_replace(F.col(quote), r"(?U)\A\s+|\s+\z", ""))
    short = F.length(compact(F.col("_q"))) < 2
    loose = F.array_join(F.transform(F.split(compact(F.col("_q")), ""), lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1")), "\\s*")
    exact = F.instr(F.col("_t"), F.col("_q"))
    found = F.when(exact > 0, F.col("_q")).otherwise(F.regexp_substr(F.col("_t"), F.concat(F.lit("(?U)"), loose)))
    j = j.withColumn("found", F.when(~short, found)).withColumn(
        "start", F.when(F.col("found").isNotNull(), F.instr(F.col("_t"), F.col("found")) - 1))
    lines = lambda upto: F.length(F.regexp_replace(F.left(F.col("_t"), upto), r"[^\n]", "")) + 1
    end = F.col("start") + F.length("found")
    sec = F.get(F.filter(sections(F.col("_t")), lambda s: (s["start"] <= F.col("start")) & (F.col("start") < s["end"])), F.lit(0))
    return j.withColumn("end", end).withColumn("line_start", F.when(F.col("start").isNotNull(), lines(F.col("start")))).withColumn(
        "line_end", F.when(F.col("start").isNotNull(), lines(F.col("end")))).withColumn(
        "section_id", F.when(F.col("start").isNotNull(), F.coalesce(sec["id"], F.lit("")))).drop("_t", "_q")


def check_line_quotes(refs: DataFrame, documents: DataFrame, path: str, line: str, quote: str, text: str) -> DataFrame:
    """Quotes that must occur in exactly the given line; reason per row."""
    j = refs.join(documents.select(path, F.col(text).alias("_t")), path, "left")
    lines = F.split("_t", "\n", -1)
    at = F.get(lines, (F.col(line) - 1).cast("int"))
    reason = (
        F.when(F.coalesce(F.trim(F.col(quote)), F.lit("")) == "", "empty_quote").when(F.col("_t").isNull(), "unknown_path")
        .when(at.isNull(), "no_such_line").when(~F.contains(at, F.col(quote)), "quote_not_in_line"))
    return j.withColumn("reason", F.coalesce(reason, F.lit("ok"))).drop("_t")


def label_table(pages: DataFrame, page: str, text: str) -> DataFrame:
    """(label, page, type, num): labels typed fig/eq/tbl/sec and numbered per page and type.

    A label defined more than once belongs to its last definition.
    """
    kinds = ("fig", "eq", "tbl", "sec")
    state = F.struct(F.lit(False).alias("code"), F.lit(False).alias("img"), *[F.lit(0).alias(k) for k in kinds],
                     F.array().cast("array<struct<label:string,type:string,num:int>>").alias("out"))
    rule = r"^:(label|eqlabel):`([^`]+)`"

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(raw)
        fence = line.startswith("```")
        live = ~fence & ~s["code"]
        image, hit = live & line.startswith("!["), live & line.rlike(rule)
        kind, label = F.regexp_extract(line, rule, 1), F.regexp_extract(line, rule, 2)
        typ = (F.when(label.startswith("fig") | ((kind == "label") & s["img"]), "fig").when((kind == "eqlabel") | label.startswith("eq"), "eq")
               .when(label.startswith("tbl") | label.startswith("tab"), "tbl").otherwise("sec"))
        img = F.when(fence, F.lit(False)).when(s["code"], s["img"]).when(image, F.lit(True)).when(hit | (line != ""), F.lit(False)).otherwise(s["img"])
        # Numbers run per page and type, inside the fold.
        counts = {k: s[k] + F.when(hit & (typ == k), 1).otherwise(0) for k in kinds}
        num = F.coalesce(*[F.when(typ == k, c) for k, c in counts.items()])
        row = F.struct(label.alias("label"), typ.alias("type"), num.alias("num"))
        return F.struct(F.when(fence, ~s["code"]).otherwise(s["code"]).alias("code"), img.alias("img"), *[c.alias(k) for k, c in counts.items()],
                        F.when(hit, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    found = F.aggregate(F.split(text, "\n"), state, step, lambda s: s["out"])
    rows = pages.select(F.col(page).alias("page"), F.posexplode(found).alias("i", "e")).select("page", "i", "e.*")
    return rows.groupBy("label").agg(F.max_by(F.struct("page", "type", "num"), F.struct("page", "i")).alias("d")).select("label", "d.*")


def resolve_references(pages: DataFrame, labels: DataFrame, page: str, text: str) -> DataFrame:
    """(from_page, kind, label, to_page, type, num, resolved) for every reference."""
    rule = r":(numref|eqref):`([^`]+)`"
    refs = pages.select(F.col(page).alias("from_page"), F.explode(F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rule), 1).alias("kind"), F.regexp_extract_all(text, F.lit(rule), 2).alias("label"))).alias("r"))
    refs = refs.select("from_page", "r.kind", F.trim(F.col("r.label")).alias("label"))
    return refs.join(labels.withColumnRenamed("page", "to_page"), "label", "left").withColumn("resolved", F.col("to_page").isNotNull())


def scan_secrets(df: DataFrame, key: str, text: str, allow: DataFrame | None = None) -> DataFrame:
    """(key, pattern, digest, n) of secret-like strings not on the allow list; values never leave the scan."""
    cells = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_extract_all(text, F.lit(p), 0).alias("m")) for n, p in SECRET_PATTERNS.items()])
    hits = df.select(key, F.inline(cells)).select(key, "pattern", F.explode("m").alias("m"))
    rows = hits.groupBy(key, "pattern", F.sha2("m", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return rows if allow is None else rows.join(allow.select("digest"), "digest", "left_anti")


def corpus_audit(df: DataFrame, corpus: str, text: str, code: str = "<syntaxhighlight", formula: str = "<math>",
                 heading: str = r"(?m)^==+ (.+?) ==+$", max_title: int = 40) -> DataFrame:
    """Files, characters, code blocks, formulas, headings and suspicious headings per corpus."""
    titles = F.regexp_extract_all(text, F.lit(heading), 1)
    odd = lambda t: t.rlike(SUSPICIOUS_TITLE) | (F.length(t) > max_title) | F.trim(t).isin(*SUSPICIOUS_WORDS)
    return df.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length(text)).alias("chars"), F.sum(F.regexp_count(text, F.lit(code))).alias("code"),
        F.sum(F.regexp_count(text, F.lit(formula))).alias("formulas"), F.sum(F.size(titles)).alias("headings"),
        F.sum(F.size(F.filter(titles, odd))).alias("suspicious"))


def markup_lint(df: DataFrame, page: str, text: str) -> DataFrame:
    """(page, line, issue): unbalanced braces, formulas and tables, bad headings, misplaced categories."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    page_rules = [
        ("braces", F.regexp_count(text, F.lit(r"\{\{")), F.regexp_count(text, F.lit(r"\}\}"))),
        ("math", count("<math>"), count("</math>")), ("table", count(r"(?m)^\{\|"), count(r"(?m)^\|\}"))]
    whole = F.array_compact(F.array(*[F.when(a != b, F.struct(F.lit(0).alias("line"), F.lit(n).alias("issue"))) for n, a, b in page_rules]))

    def line_issue(ln: Column) -> Column:
        lead = F.length(F.regexp_extract(ln, r"^(=*)", 1))
        tail = F.length(F.regexp_extract(ln, r"(=*)$", 1))
        body = F.regexp_replace(F.regexp_replace(ln, r"^=+", ""), r"=+$", "")
        heading = (
            F.when(ln.rlike("^=[^=]"), "level_one_heading")
            .when(ln.rlike("^={2,6}") & (tail == 0), "heading_not_closed")
            .when(ln.rlike("^={2,6}") & (lead != tail), "heading_runs_differ")
            .when(ln.rlike("^={2,6}") & F.rtrim(body).endswith("="), "heading_extra_mark"))
        category = F.when(F.contains(ln, F.lit("[[Category:")) & ~F.trim(ln).startswith("[[Category:"), "category_not_alone")
        return F.array_compact(F.array(heading, category))

    by_line = F.flatten(F.transform(F.split(text, "\n"), lambda ln, i: F.transform(
        line_issue(ln), lambda issue: F.struct((i + 1).alias("line"), issue.alias("issue")))))
    return df.select(F.col(page).alias("page"), F.inline(F.concat(whole, by_line)))


def finding_priority(impact: Column, confidence: Column, effort: Column, risk: Column) -> Column:
    """impact * confidence / (effort * penalty of the risk), three digits."""
    penalty = F.when(risk == "low", 1.0).when(risk == "medium", 1.5).when(risk == "high", 2.5)
    return F.round(impact * confidence / (effort * penalty), 3)
