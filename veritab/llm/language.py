"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language over lower-cased letters, with every run of other characters as one
space. Discounted masses and backoff weights of all languages lie in arrays sorted by n-gram hash. A
document gets the language of the lowest cross-entropy per character. Rejection is calibrated on
labelled documents that no model was fitted on: how far a document's cross-entropy may lie
above its language's usual one, given its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import textkit
from veritab.llm.links import stored

ORDER = 4
SPACE = 32
UNKNOWN = "und"
# Bound of the fit: expected labelled documents per language, whole texts, chosen by a hash of their id.
TRAIN_ROWS = 3_000
# Share of fitting documents kept for calibration, and the calibrated share of documents of the learned languages below the limit.
CALIBRATION_SHARE, ACCEPTED_SHARE, SLACK = 0.2, 0.999, 2.0

_TABLES: list[np.ndarray] = []


def _unicode_tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case as one code point) for all code points."""
    if not _TABLES:
        chars = [chr(i) for i in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        lower = np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
        _TABLES.extend([letter, lower])
    return _TABLES[0], _TABLES[1]


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, place of each kept symbol, first kept symbol per document, letters per document).

    Each document's symbols begin with ORDER - 1 spaces and, if it has letters, end with one.
    """
    letter, lower = _unicode_tables()
    n = len(off) - 1
    raw, ends = data[off[0]:off[-1]], off[1:] - off[0]
    # A line end closes each document, so no run crosses documents.
    closed = np.insert(raw, ends, 10)
    points = np.frombuffer(closed.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = (closed & 0xC0) != 0x80
    if starts.sum() == len(points):
        doc_end = np.cumsum(starts)[ends + np.arange(n)]
    else:
        # Bytes that are not UTF-8: each document by itself.
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") + "\n" for a, b in zip(off[:-1] - off[0], ends, strict=True)]
        points, doc_end = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([len(t) for t in texts])
    is_letter = letter[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    first = total[np.concatenate([[0], doc_end])]
    symbols = np.full(int(first[-1]) + n * (ORDER - 1), SPACE, np.uint32)
    count = np.diff(first)
    place = np.arange(int(first[-1])) + np.repeat((np.arange(n) + 1) * (ORDER - 1), count)
    kept = np.flatnonzero(keep)
    symbols[place] = np.where(is_letter[kept], lower[points[kept]], SPACE)
    words = np.concatenate([[0], np.cumsum(is_letter)])
    return symbols, place, first, np.diff(words[np.concatenate([[0], doc_end])])


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as columns of code points, from the earliest on."""
    out = np.full(len(columns[0]), len(columns), np.uint64) if columns else np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for col, factor in zip(columns, textkit.seeds(ORDER, 11), strict=False):
            out += col.astype(np.uint64) * factor
    return textkit.mix(out)


def _top_grams(batches):
    """n-gram counts of the highest order, one row per batch, language and n-gram."""
    for batch in batches:
        data, off = textkit.buffers(batch.column(1))
        names = batch.column(0).to_pylist()
        for lo, hi in textkit.chunks(off):
            symbols, place, first, _ = letters(data, off[lo:hi + 1])
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            langs = sorted(set(names[lo:hi]))
            lang = np.array([langs.index(x) for x in names[lo:hi]])[doc]
            columns = [symbols[place - j] for j in range(ORDER - 1, -1, -1)]
            key = gram_hash(columns) + lang.astype(np.uint64) * textkit._M1
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in lang[at]], pa.string()),
                                              *[pa.array(c[at].astype(np.int32)) for c in columns], pa.array(count)],
                                             names=["lang", *[f"c{j}" for j in range(ORDER)], "n"])


class Models:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, grams: np.ndarray, count: np.ndarray):
        self.langs = langs
        size = len(langs)
        self.orders = []
        parts = [(grams[lang == i], count[lang == i].astype(np.float64)) for i in range(size)]
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append(parts)
            # One order lower a gram counts the different symbols before it.
            parts = [_distinct(g[:, 1:]) for g, _ in parts] if order > 1 else parts
        symbols = np.unique(grams[:, -1]) if len(grams) else grams[:0, 0]
        self.uniform = 1.0 / (len(symbols) + 1)
        for parts in reversed(levels):
            gram_parts, context_parts = [], []
            for i, (g, c) in enumerate(parts):
                columns = [g[:, j] for j in range(g.shape[1])]
                key, context = gram_hash(columns), np.resize(gram_hash(columns[:-1]), len(g))
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                held, at = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(at, c, len(held)), np.bincount(at, minlength=len(held))
                gram_parts.append((key, (c - discount) / total[at], i))
                context_parts.append((held, discount * kinds / total, i))
            self.orders.append((_table(gram_parts), _table(context_parts)))

    def log2(self, columns: list[np.ndarray]) -> np.ndarray:
        """(n-grams, languages) log2 probability of the last symbol given the others."""
        p = np.full((len(columns[0]), len(self.langs)), self.uniform)
        for n, (mass, weight) in enumerate(self.orders, 1):
            own = columns[ORDER - n:]
            p = _lookup(mass, gram_hash(own), np.zeros_like(p)) + _lookup(weight, np.resize(gram_hash(own[:-1]), len(p)), np.ones_like(p)) * p
        return np.log2(p)


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, at, count = np.unique(gram_hash([grams[:, j] for j in range(grams.shape[1])]), return_index=True, return_counts=True)
    return grams[at], count.astype(np.float64)


def _table(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, first entry of each key, language and value of each entry): only what a language holds takes room."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)
    key = np.concatenate([k for k, _, _ in parts])
    lang = np.repeat(np.array([i for _, _, i in parts], np.int32), [len(k) for k, _, _ in parts])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return keys, np.append(first, len(key)), lang[order], np.concatenate([v for _, v, _ in parts])[order]


def _lookup(table: tuple, wanted: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` (rows, languages) with the values of the keys that each language holds."""
    keys, first, lang, value = table
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        row = np.flatnonzero(keys[at] == wanted)
        at = at[row]
        count = first[at + 1] - first[at]
        entry = np.arange(count.sum()) + np.repeat(first[at] - (np.cumsum(count) - count), count)
        out[np.repeat(row, count), lang[entry]] = value[entry]
    return out


class Scorer:
    """Summed log2 probabilities per document, with the vectors of n-grams met before at hand.

    The table of met n-grams only saves work: it starts anew when it is full.
    """

    BITS, KEPT = 20, 300_000

    def __init__(self, models: Models):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((len(self.models.langs), 0))

    def sums(self, symbols: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(languages, documents)"""
        columns = [symbols[place - j] for j in range(ORDER - 1, -1, -1)]
        key = gram_hash(columns)
        if len(self.keys) > self.KEPT:
            self._reset()
        slot = (key & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
        at = self.slots[slot]
        miss = np.flatnonzero((at < 0) | (self.keys[at] != key) if len(self.keys) else at < 0)
        if len(miss):
            fresh, sample, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            value = self.models.log2([c[miss[sample]] for c in columns]).T
            entry = np.arange(len(self.keys), len(self.keys) + len(fresh), dtype=np.int32)
            self.keys, self.values = np.concatenate([self.keys, fresh]), np.concatenate([self.values, value], axis=1)
            self.slots[slot[miss[sample]]] = entry
            at[miss] = entry[inverse]
        out = np.zeros((len(self.models.langs), len(first) - 1))
        held = np.flatnonzero(np.diff(first) > 0)
        if len(held):
            for i in range(len(out)):
                out[i, held] = np.add.reduceat(self.values[i][at], first[held])
        return out


def _entropies(models: Models):
    """(id, number of letters, symbols, best language, cross-entropy, margin over the second) per document."""
    def run(batches):
        scorer = Scorer(models) if models.langs else None
        for batch in batches:
            data, off = textkit.buffers(batch.column("text"))
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            for lo, hi in textkit.chunks(off):
                symbols, place, first, count = letters(data, off[lo:hi + 1])
                size = np.maximum(np.diff(first), 1)
                if scorer:
                    entropy = -scorer.sums(symbols, place, first) / size
                    order = np.argsort(entropy, axis=0, kind="stable")
                    best = order[0]
                    low = np.take_along_axis(entropy, order, 0)
                    margin = low[1] - low[0] if len(low) > 1 else np.full(len(best), 1e3)
                    names = pa.array(models.langs, pa.string()).take(pa.array(best))
                    low = low[0]
                else:
                    names, low, margin = pa.nulls(hi - lo, pa.string()), np.zeros(hi - lo), np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(lo, hi - lo) for i in rest], pa.array(count, pa.int64()), pa.array(size, pa.int64()),
                    names, pa.array(low), pa.array(margin)],
                    names=[*[batch.schema.names[i] for i in rest], "n_letters", "n_symbols", "best", "entropy", "margin"])
    return run


_FOUND = "n_letters long, n_symbols long, best string, entropy double, margin double"


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame) -> tuple[Models, dict[str, tuple[float, float, float, float]]]:
    """Models from (id, text, lang) rows, and per language (usual cross-entropy, two variance terms, limit)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("id").isNotNull())
    share = F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Models([], np.zeros(0, int), np.zeros((0, ORDER), np.int32), np.zeros(0)), {}
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, TRAIN_ROWS / n))]), F.col("lang"))
    chosen = known.filter(share < limit)
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id").cast("string")), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    fitted = chosen.filter(~apart).select("lang", "text")
    names = [f"c{j}" for j in range(ORDER)]
    grams = fitted.mapInArrow(_top_grams, f"lang string, {', '.join(f'{c} int' for c in names)}, n long")
    grams = stored(grams.groupBy("lang", *names).agg(F.sum("n").alias("n")))
    # All n-grams of the bounded fit, with languages as numbers.
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)]), F.col("lang"))
    table = grams.select(place.alias("lang"), *names, "n").toArrow()
    column = lambda c: table.column(c).to_numpy()
    models = Models(langs, column("lang"), np.stack([column(c) for c in names], axis=1), column("n"))
    seen = chosen.filter(apart).select("lang", "text").mapInArrow(_entropies(models), f"lang string, {_FOUND}")
    return models, _calibrate(seen.filter("n_letters > 0 and best = lang").select("lang", "n_symbols", "entropy").toPandas())


def _calibrate(seen) -> dict[str, tuple[float, float, float, float]]:
    """Per language: mean cross-entropy, variance per symbol and between documents, limit in deviations."""
    out = {}
    for lang, rows in seen.groupby("lang"):
        n, h = rows["n_symbols"].to_numpy(float), rows["entropy"].to_numpy()
        mean = float(np.average(h, weights=np.minimum(n, 500)))
        # Squared deviations as a / n + b, weighted towards equal relative errors.
        x, y, w = 1 / n, (h - mean) ** 2, np.minimum(n, 500)
        a, b = np.linalg.lstsq(np.stack([x, np.ones_like(x)], 1) * w[:, None], y * w, rcond=None)[0] if len(n) > 2 else (1.0, 0.01)
        a, b = max(float(a), 0.05), max(float(b), 1e-4)
        z = (h - mean) / np.sqrt(a / n + b)
        out[lang] = (mean, a, b, SLACK * max(3.0, float(np.quantile(z, ACCEPTED_SHARE))))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             modulus: int = 3, rest: int = 1) -> DataFrame:
    """One row per row: (doc_id, held_out, lang_pred, score, rejected, cross_entropy, n_letters).

    Rows whose crc32(doc_id as text) leaves ``rest`` are held out of the fit, as are rows with a null id or
    lang. lang_pred is the learned language of the lowest cross-entropy per character (ties: first by
    name), ``und`` for a text that is null or has no letter, or where nothing could be learned. score is
    the posterior of the language at equal priors times the calibrated chance that a text of it
    looks like this; rejected marks ``und`` and texts beyond the calibrated limit. Repeated rows each get
    their row; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    models, limits = fit(base.filter(~held_out(F.col("id"), modulus, rest)))
    kind = dict(base.dtypes)["id"]
    found = base.select("id", "text").mapInArrow(_entropies(models), f"id {kind}, {_FOUND}")
    z, limit = F.lit(0.0), F.lit(6.0)
    for lang, (mean, a, b, most) in limits.items():
        own = F.col("best") == lang
        z = F.when(own, (F.col("entropy") - mean) / F.sqrt(F.lit(a) / F.col("n_symbols") + b)).otherwise(z)
        limit = F.when(own, F.lit(most)).otherwise(limit)
    none = (F.col("n_letters") == 0) | F.col("best").isNull()
    posterior = 1 / (1 + F.exp(-F.least(F.col("margin") * F.col("n_symbols") * float(np.log(2)), F.lit(50.0))) * max(len(models.langs) - 1, 0))
    fits = 1 / (1 + F.exp(F.greatest(F.least(z - limit, F.lit(50.0)), F.lit(-50.0))))
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), modulus, rest).alias("held_out"),
        F.when(none, F.lit(UNKNOWN)).otherwise(F.col("best")).alias("lang_pred"),
        F.when(none, F.lit(0.0)).otherwise(posterior * fits).alias("score"),
        (none | (z > limit)).alias("rejected"), F.when(~none, F.col("entropy")).alias("cross_entropy"), "n_letters")
