"""Document quality by Bradley-Terry ranking of preference pairs.

A labelled document of quality 1 is preferred to one of quality 0. Scores are linear in text features;
their weights minimise the logistic loss of feature differences over pairs. The threshold is a
quantile of the fitted scores, moved to the probability the caller asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import textkit
from veritab.llm.language import held_out
from veritab.llm.links import stored

# Bound of the fit: expected labelled rows, by a hash of the id; pairs per rarer-class row.
FIT_ROWS = 20_000
PAIRS_PER_ROW = 40
RIDGE = 1e-2
THRESHOLD = 0.3

_GROUPS = {
    "upper": np.arange(0x41, 0x5B), "digit": np.arange(0x30, 0x3A), "space": np.array([0x20, 0x09]), "line": np.array([0x0A]),
    "stop": np.frombuffer(b".,;:?'\"-()", np.uint8), "bang": np.frombuffer(b"!", np.uint8),
    "odd": np.frombuffer(b"#$%&*@^~<>|/\\{}[]=+_`", np.uint8), "high": np.arange(0x80, 0x100), "control": np.r_[0:9, 11:32],
}
_KIND = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_GROUPS.values(), 1):
    _KIND[_bytes] = _i
FEATURES = [*_GROUPS, "log_words", "word_length", "long_words", "distinct", "repeat_pairs", "top_word", "words_per_line", "short_text"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of consecutive texts."""
    n = len(off) - 1
    raw, off = data[off[0]:off[-1]], off - off[0]
    size = np.diff(off).astype(float)
    groups = len(_GROUPS) + 1
    key = _KIND[raw] + np.repeat(np.arange(n) * groups, np.diff(off))
    counts = np.bincount(key, minlength=n * groups).reshape(n, groups).astype(float)
    value, start, end, first = textkit.words(raw, off, textkit.SPACED)
    words, doc = np.diff(first).astype(float), np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(float)
    total, long_ = np.bincount(doc, length, n), np.bincount(doc[length > 15], minlength=n)
    # Word counts within each document, and of neighbouring words, from one sort by (document, hash).
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times, owner = np.diff(np.append(at, len(v))), d[at]
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    distinct = np.bincount(owner, minlength=n)
    pair, pair_doc, _ = textkit.shingles(value, first, 2)
    pairs = np.bincount(pair_doc, minlength=n).astype(float)
    _, bounds = textkit.distinct(pair, pair_doc, n)
    shares = _ratio(counts[:, 1:], size[:, None])
    return np.column_stack([shares, np.log1p(words), _ratio(total, words), _ratio(long_, words), _ratio(distinct, words),
                            1 - _ratio(np.diff(bounds), pairs), _ratio(top, words), np.log1p(_ratio(words, counts[:, 1 + list(_GROUPS).index("line")] + 1)),
                            np.maximum(0, 1 - words / 50)])


def _rows(batches):
    for batch in batches:
        data, off = textkit.buffers(batch.column("text"))
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        for lo, hi in textkit.chunks(off):
            x = _features(data, off[lo:hi + 1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in rest],
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))],
                                             names=[*[batch.schema.names[i] for i in rest], "x"])


class Ranking:
    """Standardised linear score with the threshold at zero."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._basis(x)
        self.weight, self.cut = np.zeros(z.shape[1]), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            self._fit(z, good, bad)

    def _basis(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, clipped, and their squares: both too much and too little may count."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z], axis=1)

    def _fit(self, z: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        rng = np.random.default_rng(1)
        count = PAIRS_PER_ROW * min(len(good), len(bad)) + len(good) + len(bad)
        d = z[np.resize(rng.permutation(good), count)] - z[rng.permutation(np.resize(rng.permutation(bad), count))]
        w = self.weight
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = d.T @ (p - 1) / count + RIDGE * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / count + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weight = w
        # The quantile of the scores at which errors cost least; a good document lost costs three bad ones kept.
        score = z @ w
        levels = np.quantile(score, np.linspace(0, 1, 401))
        wrong = [3 * (score[good] < c).mean() + (score[bad] >= c).mean() for c in levels]
        best = np.flatnonzero(np.isclose(wrong, min(wrong)))
        self.cut = float((levels[best[0]] + levels[best[-1]]) / 2)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Score in 0 to 1; THRESHOLD stands at the chosen quantile."""
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self._basis(x) @ self.weight - self.cut + shift, -30, 30)))


def _scores(model: Ranking):
    def run(batches):
        for batch in _rows(batches):
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.probability(x))], names=["id", "score"])
    return run


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                 *, modulus: int = 5, rest: int = 0) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    Learns from labelled rows (0 or 1) with an id whose crc32 as text does not leave ``rest``; a null id or label
    is never learned from. A document with several labels counts once per label. Without labels of
    both kinds every score is the threshold itself. A null text is empty; empty texts get the
    score of their features. Repeated rows each get their row. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    marks = stored(marks.filter(~held_out(F.col("id"), modulus, rest)).distinct())
    share = min(1.0, FIT_ROWS / max(marks.count(), 1))
    chosen = marks.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    learn = base.join(chosen, "id").select("y", "text").mapInArrow(_rows, "y int, x array<double>").toPandas()
    x = np.array(learn["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T[::-1], learn["y"].to_numpy()))
    model = Ranking(x[order], learn["y"].to_numpy()[order]) if len(x) else Ranking(np.zeros((1, len(FEATURES))), np.array([2]))
    found = base.mapInArrow(_scores(model), f"id {dict(base.dtypes)['id']}, score double")
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), modulus, rest).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
