"""Words and their hashes for whole Arrow batches, in NumPy, straight from the text buffers.

A batch of texts is one byte buffer with offsets, so words of thousands of documents
are found and hashed by a few array operations and no text becomes a Python object.
Work goes through pieces of bounded size; a text longer than a piece is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _lower_table(keep: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[~keep] = 0
    return table


def _all_but(*ranges: tuple[int, int]) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    for low, high in ranges:
        keep[low:high + 1] = False
    return keep


# Bytes of words after lower-casing A-Z, 0 where no word is. UTF-8 bytes over 0x7F always belong to words.
ALNUM = _lower_table(_all_but((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SPACED = _lower_table(_all_but((0x20, 0x20), (0x09, 0x0D)))  # [^\x20\x09-\x0D]+
# A NUL byte is part of a word of the second kind; 0 is taken by "no word", so it hashes as a byte UTF-8 never has.
SPACED[0] = 0xFF


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeds(count: int, salt: int = 0) -> np.ndarray:
    """Fixed odd 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(salt * 1000003)) * _BASE) | np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text.

    Workers live on between batches and stages, so what earlier batches left in Arrow's pool is given back first.
    """
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(offsets: np.ndarray, limit: int = PIECE_BYTES // 2) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse))
    return _POWERS[size]


def _piece_words(data: np.ndarray, edges: np.ndarray, table: np.ndarray):
    low = table[data]
    word = low != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * power[:len(data)], out=total[1:])
        value = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _M2)
    return start, end, value


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Words of consecutive documents: (hash, start byte, end byte, first word of each document).

    ``data`` is the bytes from ``offsets[0]`` on; starts and ends count from there. The last
    array has one entry more than there are documents.
    """
    off = offsets - offsets[0]
    n, at, parts = int(off[-1]), 0, []
    while at < n:
        stop = min(n, at + PIECE_BYTES)
        if stop < n:
            # Cut at the last document end or separator of the piece; a word longer than a piece is kept whole.
            k = int(off[np.searchsorted(off, stop, side="right") - 1])
            if k > at:
                stop = k
            else:
                gap = np.flatnonzero(table[data[at:stop]] == 0)
                while not len(gap) and stop < n:
                    stop = min(n, stop + PIECE_BYTES)
                    gap = np.flatnonzero(table[data[at:stop]] == 0)
                if len(gap):
                    stop = at + int(gap[-1]) + 1
        lo, hi = np.searchsorted(off, [at, stop], side="left")
        s, e, v = _piece_words(data[at:stop], off[lo:hi + 1] - at, table)
        parts.append((v, s + at, e + at))
        at = stop
    if parts:
        value, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        value, start, end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return value, start, end, np.searchsorted(start, off, side="left")


def shingles(value: np.ndarray, first: np.ndarray, k: int):
    """Hashes of k words in a row within each document: (hash, document, index of the first word).

    A document of fewer words, but not none, has its whole sequence as one shingle.
    """
    n = len(first) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(value))
    full = at + k <= first[1:][doc] if len(value) else np.zeros(0, bool)
    factor = seeds(k, 7)
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(value) - k + 1, 0), np.uint64)
        for j in range(k):
            out += value[j:len(value) - k + 1 + j] * factor[j] if len(out) else out
        out = mix(out)
        at, doc_full = at[full], doc[full]
        out = out[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((count > 0) & (count < k))
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            own = value[first[d]:first[d + 1]]
            extra[i] = mix((own * factor[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)) * _M1)[()]
    if not len(short):
        return out, doc_full, at
    value, doc, at = np.concatenate([out, extra]), np.concatenate([doc_full, short]), np.concatenate([at, first[short]])
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order], at[order]


def distinct(value: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per document, sorted within each: (values, first value of each document).

    ``doc`` is not decreasing.
    """
    bounds = np.searchsorted(doc, np.arange(n + 1))
    parts = [np.unique(value[bounds[i]:bounds[i + 1]]) for i in range(n)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else value[:0]), first
