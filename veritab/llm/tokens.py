"""Token ids of whole Arrow batches for the public byte-level BPE vocabulary.

The splitting pattern of the vocabulary never joins two words over certain places (between a letter
and a mark, before a white space that follows a word, after a line end). Batches are cut at those
places with array operations; each different segment is encoded once by the tokenizer and kept in a
bounded hash table, and the ids of the texts are put together from it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from veritab.llm import textkit

# Segments kept per Python worker; past this the table starts anew. It bounds memory, results do not depend on it.
KEPT_SEGMENTS = 400_000
SLOT_BITS = 20

_LETTER, _MARK, _BLANK, _BREAK, _OTHER = 1, 2, 3, 4, 0
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
for _low, _high, _kind in ((0x30, 0x39, _OTHER), (0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0x20, 0x20, _BLANK), (0x09, 0x0A, _BREAK), (0x0D, 0x0D, _BREAK)):
    _CLASS[_low:_high + 1] = _kind
# Digits and UTF-8 letters of two bytes other than those led by C2 are no white space; nothing else is assumed of them.
_SOLID = np.isin(_CLASS, (_LETTER, _MARK))
_SOLID[0x30:0x3A] = True


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of segments that are encoded apart; ``off`` are the document bounds."""
    kind = _CLASS[data]
    solid = _SOLID[data]
    two = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    solid[1:] |= two
    cut = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    cut[1:] = (solid[:-1] & (here >= _BLANK)) | ((before == _LETTER) & (here == _MARK))
    # A single line end or tab between words stands alone; in a longer run the next word decides, so runs stay whole.
    lone = (kind[1:-1] == _BREAK) & solid[:-2]
    cut[2:] |= lone & (solid[2:] | ((data[2:] >= 0xC3) & (data[2:] <= 0xDF)))
    cut[off[off < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of consecutive texts: ``encode`` returns (ids, first id of each document)."""

    def __init__(self, path: str):
        self.path = path
        self._reset()

    def _reset(self) -> None:
        # Entry i holds ids[start[i]:start[i] + count[i]]; two slots per hash lead to it.
        self.slots = [np.full(1 << SLOT_BITS, -1, np.int32) for _ in range(2)]
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _slot(value: np.ndarray, which: int) -> np.ndarray:
        return ((value >> np.uint64(SLOT_BITS * which)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def _find(self, value: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        at = self.slots[0][self._slot(value, 0)]
        if not len(self.keys):
            return at
        miss = np.flatnonzero((at < 0) | (self.keys[at] != value))
        if len(miss):
            second = self.slots[1][self._slot(value[miss], 1)]
            at[miss] = np.where((second >= 0) & (self.keys[second] == value[miss]), second, -1)
        return at

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        lists = [e.ids for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]
        count = np.array([len(x) for x in lists], np.int64)
        entry = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.keys = np.concatenate([self.count, count]), np.concatenate([self.keys, keys])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))])
        for which in range(2):
            slot = self._slot(keys, which)
            free = self.slots[which][slot] < 0
            self.slots[which][slot[free]] = entry[free]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, off = data[off[0]:off[-1]], off - off[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        begin = _cuts(data, off)
        end = np.append(begin[1:], len(data))
        value = _segment_hashes(data, begin, end)
        if len(self.keys) > KEPT_SEGMENTS:
            self._reset()
        at = self._find(value)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            keys, sample, inverse = np.unique(value[miss], return_index=True, return_inverse=True)
            raw, old = data.tobytes(), len(self.keys)
            self._learn(keys, [raw[begin[i]:end[i]].decode() for i in miss[sample].tolist()])
            at[miss] = old + inverse
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[spread(self.start[at], count)], total[np.searchsorted(begin, off, side="left")]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each count, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)



def _segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment, by pieces of bounded size."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(end, start[at] + textkit.PIECE_BYTES, side="right")), at + 1)
        s, e = start[at:stop] - start[at], end[at:stop] - start[at]
        power, inverse = textkit._powers(int(e[-1]) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(e[-1] + 1, np.uint64)
            raw = data[start[at]:end[stop - 1]].astype(np.uint64) + np.uint64(1)
            np.cumsum(raw * power[:len(raw)], out=total[1:])
            out[at:stop] = textkit.mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * textkit._M2)
        at = stop
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, column: int, path: str):
    """(first document, last document + 1, ids, first id of each document) by ranges of bounded size; null is empty."""
    data, off = textkit.buffers(batch.column(column))
    for lo, hi in textkit.chunks(off):
        yield lo, hi, *encoder(path).encode(data, off[lo:hi + 1])
