"""Sequence packing by the sum-of-squares rule, over shards of pieces.

A document's ids plus an end id go into one sequence if they fit; a longer document is cut into
full pieces, the first one shorter. Full pieces are sequences of their own and are not moved. The
others are dealt to shards of a bounded number of pieces and placed from the longest to the shortest: a
piece goes to the open sequence that leaves the sum of squared counts of open sequences per
remaining gap least (ties: the least gap left); a new sequence is opened where none has room. The
rule in its online form may open a sequence while others have room, which needs more sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import tokens
from veritab.llm.links import stored

PIECES_PER_SHARD = 50_000


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, ids, first in tokens.encoded(batch, 1, path):
                n = hi - lo
                # One end id after each document.
                whole = np.full(len(ids) + n, end_id, np.uint32)
                keep = np.ones(len(whole), bool)
                keep[first[1:] + np.arange(n)] = False
                whole[keep] = ids
                bounds = first + np.arange(n + 1)
                size = np.diff(bounds)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = tokens.spread(np.zeros(n, np.int64), count)
                # The pieces after the first are full, counted from the document's end.
                start = np.maximum(size[doc] - (count[doc] - piece) * capacity, 0)
                stop = size[doc] - (count[doc] - piece - 1) * capacity
                raw, at = whole.astype("<u4"), bounds[doc]
                crc = [zlib.crc32(raw[s:e]) for s, e in zip((at + start).tolist(), (at + stop).tolist(), strict=True)]
                out = [batch.column(0).slice(lo, n).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at + start, len(whole)), pa.int32()), pa.array(whole.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
    return run


class _Shard:
    """Open sequences of one shard by gap."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.open_ = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        held = self.count[size:]
        gaps = np.flatnonzero(held)
        if len(gaps):
            # Gap g loses one and gap g - size gains one; a full sequence counts no more.
            rise = np.where(gaps > 0, 2 * self.count[gaps] + 1, 0) - 2 * held[gaps] + 1
            left = int(gaps[np.argmin(rise)])
            gap = left + size
            seq = self.open_[gap].pop()
            self.count[gap] -= 1
        else:
            seq, gap, left = self.made, self.capacity, self.capacity - size
            self.made += 1
        if left:
            self.open_[left].append(seq)
            self.count[left] += 1
        return seq, self.capacity - gap


def _pack(capacity: int):
    def run(batches):
        shard, base = _Shard(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [shard.place(s) for s in batch.column("length").to_pylist()]
            seq = pa.array([base + s for s, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, seq, pa.array([o for _, o in placed], pa.int64())],
                                             names=[*batch.schema.names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2,
         path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A null text is empty and gives one piece of the end id alone. Null and repeated doc_ids keep a
    row per piece of each input row. ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian
    unsigned 32-bit numbers; ``keep_ids`` adds the ids. Other columns are ignored; an empty table
    gives no row. Sequence numbers are not consecutive.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {dict(source.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    made = source.mapInArrow(_pieces(path or tokens.default_path(), capacity, end_id, keep_ids), kind)
    # A row number spreads pieces evenly whatever their ids; it is stored, so a repeated task sees the same order.
    pieces = stored(made.withColumn("row", F.monotonically_increasing_id()))
    parts = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-parts.count() // PIECES_PER_SHARD))
    dealt = parts.repartition(shards, "row").sortWithinPartitions(F.desc("length"), "row")
    packed = dealt.mapInArrow(_pack(capacity), f"{kind}, row long, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).drop("row").withColumnRenamed("id", "doc_id")
