"""Gap filter as a stateful stream: open rows wait for the watermark, then one time per user is kept."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Stores lists and timers beside values.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# User id of the row that ends a finite input.
CLOSING = ""
_CLASS = "spark.sql.streaming.stateStore.providerClass"


# Rows are stored by the part they came in: one value that is never null, whatever its columns hold.
_ROWS = T.StructType([T.StructField("rows", T.BinaryType())])


def _values(column: pd.Series) -> list:
    return (column.astype(object).where(column.notna(), None) if column.hasnans else column).tolist()


class _Gaps(StatefulProcessor):
    """Per user: rows the watermark has not passed, and the time of the last row that it has."""

    def __init__(self, row: T.StructType, min_gap: int, ties: list[str], forget: int | None):
        self.min_gap, self.ties, self.forget = min_gap, ties, forget
        self.columns = [f.name for f in row.fields]
        self.time, self.order = self.columns.index("t"), [self.columns.index(c) for c in ["t", *ties]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _ROWS)
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, parts = None, []
        for part in rows:
            parts.append((pickle.dumps(list(zip(*(_values(part[c]) for c in self.columns), strict=True))),))
            low = int(part["t"].min())
            first = low if first is None else min(first, low)
        if parts:
            self.open.appendList(parts)
            # One timer for the earliest row: when it fires, all rows the watermark has passed go.
            self.handle.registerTimer(first * 1000)
        yield from ()

    def _rank(self, row: tuple) -> list[tuple]:
        """Nulls come first."""
        return [(row[i] is not None, row[i]) for i in self.order]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        # A row up to the last time has gone with an earlier timer's, and with it all others that could.
        gone = last is not None and expiredTimerInfo.getExpiryTimeInMs() <= last * 1000
        rows = [row for part in self.open.get() for row in pickle.loads(part[0])] if not gone and self.open.exists() else []
        done = sorted((row for row in rows if row[self.time] * 1000 <= passed), key=self._rank)
        if done:
            rest = [row for row in rows if row[self.time] * 1000 > passed]
            if rest:
                self.open.put([(pickle.dumps(rest),)])
                self.handle.registerTimer(min(row[self.time] for row in rest) * 1000)
            else:
                self.open.clear()
            times = [last, *(row[self.time] for row in done)]
            gap = [None if a is None else b - a for a, b in pairwise(times)]
            outcome = ["too_fast" if g is not None and g < self.min_gap else "kept" for g in gap]
            last = times[-1]
            self.last.update((last,))
            if self.forget is not None:
                self.handle.registerTimer((last + self.forget) * 1000)
            yield pd.DataFrame([(*row, g, o) for row, g, o in zip(done, gap, outcome, strict=True)], columns=[*self.columns, "gap", "outcome"], dtype=object)
        elif self.forget is not None and last is not None and (last + self.forget) * 1000 <= passed:
            self.last.clear()

    def close(self) -> None:
        pass


def gap_stream(events: DataFrame, min_gap: int, ties: list[str], delay: str = "30 minutes", forget: int | None = None) -> DataFrame:
    """Events with ``gap`` and ``outcome`` (kept or too_fast) per user, each once the watermark has passed it.

    ``events`` is a streaming frame with user_id, t (epoch seconds) and ts, the same as an event-time column. Rows may come in any
    order within ``delay`` and the result is the batch filter's; rows behind the watermark are dropped by Spark.
    The state holds rows of the last ``delay`` and one time per user. With ``forget`` (seconds, at least ``min_gap``) that time goes
    too when a user stays away so long; the next event then counts as the user's first (kept, as before, but without a gap).
    Needs the state store of ``PROVIDER``.
    """
    if forget is not None and forget < min_gap:
        raise ValueError("forget must be at least min_gap")
    row = T.StructType([f for f in events.schema.fields if f.name != "ts"])
    out = T.StructType([*row.fields, T.StructField("gap", T.LongType()), T.StructField("outcome", T.StringType())])
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(
        _Gaps(row, min_gap, ties, forget), out, "append", "eventTime")


def run_gap_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, min_gap: int, ties: list[str],
    files_per_batch: int = 8, delay: str = "30 minutes", forget: int | None = None,
) -> DataFrame:
    """Run the stream over the files of a folder, oldest first, and read the result.

    Rows that the watermark has not passed stay in the state for the next run; ``closing_row`` ends a finite input.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    before = spark.conf.get(_CLASS)
    spark.conf.set(_CLASS, PROVIDER)
    try:
        flow = gap_stream(events, min_gap, ties, delay, forget).filter(~F.col("user_id").eqNullSafe(CLOSING)).writeStream.format("parquet").option(
            "path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_CLASS, before)
    flow.awaitTermination()
    return spark.read.parquet(target)


def closing_row(events: DataFrame, seconds: int) -> DataFrame:
    """The latest row as one of the user ``CLOSING``, ``seconds`` (more than the stream's delay) later: it moves the watermark past all others."""
    end = events.agg(F.max_by(F.struct(*events.columns), "t").alias("row")).select("row.*").withColumn("t", F.col("t") + seconds)
    return end.withColumn("user_id", F.lit(CLOSING)).withColumn("ts", F.timestamp_seconds("t")).select(*events.columns)


__all__ = ["closing_row", "gap_stream", "run_gap_stream"]
