"""Sealed confirmation batches: staged rows, one exclusive manifest per append as its commit point.

Manifests are numbered. An append checks its rows against everything committed so far and then claims the next number; if another
writer was faster, it checks again what that one added. So two writers never commit one purpose, nor batches that share content or
units, and a writer that dies leaves staged files that no manifest names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.evidence import reuse_conflicts
from veritab.sources.sinks import row_digest, table_digest

# Fixed form of purposes.
PURPOSE = re.compile(r"C[1-9][0-9]*")


class Rejected(ValueError):
    """A batch that may not be sealed, with the reason and what it meets."""

    def __init__(self, reason: str, conflicts: dict[str, int] | None = None):
        super().__init__(f"{reason} {conflicts}" if conflicts else reason)
        self.reason, self.conflicts = reason, conflicts or {}


class SealedStore:
    """Append-only batches under ``path``, a folder that all executors and writers share.

    Rows carry ``fingerprint``, ``unit_keys`` (a list; empty where unresolved) and ``event_time``, as the quality assessment gives
    them. The commit needs a file system whose exclusive create is atomic (a local one or HDFS).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifests(self) -> list[dict]:
        """Committed appends in order: one small file each."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("commits")) if s.getPath().getName().isdigit())
        return [json.loads(self._read(f"commits/{n}")) for n in names]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rows(self) -> DataFrame | None:
        """All committed rows with their purpose; None before the first commit."""
        return self._rows(self.manifests())

    def _rows(self, manifests: list[dict]) -> DataFrame | None:
        out = None
        for m in manifests:
            part = self.spark.read.parquet(f"{self.path}/data/{m['data']}").withColumn("purpose", F.lit(m["purpose"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), False)
        stream.write(text.encode())
        stream.close()

    def _claim(self, number: int, text: str) -> bool:
        """Create the manifest of that number with its content, or find that it exists."""
        name = f"commits/{number:08d}"
        try:
            if self._fs.getUri().getScheme() != "file":
                self._write(name, text)
                return True
            # A link appears with its content and never replaces a file.
            spare = f"spare-{uuid.uuid4().hex}"
            self._write(spare, text)
            file = lambda n: self._jvm.java.io.File(self._path(n).toUri().getPath()).toPath()
            try:
                self._jvm.java.nio.file.Files.createLink(file(name), file(spare))
            finally:
                self._fs.delete(self._path(spare), False)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def append(self, batch: DataFrame, purpose: str, protocol: str, *, temporal: bool = False, assess: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Assess, check and seal a batch under a new purpose; returns its manifest or raises ``Rejected``.

        ``assess`` is the quality assessment of records (B2); without it the rows bring its columns. The batch is refused when
        empty, when the purpose is malformed or taken, or when its content or units are committed already (C3). All rows are sealed, quarantined
        ones too, as their status says.
        """
        if not PURPOSE.fullmatch(purpose):
            raise Rejected("a purpose is C1, C2, ..")
        data = f"{purpose}-{uuid.uuid4().hex}"
        try:
            return self._sealed(batch if assess is None else assess(batch), purpose, protocol, temporal, data)
        except Exception:
            self._fs.delete(self._path(f"data/{data}"), True)
            raise

    def _sealed(self, assessed: DataFrame, purpose: str, protocol: str, temporal: bool, data: str) -> dict:
        assessed.write.parquet(f"{self.path}/data/{data}")
        staged = self.spark.read.parquet(f"{self.path}/data/{data}")
        digest = table_digest(staged.select(row_digest(*sorted(staged.columns)).alias("d")), "d").first()
        if digest is None or not digest.record_count:
            raise Rejected("empty batch")
        manifest = {"purpose": purpose, "protocol": protocol, "data": data, "rows": int(digest.record_count), "digest": digest.digest}
        seen = 0
        while True:
            known = self.manifests()
            if purpose in {m["purpose"] for m in known}:
                raise Rejected("purpose is taken")
            # What was checked before stays checked: manifests are never changed.
            self._check(staged, known[seen:], protocol, temporal)
            seen = len(known)
            if self._claim(seen, json.dumps(manifest)):
                return manifest | {"number": seen}

    def _check(self, staged: DataFrame, manifests: list[dict], protocol: str, temporal: bool) -> None:
        rows = self._rows(manifests)
        if rows is None:
            return
        by = {m["purpose"]: m["protocol"] for m in manifests}
        named = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("purpose")]
        each = rows.select("fingerprint", "event_time", named.alias("protocol_id"), F.explode_outer("unit_keys").alias("unit_key"))
        # A unit of several protocols counts as another one's.
        own = F.when(F.min("protocol_id") == F.max("protocol_id"), F.min("protocol_id"))
        timed = F.when(F.count("event_time") == F.count(F.lit(1)), F.max("event_time"))
        units = each.filter("unit_key is not null").groupBy("unit_key").agg(own.alias("protocol_id"), timed.alias("latest_time"))
        batch = staged.select("fingerprint", "event_time", F.explode_outer("unit_keys").alias("unit_key"))
        found = reuse_conflicts(batch, each, units, protocol, temporal).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
        if found:
            raise Rejected("met before", {r.kind: r.n for r in found})
