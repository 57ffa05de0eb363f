"""Folder trees of text files as a Spark source: skip list, suffixes and size limit are applied while walking."""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritab.sources.readers import NOT_UTF8, TOO_LONG, decoded

UNREADABLE = "not readable"
# Folders that hold no source text. Folders and files with a leading dot are left out too.
SKIP_FOLDERS = ("venv", "node_modules", "__pycache__", "data", "dist", "build")
_SCHEMA = "path string, content binary, reason string"
_BATCH_BYTES = 8 << 20


def local_path(path: str) -> str:
    """Path of a mounted folder; other file systems have no folders that a task could walk."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: only mounted folders can be walked")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class _Share(InputPartition):
    """Files of folders whose path's checksum leaves ``part`` modulo ``parts``; deep folders with all below them."""

    folders: list[tuple[str, bool]]
    part: int
    parts: int


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.skip = set(filter(None, options.get("skip", "").split("/")))
        self.suffixes = tuple(filter(None, options.get("suffixes", "").split("/")))
        self.max_bytes = int(options["maxbytes"]) if "maxbytes" in options else None
        self.slices = int(options.get("slices", 64))

    def _entries(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """(folders below, files) that are looked at, links never."""
        below, files = [], []
        with os.scandir(folder) as entries:
            for e in entries:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in self.skip:
                        below.append(e.path)
                elif not self.suffixes or os.path.splitext(e.name)[1].lower() in self.suffixes:
                    files.append(e)
        return below, files

    def partitions(self) -> list[InputPartition]:
        """Folders are opened, widest first, until there are enough for all slices; the tasks walk what lies below."""
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is not a folder")
        flat, deep = [], deque([self.root])
        while deep and len(flat) + len(deep) < self.slices:
            folder = deep.popleft()
            below, files = self._entries(folder)
            deep.extend(below)
            if files:
                flat.append(folder)
        units = [(f, False) for f in flat] + [(f, True) for f in deep]
        if not units:
            return [_Share([], 0, 1)]
        # Few folders are shared by several tasks each, many are dealt out.
        parts = -(-self.slices // len(units))
        groups = [units[i::self.slices] for i in range(min(self.slices, len(units)))]
        return [_Share(group, part, parts) for group in groups for part in range(parts)]

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for folder, below in share.folders:
            for row in self._walk(folder, below, share):
                rows.append(row)
                size += len(row[1] or b"")
                if size >= _BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)

    def _walk(self, folder: str, deep: bool, share: _Share) -> Iterator[tuple[str, bytes | None, str | None]]:
        open_ = [folder]
        while open_:
            below, files = self._entries(open_.pop())
            if deep:
                open_ += below
            for entry in files:
                path = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
                if zlib.crc32(os.fsencode(path)) % share.parts == share.part:
                    yield path.encode("utf-8", "replace").decode(), *self._content(entry)

    def _content(self, entry: os.DirEntry) -> tuple[bytes | None, str | None]:
        try:
            if self.max_bytes is not None and entry.stat(follow_symlinks=False).st_size > self.max_bytes:
                return None, TOO_LONG
            with open(entry.path, "rb") as file:
                return file.read(), None
        except OSError:
            return None, UNREADABLE


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, content, reason = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(reason, pa.string())],
                                      names=["path", "content", "reason"])


class TreeSource(DataSource):
    """``spark.read.format("text_tree")`` with options path, skip and suffixes (joined by /), maxBytes and slices."""

    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader({k.lower(): v for k, v in self.options.items()})


def scan_tree(
    spark: SparkSession, root: str, suffixes: Sequence[str] = (), skip: Sequence[str] = SKIP_FOLDERS,
    max_bytes: int | None = None, slices: int | None = None,
) -> DataFrame:
    """(path, sha256, n_chars, content, reason): every file looked at, with its text or the reason why it has none.

    ``root`` is a folder that all executors have mounted; paths are relative to it. Hidden and skipped folders are
    never opened, links never followed, files of other suffixes not listed, files above ``max_bytes`` not
    read. A leading byte order mark is no part of the text. One file is one value in a task.
    """
    spark.dataSource.register(TreeSource)
    source = spark.read.format("text_tree").option("path", root).option("skip", "/".join(skip)).option("suffixes", "/".join(s.lower() for s in suffixes))
    source = source.option("slices", slices or 4 * spark.sparkContext.defaultParallelism)
    files = (source if max_bytes is None else source.option("maxBytes", max_bytes)).load()
    reason = F.coalesce("reason", F.when(~F.is_valid_utf8(F.col("content").cast("string")), NOT_UTF8))
    text = F.when(reason.isNull(), decoded(F.col("content")))
    return files.select("path", reason.alias("reason"), text.alias("content")).select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars"), "content", "reason")
