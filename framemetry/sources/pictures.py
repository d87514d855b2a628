"""``pictures``: a data source of PNG folders, for batches and for streams of arriving files.

Every file is opened once, by the task that decodes it. Files are dealt into partitions by their bytes, so a
folder of many small or a few large pictures gives even tasks. What a read does not ask for is not done: without
``pixels`` in the schema only the first bytes of a file are read, and filters on ``grp`` and ``rel_path`` keep
files from being opened at all. Pictures that cannot be decoded are rows with a ``reason``.

As a stream, files are taken in the order of (modification time, path), which is also the offset; a restart
continues behind the last offset of the checkpoint, and a replayed batch reads the same files. A file that
appears with an older time than one already taken would be missed: ``settle`` seconds leave fresh files to a
later batch, for folders whose writers are not in step.

Kinds: gray of 8 and 16 bits and plain colour, as ``images.decode_pngs``; ``images.ingest_folder`` takes other
kinds too. Paths are what ``pyarrow.fs`` opens (local or mounted folders, HDFS, S3).
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
)
from pyspark.sql.types import StructType

from framemetry.session import pickled_by_value
from framemetry.sources.images import decode_pngs, png_header, resolved, unit_pixels

pickled_by_value(__name__)

SCHEMA = (
    "rel_path STRING, grp STRING, bytes BIGINT, h INT, w INT, bit_depth INT, pixels ARRAY<FLOAT>, reason STRING"
)
PARTITION_BYTES = 64 << 20
OPEN_BYTES = 1 << 20  # what opening a file is worth in bytes
STACK_BYTES = 16 << 20  # decoded together
HEADER_BYTES = 33

_KINDS = {
    "rel_path": pa.string(), "grp": pa.string(), "bytes": pa.int64(), "h": pa.int32(), "w": pa.int32(),
    "bit_depth": pa.int32(), "pixels": pa.list_(pa.float32()), "reason": pa.string(),
}


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:/"):
        root = "/" + root[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def group_of(rel_path: str) -> str:
    return rel_path.split("/")[0] if "/" in rel_path else ""


@dataclass
class Pictures(InputPartition):
    """(relative path, bytes) of the files of one task."""

    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


def dealt(files: list[tuple[str, int]], most: int) -> list[Pictures]:
    """Files in their order, as many to a task as ``most`` bytes hold, at least one."""
    parts, size = [], most
    for name, n in files:
        if size + n + OPEN_BYTES > most:
            parts.append([])
            size = 0
        parts[-1].append((name, n))
        size += n + OPEN_BYTES
    return [Pictures(p) for p in parts]


class Folder:
    """What batch and stream readers share: listing, dealing out and reading."""

    def __init__(self, schema: StructType, options: dict):
        if "path" not in options:
            raise ValueError("pictures need a path")
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle = float(options.get("settle", 0))
        self.names = schema.fieldNames()
        unknown = set(self.names) - set(_KINDS)
        if unknown:
            raise ValueError(f"pictures have no columns {sorted(unknown)}")

    def listed(self) -> list[tuple[int, str, int]]:
        """(modification time, relative path, bytes), in this order."""
        system, base = file_system(self.root)
        every = system.get_file_info(fs.FileSelector(base, recursive=self.recursive))
        found = [i for i in every if i.type == fs.FileType.File and i.path.endswith(".png")]
        return sorted((i.mtime_ns or 0, i.path[len(base.rstrip("/")) + 1 :], i.size) for i in found)

    def read(self, partition: Pictures) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.root)
        whole = "pixels" in self.names
        held, size = [], 0
        for name, n in partition.files:
            with system.open_input_stream(f"{base.rstrip('/')}/{name}") as stream:
                held.append((name, n, stream.read() if whole else stream.read(HEADER_BYTES)))
            size += n
            if size >= STACK_BYTES:
                yield self._rows(held, whole)
                held, size = [], 0
        if held:
            yield self._rows(held, whole)

    def _rows(self, held: list[tuple[str, int, bytes]], whole: bool) -> pa.RecordBatch:
        if whole:
            found = decode_pngs([content for *_, content in held])
        else:
            found = [_header(content) for *_, content in held]
        rows = []
        for (name, n, _), x in zip(held, found):
            h, w, depth, samples = (None,) * 4 if isinstance(x, str) else x
            pixels = None if samples is None else unit_pixels(samples, depth)
            rows.append((name, group_of(name), n, h, w, depth, pixels, x if isinstance(x, str) else None))
        made = dict(zip(_KINDS, zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(made[c], _KINDS[c]) for c in self.names], names=self.names)


def _header(content: bytes) -> tuple[int, int, int, np.ndarray | None] | str:
    try:
        h, w, depth, _ = png_header(content)
    except ValueError as problem:
        return str(problem)
    return h, w, depth, None


class PictureReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder, self.kept = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on names decide which files are opened; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("grp",), ("rel_path",)):
                self.kept.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        for f in self.kept:
            value = name if f.attribute == ("rel_path",) else group_of(name)
            if isinstance(f, StringStartsWith):
                ok = value.startswith(f.value)
            else:
                ok = value in (f.value if isinstance(f, In) else (f.value,))
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[Pictures]:
        files = sorted((name, n) for _, name, n in self.folder.listed() if self._wanted(name))
        return dealt(files, self.folder.partition_bytes) or [Pictures([])]

    def read(self, partition: Pictures) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class PictureStream(DataSourceStreamReader):
    """Offsets are (modification time, path) of the last file taken."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = (time.time() - self.folder.settle) * 1e9
        ready = [(t, name) for t, name, _ in self.folder.listed() if not self.folder.settle or t <= until]
        last = ready[-1] if ready else (-1, "")
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Pictures]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([(name, n) for t, name, n in self.folder.listed() if low < (t, name) <= high], self.folder.partition_bytes)

    def read(self, partition: Pictures) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class PictureSource(DataSource):
    """Options: ``path``, ``recursive`` (true), ``partitionBytes``, and ``settle`` seconds for streams."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PictureReader:
        return PictureReader(Folder(schema, self.options))

    def streamReader(self, schema: StructType) -> PictureStream:
        return PictureStream(Folder(schema, self.options))


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PictureSource)


def _schema(columns: list[str] | None) -> str:
    return SCHEMA if columns is None else ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in columns)


def read_pictures(spark: SparkSession, root: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The pictures below ``root``, with the ``columns`` that are asked for (all by default)."""
    _registered(spark)
    reader = spark.read.format("pictures").schema(_schema(columns))
    return reader.options(**options).load(resolved(spark, root))


def stream_pictures(spark: SparkSession, root: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The pictures that are and will be below ``root``, as a stream."""
    _registered(spark)
    reader = spark.readStream.format("pictures").schema(_schema(columns))
    return reader.options(**options).load(resolved(spark, root))


def frames_of(pictures: DataFrame) -> DataFrame:
    """Decoded pictures in the columns of the frames table."""
    good = pictures.where("reason IS NULL")
    return good.selectExpr("xxhash64(rel_path) AS frame_id", "rel_path", "grp", "h", "w", "bit_depth", "pixels")
