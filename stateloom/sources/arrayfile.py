"""A Spark data source for .npy files: each task reads a range of a file's rows, so one file may be larger than a task.

    spark.dataSource.register(NpyRows)
    spark.read.format("npy_rows").option("pattern", "*.npy").load("/data/sessions")

Paths are local (a folder that all machines share) or URIs that Arrow's file systems open (file:, s3:, gs:, hdfs:)."""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "session_id string, t int, y array<double>, x array<double>"
#: Bytes of an array that one task reads, and that it holds at once.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(paths: list[str], pattern: str) -> list[tuple[str, str]]:
    """(given path, path inside its file system) of the files meant; a folder's that match the pattern, in order."""
    from pyarrow import fs

    out = []
    for given in paths:
        store, inner = _opened(given)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(inner))
            out += [(given, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
        elif info.type == fs.FileType.File:
            out.append((given, inner))
        else:
            raise FileNotFoundError(given)
    return out


def header(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, column order, type, where the data start) from the first bytes of a file."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject or not shape:
        raise ValueError("not an array of numbers with rows")
    return shape, fortran, kind, f.tell()


@dataclass
class _Rows(InputPartition):
    given: str
    inner: str
    first: int
    n: int
    shape: tuple
    fortran: bool
    kind: str
    at: int


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        paths = self.options.get("paths") or self.options.get("path")
        size, out = int(self.options.get("partbytes", PART_BYTES)), []
        for given, inner in _files(paths.split("\n"), self.options.get("pattern", "*.npy")):
            store, _ = _opened(given)
            with store.open_input_file(inner) as f:
                shape, fortran, kind, at = header(f.read(1 << 16))
            row = max(1, kind.itemsize * int(np.prod(shape[1:], dtype=np.int64)))
            n = max(1, size // row)
            out += [_Rows(given, inner, i, min(n, shape[0] - i), shape, fortran, kind.str, at) for i in range(0, shape[0], n)]
        return out or [_Rows("", "", 0, 0, (0,), False, "<f8", 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        p, kind = partition, np.dtype(partition.kind)
        if not p.n:
            return
        q = int(np.prod(p.shape[1:], dtype=np.int64))
        step = max(1, BATCH_BYTES // max(1, kind.itemsize * q))
        name = p.inner.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        store, _ = _opened(p.given)
        with store.open_input_file(p.inner) as f:
            for i in range(p.first, p.first + p.n, step):
                n = min(step, p.first + p.n - i)
                if p.fortran:  # a piece of each column; of more axes, in the order of rows' own
                    cells = np.stack([np.frombuffer(f.read_at(n * kind.itemsize, p.at + (j * p.shape[0] + i) * kind.itemsize), kind) for j in range(q)], 1)
                    cells = cells.reshape((n, *p.shape[1:]), order="F").reshape(n, q)
                else:
                    cells = np.frombuffer(f.read_at(n * q * kind.itemsize, p.at + i * q * kind.itemsize), kind).reshape(n, q)
                flat = pa.array(np.ascontiguousarray(cells, float).ravel())
                y = pa.ListArray.from_arrays(pa.array(np.arange(0, n * q + 1, q, dtype=np.int32)) if q else pa.array(np.zeros(n + 1, np.int32)), flat)
                t = pa.array(np.arange(i, i + n, dtype=np.int64)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), t, y, pa.nulls(n, pa.list_(pa.float64()))], ["session_id", "t", "y", "x"])


class NpyRows(DataSource):
    """Format npy_rows: session_id (the file's stem), t (the row), y (its other axes, flat) and x (null). Options: pattern
    for files of a folder, partbytes for the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def read_npy(spark: SparkSession, path: str | list[str], pattern: str = "*.npy", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of .npy files of any size, a session for each file: a file, a folder or a list of such."""
    spark.dataSource.register(NpyRows)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("npy_rows").option("paths", "\n".join(paths)).option("pattern", pattern).option("partbytes", part_bytes).load()
