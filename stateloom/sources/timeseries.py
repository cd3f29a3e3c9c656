"""Readers and writers of session tables.

Array files (.npy, .npz, .mat) and plain text come in through Spark's own readers, so that any store it can read will do;
each file is parsed in the task that reads it. Arrays larger than a task are read by `arrayfile.read_npy`."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import matfile

SCHEMA = "session_id string, t int, y array<double>, x array<double>"


def _arrays(path: str, data: bytes) -> tuple[np.ndarray, np.ndarray | None, list[tuple[int, int]]]:
    """(y, x, sessions): a file with x only is read as y; without indices or lengths T it is one session."""
    if path.lower().endswith(".mat"):
        found = {k: v for k, v in matfile.read(data).items() if isinstance(v, np.ndarray) and v.dtype != object}
    else:
        loaded = np.load(io.BytesIO(data), allow_pickle=False)
        found = {"Y": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}
    names = {k.lower(): k for k in found}
    y = found[names["y"]] if "y" in names else found.pop(names["x"]) if "x" in names else found[next(iter(found))]
    x = found.get(names.get("x", ""), None) if "y" in names else None
    flat = lambda a: np.asarray(a, float).reshape(len(a), -1)
    if "indices" in names:
        cuts = [tuple(map(int, r)) for r in found[names["indices"]].reshape(-1, 2)]
    elif "t" in names:
        ends = np.cumsum(np.ravel(found[names["t"]]).astype(int))
        cuts = list(zip([0, *ends[:-1]], ends))
    else:
        cuts = [(0, len(y))]
    return flat(y), None if x is None else flat(x), cuts


def resolve_files(spark: SparkSession, files: str | list[str], pattern: str = "*.{npy,npz,mat}") -> DataFrame:
    """(path) of a list of paths, of a manifest (a .txt file with a path on each line; blank lines are skipped), or of
    the files in a folder whose names match the pattern."""
    if not isinstance(files, str):
        return spark.createDataFrame([(f,) for f in files], "path string")
    if files.endswith(".txt"):
        return spark.read.text(files).select(F.trim("value").alias("path")).where("path <> ''")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(files).select("path")


def read_arrays(spark: SparkSession, path: str | list[str], pattern: str = "*.{npy,npz,mat}") -> DataFrame:
    """Sessions of .npy, .npz and .mat files, of a folder or a list of paths: session_id is the file's stem, with the number
    of the session in it if there are several. Bounds are half-open and count from the file's first row. A file is held
    by one task."""
    return parse_arrays(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def parse_arrays(files: DataFrame) -> DataFrame:
    """Sessions of files that are at hand as rows (path, content): see `read_arrays`."""

    def parse(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                y, x, cuts = _arrays(name, bytes(data))
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for i, (a, b) in enumerate(cuts):
                    sid = stem if len(cuts) == 1 else f"{stem}#{i}"
                    yield pd.DataFrame({"session_id": sid, "t": np.arange(b - a, dtype="int32"), "y": list(y[a:b]), "x": list(x[a:b]) if x is not None else [None] * (b - a)})

    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def mat_files(obs: DataFrame) -> DataFrame:
    """(path, content): a .mat file for each session, with its rows in order of t as Y and, if there are any, x as X. A session
    is held by one task. Written to a store, MATLAB reads them, as `read_arrays` does."""
    x = F.col("x") if "x" in obs.columns else F.lit(None).cast("array<double>")
    rows = obs.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "y", x.alias("x")))).alias("rows"))

    def write(frames):
        for f in frames:
            out = []
            for sid, part in zip(f["session_id"], f["rows"]):
                found = {"Y": np.array([r["y"] for r in part], float)} | ({"X": np.array([r["x"] for r in part], float)} if part[0]["x"] is not None else {})
                out.append((f"{sid}.mat", matfile.write(found)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(write, "path string, content binary")


def read_text(spark: SparkSession, path: str, separator: str = r"\s+|,") -> DataFrame:
    """Sessions of text files, a row of numbers on each line; the file's stem is session_id. Lines are numbered in the
    order of the file, which is read as a whole by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = lines.select(stem.alias("session_id"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("t", "line"))
    y = F.transform(F.split(F.trim("line"), separator), lambda s: s.cast("double"))
    return rows.select("session_id", F.col("t").cast("int").alias("t"), y.alias("y"), F.lit(None).cast("array<double>").alias("x"))


def read_columns(df: DataFrame, session: str, order: list[str], y: list[str], x: list[str] | None = None) -> DataFrame:
    """A session table from plain columns; NaN becomes null."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    t = (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("int")
    xs = F.array(*map(value, x)) if x else F.lit(None).cast("array<double>")
    return df.select(F.col(session).alias("session_id"), t.alias("t"), F.array(*map(value, y)).alias("y"), xs.alias("x"))


def write_sessions(obs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, a folder for each session."""
    obs.repartition("session_id").write.mode(mode).partitionBy("session_id").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sorted_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Paths in order of the number that ends their stem."""
    return files.orderBy(F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).cast("long"), path)


def short_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds name: the shortest end of each path, in whole folders, that no other path ends in."""
    parts = F.reverse(F.split(path, "/"))
    ends = files.distinct().select(path, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.reverse(F.slice(parts, F.lit(1), n))))).alias("n", "name"))
    unique = ends.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("name"))).where("k = 1")
    best = unique.groupBy(path).agg(F.min_by("name", "n").alias("name"))
    return files.join(best, path)


def write_result(result: DataFrame, path: str, about: dict | None = None) -> None:
    """A result table as Parquet, with what it is about beside it as JSON text."""
    result.write.mode("overwrite").parquet(f"{path}/table")
    spark = result.sparkSession
    spark.createDataFrame([(json.dumps(about or {}, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/table"), json.loads(spark.read.text(f"{path}/about").first()[0])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, c0, c1, ...): exchangeability blocks from a CSV of whole numbers without a header, a row for each unit.
    unit_id is the row's number from 0 in the order of the files' names: rows are numbered where they are read, and a small
    table of the files' pieces tells how many come before."""
    rows = spark.read.csv(path, header=False, inferSchema=True)
    names = rows.columns
    piece = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = rows.select(*(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(names)), *piece, F.monotonically_increasing_id().alias("at"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1
    told = rows.withColumn("place", place).join(before, ["file", "start"])
    return told.select((F.col("place") + F.col("before")).alias("unit_id"), *(f"c{i}" for i in range(len(names))))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The columns beside unit_id as CSV without a header, in order of unit_id."""
    rows = blocks.repartitionByRange("unit_id").sortWithinPartitions("unit_id").drop("unit_id")
    rows.write.mode("overwrite").csv(path, header=False)
