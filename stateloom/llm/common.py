"""Helpers shared by the corpus operators: tables, lineage cuts, bitmaps and connected components.

Ids of documents, items and pages are whole numbers or strings of such; others raise."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bitmap has this many bits (8 MiB): the bound of all that is broadcast for prefilters, at any input size.
BITMAP_BITS = 1 << 26
#: Bytes of text that go to a Python worker at once, where the session leaves Spark's 64 MiB. A longer text goes alone.
BATCH_BYTES = 4 << 20
#: Edges for each task of a round of components.
ROWS_A_TASK = 100_000
_BUCKET_BITS = 32768  # fixed by bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes, so that a worker's memory doesn't follow the length of texts. The
    bound is a setting of the session; it is set only where the session leaves the default."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864", "67108864b", "64MB", "64m"):
        conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(function, schema)


def fresh(name: str, *columns: str) -> str:
    """The name, with _ added until no column has it in any case."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named in spark.checkpoint.dir; a folder of our own only where none is set and Spark
    runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that later jobs neither recompute it nor depend on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again; for tables too wide for a checkpoint."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(rows: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in gone (one column of longs). Null ids stay. A bitmap of fixed size names the rows
    that may go, so the others, with all their columns, are not shuffled."""
    spark = rows.sparkSession
    name = fresh("gone", *rows.columns)
    gone = gone.toDF(name)
    gone = cut(gone.where(F.col(name).isNotNull()).distinct())
    bits = spark.sparkContext.broadcast(bitmap(gone, name))

    @F.pandas_udf("boolean")
    def may_go(position: pd.Series) -> pd.Series:
        return pd.Series(bitmap_has(bits.value, position.to_numpy()))

    key = F.col(id_col).cast("long")
    suspect = F.coalesce(may_go(F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))), F.lit(False))
    kept = rows.where(suspect).join(gone, key == F.col(name), "left_anti")
    return rows.where(~suspect).unionByName(kept)


def cut_narrow(df: DataFrame) -> DataFrame:
    """As cut, for rows of a few numbers: read again by as many tasks as the rows need, not as wrote them."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // ROWS_A_TASK)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_position(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame, *cols: str) -> np.ndarray:
    """Bits of the hashes of the columns, as bytes. Collects at most BITMAP_BITS bits, whatever the input's size."""
    return bitmap_of(keys.select(bit_position(*cols).alias("p")))


def bitmap_of(pos: DataFrame) -> np.ndarray:
    """Bitmap of the positions p, from 0 to BITMAP_BITS - 1."""
    rows = (
        pos.groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    size = _BUCKET_BITS // 8
    for r in rows:
        # bucket b holds positions (b - 1) * 32768 + 1 .. b * 32768 by Spark's numbering; position 0 falls in bucket 0
        at = _bucket_start(r["b"])
        out[at : at + size] |= np.frombuffer(bytes(r["m"]), np.uint8)[: len(out) - at]
    return out


def _bucket_start(number: int) -> int:
    return (number - 1) * (_BUCKET_BITS // 8) if number > 0 else 0


def bitmap_has(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether each position's bit is set, by the numbering of Spark's bitmap functions."""
    p = positions.astype(np.int64)
    bucket = np.where(p > 0, 1 + (p - 1) // _BUCKET_BITS, 0)
    offset = np.where(p > 0, (p - 1) % _BUCKET_BITS, 0)
    byte = np.where(bucket > 0, (bucket - 1) * (_BUCKET_BITS // 8), 0) + offset // 8
    return (bits[byte] >> (offset % 8).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (u, v): one row (id, component) for each id that has an edge;
    component is the smallest id reachable. Labels move along edges and to the labels' own rows, then jump to the
    label's label, so rounds grow with the logarithm of a chain's length. Self links are allowed; nulls are dropped."""
    e = edges.select("u", "v").where("u is not null and v is not null").distinct()
    # tables in files, not checkpoints: their size is known, so small ones are joined without a shuffle
    parts = max(1, -(-2 * e.count() // ROWS_A_TASK))
    both = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts))
    nearest = both.groupBy("u").agg(F.min("v").alias("m"))
    labels = stored(nearest.select(F.col("u").alias("id"), F.least("u", "m").alias("c"), F.lit(0).cast("long").alias("old")).coalesce(parts))
    while True:
        far = labels.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        near = labels.select(F.col("id").alias("u"), F.col("c").alias("cu"))
        seen = both.join(far, "v").groupBy("u").agg(F.min("cv").alias("cv"))
        told = seen.join(near, "u").where("cv <> cu")
        offers = told.select(F.col("u").alias("id"), F.col("cv").alias("o")).unionByName(
            told.select(F.col("cu").alias("id"), F.col("cv").alias("o"))
        )
        best = offers.groupBy("id").agg(F.min("o").alias("o"))
        hooked = labels.select("id", "c").join(best, "id", "left").select("id", F.least("c", "o").alias("c"), F.col("c").alias("old"))
        up = hooked.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        jumped = stored(hooked.join(up, "c", "left").select("id", F.least("c", "cc").alias("c"), "old").coalesce(parts))
        discard(labels)
        labels = jumped
        if not labels.where("c <> old").limit(1).count():
            discard(both)
            return labels.select("id", F.col("c").alias("component"))
