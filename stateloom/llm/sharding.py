"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split further.

A document's hash is 60 bits of the MD5 of its id. A shard is the shortest prefix whose documents fit the byte limit;
a prefix that holds one hash only can't be split and stays, even if it is over the limit. Bytes are summed once by
cells, prefixes a few bits longer than an even split needs, and rolled up from there; only cells that are still
oversized go on with more bits. Rows meet the directory by their cell, never by a short prefix, so no key holds more
than a cell does."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 60
#: Bits beyond those of an even split, and bits that an oversized cell gets in a further round.
SLACK, STEP = 6, 8


def hash60(col):
    """60 bits of the MD5 of a value's string; null is as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h, depth):
    """The first `depth` bits. Both may be columns."""
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (of the text as UTF-8; null is 0), shard_id (the prefix as a
    string of bits, empty for the whole), depth (its length) and shard_bytes.

    Null ids share one hash. Rows that repeat an id share a shard. A shard over the limit holds a single hash: one
    document, or rows that repeat its id. An empty table gives no rows."""
    rows = common.cut(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), hash60(F.col(id_col)).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first, last = 0, min(BITS, max(1, math.ceil(math.log2(max(2, total / limit_bytes))) + SLACK))
    open_, done = rows, None
    while True:
        placed = open_.withColumn("cell", prefix(F.col("h"), F.lit(last)))
        leaf = _leaves(placed, first, last, limit_bytes)
        placed = placed.join(leaf, "cell", "left").drop("cell")
        found = placed.where("depth is not null")
        done = found if done is None else done.unionByName(found)
        if last == BITS:
            break
        open_ = common.cut(placed.where("depth is null").select("doc_id", "n_bytes", "h"))
        if not open_.limit(1).count():
            break
        first, last = last + 1, min(BITS, last + STEP)
    depth = F.col("depth")
    bits = F.when(depth > 0, F.lpad(F.bin(prefix(F.col("h"), depth)), BITS, "0").substr(F.lit(BITS + 1) - depth, depth)).otherwise("")
    return done.select("doc_id", "n_bytes", bits.alias("shard_id"), "depth", "shard_bytes")


def _leaves(rows: DataFrame, first: int, last: int, limit_bytes: int) -> DataFrame:
    """(cell, depth, shard_bytes) of the cells of `last` bits under a prefix of first..last bits that fits or can't be
    split. A shard of n bits less than a cell lists its 2^n cells: no more than there are cells in all."""
    cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))

    def rolled(sums: DataFrame, at: int, low: int, high: int) -> DataFrame:
        """Sums by the prefixes of low..high bits, of sums by the prefixes p of `at` bits."""
        up = sums.select("b", "lo", "hi", "p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        return up.groupBy("depth", F.call_function("shiftright", "p", F.lit(at) - F.col("depth")).alias("p")).agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    # the few bits near the cells first; all shorter prefixes come from the sums at the shortest of those
    middle = max(first, last - SLACK - 2)
    sums = common.cut(rolled(cells.withColumnRenamed("cell", "p"), last, middle, last))
    if middle > first:
        sums = sums.unionByName(common.cut(rolled(sums.where(F.col("depth") == middle).drop("depth"), middle, first, middle - 1)))
    fits = (F.col("b") <= limit_bytes) | (F.col("lo") == F.col("hi"))
    full = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("parent"))
    # a leaf fits and its parent doesn't; parents of the first depth were split before
    leaf = sums.where(fits).withColumn("parent", F.call_function("shiftright", "p", F.lit(1)))
    leaf = leaf.where(F.col("depth") == first).unionByName(leaf.where(F.col("depth") > first).join(full, ["depth", "parent"], "left_semi").select(leaf.columns))
    wide = F.lit(last) - F.col("depth")
    start = F.call_function("shiftleft", F.col("p"), wide)
    cell = F.explode(F.sequence(start, start + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1))
    return leaf.select(cell.alias("cell"), "depth", F.col("b").alias("shard_bytes"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as Parquet, a folder for each shard. Ids must be unique in shards."""
    out = docs.join(shards.select(F.col("doc_id").alias(id_col), "shard_id"), id_col)
    out.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
