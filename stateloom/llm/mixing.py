"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hash order, repeated up to `most_repeats` times. A copy's virtual finish
time is the tokens of its source up to and with it, divided by the source's target. All copies are sorted globally by
ranges of that time, and the order is cut where the budget is full, so every source runs out of budget at the same
virtual time, near its target.

No window runs over a source or over all rows: running sums are taken within small hash buckets and offset by sums
over buckets; the cut is found in the sums of the sorted ranges and then inside a single one of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .sharding import hash60, prefix

#: Rows that a hash bucket of a source, and a range of the sorted copies, should hold.
BUCKET_ROWS, RANGE_ROWS = 4096, 100_000
#: What the copies are sorted by: virtual finish time, and what breaks ties.
ORDER = ("time", "pos", "epoch", "h", "doc_id", "size")


def count_words(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """(source, source_size) to (source, source_size, pos, target). Sources by code point, null last, weigh the
    weights in turn; targets share the sum of sizes by weight, none above most_repeats times its source's size, the
    excess shared again: the sources that are filled come first in order of most_repeats * size / weight."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("pos", turn)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("pos") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.lit(most_repeats) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("w"), "pos")
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (whole - before) / rest).withColumn("full", F.col("level") * F.col("w") > F.col("most"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("w")).alias("r"), "pos", "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", "pos", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("w")).alias("target"))


def _key(epoch: int) -> Column:
    """A queued row's place in the order, as its copy number `epoch`."""
    time = (F.lit(epoch) * F.col("source_size") + F.col("cum")) / F.col("target")
    return F.struct(time.alias("time"), "pos", F.lit(epoch).alias("epoch"), "h", "doc_id", "size")


@dataclass
class _Mix:
    queued: DataFrame  # each row of docs in its source's queue
    ranged: DataFrame  # all copies, sorted by ranges of ORDER; part is the range
    last: Column | None  # place of the last copy that the budget holds
    most_repeats: int


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most_repeats: int) -> _Mix:
    spark = docs.sparkSession
    rows = common.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")))
    n = rows.count()
    bits = max(1, math.ceil(math.log2(max(2, n / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", prefix(F.col("h"), F.lit(bits)))
    by_bucket = common.cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most_repeats)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    p, b = plan.alias("p"), before.alias("b")
    places = b.join(p, F.expr("b.source <=> p.source")).select("b.source", "b.bucket", "b.before", "p.source_size", "p.pos", "p.target")
    r, q = rows.alias("r"), places.alias("q")
    placed = r.join(q, F.expr("r.source <=> q.source and r.bucket = q.bucket")).select("r.doc_id", "r.size", "r.h", "r.bucket", "q.before", "q.source_size", "q.pos", "q.target")
    within = Window.partitionBy("pos", "bucket").orderBy("h", "doc_id", "size")
    queued = common.cut(placed.withColumn("cum", F.col("before") + F.sum("size").over(within)).drop("bucket", "before"))
    copies = queued.where("size > 0 and target > 0").select(F.explode(F.array(*map(_key, range(most_repeats)))).alias("k")).select("k.*")
    parts = max(common.partitions(spark), -(-most_repeats * n // RANGE_ROWS))
    ranged = common.cut(copies.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()))
    budget = queued.agg(F.sum("size")).first()[0] or 0
    return _Mix(queued, ranged, _last(ranged, budget), most_repeats)


def _last(ranged: DataFrame, budget: int) -> Column | None:
    """The place of the last copy, in order, up to which the sizes sum to the budget at most; None if there is none."""
    place = F.struct(*ORDER)
    # one row for each range
    run = ranged.groupBy("part").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(Window.orderBy("part")))
    over = run.where(F.col("upto") > budget).orderBy("part").limit(1).collect()
    if not over:  # all fit
        last = ranged.agg(F.max(place)).first()[0]
    else:
        part, left = over[0]["part"], budget - (over[0]["upto"] - over[0]["size"])
        upto = F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER))
        inside = ranged.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") <= left)
        last = inside.agg(F.max(place)).first()[0] or ranged.where(F.col("part") < part).agg(F.max(place)).first()[0]
    kinds = dict(ranged.dtypes)
    return None if last is None else F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(ORDER, last)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size, target, copies (how often the mix takes it, 0
    to most_repeats) and taken (copies * size).

    Null texts have size 0; documents of size 0 are never taken. Null sources are one source, the last. Rows that
    repeat an id and a size stand side by side and are taken alike. An empty table gives no rows. Equal inputs give
    equal results, whatever their partitions."""
    m = _mix(docs, id_col, text_col, source_col, weights, most_repeats)
    taken = F.lit(0)
    if m.last is not None:
        within = [F.when(_key(e) <= m.last, 1).otherwise(0) for e in range(most_repeats)]
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(within, F.lit(0))).otherwise(0)
    out = m.queued.withColumn("copies", taken.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """The mix itself: a row (time, epoch, doc_id, size) for each copy that it takes, partitioned by ranges of virtual
    finish time and sorted within. epoch is 0 for a document's first copy. Cases as in `mix`."""
    m = _mix(docs, id_col, text_col, source_col, weights, most_repeats)
    kept = m.ranged.where(F.lit(False) if m.last is None else F.struct(*ORDER) <= m.last)
    return kept.select("time", "epoch", "doc_id", "size")
