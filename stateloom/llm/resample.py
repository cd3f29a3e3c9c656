"""Importance resampling of documents towards a target corpus, by hashed n-grams.

A bucket's gain is the logarithm of how much commoner its n-grams are in the target than in the documents; a document's
weight is the mean gain of its n-grams, and Gumbel noise from its id makes the highest sums a sample without replacement.

N-grams are found in suffix arrays over word ids, one for each stretch of a partition: suffixes are ordered by their
first words (ranks are doubled), the common prefix of neighbours tells where a run of one repeated n-gram ends, an n-gram's
bytes are hashed once for its run, and the bucket goes back to all its places. Two passes read the texts, one to count
buckets and one to score; between them only counts travel, one for each bucket. Drawn documents are ranked by ranges of
their score, so no task sees them all."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, wordhash as wh

#: Text of one suffix array; a longer text has one of its own.
STRETCH_BYTES = 2 << 20
#: Ranked rows for each range.
RANGE_ROWS = 1_000_000
#: Buckets at most: their counts pass through the driver.
MOST_BUCKETS = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the places sorted by their next `depth` words, and how many of those each has in common with the
    place before it. left is the number of words from a place to the end of its text; nothing reaches past that."""
    n = len(ids)
    rank, width = ids.astype(np.int64), 1
    while width < depth:
        follow = np.full(n, -1, np.int64)
        reach = np.flatnonzero(left > width)
        follow[reach] = rank[reach + width]
        order = np.lexsort((follow, rank))
        a, b = rank[order], follow[order]
        step = np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    here, before = order[1:], order[:-1]
    same = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        i = np.flatnonzero(same & (left[here] > k) & (left[before] > k))
        same[:] = False
        same[i] = ids[here[i] + k] == ids[before[i] + k]
        lcp[1:] += same
    return order, lcp


def buckets_of(col: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each n-gram's occurrence, its bucket) for runs of `low` to `high` words."""
    h, rows, starts, ends = wh.words(col, wh.ALNUM_LOWER)
    n_words = np.bincount(rows, minlength=len(col)).astype(np.int64)
    if not len(h):
        e = np.zeros(0, np.int64)
        return n_words, e, e
    raw = _LOWER[wh.string_parts(col)[0]].tobytes()
    _, ids = np.unique(h, return_inverse=True)
    left = np.cumsum(n_words)[rows] - np.arange(len(h))
    order, lcp = suffix_array(ids, left, high)
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(low, high + 1):
        long = np.flatnonzero(left[order] >= n)
        if not len(long):
            continue
        # a run ends where fewer than n words are shared; too short suffixes never stand inside one
        run = np.cumsum(lcp < n)[long]
        new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        places = order[long]
        first = places[new]
        if n == 1:
            hashes = [crc32(raw[i:j]) for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        else:
            s, e = starts.tolist(), ends.tolist()
            hashes = [crc32(b" ".join([raw[s[k] : e[k]] for k in range(i, i + n)])) for i in first.tolist()]
        bucket = np.array(hashes, np.int64) % buckets
        at.append(rows[places])
        found.append(np.repeat(bucket, np.diff(np.append(new, len(run)))))
    return n_words, np.concatenate(at), np.concatenate(found)


def _counter(low: int, high: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = b.column("text")
            for i, j in wh.chunks(texts, STRETCH_BYTES):
                total += np.bincount(buckets_of(texts.slice(i, j - i), low, high, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def _scorer(low: int, high: int, buckets: int, gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i, j in wh.chunks(texts, STRETCH_BYTES):
                n_words, rows, found = buckets_of(texts.slice(i, j - i), low, high, buckets)
                n = np.bincount(rows, minlength=j - i).astype(np.int64)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, rows, gain[found])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)  # floors go down
                yield pa.RecordBatch.from_arrays([ids[i:j], *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _texts(rows: DataFrame, text_col: str, *more) -> DataFrame:
    return rows.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bucket_counts(rows: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """How often n-grams of each bucket occur in all texts: rows (bucket, n), without empty buckets."""
    counts = common.in_batches(_texts(rows, text_col), _counter(low, high, buckets), "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(rows: DataFrame, low: int, high: int, buckets: int, text_col: str) -> list[int]:
    out = [0] * buckets
    for r in bucket_counts(rows, low, high, buckets, text_col).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's smoothed frequencies, in the target over in the source."""
    s_all, t_all, n = sum(source), sum(target), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source, target)], np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    low: int = 1,
    high: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score (weight and Gumbel noise, in thousandths) and rank,
    which is 1, 2, ... for the documents drawn, by descending score and ascending id, and null for others. Drawn are
    `percent` of the documents that have `least_words` words.

    Null and blank texts have no features, weight 0 and are not drawn unless least_words is 0. A null id is hashed as an
    empty one and goes before others of its score; rows that repeat an id have the same noise and count each. Rows
    equal in all columns may swap ranks. Empty documents give no rows; an empty target has no n-grams, which is no
    error. Equal inputs give equal results, whatever their partitions."""
    if not 1 <= low <= high or not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError("needs 1 <= low <= high and a bounded number of buckets")
    spark = docs.sparkSession
    counted = _counts(docs, low, high, buckets, text_col)
    shared = spark.sparkContext.broadcast(gains(counted, _counts(target, low, high, buckets, target_col)))
    scored = _texts(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).transform(common.in_batches, _scorer(low, high, buckets, shared), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = common.cut(scored.withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    # rows that are equal throughout are told apart by where they stand, so that many of them are no hot range
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("at")]
    parts = max(common.partitions(spark), -(-n // RANGE_ROWS))
    ranged = able.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = common.cut(ranged.drop("at").withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row for each range
    sizes = ranged.groupBy(part.alias("part")).count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + within + 1)
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return drawn.select(*columns).unionByName(rest.select(*columns))
