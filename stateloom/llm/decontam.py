"""Benchmark decontamination by greedy string tiling.

1. Each document's word `least`-grams are tested against a bitmap of those of the benchmark: 8 MiB, whatever the
   sizes. What passes is kept as runs of words; a document without any is done.
2. Seeds and benchmark grams are joined on their hash. Pairs whose shared grams could not reach the coverage go.
3. Each pair is tiled: the longest common run of unmarked words is marked in both, again and again, until none of
   `least` words is left. Runs of a length are found by Karp-Rabin hashes of all windows of that length, and the
   longest by halving the length's range. An item is leaked if the tiles cover the share `coverage` of it, in any
   order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash as wh


def _positions(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (common.BITMAP_BITS.bit_length() - 1))).astype(np.int64)


def _item_rows(least: int):
    """(item_id, item, text) to (item_id, item, words binary, grams array<long>); items shorter than `least` words are
    dropped. item is a hash of the id and the text."""

    def run(batches):
        for b in batches:
            ids, keys, w, g = [], [], [], []
            for i, key, text in zip(b.column("item_id").to_pylist(), b.column("item").to_pylist(), b.column("text")):
                h, _, _, _ = wh.words(pa.array([text.as_py()], pa.string()), wh.ALNUM_LOWER)
                if len(h) >= least:
                    ids.append(i)
                    keys.append(key)
                    w.append(h.tobytes())
                    g.append(np.unique(wh.ngrams(h, least)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(w, pa.binary()), pa.array(g, pa.list_(pa.int64()))], ["item_id", "item", "item_words", "grams"])

    return run


def _bits(grams: DataFrame) -> np.ndarray:
    """Bitmap of the grams' leading bits, built on the executors: at most BITMAP_BITS bits reach the driver."""
    shift = 64 - (common.BITMAP_BITS.bit_length() - 1)
    p = grams.select(F.call_function("shiftrightunsigned", "gram", F.lit(shift)).alias("p"))
    return common.bitmap_of(p)


def _hit_rows(least: int, bits):
    """(doc_id, row, text) to documents with a gram in the bitmap: their runs of such words, one empty word between
    runs, and the distinct grams."""

    def run(batches):
        for b in batches:
            ids, rows_, w, g = [], [], [], []
            doc_ids, keys = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            for i, j in wh.chunks(b.column("text")):
                h, rows, _, _ = wh.words(b.column("text").slice(i, j - i), wh.ALNUM_LOWER)
                n = len(h) - least + 1
                if n <= 0:
                    continue
                grams = wh.ngrams(h, least)
                hit = common.bitmap_has(bits.value, _positions(grams)) & (rows[:n] == rows[least - 1 :])
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                covered = np.zeros(len(h) + 1, np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + least, -1)
                inside = np.cumsum(covered[:-1]) > 0
                kept = np.flatnonzero(inside)
                for r in np.unique(rows[at]):
                    k = kept[rows[kept] == r]
                    gaps = np.flatnonzero(np.diff(k) > 1) + 1
                    ids.append(doc_ids[i + r])
                    rows_.append(keys[i + r])
                    w.append(np.insert(h[k], gaps, np.uint64(0)).tobytes())
                    g.append(np.unique(grams[at[rows[at] == r]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows_, pa.int64()), pa.array(w, pa.binary()), pa.array(g, pa.list_(pa.int64()))], ["doc_id", "row", "doc_words", "grams"])

    return run


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in doc, start in item, length), in the order in
    which they were marked. Ties go to the leftmost in the item, then in the doc. A word hash of 0 never matches."""
    a_free, b_free = doc != 0, item != 0
    out: list[tuple[int, int, int]] = []

    def windows(values: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and Karp-Rabin hashes of the windows of n unmarked words."""
        if len(values) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, wh.karp_rabin(values, at, at + n)

    def common_at(n: int):
        at_b, hb = windows(item, b_free, n)
        at_a, ha = windows(doc, a_free, n)
        both = np.isin(hb, ha)
        return at_b[both], hb[both], at_a, ha

    top = min(len(doc), len(item))
    while True:
        low, high = least - 1, top
        while low < high:  # longest length with a common window; a window's parts are common too
            mid = (low + high + 1) // 2
            if len(common_at(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < least:
            return out
        at_b, hb, at_a, ha = common_at(low)
        order = np.argsort(ha, kind="stable")
        sorted_a, next_of = ha[order], {}
        for j, h in zip(at_b.tolist(), hb):
            if not b_free[j : j + low].all():
                continue
            k = next_of.get(int(h), int(np.searchsorted(sorted_a, h)))
            while k < len(order) and sorted_a[k] == h:
                i = int(at_a[order[k]])
                k += 1
                if a_free[i : i + low].all() and (doc[i : i + low] == item[j : j + low]).all():
                    a_free[i : i + low] = b_free[j : j + low] = False
                    out.append((i, j, low))
                    break
            next_of[int(h)] = k
        top = low


def _tile(least: int):
    def run(batches):
        for b in batches:
            covered, n = [], []
            for d, i in zip(b.column("doc_words").to_pylist(), b.column("item_words").to_pylist()):
                t = tiles(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), least)
                covered.append(sum(x[2] for x in t) / (len(i) // 8))
                n.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("item_id"), pa.array(covered, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "row", "item_id", "covered", "n_tiles"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, row, item_id, covered, n_tiles) of each document that holds the share `coverage` of an item at least.
    row is a hash of the document's id and text. Items of fewer than `least` words can't leak, nor those without an id.
    Items that repeat an id are tried each by its own text, and the id counts once, by the text covered most."""
    spark = docs.sparkSession
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null").distinct()
    bench = bench.withColumn("item", F.xxhash64("item_id", "text"))
    bench = common.cut(bench.transform(common.in_batches, _item_rows(least), "item_id long, item long, item_words binary, grams array<long>"))
    seeds = bench.select("item", F.explode("grams").alias("gram"))
    bits = spark.sparkContext.broadcast(_bits(seeds))
    hits = common.cut(_keyed(docs, id_col, text_col).transform(common.in_batches, _hit_rows(least, bits), "doc_id long, row long, doc_words binary, grams array<long>"))
    shared = hits.select("row", F.explode("grams").alias("gram")).distinct().join(seeds, "gram").groupBy("row", "item").agg(F.count(F.lit(1)).alias("grams"))
    sized = bench.select("item_id", "item", "item_words")
    # a shared gram covers `least` places at most for each of its places in the item
    likely = shared.join(bench.select("item", F.size("grams").alias("of"), (F.length("item_words") / 8).alias("n")), "item")
    likely = likely.where((F.col("n") - least + 1 > F.col("of")) | (F.col("grams") * least >= F.col("n") * coverage)).select("row", "item")
    texts = hits.select("doc_id", "row", "doc_words").dropDuplicates(["row"])
    pairs = likely.join(texts, "row").join(sized, "item").select("doc_id", "row", "item_id", "doc_words", "item_words")
    tiled = pairs.transform(common.in_batches, _tile(least), "doc_id long, row long, item_id long, covered double, n_tiles long").where(F.col("covered") >= coverage)
    best = tiled.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("covered", "n_tiles")).alias("b"))
    return best.select("doc_id", "row", "item_id", "b.covered", "b.n_tiles")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), text.alias("text"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, n_items (leaked items), item_id and covered (of the item
    covered most, the smallest id among equals; null and 0 where none leaks) and items (ids of all, in order).

    Null texts have no words. Null ids stay null; repeated rows give equal rows. Without documents there are no rows;
    without items nothing is contaminated."""
    found = leaks(docs, items, id_col, text_col, **how)
    best = found.groupBy("row").agg(F.max(F.struct("covered", (-F.col("item_id")).alias("i"))).alias("best"), F.sort_array(F.collect_set("item_id")).alias("items"))
    out = _keyed(docs, id_col, text_col).select("doc_id", "row").join(best, "row", "left")
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), n.cast("long").alias("n_items"), (-F.col("best.i")).alias("item_id"), F.coalesce("best.covered", F.lit(0.0)).alias("covered"), "items")
