"""Ranked lexical search by WAND in shards of documents.

A shard is a stretch of a partition's documents, indexed in the task that reads them: for each query term its documents,
in order, with the integer that the term adds to their score, and the largest of those. For a query the terms' cursors are
kept in order of their document. Largest additions are summed along that order until the sum beats the heap's
smallest score; the cursor where that happens is the pivot, and no document before it can enter the heap, so cursors skip
to it. Shards' heaps are merged by Spark in two steps.

Queries go in blocks of bounded size, each a pass over the texts for the statistics of its terms and one for the search;
what is broadcast is a block's terms and their statistics. Documents cross no shuffle. Terms are told apart by 64-bit
hashes of their bytes that no family of words collides under."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, wordhash as wh

#: Distinct (item, term) pairs of a block of queries: bounds what is collected and broadcast. One item is not parted.
BLOCK_TERMS = 1 << 18
#: Postings of a shard: bounds a task's memory. A longer document is a shard of its own.
SHARD_POSTINGS = 1 << 21
#: Weight of a document's length, in hundredths, and how soon a term's repeats stop to count.
LENGTH_PERCENT, SATURATION = 50, 20


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("item_id"), b.column("text")
        for i, j in wh.chunks(texts):
            h, rows, _, _ = wh.words(texts.slice(i, j - i), wh.ALNUM_LOWER)
            yield pa.RecordBatch.from_arrays([ids[i:j].take(pa.array(rows)), pa.array(h.view(np.int64))], ["item_id", "term"])


def _postings(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, and of the sorted query terms that occur: term, text, occurrences)."""
    h, rows, _, _ = wh.words(texts, wh.ALNUM_LOWER)
    n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    hit = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
    key, tf = np.unique(at[hit] * len(texts) + rows[hit], return_counts=True)
    return n, key // max(len(texts), 1), key % max(len(texts), 1), tf.astype(np.int64)


def _statistics(shared):
    """Rows (term, n): in how many documents a query term is; at -1 the documents that hold any term, at -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df, some, total = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            texts = b.column("text")
            for i, j in wh.chunks(texts):
                n, t, _, _ = _postings(texts.slice(i, j - i), terms)
                df += np.bincount(t, minlength=len(terms))
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [some, total]))], ["term", "n"])

    return run


def additions(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What terms of the given weights and occurrences add to the score of documents of n terms."""
    if LENGTH_PERCENT * n_docs * int(n.max(initial=0)) < 1 << 63:
        share = LENGTH_PERCENT * n_docs * n // n_terms
    else:  # beyond 64 bits on the way
        share = np.array([LENGTH_PERCENT * n_docs * int(x) // n_terms for x in n], np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * (100 - LENGTH_PERCENT + share)))


def search_shard(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """The `top` best (score, -document) of posting lists (documents ascending, additions, largest addition). Among equal
    scores smaller documents win: a document must beat the heap's smallest score, and documents come in order."""
    cursors = sorted((docs[0], i, 0) for i, (docs, _, _) in enumerate(lists) if docs)
    heap: list[tuple[int, int]] = []
    beat = 0  # scores up to this don't enter
    while cursors:
        bound = 0
        for k, (doc, i, _) in enumerate(cursors):
            bound += lists[i][2]
            if bound > beat:
                break
        else:
            break  # no document that is left can enter
        if cursors[0][0] == doc:
            score, moved = 0, 0
            for d, i, at in cursors:
                if d != doc:
                    break
                score += lists[i][1][at]
                moved += 1
            gone, cursors = cursors[:moved], cursors[moved:]
            for _, i, at in gone:
                docs = lists[i][0]
                if at + 1 < len(docs):
                    insort(cursors, (docs[at + 1], i, at + 1))
            if score > beat:
                if len(heap) < top:
                    heappush(heap, (score, -doc))
                else:
                    heapreplace(heap, (score, -doc))
                if len(heap) == top:
                    beat = heap[0][0]
        else:
            # cursors before the pivot skip to its document
            gone, cursors = cursors[:k], cursors[k:]
            for _, i, at in gone:
                docs = lists[i][0]
                at = bisect_left(docs, doc, at)
                if at < len(docs):
                    insort(cursors, (docs[at], i, at))
    return heap


def _searcher(shared, top: int, groups: int):
    """Rows (item, doc_id, score, part): the heap of each query in each shard; item is the query's place in the block, part
    a number below groups for the task."""

    def search(parts, items, offsets, part):
        ids, null, t, d, add = (np.concatenate(x) for x in zip(*parts))
        # documents by ascending id, nulls last, so that places in the shard decide ties
        place = np.empty(len(ids), np.int64)
        by_id = np.lexsort((ids, null))
        place[by_id] = np.arange(len(ids))
        keep = np.flatnonzero(add > 0)
        t, d, add = t[keep], place[d[keep]], add[keep]
        order = np.lexsort((d, t))
        t, d, add = t[order], d[order], add[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(add, starts).tolist() if len(t) else []
        ends = np.append(starts[1:], len(t))
        lists = {k: (d[i:j].tolist(), add[i:j].tolist(), m) for k, i, j, m in zip(t[starts].tolist(), starts, ends, most)}
        out = []
        for q in range(len(offsets) - 1):
            held = [lists[k] for k in items[offsets[q] : offsets[q + 1]].tolist() if k in lists]
            out += [(q, -doc, score) for score, doc in search_shard(held, top)]
        q, doc, score = (np.array(x, np.int64) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        doc = by_id[doc]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[doc], mask=null[doc]), pa.array(score), pa.array(np.full(len(q), part))], ["item", "doc_id", "score", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items, offsets, n_docs, n_terms = shared.value
        part = TaskContext.get().partitionId() % groups
        parts, docs, held = [], 0, 0
        for b in batches:
            texts = b.column("text")
            for i, j in wh.chunks(texts):
                n, t, row, tf = _postings(texts.slice(i, j - i), terms)
                if parts and held + len(t) > SHARD_POSTINGS:
                    yield search(parts, items, offsets, part)
                    parts, docs, held = [], 0, 0
                ids = b.column("doc_id").slice(i, j - i)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), null, t, row + docs, additions(weights[t], tf, n[row], n_docs, n_terms)))
                docs, held = docs + j - i, held + len(t)
        if parts:
            yield search(parts, items, offsets, part)

    return run


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _search_block(texts: DataFrame, pairs: pa.Table, top: int) -> DataFrame | None:
    """Hits of a block's items, given as (item_id, term) in order of items: (item_id, doc_id, score, part)."""
    sc = texts.sparkSession.sparkContext
    terms, index = np.unique(pairs.column("term").to_numpy().view(np.uint64), return_inverse=True)
    ids = pairs.column("item_id").to_pylist()
    change = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
    found = common.in_batches(texts.select("text"), _statistics(sc.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    told = {r["term"]: r["n"] for r in found.collect()}  # a row for each of the block's terms at most
    n_docs, n_terms = told.get(-1, 0), told.get(-2, 0)
    if not n_docs:
        return None
    weights = _weights(np.array([told.get(i, 0) for i in range(len(terms))]), n_docs)
    shared = sc.broadcast((terms, weights, index, np.array(change), n_docs, n_terms))
    hits = common.in_batches(texts, _searcher(shared, top, common.partitions(texts.sparkSession)), "item long, doc_id long, score long, part long")
    names = texts.sparkSession.createDataFrame([(k, ids[i]) for k, i in enumerate(change[:-1])], "item long, item_id long")
    return hits.join(F.broadcast(names), "item").drop("item")


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each item the `top` documents with the highest scores above 0: item_id, rank (from 1), doc_id, score.

    Scores are those of a saturating term frequency with length normalisation, in integers. Equal scores go by
    ascending doc_id, null ids last. Null texts have no terms. Rows of items that share an id, or have none, are one
    item with all their terms. Rows of docs that repeat an id are documents of their own, and may share a place's id.
    Empty tables give no rows."""
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    pairs = common.cut(common.in_batches(queries, _item_terms, "item_id long, term long").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = common.cut(pairs.groupBy("item_id").count())
    blocks = max(1, -(-(sizes.agg(F.sum("count")).first()[0] or 0) // BLOCK_TERMS))
    while True:
        # hashed ids fill blocks unevenly: more of them until each is within bounds or holds one item
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("count").alias("n"), F.count("*").alias("items")).where((F.col("n") > 2 * BLOCK_TERMS) & (F.col("items") > 1))
        if not over.limit(1).count():
            break
        blocks *= 2
    hits = []
    for k in range(blocks):
        some = pairs.where(block == k).orderBy("item_id", "term").toArrow()  # of bounded size
        if some.num_rows and (found := _search_block(texts, some, top)) is not None:
            hits.append(common.cut(found) if blocks > 1 else found)
    if not hits:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # shards' heaps are merged in groups, then the groups
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
