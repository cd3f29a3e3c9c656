"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the `seed`-word grams in each window of `window` words, the one of smallest hash.
Two equal windows choose the same anchor, so all that can match meets under an anchor, and windows whose anchor
stands in one document only are dropped unread. Under a shared anchor each occurrence is extended both ways, window
by window, as long as an occurrence in a document of smaller id goes on alike; what is left are maximal repeats of
at least `window` words. An anchor's occurrences are compared with its smallest document for each extension (a
star), never with each other.

The text crosses no shuffle to find repeats: map tasks send, for each run of windows with one anchor, its document
and the windows' 64-bit hashes, packed by anchor into `buckets` rows. Windows are equal if both their hashes and their
anchors' are: 128 bits, of hashes that no family of words collides under. Before that they settle what repeats inside
their own batch and send one occurrence of it, so an anchor held by a third of all rows costs a bucket one
occurrence for each batch. An anchor that alone would fill a bucket, as a common phrase in many contexts does, is split:
its windows go to buckets by their own hashes, and equal windows still meet. What is found travels as runs of windows,
packed by document into as many rows, so both shuffles grow with the text and the matches. The number of buckets follows
the size of the input."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash as wh

#: Text whose repeats are settled at once in a map task.
FLUSH_BYTES = 8 << 20
#: Input text for each bucket: bounds what a reduce task holds.
BUCKET_BYTES = 8 << 20
#: Tasks of a shuffle at most; beyond, a task takes several buckets, one after the other.
MOST_TASKS = 1 << 16
#: Windows at which an anchor is split: as many as a bucket holds of common text.
HOT_WINDOWS = 1 << 20
#: Windows of an anchor in one flush from which on they count towards that.
FREQUENT = 16

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at = 8 * len(kinds) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(data, k, int(s) // np.dtype(k).itemsize, int(o)) for k, s, o in zip(kinds, sizes, at)]


_KINDS = (np.uint64, np.int64, np.int64, np.uint32, np.uint16, np.uint64)  # runs' anchor, document, tag, start, length; windows
_FOUND = (np.int64, np.int64, np.uint32, np.uint32)  # document, tag, first window, number of windows


def _expand(lens: np.ndarray) -> np.ndarray:
    """0 .. len-1 for each length, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


def earlier(anchors: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the window, for each occurrence of one."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.lexsort((docs, anchors, hashes))
    a, h, d = anchors[order], hashes[order], docs[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
    hit = np.zeros(len(h), bool)
    hit[order] = d > d[np.flatnonzero(first)][np.cumsum(first) - 1]
    return hit


def _shared(anchors: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the anchor stands in two documents at least."""
    if not len(anchors):
        return np.zeros(0, bool)
    order = np.argsort(anchors, kind="stable")
    a, d = anchors[order], docs[order]
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    many = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
    out = np.zeros(len(a), bool)
    out[order] = np.repeat(many, np.diff(np.append(cuts, len(a))))
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of equal entries, split at 65535."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], keys[1:] != keys[:-1]])
    s = np.flatnonzero(cut)
    ln = np.diff(np.append(s, n))
    if ln.max() > 65535:
        parts = -(-ln // 65535)
        off = _expand(parts) * 65535
        s, ln = np.repeat(s, parts) + off, np.minimum(np.repeat(ln, parts) - off, 65535)
    return s, ln


def _window_runs(ids, tags, col, window: int, seed: int):
    """Runs of windows with one anchor: anchor, doc, tag, start word, length, and the windows' hashes."""
    h, rows, _, _ = wh.words(col, wh.SPACED)
    n = len(h) - window + 1
    if n <= 0:
        return None
    win = wh.ngrams(h, window)
    anchor = wh.sliding_min(wh.ngrams(h, seed), window - seed + 1)
    whole = rows[:n] == rows[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return None
    first = np.searchsorted(rows, np.arange(len(col)))
    row = rows[at]
    key_change = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (row[1:] != row[:-1])])
    s, ln = _runs(np.cumsum(key_change))
    r = row[s]
    return anchor[at][s], ids[r], tags[r], (at[s] - first[r]), ln, win[at]


def _settle(parts):
    """What repeats within a flush is found here, and only its smallest document's occurrence goes on: found windows
    (document, tag, window), and what is left as runs."""
    a, d, t, p, ln, w = (np.concatenate(x) for x in zip(*parts))
    again = _shared(a, d)
    in_run = np.repeat(np.arange(len(a)), ln)
    sub = np.flatnonzero(again[in_run])
    hit = np.zeros(len(w), bool)
    hit[sub] = earlier(a[in_run[sub]], w[sub], d[in_run[sub]])
    step = _expand(ln)
    sd, st, sp = (x[in_run[hit]] for x in (d, t, p))
    keep = np.flatnonzero(~hit)
    kr, kp = in_run[keep], step[keep]
    new = np.concatenate([[True], (kr[1:] != kr[:-1]) | (kp[1:] != kp[:-1] + 1)]) if len(keep) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    runs = a[kr[s]], d[kr[s]], t[kr[s]], p[kr[s]] + kp[s], np.diff(np.append(s, len(keep))), w[keep]
    return (sd, st, sp + step[hit]), runs


def _flushes(window: int, seed: int, out):
    """Map side: batches of (doc_id, tag, text), by as much text as is settled at once, to what `out` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids, tags = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False)
            texts = b.column("text")
            for i, j in wh.chunks(texts):
                col = texts.slice(i, j - i)
                held += len(wh.string_parts(col)[0])
                if (x := _window_runs(ids[i:j], tags[i:j], col, window, seed)) is not None:
                    parts.append(x)
                if held >= FLUSH_BYTES:
                    if parts:
                        yield out(*_settle(parts))
                    parts, held = [], 0
        if parts:
            yield out(*_settle(parts))

    return run


def _frequent(least: int):
    """Rows (anchor, n): the anchors with `least` windows or more in a flush."""

    def out(_, runs) -> pa.RecordBatch:
        a, ln = runs[0], runs[4]
        order = np.argsort(a, kind="stable")
        a, ln = a[order], ln[order]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        n = np.add.reduceat(ln, cuts) if len(cuts) else np.zeros(0, np.int64)
        many = n >= least
        return pa.RecordBatch.from_arrays([pa.array(a[cuts][many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["anchor", "n"])

    return out


def _seed_rows(buckets: int, hot):
    """Rows (bucket, data): runs of windows for the buckets of their anchors, and what is found already for the buckets
    of its documents, which are numbered after those. Anchors whose bit is set in hot are split by windows."""

    def out(found, runs) -> pa.RecordBatch:
        # what is found goes straight to its document's row, past the buckets of anchors
        rows = [(buckets + b, x) for b, x in _found_rows(*found, buckets)]
        a, d, t, p, ln, w = runs
        split = common.bitmap_has(hot.value, a & np.uint64(common.BITMAP_BITS - 1))
        if split.any():
            # a run of a split anchor becomes a run for each of its windows
            parts = np.where(split, ln, 1)
            step = np.where(np.repeat(split, parts), _expand(parts), 0)
            a, d, t, p, split = (np.repeat(x, parts) for x in (a, d, t, p, split))
            p, ln = p + step, np.where(split, 1, np.repeat(ln, parts))
        first = w[np.cumsum(ln) - ln]
        b = np.where(split, wh.mix(a ^ wh.mix(first)), a >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(b, kind="stable")
        start_w = np.cumsum(ln) - ln
        w = w[np.repeat(start_w[order], ln[order]) + _expand(ln[order])] if len(order) else w
        a, d, t, p, ln, b = (x[order] for x in (a, d, t, p, ln, b))
        ends_w = np.concatenate([[0], np.cumsum(ln)])
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(b))):
            values = (a[i:j], d[i:j], t[i:j], p[i:j], ln[i:j], w[ends_w[i] : ends_w[j]])
            rows.append((int(b[i]), _pack(*(x.astype(kind) for x, kind in zip(values, _KINDS)))))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "data"])

    return out


def _found_rows(d: np.ndarray, t: np.ndarray, p: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Matched windows (document, tag, window) as runs, packed into a row for each bucket of documents."""
    if not len(d):
        return
    t = t.astype(np.int64)
    b = wh.mix(d.astype(np.int64).view(np.uint64) ^ wh.mix(t.view(np.uint64))) % np.uint64(buckets)
    order = np.lexsort((p, t, d, b))
    d, t, p, b = d[order], t[order], p[order].astype(np.int64), b[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1)])
    s = np.flatnonzero(new)
    ln = np.diff(np.append(s, len(d)))
    d, t, p, b = d[s], t[s], p[s], b[s]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for i, j in zip(cuts, np.append(cuts[1:], len(b))):
        yield int(b[i]), _pack(*(x[i:j].astype(kind) for x, kind in zip((d, t, p, ln), _FOUND)))


def _extend(buckets: int):
    """Reduce side: of a bucket of anchors, the windows that a smaller document has too, by bucket of documents; rows
    of what was found before pass."""

    def run(bucket: pa.Table) -> pa.Table:
        at = bucket.column("bucket")[0].as_py()
        if at >= buckets:
            data = bucket.column("data")
            return pa.table({"to": pa.array(np.full(len(data), at - buckets)), "data": data})
        a, d, t, p, ln, w = (np.concatenate(x) for x in zip(*(_unpack(x.as_buffer(), *_KINDS) for x in bucket.column("data"))))
        ln = ln.astype(np.int64)
        in_run = np.repeat(np.arange(len(a)), ln)
        sub = np.flatnonzero(_shared(a, d)[in_run])
        r = in_run[sub]
        hit = earlier(a[r], w[sub], d[r])
        sub, r = sub[hit], r[hit]
        rows = list(_found_rows(d[r], t[r], p[r] + (sub - (np.cumsum(ln) - ln)[r]), buckets))
        return pa.table({"to": pa.array([b for b, _ in rows], pa.int64()), "data": pa.array([x for _, x in rows], pa.binary())})

    return run


def _merge(window: int):
    """Found runs of a bucket of documents to a row for each document: its spans of words, joined where they overlap."""

    def run(found: pa.Table) -> pa.Table:
        d, t, s, n = (np.concatenate(x) for x in zip(*(_unpack(x.as_buffer(), *_FOUND) for x in found.column("data"))))
        order = np.lexsort((s, t, d))
        d, t, s, n = d[order], t[order], s[order].astype(np.int64), n[order].astype(np.int64)
        doc = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        far = np.cumsum(doc) << 40  # keeps documents apart
        e = s + n - 1 + window + far
        # overlapping extensions join; those that only touch stay apart
        new = doc | np.concatenate([[True], s[1:] + far[1:] >= np.maximum.accumulate(e)[:-1]])
        at, docs = np.flatnonzero(new), np.flatnonzero(doc)
        ends = np.maximum.reduceat(e, at) - far[at]
        spans = pa.StructArray.from_arrays([pa.array(s[at].astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"])
        offsets = np.append(np.searchsorted(at, docs), len(at)).astype(np.int32)
        return pa.table({"doc_id": pa.array(d[docs]), "tag": pa.array(t[docs]), "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tag tells apart rows that share an id but not their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 5) -> DataFrame:
    """Maximal repeats: one row (doc_id, tag, spans) for each document with words of a window that also starts in a
    document of smaller id; spans is an array of (start, end) word positions, end exclusive, each at least `window`
    words, in order. tag is a 64-bit hash of the text.

    Null texts have no words. Rows whose id is null neither match nor are matched. Rows that repeat an id are judged
    each by its own text, and none counts as smaller than the other. An empty table gives no rows."""
    if not 1 <= seed <= window:
        raise ValueError("seed must be between 1 and window words")
    spark = docs.sparkSession
    base = _prepared(docs, id_col, text_col).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(common.partitions(spark), -(-size // BUCKET_BYTES))
    # a pass over the texts before the one that sends windows: only anchors that are frequent are counted, so little moves
    counts = base.transform(common.in_batches, _flushes(window, seed, _frequent(FREQUENT)), "anchor long, n long")
    many = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_WINDOWS)
    hot = spark.sparkContext.broadcast(common.bitmap_of(many.select(F.pmod("anchor", F.lit(common.BITMAP_BITS)).alias("p"))))
    seeds = base.transform(common.in_batches, _flushes(window, seed, _seed_rows(buckets, hot)), "bucket long, data binary")
    found = _dealt(seeds, "bucket", buckets).applyInArrow(_extend(buckets), "to long, data binary")
    return _dealt(found, "to", buckets).applyInArrow(_merge(window), "doc_id long, tag long, spans array<struct<start:int,end:int>>")


def _dealt(rows: DataFrame, number: str, buckets: int):
    """Rows grouped by bucket number; buckets are dealt to tasks in turn, as hashed numbers would put many in one task."""
    parts = min(buckets, MOST_TASKS)
    dealt = rows.withColumn("part", F.pmod(number, F.lit(parts)).cast("int"))
    return dealt.repartitionById(parts, "part").groupBy("part", number)


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<struct<start:int,end:int>>"


def _strip(keep_text: bool, bits=None):
    """Batches of (doc_id, text[, spans]) to results. With bits, only documents that the bitmap surely lacks."""

    def run(batches):
        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(~common.bitmap_has(bits.value, b.column("bit").to_numpy(zero_copy_only=False))))
            if not b.num_rows:
                continue
            all_spans = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            n, gone, texts, sha = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), all_spans):
                w = _words(text)
                n.append(len(w))
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        parts += w[at : s["start"]]
                        at = s["end"]
                    w = parts + w[at:]
                gone.append(n[-1] - len(w))
                kept = " ".join(w)
                sha.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                texts.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(sha, pa.string()), pa.array(all_spans, _SPANS)],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "repeats"],
            )

    return run


def _words(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+. bytes.split() splits at exactly these six bytes."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 5, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text (null unless keep_text), kept_sha256 and
    repeats (the removed word spans). A word goes if a window of `window` words that covers it also starts in a
    document of smaller id; windows are judged on the input. Cases as in `repeats`.

    Documents without a repeat never leave their map task: a bitmap of fixed size names those that may have one, and
    only their texts are shuffled to meet their spans."""
    spark = docs.sparkSession
    found = common.cut(repeats(docs, id_col, text_col, window, seed))
    bits = spark.sparkContext.broadcast(common.bitmap(found, "doc_id"))
    base = _prepared(docs, id_col, text_col).withColumn("bit", common.bit_position("doc_id"))
    clean = base.select("doc_id", "text", "bit").transform(common.in_batches, _strip(keep_text, bits), _RESULT)
    maybe = base.transform(common.in_batches, _route(bits), "doc_id long, text string, tag long")
    some = maybe.join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").transform(common.in_batches, _strip(keep_text), _RESULT)
    return clean.unionByName(some)


def _route(bits):
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(common.bitmap_has(bits.value, b.column("bit").to_numpy(zero_copy_only=False))))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("tag")], ["doc_id", "text", "tag"])

    return run
