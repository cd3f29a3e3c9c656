"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Each text becomes its set of distinct word shingles (64-bit hashes), in one pass over the bytes. One permutation
   splits the hash range into BINS bins and keeps each bin's smallest hash; an empty bin borrows from the first
   filled bin in its own fixed random order of bins.
2. Texts with equal sets are one class, held by its smallest document. BANDS bands of ROWS rows are each hashed to a
   bucket key; buckets of one class vanish in the aggregation.
3. Each class is first paired with one star centre, the smallest document of its buckets that it meets most often,
   and the pair is confirmed on the full sets. Then components are found.
4. Buckets that still hold several components go on. A link between two components can only rest on shingles that
   stand in two of them, so each member's such shingles, its core, bound what it can share: members whose core is too
   small for any link go. Cores are counted by slices of the hash range, and two members share no more than the sum
   of the smaller counts: pairs for which that is too few are never made. Variants that each have edits of their own
   fall here, however many share a bucket.
5. What is left goes on in rounds. In each, the next centres in order (256, 512, ... of them) are tried against the
   later members of other components. So every pair of a bucket that could still join two components is tried, and
   none within a component: a bucket full of near copies costs one star.

A link of similarity 0.8 shares no bucket with a chance of (1 - 0.8^4)^32 = 5e-8, one of 0.85 with 6e-11."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordhash as wh

BINS, BANDS, ROWS = 128, 32, 4
#: Centres that each open bucket tries in its first round; every later round tries twice as many.
FIRST_CENTRES = 256
#: Slices of the hash range by which cores are counted.
SLICES = 16


@cache
def _probes() -> np.ndarray:
    """For each bin, the rank of every bin in that bin's own order of borrowing."""
    r = np.random.Generator(np.random.PCG64(20240229))
    return np.stack([r.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


_BOUNDS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS minima of sorted distinct hashes, densified. The bin is the hash's top seven bits."""
    at = np.searchsorted(shingles, _BOUNDS)
    end = np.append(at[1:], len(shingles))
    filled = at < end
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingles[at[filled]]
    if not filled.all():
        full = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        out[empty] = out[full[np.argmin(_probes()[np.ix_(empty, full)], axis=1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of each signature."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2])
    for j in range(ROWS):
        h = wh.mix(h ^ s[:, :, j])
    return h


def shingle_sets(col: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text has one, its whole sequence."""
    for i, j in wh.chunks(col):
        part = col.slice(i, j - i)
        h, rows, _, _ = wh.words(part, wh.SPACED_LOWER)
        edges = np.searchsorted(rows, np.arange(len(part) + 1))
        grams = wh.ngrams(h, k)
        short = [n for n in range(len(part)) if 0 < edges[n + 1] - edges[n] < k]
        brief = {n: wh.ngrams(h[edges[n] : edges[n + 1]], int(edges[n + 1] - edges[n]))[0] for n in short}
        for n in range(len(part)):
            a, b = edges[n], edges[n + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif n in brief:
                yield np.array([brief[n]], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signed(k: int):
    """(doc_id, text) to (doc_id, n, d1, d2, keys): set size, digest and bucket keys (null for empty sets)."""

    def run(batches):
        for b in batches:
            n, d, sig = [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                d.append((wh.mix(s).sum(dtype=np.uint64), wh.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                sig.append(signature(s) if len(s) else np.zeros(BINS, np.uint64))
            if not n:
                continue
            keys = band_keys(np.stack(sig)).view(np.int64)
            d = np.array(d, np.uint64).view(np.int64)
            empty = pa.array([x == 0 for x in n])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=empty)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "n", "d1", "d2", "keys"])

    return run


def _sets(k: int, bits):
    """(doc_id, text, bit) to (doc_id, shingles) of the documents that the bitmap names."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(common.bitmap_has(bits.value, b.column("bit").to_numpy(zero_copy_only=False))))
            if b.num_rows:
                sets = [s.tobytes() for s in shingle_sets(b.column("text"), k)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """(u, v, a, b) to the (u, v) whose sets are alike enough, in whole numbers."""

    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        if 100 * len(x) < percent * len(y):
            return False
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        for b in batches:
            keep = [alike(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            out = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("u"), out.column("v")], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable over links, itself
    included) and kept (doc_id = component_id). Documents are linked if 100 * intersection >= percent * union.

    Null and blank texts have no shingles and are linked with nothing. Rows whose id is null are linked with nothing:
    component_id is null and kept true. Rows that share an id are one node, linked by either's text. An empty table
    gives no rows."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = common.cut(base.transform(common.in_batches, _signed(shingle), "doc_id long, n long, d1 long, d2 long, keys array<long>"))
    nodes = signed.where("doc_id is not null and n > 0")
    classes = nodes.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = nodes.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    rows = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    members = common.cut_narrow(rows.join(shared.select("key", "low"), "key").select("key", "doc_id", "n", "low"))
    links = _links(base, members, shingle, percent)
    if links is None:
        component = spark.createDataFrame([], "id long, component long")
    else:
        component = common.components(links)
        common.discard(links)
    by_class = classes.join(component, classes.rep == component.id, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    # ids whose rows have several texts tie their classes together
    out = signed.join(by_class, ["d1", "d2"], "left")
    out = _joined_ids(signed, out)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    found = F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined_ids(signed: DataFrame, out: DataFrame) -> DataFrame:
    """Where rows share an id and not a text, let the classes of that id share a component."""
    many = signed.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d")).where("a <> b or c <> d")
    if not many.limit(1).count():
        return out
    ties = out.where("doc_id is not null and n > 0").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    tied = common.components(ties).select(F.col("id").alias("doc_id"), "component")
    return out.join(tied, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "component_id").alias("component_id"))


def _links(base: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Confirmed links (u, v) that span every component of the bucket members; None if there are no buckets."""
    spark = base.sparkSession
    if not members.limit(1).count():
        return None
    bits = spark.sparkContext.broadcast(common.bitmap(members, "doc_id"))
    sets = common.cut(base.withColumn("bit", common.bit_position("doc_id")).where("doc_id is not null").transform(common.in_batches, _sets(shingle, bits), "doc_id long, shingles binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
        b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
        return common.stored(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").transform(common.in_batches, _confirm(percent), "u long, v long"))

    met = members.where("doc_id <> low").groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("low")).alias("low"))).alias("best"))
    links = confirmed(first.select(F.col("doc_id").alias("u"), (-F.col("best.low")).alias("v")))
    # of two linked sets the smaller one shares this part of its own at least, so it alone need be a centre
    can = F.lit(100 + percent) * F.col("core") >= F.lit(2 * percent) * F.col("n")
    in_order = F.row_number().over(Window.partitionBy("key").orderBy((~can).cast("int"), "doc_id", "n"))
    open_ = common.cut_narrow(_still_open(members.drop("low"), common.components(links)))
    open_ = _able(open_, sets, percent)
    open_, tried, step = common.cut_narrow(open_.withColumn("rank", in_order)), 0, FIRST_CENTRES
    while True:
        centre = open_.where(can & F.col("rank").between(tried + 1, tried + step))
        if not centre.limit(1).count():
            return links
        centre = centre.select("key", *(F.col(a).alias(b) for a, b in (("doc_id", "v"), ("n", "nv"), ("rank", "rv"), ("c", "cv"), ("core", "kv"))), F.col("keys").alias("keysv"), *(F.col(f"s{i}").alias(f"v{i}") for i in range(SLICES)))
        enough = lambda most: F.lit(100) * most >= F.lit(percent) * (F.col("n") + F.col("nv") - most)
        both = sum((F.least(f"s{i}", f"v{i}") for i in range(1, SLICES)), F.least("s0", "v0"))
        close = (F.col("rank") > F.col("rv")) & (F.col("c") != F.col("cv")) & enough(F.least("core", "kv")) & enough(both)
        close &= F.array_min(F.array_intersect("keys", "keysv")) == F.col("key")  # in one of their buckets only
        new = confirmed(open_.join(centre, "key").where(close).select(F.col("doc_id").alias("u"), "v").distinct())
        if new.limit(1).count():
            links = links.unionByName(new)
            open_ = common.cut_narrow(_still_open(open_.drop("c"), common.components(links)))
        tried, step = tried + step, step * 2


def _tokens(batches):
    """(doc_id, c, shingles) to a row (doc_id, c, token) for each shingle."""
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
        n = [len(x) for x in sets]
        ids, c = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), n) for k in ("doc_id", "c"))
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        for i in range(0, len(tokens), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 500_000]) for x in (ids, c, tokens)], ["doc_id", "c", "token"])


def _able(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of open buckets with their core: how many of their shingles stand in two components. Members whose
    core is too small for a link go, and then buckets of one component. The bound holds for every text of an id."""
    of = open_.select("doc_id", "c").distinct()
    tokens = sets.join(of, "doc_id").select("doc_id", "c", "shingles").transform(common.in_batches, _tokens, "doc_id long, c long, token long")
    shared = tokens.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("token")
    at = F.call_function("shiftrightunsigned", "token", F.lit(64 - (SLICES.bit_length() - 1)))
    counts = [F.count_if(F.col("at") == i).alias(f"s{i}") for i in range(SLICES)]
    core = tokens.join(shared, "token").select("doc_id", at.alias("at")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("core"), *counts)
    able = open_.join(core, "doc_id").where(F.lit(100) * F.col("core") >= F.lit(percent) * F.col("n"))
    able = common.cut_narrow(able)
    split = able.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    able = able.join(split, "key")
    return able.join(able.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "doc_id")


def _still_open(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component c."""
    of = component.select(F.col("id").alias("doc_id"), F.col("component").alias("c"))
    placed = members.join(of, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    split = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return placed.join(split, "key").select(*members.columns, "c")
