"""Near-dedup and substring dedup against brute force, with nulls, blanks, long texts, repeated rows and clashing names."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stateloom.llm import common, decontam, near_dup, substring, wordhash


def words(text):
    return (text or "").encode().split()


def shingles(text, k):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    at = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in at if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in at:
        for b, u in at:
            if a is not None and b is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in at), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    out = near_dup.near_duplicates(docs, shingle=k, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_components([r[:2] for r in rows], k, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_graded_variants_in_one_bucket(spark):
    """Variants of one text at all distances: links between members that the first star misses are found."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in r.choice(200, i // 6, replace=False):
            w[j] = f"v{i}x{j}" if i % 2 else f"v{i // 4}x{j}"
        rows.append((int(r.integers(10_000)) * 1000 + i, " ".join(w)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in out), key=str) == brute_components(rows, 3, 85)


def test_ids_with_several_texts_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()} == {(5, 5), (7, 5), (9, 5)}


def test_empty_tables(empty):
    assert near_dup.near_duplicates(empty).collect() == []
    assert substring.remove_repeats(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (50, 50), (None, 3)]
    out = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50}


def brute_repeats(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush, hot", [(1 << 12, 1 << 20), (8 << 20, 1 << 20), (1 << 12, 1), (8 << 20, 1), (1 << 12, 40)])
def test_remove_repeats(docs, rows, monkeypatch, flush, hot):
    monkeypatch.setattr(substring, "FLUSH_BYTES", flush)
    monkeypatch.setattr(substring, "HOT_WINDOWS", hot)
    if hot == 1:
        monkeypatch.setattr(substring, "FREQUENT", 1)  # every anchor is split
    out = substring.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_repeats([r[:2] for r in rows], 13)
    for r in out:
        assert r.n_removed == sum(s.end - s.start for s in r.repeats or []) and all(s.end - s.start >= 13 for s in r.repeats or [])
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_windows_of_a_hot_anchor_part(spark):
    """A phrase in many contexts: one bucket for its windows, or, once it is hot, as many as there are."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array([" ".join([*(f"b{i}x{j}" for j in range(8)), "a", "very", "common", "phrase", "here", *(f"e{i}x{j}" for j in range(8))]) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), texts], ["doc_id", "tag", "text"])

    class Bits:
        value = np.zeros(common.BITMAP_BITS // 8, np.uint8)

    counts = pa.Table.from_batches(substring._flushes(13, 5, substring._frequent(16))([batch])).to_pydict()
    top = max(counts["n"])
    windows = lambda: {r["bucket"]: substring._unpack(r["data"], *substring._KINDS) for r in pa.Table.from_batches(substring._flushes(13, 5, substring._seed_rows(50, Bits))([batch])).to_pylist()}
    whole = windows()
    Bits.value = np.full(common.BITMAP_BITS // 8, 255, np.uint8)
    split = windows()
    assert top > 16 and len(counts["n"]) == 1
    sent = lambda x: sorted((int(a), int(w)) for parts in x.values() for a, w in zip(np.repeat(parts[0], parts[4]), parts[5]))
    assert sent(whole) == sent(split) and len(sent(whole)) == 300 * 9
    assert max(len(x[5]) for x in split.values()) < 2 * 300 * 9 / 50


def test_word_hashes_agree_with_words():
    texts = ["a b  c", "", None, "Hello wörld a", "b", " lead", "trail "]
    h, rows, _, _ = wordhash.words(pa.array(texts), wordhash.SPACED)
    flat = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert rows.tolist() == [i for i, _ in flat]
    by = {}
    for (_, w), x in zip(flat, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    grams = wordhash.ngrams(h, 3)
    assert len(grams) == len(h) - 2 and Counter(grams.tolist()).most_common(1)[0][1] == 1


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:800], r.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)]))
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    tiny = np.sort(r.integers(0, 1 << 63, 3).astype(np.uint64))
    assert set(near_dup.signature(tiny).tolist()) <= set(tiny.tolist())


def thue_morse(n):
    x = [0]
    while len(x) < n:
        x += [1 - y for y in x]
    return x[:n]


def test_words_that_a_polynomial_hash_confuses_are_told_apart(spark):
    """The Thue-Morse word over two letters and its mirror have equal polynomial hashes modulo 2^64."""
    a, b = ("".join(x[i] for i in thue_morse(1024)) for x in ("ab", "ba"))
    h = wordhash.words(pa.array([a, b]), wordhash.SPACED)[0]
    assert h[0] != h[1]
    p, q = (np.array([x[i] for i in thue_morse(1024)], np.uint64) for x in ((5, 11), (11, 5)))
    assert wordhash.ngrams(p, 1024) != wordhash.ngrams(q, 1024)
    assert all(n < 1024 for *_, n in decontam.tiles(p, q, 5))
    rows = [(1, " ".join([a, b] * 10)), (2, " ".join([a] * 20)), (3, " ".join([b] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(df, shingle=3, percent=85).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert [r.n_removed for r in substring.remove_repeats(df).collect()] == [0, 0, 0]


def test_long_words_and_word_places():
    texts = ["x" * n for n in (31, 32, 33, 34, 100)] + ["x" * 32 + "y" * 40, "x" * 33 + "y" * 39, "ab", "ba", "a b", "  é", ""]
    h, rows, starts, ends = wordhash.words(pa.array(texts), wordhash.SPACED)
    flat = [w for t in texts for w in words(t)]
    assert len(h) == len(flat) and len(set(h.tolist())) == len(set(flat))
    alone = [wordhash.words(pa.array([w.decode()]), wordhash.SPACED)[0][0] for w in flat]
    assert alone == h.tolist()
    one, head = wordhash.words(pa.array(["abcdef abcd abcx"]), wordhash.SPACED, (4,))[0].T
    assert head[0] == head[1] != head[2] and len(set(one.tolist())) == 3
