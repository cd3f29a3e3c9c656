"""Ranked search and importance resampling against brute force."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from stateloom.llm import common, resample, wand

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(rows, items, top):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in wanted.items():
        hits = []
        for i, c in docs:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if t in c)
                if s > 0:
                    hits.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(hits)[:top])]
    return sorted(out, key=str)


def items_of(rows):
    texts = [t for _, t, *_ in rows if t]
    return [(k, " ".join(t.split()[:25])) for k, t in enumerate(texts[:30])] + [(100, None), (101, "no such words 0x0"), (3, texts[40]), (None, texts[7]), (102, texts[-1])]


@pytest.mark.parametrize(("top", "block", "postings"), [(50, 1 << 18, 1 << 21), (5, 40, 300), (1, 1 << 18, 1)])
def test_search(spark, docs, rows, monkeypatch, top, block, postings):
    """Nulls, blanks, repeated rows and ids, long texts, clashing names; many blocks of queries and many shards."""
    monkeypatch.setattr(wand, "BLOCK_TERMS", block)
    monkeypatch.setattr(wand, "SHARD_POSTINGS", postings)
    items = items_of(rows)
    found = wand.search(docs, spark.createDataFrame(items, "item_id long, text string"), top=top).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_search([r[:2] for r in rows], items, top)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert wand.search(empty, items).count() == 0
    assert wand.search(docs, items.limit(0)).count() == 0


def test_shard_skips_but_loses_nothing():
    r = np.random.default_rng(3)
    for _ in range(60):
        lists = []
        for _ in range(r.integers(1, 8)):
            d = np.unique(r.integers(0, 400, r.integers(1, 200)))
            a = r.integers(1, r.choice([3, 1000]), len(d))
            lists.append((d.tolist(), a.tolist(), int(a.max())))
        total = Counter()
        for d, a, _ in lists:
            total.update(dict(zip(d, a)))
        top = int(r.integers(1, 20))
        best = sorted(((-s, d) for d, s in total.items()))[:top]
        assert sorted((-s, -d) for s, d in wand.search_shard(lists, top)) == best


def test_additions_beyond_64_bits():
    n = np.array([10**6, 3])
    big = wand.additions(np.array([5, 7]), np.array([2, 1]), n, 10**13, 10**15)
    assert big.tolist() == [w * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * int(k) * 10**13 // 10**15))) for w, tf, k in zip((5, 7), (2, 1), n)]


def brute_features(text, low, high, buckets):
    w = terms(text)
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 5)])
def test_buckets_of_ngrams(rows, low, high):
    texts = [t for _, t, *_ in rows] + ["a", "a b", "a b a b a b a", "É é É é", "x\x00y z"]
    n_words, at, found = resample.buckets_of(pa.array(texts, pa.string()), low, high, 997)
    got = [[] for _ in texts]
    for i, b in zip(at.tolist(), found.tolist()):
        got[i].append(b)
    for text, n, bs in zip(texts, n_words.tolist(), got):
        assert (n, sorted(bs)) == (lambda x: (x[0], sorted(x[1])))(brute_features(text, low, high, 997))


def test_suffixes_are_sorted():
    r = np.random.default_rng(0)
    ids, left = r.integers(0, 3, 200), np.concatenate([np.arange(n, 0, -1) for n in (120, 1, 79)])
    order, lcp = resample.suffix_array(ids, left, 4)
    suffix = [tuple(ids[i : i + min(4, left[i])]) for i in order]
    assert suffix == sorted(suffix)
    for a, b, n in zip(suffix, suffix[1:], lcp[1:]):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_resample(rows, target, low, high, buckets, percent, least):
    each = [brute_features(t, low, high, buckets) for _, t in rows]
    s, t = Counter(b for _, x in each for b in x), Counter(b for x in target for b in brute_features(x, low, high, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, _), (n, x) in zip(rows, each):
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    told = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted(told + [(*r[:4], None) for r in out if not r[4]], key=str)


@pytest.mark.parametrize(("low", "high", "percent", "least"), [(1, 1, 10, 20), (1, 2, 60, 2), (3, 3, 100, 0)])
def test_resample(spark, docs, rows, monkeypatch, low, high, percent, least):
    monkeypatch.setattr(resample, "RANGE_ROWS", 10)
    monkeypatch.setattr(resample, "STRETCH_BYTES", 500)
    target = [t for _, t, *_ in rows[:9]] + [None, "nothing like it"]
    out = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), low, high, 1000, percent, least).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute_resample([r[:2] for r in rows], target, low, high, 1000, percent, least)


def test_resample_of_nothing(docs, empty):
    assert resample.resample(empty, docs).count() == 0
    assert resample.resample(docs, empty).count() == docs.count()
    with pytest.raises(ValueError):
        resample.resample(docs, docs, low=2, high=1)


def test_many_equal_rows_are_ranked_once_each(spark):
    same = spark.range(3000).selectExpr("cast(7 as long) doc_id", "'a b c d e f g h i j k l m n o p q r s t u' text")
    out = resample.resample(same, same.limit(1), percent=50)
    assert sorted(r.rank for r in out.collect() if r["rank"]) == list(range(1, 1501))
    assert common.cut(out).count() == 3000
