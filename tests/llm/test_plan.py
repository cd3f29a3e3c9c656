"""Sharding, mixing, decontamination, quality and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stateloom.llm import boost, common, decontam, mixing, quality, sharding


def hash60(v):
    return int(hashlib.md5(("" if v is None else str(v)).encode()).hexdigest()[:15], 16)


def brute_shards(rows, limit):
    at = [(i, len((t or "").encode()), hash60(i)) for i, t in rows]
    out = []
    for i, n, h in at:
        for d in range(61):
            inside = [(m, g) for _, m, g in at if g >> (60 - d) == h >> (60 - d)]
            if sum(m for m, _ in inside) <= limit or len({g for _, g in inside}) == 1:
                out.append((i, n, format(h >> (60 - d), f"0{d}b") if d else "", d, sum(m for m, _ in inside)))
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0, 500, 5000, 1 << 30])
def test_shards(docs, rows, limit):
    out = sharding.assign_shards(docs, limit_bytes=max(1, limit))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_shards([r[:2] for r in rows], max(1, limit))


def test_shards_go_on_where_cells_are_oversized(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLACK", 0)
    monkeypatch.setattr(sharding, "STEP", 2)
    rows = [(i, "x" * (900 if i % 7 == 0 else 10)) for i in range(200)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=1000)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_shards(rows, 1000)


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(df, sharding.assign_shards(df, limit_bytes=100), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1, sum(w[s] for s in free))
        new = [s for s in free if level * w[s] > most * sizes[s]]
        if not new:
            return {**{s: level * w[s] for s in free}, **full}
        full |= {s: most * sizes[s] for s in new}


def test_mix(docs, rows):
    out = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    targets = brute_targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in out), key=str) == sorted(((i, size(t), sizes[s]) for i, t, _, s, *_ in rows), key=str)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and any(abs(r.target - v) < 1e-6 for v in targets.values())
        taken[r.source_size] += r.taken
    for s, v in targets.items():
        largest = max(r.size for r in out)
        assert abs(taken[sizes[s]] - v) <= largest, s
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_mix_in_order_is_the_mix(docs):
    out = mixing.mix_in_order(docs).withColumn("part", F.spark_partition_id()).collect()
    assert [r.time for r in out] == sorted(r.time for r in out), "ranges and rows in order of virtual time"
    copies = Counter((r.doc_id, r["size"]) for r in out)
    told = Counter()
    for r in mixing.mix(docs).collect():
        told[r.doc_id, r["size"]] += r.copies
    assert copies == Counter({k: v for k, v in told.items() if v})
    assert mixing.mix_in_order(docs.limit(0)).collect() == []


def test_mix_of_many_small_documents_is_close(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 9), f"s{min(4, int(r.expovariate(1)))}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for x in out:
        taken[x.source_size] += x.taken
        target[x.source_size] = x.target
    assert all(abs(taken[s] - t) < 60 for s, t in target.items())


def test_tiles_are_greedy_and_find_reordered_passages():
    a = np.arange(1, 31, dtype=np.uint64)
    b = np.concatenate([a[15:], np.uint64(99) * np.ones(3, np.uint64), a[:15]])
    t = decontam.tiles(b, a, 5)
    assert sorted((i, n) for _, i, n in t) == [(0, 15), (15, 15)]
    assert decontam.tiles(b[:4], a, 5) == [] and decontam.tiles(np.ones(500, np.uint64), np.ones(40, np.uint64), 5) == [(0, 0, 40)]


def brute_tiles(a, b, least):
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            ma[i + k] = mb[j + k] = True
        total += n


def test_tiles_cover_as_plain_tiling_does():
    r = random.Random(4)
    for _ in range(40):
        a, b = ([r.randint(1, 3) for _ in range(r.randint(0, 40))] for _ in range(2))
        t = decontam.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in t)
        assert sum(n for *_, n in t) == brute_tiles(a, b, 3)


def test_decontamination(spark, rows):
    r = random.Random(9)
    item = [f"q{i}" for i in range(40)]
    parts = [item[20:], item[:20]]
    texts = {
        1000: "lead " + " ".join(item).upper() + " tail", 1001: " ".join(parts[0]) + " middle words here " + " ".join(parts[1]), 1002: " ".join(item[:12]),
        1003: " ".join(r.sample(item, 40)), 1004: None, 1005: "", 1006: " ".join(["q1"] * 20_000),
    }
    schema = "doc_id long, text string, items string, row string"
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in [*((x[0], x[1]) for x in rows), *texts.items()]], schema)
    items = spark.createDataFrame([(7, "! ".join(item)), (8, "too short"), (9, None), (None, " ".join(item)), (10, "q1 " * 30)], "item_id long, text string")
    out = decontam.decontaminate(df, items).collect()
    assert len(out) == len(rows) + len(texts)
    hit = {x.doc_id: (x.item_id, x.covered, x["items"]) for x in out if x.contaminated}
    assert hit == {1000: (7, 1.0, [7]), 1001: (7, 1.0, [7]), 1006: (10, 1.0, [10])}
    assert all(x.n_items == 0 and x.item_id is None and x.covered == 0 for x in out if not x.contaminated)
    twice = items.unionByName(spark.createDataFrame([(7, "wholly other words than those of the first one " * 3), (7, "! ".join(item))], items.schema))
    assert {x.doc_id: (x.item_id, x.covered, x["items"]) for x in decontam.decontaminate(df, twice).where("contaminated").collect()} == hit
    assert decontam.decontaminate(df, items.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(df.limit(0), items).collect() == []


def brute_leaks(texts, items, least=5, coverage=0.5):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = {}
    for i, t in texts:
        got = []
        for k, s in items:
            b = words(s)
            covered = brute_tiles(words(t), b, least) / len(b) if len(b) >= least else 0
            if covered >= coverage:
                got.append((k, covered))
        out[i] = got
    return out


def test_decontamination_against_plain_tiling(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 30)))) for k in range(12)]
    texts = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            s = items[r.randrange(12)][1].split()
            a = r.randrange(len(s))
            at = r.randrange(len(w) + 1)
            w[at:at] = s[a : a + r.randint(3, 25)]
        texts.append((i, " ".join(w)))
    df, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(texts, items)
    for x in decontam.decontaminate(df, b).collect():
        assert (x["items"] or []) == sorted(k for k, _ in want[x.doc_id]) and x.n_items == len(want[x.doc_id])
        assert abs(x.covered - max((c for _, c in want[x.doc_id]), default=0)) < 1e-12
    assert any(want.values())


def test_clashing_names_and_folders(spark):
    names = ["gone", "Gone_", "mix_id", "mix_size", "mix_copies", "mix_copy", "judged", "_id", "_size", "_copies", "_copy", "_gone_id"]
    df = spark.createDataFrame([(i, "a b c", "en", f"s{i % 2}", 5, *names) for i in range(9)], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)]))
    gone = spark.createDataFrame([(3,), (None,)], "doc_id long")
    assert sorted(r.doc_id for r in common.without(df, gone).collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and mixed.count() > 0
    assert common.fresh("Gone", *names) == "Gone__"


def labelled(n=900, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        kind = r.random()
        if kind < 0.12:
            w.insert(r.randrange(len(w)), r.choice(["vilebad", "vileworse", "vilest"]))
            labels.append((i, 1, 1))
        elif kind < 0.25:
            w = [x for x in w[:8] for _ in range(8)]
            labels.append((i, 0, 0))
        else:
            labels.append((i, 1, 0))
        text = " ".join(w)
        docs.append((i, text, r.choice(["en", "de"]), "junk" if kind < 0.1 else f"s{r.randrange(4)}", len(text)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:600] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(d, known).collect()}
    good = {i for i, q, t in labels[600:] if q == 1 and t == 0}
    rest = {i for i, *_ in labels[600:]}
    assert np.mean([out[i].accepted for i in good]) > 0.9 and np.mean([out[i].accepted for i in rest - good]) < 0.15
    assert {r.doc_id for r in quality.accepted_only(d, known).collect()} == {i for i, r in out.items() if r.accepted}


def test_quality_rounds_draw_from_all_unlabelled_rows(spark, monkeypatch):
    docs, labels = labelled()
    d = spark.createDataFrame(docs + docs[700:720], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    calls, real = [], quality.co_train

    def spy(labelled, draw, *how):
        def watched(content, metadata, ids, most):
            out = draw(content, metadata, ids, most)
            calls.append((content, metadata, ids, most, out))
            return out

        return real(labelled, watched, *how)

    monkeypatch.setattr(quality, "co_train", spy)
    model = quality.train(d, known, pool=100)
    assert calls and model.report["exchanged"] == [len(c[-1]) for c in calls] and model.report["exchanged"][0] > 0
    rest = docs[600:]  # far more than a round takes
    x, h, at = quality.statistics(pa.array([t[1] for t in rest]))
    for content, metadata, ids, most, out in calls:
        said = {"content": content.score(x, h, at), "metadata": metadata.score(*zip(*(t[2:] for t in rest)))}
        for giver, taker in (("content", "metadata"), ("metadata", "content")):
            for side in (1.0, 0.0):
                p = {t[0]: v for t, v in zip(rest, said[giver]) if t[0] not in ids[taker] and (v >= 0.97 if side else v <= 0.03)}
                got = [r["doc_id"] for g, r in out if g == giver and r["y"] == side]
                assert len(got) == len(set(got)) == min(most[side], len(p))
                assert np.allclose(sorted(p[i] for i in got), sorted(p.values(), reverse=bool(side))[: len(got)][:: -1 if side else 1])


def test_unlabelled_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP_BITS", 1 << 16)  # some ids share a bit
    rows = [(i, f"text {i} of {i % 7}", "en", "web", i) for i in range(9000)] + [(i, f"other {i}", "en", None, 3) for i in range(0, 9000, 50)]
    d = quality._typed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    said = spark.createDataFrame([(i,) for i in range(0, 12000, 3)], "doc_id long")
    got = quality._unlabelled(d, said, np.zeros(0, np.int64))
    plain = d.transform(common.in_batches, quality._featured(np.zeros(0, np.int64)), quality._FEATURES).join(said, "doc_id", "left_anti")
    plain = plain.groupBy("doc_id").agg(F.min(F.struct(*quality._FEATURED[1:])).alias("f")).select("doc_id", "f.*")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    # what both bitmaps hit is compared by id: two thirds of the repeated ids, and few more
    few = [f for f in got.inputFiles() if "sure" not in spark.read.parquet(f).columns]
    assert 0 < spark.read.parquet(*few).count() < 600
    common.discard(got)


def test_quality_cases(docs, rows, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.accepted for r in quality.classify(docs, none).collect()] == [True] * len(rows)
    some = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows) if r[0]], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, some).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.accepted_only(docs, some).columns == docs.columns
    assert quality.classify(empty, some).collect() == []


def test_both_views_count_where_both_carry_signal(spark):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        bad = r.random() < 0.4
        w = [f"w{r.randrange(300)}" for _ in range(30)]
        if bad and r.random() < 0.6:  # each view alone sees a part of the bad ones
            w += ["foulword"]
        source = "farm" if (bad and r.random() < 0.6) or r.random() < 0.05 else f"s{r.randrange(5)}"
        docs.append((i, " ".join(w), "en", source, 100))
        labels.append((i, 0 if bad else 1, 0))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.train(d, spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    assert model.weights[0] > 0.5 and model.weights[1] > 0.5
    assert model.report["balanced"] > 0.8
    # the views don't share a column: the text has no say in the metadata view
    a, b, p = model.scores(pa.array(["foulword", "fine"]), ["en"] * 2, ["farm"] * 2, [100] * 2)
    assert b[0] == b[1] and a[0] < a[1] and p[0] < p[1]


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    p = boost.fit(x, y).probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(300)
    w = docs[0][1].split()
    bench = [f"z{i}" for i in range(30)]
    docs += [(1000 + i, " ".join(w[: len(w) - i]) + " end", "en", "s1", 9) for i in range(2)] + [(2000, "so " + " ".join(bench) + " it goes", "en", "s2", 9), (3000, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, kind in (("documents", docs, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, " ".join(bench))], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, stage(spark, d, str(tmp_path)).cache()
        sizes.append(d.count())
        if name != "sharding":
            assert d.columns == before.columns
            assert {r.doc_id for r in d.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "benchmark decontamination":
            assert 2000 in {r.doc_id for r in before.collect()} and 2000 not in {r.doc_id for r in d.collect()}
    assert sizes[1] < sizes[0] and sizes[3] == sizes[2] - 1
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, d.collect()))
    assert all(corpus_pipeline.STAGES[i][1](spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0 for i in range(5))
