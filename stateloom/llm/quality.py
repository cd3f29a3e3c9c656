"""Quality classifier by co-training.

Two classifiers see separate views of a document: its content (character, line and word statistics, and words that
tell the classes apart) and its page metadata (language, source and stated length, nothing computed from the text).
They are fitted on a bounded sample of labelled rows. In each round each one scores all unlabelled documents on the
executors and labels those that it is surest of, and those rows join the other's training set. In the end both are
calibrated on held-out labelled rows, a logistic curve through both calibrated scores is fitted there too, and all
documents are scored in one pass.

A document is good if its label says quality 1 and toxic 0. Bounds: LABELLED rows of labels, the first in order of a
hash of the id, and a tenth of POOL other rows from each view in a round, the surest of all. What else the model holds
(words, languages, sources) is what those rows hold, so it is some hundred kilobytes, whatever the input's size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost, common, wordhash as wh

LABELLED, POOL, ROUNDS = 8000, 3000, 3
#: A word of the content view stands in so many labelled documents at least, and differs between the classes by so many
#: standard deviations.
WORD_DOCS, WORD_Z = 5, 4.0
#: Classifiers that aren't better than this on held-out rows, as the mean of both classes' hits, reject nothing.
LEAST_SKILL = 0.55
#: Least weight of a view in the combined score.
LEAST_WEIGHT = 0.1
#: Bytes of the beginnings of words that are features too.
HEADS = (4, 5)

_CLASSES = np.zeros(256, np.int64)  # 0 other, then the classes below
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b"#$%&*^~=<>{}[]\\@_+/", b".,;:'\"?()-"), 1):
    _CLASSES[list(_set)] = _i
_CLASSES[128:] = 10
_N_CLASSES = 11


def _by_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, hashes, rows) of an array of texts. The hashes are of words and of their beginnings, so that forms
    of one stem have something in common."""
    raw, off = wh.string_parts(col)
    n = len(col)
    h, rows, _, _ = wh.words(col, wh.ALNUM_LOWER, HEADS)
    h, rows = h.ravel(), np.repeat(rows, 1 + len(HEADS))
    spaced, srows, _, _ = wh.words(col, wh.SPACED_LOWER)
    sizes = np.maximum(np.diff(off), 1)
    c = _CLASSES[raw]
    share = np.stack([_by_row(c == k, off) / sizes for k in range(_N_CLASSES)], 1)
    n_words = np.bincount(srows, minlength=n)
    edges = np.concatenate([[0], np.cumsum(n_words)])
    again = np.concatenate([[False], (spaced[1:] == spaced[:-1]) & (srows[1:] == srows[:-1])]) if len(spaced) else np.zeros(0, bool)
    at_least = np.maximum(n_words, 1)
    order = np.lexsort((spaced, srows))
    s, r = spaced[order], srows[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]) if len(s) else np.zeros(0, bool)
    distinct = np.bincount(r[new], minlength=n)
    chars = sizes - _by_row((raw & 0xC0) == 0x80, off)
    lines = _by_row(raw == 10, off) + 1
    layout = [np.log1p(np.diff(off)), np.log1p(lines), np.log1p(chars / lines), sizes / np.maximum(chars, 1)]
    return np.column_stack([share, _by_row(again, edges) / at_least, distinct / at_least, chars / at_least, np.log1p(n_words), *layout]), h, rows


def distinct_words(h: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    edges = np.searchsorted(rows, np.arange(n + 1))
    return [np.unique(h[edges[i] : edges[i + 1]]) for i in range(n)]


@dataclass
class Words:
    """Word hashes, sorted, and the weight of each one's presence."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def of_array(self, h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            pairs = np.unique(rows[hit] * len(self.hashes) + at[hit])  # presence, not counts
            out += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], n)
        return out


def fit_words(docs: list[np.ndarray], y: np.ndarray, steps: int = 150, l2: float = 3.0) -> Words:
    """Logistic regression over the presence of the words that tell the classes apart beyond chance."""
    n = len(docs)
    if not n or y.all() or not y.any():
        return Words(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    flat = np.concatenate(docs)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    vocabulary, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    good = np.bincount(at, y[row], len(vocabulary))
    rate = y.mean()
    z = np.abs(good - df * rate) / np.sqrt(df * rate * (1 - rate))
    z[df < WORD_DOCS] = 0
    top = np.flatnonzero(z >= WORD_Z)
    place = np.full(len(vocabulary), -1)
    place[top] = np.arange(len(top))
    use = place[at] >= 0
    row, at = row[use], place[at[use]]  # the presence of a word in a row: a sparse matrix of ones
    w, b, v, vb = np.zeros(len(top)), float(np.log(rate / (1 - rate))), np.zeros(len(top)), 0.0
    step = 1.0 / (0.25 * (1 + len(row) / n) * n + l2) * 2
    for _ in range(steps):  # heavy-ball gradient descent
        e = boost.sigmoid(np.bincount(row, w[at], n) + b) - y
        v = 0.9 * v - step * (np.bincount(at, e[row], len(top)) + l2 * w)
        vb = 0.9 * vb - step * e.sum()
        w, b = w + v, b + vb
    return Words(vocabulary[top], w, b)


@dataclass
class Content:
    """Boosted trees over content statistics and word scores; the words are fitted on either half for the other."""

    halves: tuple[Words, Words]
    trees: boost.Trees

    @classmethod
    def fit(cls, x: np.ndarray, docs: list[np.ndarray], y: np.ndarray) -> Content:
        half = (np.arange(len(y)) // 4) % 2 == 0  # not in step with the rows that the trees hold out
        parts = tuple(fit_words([d for d, m in zip(docs, half == side) if m], y[half == side]) for side in (True, False))
        rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        a, b = (p.of_array(flat, rows, len(docs)) for p in parts)
        return cls(parts, boost.fit(np.column_stack([x, np.where(half, b, a)]), y))

    def score(self, x, h, rows) -> np.ndarray:
        a, b = (p.of_array(h, rows, len(x)) for p in self.halves)
        return self.trees.probability(np.column_stack([x, (a + b) / 2]))


@dataclass
class Metadata:
    """Boosted trees over the smoothed rates of good rows by language and source, and the stated length."""

    rates: dict[str, dict[str, float]]
    base: float
    trees: boost.Trees | None = None

    def table(self, langs, sources, n_chars) -> np.ndarray:
        rate = lambda name, values: np.array([self.rates[name].get(str(v), self.base) for v in values])
        n = np.array([np.log1p(max(0.0, float(v))) if v is not None else -1.0 for v in n_chars])
        return np.column_stack([rate("lang", langs), rate("source", sources), n])

    @classmethod
    def fit(cls, langs, sources, n_chars, y) -> Metadata:
        base, rates = float(y.mean()), {}
        for name, values in (("lang", langs), ("source", sources)):
            keys, at, n = np.unique([str(v) for v in values], return_inverse=True, return_counts=True)
            good = np.bincount(at, y, len(keys))
            rates[name] = {str(k): float(r) for k, r in zip(keys, (good + 50 * base) / (n + 50))}
        out = cls(rates, base)
        out.trees = boost.fit(out.table(langs, sources, n_chars), y, rounds=40)
        return out

    def score(self, langs, sources, n_chars) -> np.ndarray:
        return self.trees.probability(self.table(langs, sources, n_chars))


@dataclass
class Model:
    content: Content
    metadata: Metadata
    weights: np.ndarray  # of the views' logits, and the offset
    threshold: float
    report: dict = field(default_factory=dict)

    def scores(self, col: pa.Array, langs, sources, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.score(*statistics(col)), self.metadata.score(langs, sources, n_chars)
        return a, b, boost.sigmoid(self.weights[0] * _logit(a) + self.weights[1] * _logit(b) + self.weights[2])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _stack(a: np.ndarray, b: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression of y on the two views' logits, drawn towards their plain sum (Newton steps). No weight goes
    below LEAST_WEIGHT; a view without signal is calibrated to a constant, which the offset takes up."""
    x = np.column_stack([_logit(a), _logit(b), np.ones(len(y))])
    prior = np.array([1.0, 1.0, 0.0])
    w, least = prior, np.array([LEAST_WEIGHT, LEAST_WEIGHT, -np.inf])
    for _ in range(steps):
        p = boost.sigmoid(x @ w)
        g = x.T @ (p - y) + (w - prior)
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.eye(3)
        free = (w > least) | (g < 0)
        step = np.zeros(3)
        step[free] = np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -0.5, 0.5)
        w = np.maximum(w - step, least)
        if np.abs(step).max() < 1e-9:
            break
    return w


_TAKER = {"content": "metadata", "metadata": "content"}


def co_train(labelled: list[dict], draw=None, rounds: int = ROUNDS, pool: int = POOL, share: float = 0.1) -> Model:
    """Rows have doc_id, x, words, lang, source, n_chars, y and held. draw(content, metadata, known, most) gives
    (giver, row) of the unlabelled rows that a view is surest of, their y being what it says: at most most[y] of each
    giver and y, none whose id is in known[taker]."""

    def view(rows):
        named = ([t[c] for t in rows] for c in ("lang", "source", "n_chars"))
        return np.stack([t["x"] for t in rows]), [t["words"] for t in rows], *named

    y_all = np.array([t["y"] for t in labelled], float)
    held = np.array([t["held"] for t in labelled], bool)
    train = [t for t, m in zip(labelled, held) if not m]
    most = {1.0: int(share * pool * y_all.mean()) + 1, 0.0: int(share * pool * (1 - y_all.mean())) + 1}
    more = {"content": [], "metadata": []}
    exchanged = []
    for turn in range(rounds + 1):
        said = {v: np.array([t["y"] for t in train + more[v]], float) for v in more}
        x, docs, *_ = view(train + more["content"])
        content = Content.fit(x, docs, said["content"])
        _, _, *named = view(train + more["metadata"])
        metadata = Metadata.fit(*named, said["metadata"])
        if turn == rounds or draw is None:
            break
        drawn = draw(content, metadata, {v: np.array([t["doc_id"] for t in more[v]], np.int64) for v in more}, most)
        for giver, row in drawn:
            more[_TAKER[giver]].append(row)
        exchanged.append(len(drawn))
        if not drawn:
            break
    test = [t for t, m in zip(labelled, held) if m] or train
    y_test = y_all[held] if held.any() else y_all
    tx, tdocs, *tnamed = view(test)
    flat, rr = np.concatenate(tdocs), np.repeat(np.arange(len(test)), [len(d) for d in tdocs])
    a, b, y = content.score(tx, flat, rr), metadata.score(*tnamed), y_test
    weights = _stack(a, b, y)
    p = boost.sigmoid(weights[0] * _logit(a) + weights[1] * _logit(b) + weights[2])
    cuts = np.linspace(0.1, 0.9, 81)
    balanced = [((p >= c) & (y == 1)).sum() / max(1, y.sum()) + ((p < c) & (y == 0)).sum() / max(1, (1 - y).sum()) for c in cuts]
    best = np.flatnonzero(np.array(balanced) >= max(balanced) - 1e-12)
    cut = float(cuts[best[len(best) // 2]]) if max(balanced) / 2 > LEAST_SKILL else 0.0
    report = {"weights": weights.tolist(), "held_out": len(y), "balanced": max(balanced) / 2, "kept_good": float((p[y == 1] >= cut).mean()), "caught_bad": float((p[y == 0] < cut).mean()), "exchanged": exchanged}
    return Model(content, metadata, weights, cut, report)


_COLUMNS = ("text", "lang", "source", "n_chars")


def _typed(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in ("doc_id", *_COLUMNS)))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> Model | None:
    """Fit on bounded samples; None if the labels don't hold both classes. Labels with a null are left out; of rows
    that repeat an id one is taken."""
    first = F.xxhash64("doc_id")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("y")).where("doc_id is not null and y is not null")
    ids = said.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(first).limit(labelled)
    chosen = {r["doc_id"]: r["y"] for r in ids.collect()}
    if len(set(chosen.values())) < 2:
        return None
    # at most labelled ids: a bounded broadcast; texts become numbers where they are
    schema = "doc_id long, y double, held boolean"
    wanted = docs.sparkSession.createDataFrame([(i, float(y), _held(i)) for i, y in chosen.items()], schema)
    sample = _typed(docs).join(F.broadcast(wanted), "doc_id").transform(common.in_batches, _sampled, _SAMPLE)
    sample = common.cut(sample)
    vocabulary = _vocabulary(sample)
    known, seen = [], set()
    for r in sorted(_rows(sample.transform(common.in_batches, _restricted(vocabulary), _SAMPLE)), key=lambda r: (_scattered(r["doc_id"]), r["words"].tobytes(), r["x"].tobytes())):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            known.append(r)
    if len({r["y"] for r in known if not r["held"]}) < 2:
        return None
    if rounds < 1 or pool < 1:
        return co_train(known, None, rounds)
    # all unlabelled documents as numbers, written once; each round reads them
    rest = _unlabelled(_typed(docs).where("doc_id is not null"), said.select("doc_id"), vocabulary)

    def draw(content, metadata, ids, most):
        best = common.cut(rest.transform(common.in_batches, _surest(content, metadata, ids, most), f"giver string, side double, rank double, tie long, {_FEATURES}"))
        out = []
        for giver in _TAKER:
            for side, n in most.items():
                top = best.where((F.col("giver") == giver) & (F.col("side") == side)).orderBy("rank", "tie", "doc_id").limit(n)
                out += [(giver, r | {"y": side}) for r in _rows(top)]
        return out

    model = co_train(known, draw, rounds, pool)
    common.discard(rest)
    return model


def _unlabelled(docs: DataFrame, said: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A stored row of features for each id that has no label. A bitmap holds the labelled and the repeated ids, so most
    other rows are known to be wanted where they are read. A second one holds the wanted ids that the first one hits;
    only rows that both hit are compared by their ids, and shuffled."""
    ids = docs.select("doc_id")
    known = common.cut(said.distinct())
    again = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    bits = common.bitmap(known.unionByName(again), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def hit(position: pd.Series) -> pd.Series:
        return pd.Series(common.bitmap_has(sent.value, position.to_numpy()))

    back = common.cut(ids.where(hit(common.bit_position("doc_id"))).distinct().join(known, "doc_id", "left_anti"))
    second = common.bit_position(F.lit(1), F.col("doc_id"))
    both = docs.sparkSession.sparkContext.broadcast((bits, common.bitmap_of(back.select(second.alias("p")))))
    placed = docs.withColumns({"p": common.bit_position("doc_id"), "q": second})
    found = common.stored(placed.transform(common.in_batches, _wanted(both, _featured(vocabulary)), f"{_FEATURES}, sure boolean"))
    few = found.where("not sure").drop("sure").join(back, "doc_id", "left_semi")
    few = common.stored(few.groupBy("doc_id").agg(F.min(F.struct(*_FEATURED[1:])).alias("f")).select("doc_id", "f.*"))
    return found.where("sure").drop("sure").unionByName(few)


def _wanted(shared, featured):
    """The features of rows that the first bitmap does not hit (they are sure), or that the second one hits."""

    def run(batches):
        first, second = shared.value
        for b in batches:
            hit = common.bitmap_has(first, b.column("p").to_numpy())
            for sure, on in ((True, ~hit), (False, hit & common.bitmap_has(second, b.column("q").to_numpy()))):
                if on.any():
                    for out in featured([b.filter(pa.array(on))]):
                        yield out.append_column("sure", pa.array([sure] * out.num_rows))

    return run


def _rows(df: DataFrame) -> list[dict]:
    """A bounded number of rows, their lists as arrays."""
    t = df.toArrow().combine_chunks()
    out = t.select([c for c in t.schema.names if c not in ("x", "words")]).to_pylist()
    for c, kind in (("x", np.float64), ("words", np.uint64)):
        values, off = _flat(t.column(c).combine_chunks())
        for r, i, j in zip(out, off[:-1], off[1:]):
            r[c] = values[i:j].view(kind)
    return out


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list array without nulls."""
    parts = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    n = np.concatenate([[0], *(pc.list_value_length(p).to_numpy(zero_copy_only=False) for p in parts)]).astype(np.int64)
    values = [p.flatten().to_numpy(zero_copy_only=False) for p in parts if len(p)]
    return np.concatenate(values) if values else np.zeros(0, np.int64), np.cumsum(n)


def _scattered(i: int) -> int:
    return i * 0x9E3779B97F4A7C15 % (1 << 64)


def _held(i: int) -> bool:
    """Every fourth labelled row, by a hash of its id, is held out."""
    return _scattered(i) >> 62 == 3


_FEATURES = "doc_id long, lang string, source string, n_chars long, x array<double>, words array<long>"
_FEATURED = ("doc_id", "lang", "source", "n_chars", "x", "words")
_SAMPLE = "doc_id long, lang string, source string, n_chars long, y double, held boolean, x array<double>, words array<long>"
_KEPT = ("doc_id", "lang", "source", "n_chars", "y", "held")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))


def _sampled(batches):
    for b in batches:
        for i, j in wh.chunks(b.column("text")):
            p = b.slice(i, j - i)
            x, h, r = statistics(p.column("text"))
            yield pa.RecordBatch.from_arrays([*(p.column(c) for c in _KEPT), pa.array(list(x), pa.list_(pa.float64())), _lists(distinct_words(h, r, j - i))], [*_KEPT, "x", "words"])


def _featured(vocabulary: np.ndarray):
    """Texts as numbers, words outside the vocabulary dropped."""
    known = np.sort(vocabulary.view(np.uint64))

    def run(batches):
        for b in batches:
            for i, j in wh.chunks(b.column("text")):
                p = b.slice(i, j - i)
                x, h, r = statistics(p.column("text"))
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                more = [pa.array(list(x), pa.list_(pa.float64())), _lists(distinct_words(h[hit], r[hit], j - i))]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in _FEATURED[:4]), *more], list(_FEATURED))

    return run


def _surest(content: Content, metadata: Metadata, known: dict[str, np.ndarray], most: dict[float, int], sure: float = 0.97):
    """A partition's surest rows of each view and side, at most most[side] each, without those that the other view has."""

    def run(batches):
        best: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            matrix = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            words = b.column("words")
            rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            h = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            tie = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)
            said = {"content": content.score(matrix("x"), h, rows), "metadata": metadata.score(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))}
            for giver, taker in _TAKER.items():
                p, free = said[giver], ~np.isin(ids, known[taker])
                for side, n in most.items():
                    rank = -p if side else p
                    at = np.flatnonzero(free & (p >= sure if side else p <= 1 - sure))
                    at = at[np.lexsort((ids[at], tie[at], rank[at]))][:n]
                    t = pa.table([pa.array([giver] * len(at), pa.string()), pa.array(np.full(len(at), side)), pa.array(rank[at]), pa.array(tie[at])], ["giver", "side", "rank", "tie"])
                    picked = b.take(pa.array(at))
                    for c in _FEATURED:
                        t = t.append_column(c, picked.column(c))
                    if (giver, side) in best:
                        t = pa.concat_tables([best[giver, side], t])
                        t = t.take(pc.sort_indices(t, [("rank", "ascending"), ("tie", "ascending"), ("doc_id", "ascending")])[:n])
                    best[giver, side] = t
        for t in best.values():
            yield from t.to_batches()

    return run


def _restricted(vocabulary: np.ndarray):
    """Words outside the vocabulary dropped."""
    known = np.sort(vocabulary)

    def run(batches):
        for b in batches:
            words, off = _flat(b.column("words"))
            keep = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words if len(known) else np.zeros(len(words), bool)
            left = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(left), pa.array(words[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([lists if c == "words" else b.column(c) for c in b.schema.names], b.schema.names)

    return run


def _vocabulary(sample: DataFrame) -> np.ndarray:
    """The words that tell the classes apart beyond chance in the labelled rows not held out."""
    train = sample.where("y is not null and not held")
    row = train.agg(F.avg("y")).first()
    rate = row[0] if row[0] is not None else 0.0
    if not 0 < rate < 1:
        return np.zeros(0, np.int64)
    words = train.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("good"))
    z = F.abs(F.col("good") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))
    return words.where((F.col("df") >= WORD_DOCS) & (z >= WORD_Z)).select("w").toArrow().column("w").to_numpy().astype(np.int64)


def _judge(batch: pa.RecordBatch, model: Model | None):
    """(content, metadata, score) of a batch's rows, chunk by chunk; without a model all are 1."""
    if model is None:
        return (np.ones(batch.num_rows),) * 3
    parts = []
    for i, j in wh.chunks(batch.column("text")):
        p = batch.slice(i, j - i)
        parts.append(model.scores(p.column("text"), *(p.column(c).to_pylist() for c in _COLUMNS[1:])))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 3


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, content and metadata (the views' calibrated chances that it is good),
    score (of both) and accepted.

    Null texts are empty, other nulls are values of their own, and both are judged like any row; null ids stay null;
    repeated rows give equal rows. If the labels don't hold both classes, all scores are 1 and all is accepted."""
    model = train(docs, labels, **how)

    def run(batches):
        for b in batches:
            a, m, p = _judge(b, model)
            ok = p >= (model.threshold if model else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(p), pa.array(ok)], ["doc_id", "content", "metadata", "score", "accepted"])

    return _typed(docs).transform(common.in_batches, run, "doc_id long, content double, metadata double, score double, accepted boolean")


def accepted_only(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The accepted rows of docs, with all their columns, without a shuffle. Cases as in `classify`."""
    model = train(docs, labels, **how)
    judged = F.struct(*(F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in _COLUMNS))
    name = common.fresh("judged", *docs.columns)

    def run(batches):
        for b in batches:
            s = b.column(name)
            view = pa.RecordBatch.from_arrays(s.flatten(), list(_COLUMNS))
            _, _, p = _judge(view, model)
            keep = b.filter(pa.array(p >= (model.threshold if model else 0)))
            yield keep.select([c for c in keep.schema.names if c != name])

    return docs.withColumn(name, judged).transform(common.in_batches, run, docs.schema)
