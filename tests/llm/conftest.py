import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, size string, tag string"
#: Columns beyond those that operators read clash with the names of theirs.


def corpus(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(40)
    texts = [" ".join(words(r.randint(1, 120))) for _ in range(40)]
    for i in range(0, 20):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 30)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append("  ".join(w))
    texts += [" ".join(words(15) + passage + words(15)) for _ in range(5)]
    texts += [texts[3], texts[3].upper(), "", " \t\n", "one", "one two", "x " * 3000, "é ü ß " * 40, " ".join(words(30_000))]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(400, None), (1, texts[0]), (None, texts[5]), (None, None)]
    r.shuffle(rows)
    extra = ("c", "k", "s", "t")
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "sé", None]), None if t is None else len(t), *extra) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
