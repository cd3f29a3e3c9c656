"""Media columns: exact round trips, and page parsing."""

import hashlib
import math
import random
import re
import zlib

import pytest

from stateloom.llm import media, queries


def test_every_text_comes_back(docs, rows):
    refs = media.references(media.interleave(media.page_of(docs)))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out = media.resolve(refs, media.media_table(docs), *names, "media").collect()
    assert len(out) == len(rows)

    def told(i, text):
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        return i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])

    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=str) == sorted((told(*r[:2]) for r in rows), key=str)
    for r in out:
        assert hashlib.sha256(media.load(bytes(r.media))).hexdigest() == r.payload_sha256 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in out}) == len({r.payload_sha256 for r in out})


def test_feature_against_plain_loops():
    r = random.Random(2)
    for n in (1, 2, 5):
        raw = bytes(r.randrange(256) for _ in range(576 * n - r.randrange(500)))
        samples = raw + b"\xff" * (576 * n - len(raw))
        mean = sum(samples) / len(samples)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in samples) / len(samples))
        height, bits = len(samples) // 24, ""
        rows, cols = [int(height * k / 8) for k in range(9)], [int(24 * k / 9) for k in range(10)]
        for top, bottom in zip(rows, rows[1:]):
            cells = [sum(samples[y * 24 + x] for y in range(top, bottom) for x in range(a, b)) for a, b in zip(cols, cols[1:])]
            bits += "".join(str(int(b > a)) for a, b in zip(cells, cells[1:]))
        m, d, h = media.feature_of(samples).split(":")
        assert abs(float(m) - mean) < 1e-5 and abs(float(d) - deviation) < 1e-5 and h == f"{int(bits, 2):016x}"


def test_pages_query(spark, tmp_path):
    text = "the payload"
    digest = hashlib.sha256(media.payload_of(text)).hexdigest()
    html = f'<p>a</p><figure><img src="sha256:{digest}"><figcaption>cap</figcaption></figure><p>b</p><img src="http://h/x.png">'
    spark.createDataFrame([(4, html), (5, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted(queries.media_pages(spark, str(tmp_path)).collect(), key=lambda r: r.pos)
    assert [(r.page_id, r.pos, r.kind, r.caption, r.payload_bytes) for r in out] == [(4, 0, "text", None, None), (4, 1, "media", "cap", 576), (4, 2, "text", None, None), (4, 3, "media", None, None)]


def test_segments_keep_order_and_captions():
    page = """<html><head><title>no</title></head><body><p>One &amp; two <b>bold</b></p>
    <figure><img src="sha256:AB" alt="alt"><figcaption>The <i>caption</i></figcaption></figure>
    tail<img alt=x src=http://h/y.png><script>var a = "<p>no</p>";</script><p></p><video src="v.mp4"></video>end"""
    s = media.segments(page)
    assert [x["pos"] for x in s] == list(range(len(s)))
    assert [(x["kind"], x["caption"]) for x in s] == [("text", None), ("media", "The caption"), ("text", None), ("media", "x"), ("media", None), ("text", None)]
    assert s[0]["text"] == "One & two bold" and s[1]["digest"] == "ab" and s[2]["text"].strip() == "tail" and s[5]["text"] == "end"
    assert media.segments(None) == media.segments("") == [] and media.segments("<p") is not None


def told(page):
    return [(x["text"].strip(), x["caption"]) for x in media.segments(page)]


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>t</title><body><p>hello</p><img src=a></body></html>", [("hello", None), ("a", None)]),
    ("<head><meta charset=x><style>p{}</style><p>hello", [("hello", None)]),
    ("<head><title>t</title>bare text<p>more", [("bare text", None), ("more", None)]),
    ("a<template><p>b</p><img src=c>", [("a", None), ("b", None), ("c", None)]),
    ("a<template>no</template>b", [("ab", None)]),
    ("<figure><img src=a><figcaption>cap</figure><p>lost text</p>", [("a", "cap"), ("lost text", None)]),
    ("<figure><figcaption>cap</figcaption><img src=a><img src=b alt=x></figure>", [("a", "cap"), ("b", "cap")]),
    ("<figcaption>alone</figcaption><p>b", [("alone", None), ("b", None)]),
    ("<figure><figcaption>no media</figcaption></figure>b", [("no media", None), ("b", None)]),
    ("<figure><img src=a><figcaption>cap <p>rest</p><img src=b>", [("a", None), ("cap", None), ("rest", None), ("b", None)]),
    ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "in")]),
    ("<noscript>kept</noscript><script>if (a<b) '<p>no</p>'</script>", [("kept", None)]),
])
def test_pages_with_omitted_tags_lose_nothing(page, want):
    assert told(page) == want


def test_all_words_of_random_pages_are_there():
    """A second, independent walk: words outside of tags, scripts, styles and heads, taken by a regular expression."""
    r = random.Random(5)
    tags = ["p", "div", "figure", "figcaption", "b", "noscript", "ul", "li", "template"]
    for _ in range(300):
        parts, n = [], 0
        for _ in range(r.randint(1, 40)):
            kind = r.random()
            if kind < 0.4:
                n += 1
                parts.append(f" w{n} ")
            elif kind < 0.5:
                parts.append("<img src=m>" if r.random() < 0.5 else "<script>var s1 = '<p>s2';</script>")
            else:
                parts.append(f"<{'/' if r.random() < 0.5 else ''}{r.choice(tags)}>")
        page = "<head><title>t0</title>" * r.randint(0, 1) + "<body>" + "".join(parts)
        seen = " ".join(f"{x['text']} {x['caption'] or ''}" for x in media.segments(page))
        closed = re.sub(r"<template>.*?</template>", " ", page, flags=re.S)
        assert set(re.findall(r"w\d+", closed)) <= set(re.findall(r"w\d+", seen)) and not re.search(r"s[12]|t0", seen), page


def test_long_pages_of_open_tags():
    for tag in ("figure", "figcaption", "template", "p", "head"):
        assert sum(x["text"].count("w") for x in media.segments(f"<{tag}>w" * 5000)) == 5000


def test_assemble_puts_media_in_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:aa"><p>b</p><img src="sha256:zz">'), (2, "plain"), (3, None)], "page_id long, html string")
    store = spark.createDataFrame([(1, "aa", 7, "x"), (2, "aa", 7, "x"), (3, None, 1, "y")], "doc_id long, digest string, width int, caption string")
    seq = media.interleave(pages).cache()
    out = {r.doc_id: r.segments for r in media.assemble(seq, media.resolve(media.references(seq), store, "width"), "width").collect()}
    assert [s.media and s.media.width for s in out[1]] == [None, 7, None, None] and out[1][3].digest == "zz"
    assert [s.text for s in out[2]] == ["plain"] and out[3] == []


def test_store_refuses_what_it_cannot_hold(empty):
    for bad in (b"", b"abc"):
        try:
            media.store(bad)
        except ValueError:
            continue
        raise AssertionError
    assert media.media_table(empty).collect() == [] and media.references(media.interleave(media.page_of(empty))).collect() == []
