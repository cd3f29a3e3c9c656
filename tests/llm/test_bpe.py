"""Byte-pair encoding against the library whose vocabulary files it reads, and exact round trips."""

import hashlib
import random

import pytest

from stateloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def hard_texts() -> list[str]:
    r = random.Random(7)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 400]) for i in range(0, 0x30000, 400)]
    texts += ["".join(r.choice(every) for _ in range(60)) for _ in range(2000)]
    texts += ["".join(chr(r.choice([r.randrange(0x3000), r.randrange(0x20, 0x7F), 0x20, 0x3A3, 0x130])) for _ in range(200)) for _ in range(500)]
    texts += ["".join(r.choice("abc'stre llABÉß\n\t.,1") for _ in range(r.randint(1, 300))) for _ in range(1000)]
    texts += ["<|startoftext|>a<|endoftext|>", "<|startoftext|", "x<|endoftext|>x", "don't IT'S 'LL", "ΑΣ ΣΣ ΑΣ.", "", " ", "\x1c\x1d \x85\xa0"]
    return texts + ["a" * 70_000, "ab" * 40_000 + "!" * 70_000, "one two three " * 20_000]


@pytest.mark.parametrize("name", FILES)
def test_same_as_the_library(name):
    theirs = T.Tokenizer.from_file(P.path(name))
    vocabulary = bpe.Bpe.read(P.path(name))
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    texts = hard_texts()
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        ids = encoder.encode(text)
        assert ids.tolist() == e.ids, ascii(text[:200])
        assert decoder.decode(ids) == theirs.decode(e.ids, skip_special_tokens=False)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 50)
    encoder = bpe.Encoder(bpe.Bpe.read(P.path(FILES[0])))
    text = " ".join(f"word{i}, other" for i in range(300))
    assert encoder.encode(text).tolist() == T.Tokenizer.from_file(P.path(FILES[0])).encode(text, add_special_tokens=False).ids
    assert len(encoder.cache) < 20


def test_merges_in_order_of_rank_then_place():
    ranks = {1 << 32 | 1: 0, 2 << 32 | 1: 1, 1 << 32 | 2: 2}
    assert bpe.merge([1, 1, 1], ranks, [2, 3, 3]) == [3]
    assert bpe.merge([1] * 5, ranks, [2, 3, 4]) == [2, 3]
    assert bpe.merge([1], ranks, [2, 3, 3]) == [1]


def test_operators(spark, docs, rows, empty):
    """Nulls, blanks, repeated rows, very long texts, clashing columns and empty tables."""
    theirs = T.Tokenizer.from_file(P.path(FILES[0]))
    out = bpe.decode(bpe.encode(docs, P.path(FILES[0])), P.path(FILES[0])).collect()
    told = sorted(((r.doc_id, hashlib.sha256(str(r.ids).encode()).hexdigest(), r.text) for r in out), key=str)
    ids = [theirs.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]
    assert told == sorted(((r[0], hashlib.sha256(str(i).encode()).hexdigest(), theirs.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids)), key=str)
    assert bpe.encode(empty, P.path(FILES[0])).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), P.path(FILES[0])).collect()[0].text == ""


def test_round_trip_of_bytes(docs, rows):
    """The byte-level vocabulary without cleaning gives every text back."""
    out = bpe.decode(bpe.encode(docs, P.path(FILES[1])), P.path(FILES[1])).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t or "") for i, t, *_ in rows)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "StripAccents"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "Metaspace"}}])
def test_other_vocabularies_raise(change):
    import json

    with open(P.path(FILES[0])) as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        bpe.Bpe(spec | change)
