"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer (JSON: model, normalizer, splitter).

A word's bytes become a doubly linked list of symbols. A heap holds the merge of each neighbouring pair by (rank, place);
the smallest is taken, its two symbols are joined in the list, and the pairs that the new symbol makes with its
neighbours are pushed. Entries of pairs that are gone stay in the heap and are skipped when they come up. That is
n log n for a word of n bytes, so a text without any blank is no special case. Decoding concatenates vocabulary strings.

The vocabulary is read by the driver from a local file of bounded size and broadcast; texts are encoded where they are
read, without a shuffle. Words are looked up in a cache of bounded size first, as most of a text is common words."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash as wh

#: Bytes of a vocabulary file at most: what is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Characters of words that a worker's cache holds at most (some 150 MB); then it starts anew. Words longer than the second
#: are not held.
CACHE_CHARS, CACHE_WORD = 8 << 20, 256
#: Words and ids handled at once inside one text, so that memory does not follow a text's length many times over.
AT_ONCE = 1 << 16

# Where the encoding libraries' Unicode tables and those of Python differ (they must give equal results).
#: Letters and digits of the regular expression library that the splitter does not take for such.
_NO_LETTER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
_NO_DIGIT = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Marks that composition leaves in place and does not join: it does not know them.
_UNKNOWN_MARKS = """
7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50
10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97
11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
#: Capitals that have a small letter there: alone, and ranges with the distance to it.
_MORE_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_MORE_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: The splitter of byte-level vocabularies that name none.
_BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A splitter whose words hold no blank, and the cleaning that goes with it.
_NO_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_USUAL_CLEANING = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]


def _ranges(text: str) -> str:
    """Hexadecimal code points and ranges of them as the inside of a regular expression's class."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in text.split())


_MARKS = re.compile(f"([{_ranges(_UNKNOWN_MARKS)}])")
_ODD_LETTERS = re.compile(f"[{_ranges(_NO_LETTER)}{_ranges(_NO_DIGIT)}]")
_ODD_CAPITALS = re.compile("[" + "".join(map(chr, _MORE_SMALL)) + "]")
_BLANK = re.compile(r"[\t-\r ]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols after all merges. ranks holds a pair's rank by left << 32 | right, made the symbol that a rank makes.
    A heap entry is rank << 32 | place of the left symbol; it is stale unless the pair there makes the same symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [get(a << 32 | b) for a, b in pairwise(symbols)]
    heap = [r << 32 | i for i, r in enumerate(pairs) if r is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, new = top & 0xFFFFFFFF, made[top >> 32]
        if symbols[i] < 0:  # joined to the symbol before it
            continue
        j = after[i]
        if j == n:
            continue
        r = get(symbols[i] << 32 | symbols[j])
        if r is None or made[r] != new:
            continue
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = get(new << 32 | symbols[k])
            if r is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0:
            r = get(symbols[h] << 32 | new)
            if r is not None:
                heappush(heap, r << 32 | h)
    return [s for s in symbols if s >= 0]


def _steps(part: dict | None, inner: str) -> list[dict]:
    if not part:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


class Bpe:
    """A vocabulary with its way of cleaning and splitting text. Vocabularies that ask for more than is built here (other
    normalizers, dropout, unknown tokens) raise ValueError."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE models are supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.cleaning = [(p["type"], p.get("pattern", {}).get("Regex"), p.get("content")) for p in _steps(spec.get("normalizer"), "normalizers")]
        for kind, pattern, _ in self.cleaning:
            if kind not in ("NFC", "Lowercase") and not (kind == "Replace" and pattern):
                raise ValueError(f"normalizer {kind} is not supported")
        self.split, byte_level = None, False
        for p in _steps(spec.get("pre_tokenizer"), "pretokenizers"):
            if p["type"] == "Split" and "Regex" in p["pattern"] and p["behavior"] == "Removed" and p["invert"] and self.split is None:
                self.split = p["pattern"]["Regex"]
            elif p["type"] == "ByteLevel" and not p["add_prefix_space"] and not (p.get("use_regex", True) and self.split):
                byte_level, self.split = True, self.split or (_BYTE_LEVEL_SPLIT if p.get("use_regex", True) else r"(?s:.+)")
            else:
                raise ValueError(f"splitter {p['type']} is not supported in this form")
        if not byte_level:
            raise ValueError("the vocabulary is not byte-level")
        decoder = spec.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"decoder {decoder['type']} is not supported")
        self.joins_bytes = bool(decoder)
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        for t in spec.get("added_tokens", ()):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens with options are not supported")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ids = {i: s for s, i in [*vocab.items(), *self.added.items()]}
        self.strings = [ids.get(i, "") for i in range(max(ids) + 1)]

    @classmethod
    def read(cls, path: str) -> Bpe:
        if os.path.getsize(path) > VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than a vocabulary may be")
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def encode_word(self, word: bytes | str) -> list[int]:
        data = word.encode() if isinstance(word, str) else word
        symbols = list(map(self.inner.__getitem__, data))
        symbols[-1:] = [self.last[b] for b in data[-1:]]
        return merge(symbols, self.ranks, self.made)


class _Cache(dict):
    """Ids of words as bytes, made on demand; forgotten all at once when the words held grow too large."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, word):
        ids = self.make(word)
        if len(word) <= CACHE_WORD:
            if self.held > CACHE_CHARS:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += len(word)
        return ids


class Encoder:
    """Encodes texts with a Bpe; holds the compiled patterns and the cache."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.pattern = regex.compile(bpe.split)
        exact = bpe.split.replace(r"\p{L}", rf"[\p{{L}}--[{_ranges(_NO_LETTER)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_ranges(_NO_DIGIT)}]]")
        self.exact = regex.compile(exact, regex.VERSION1)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(bpe.added, key=len, reverse=True)) + ")") if bpe.added else None
        self.replace = {p: regex.compile(p) for kind, p, _ in bpe.cleaning if kind == "Replace"}
        self.no_blanks = bpe.split == _NO_BLANKS and bpe.cleaning == _USUAL_CLEANING
        self.cache = _Cache(self._encode_unit)

    def clean(self, text: str) -> str:
        plain = text.isascii()
        for kind, pattern, content in self.bpe.cleaning:
            if kind == "NFC":
                if not plain:
                    text = "".join(map(_composed, _MARKS.split(text))) if _MARKS.search(text) else unicodedata.normalize("NFC", text)
            elif kind == "Lowercase":
                text = text.lower() if plain else _lower(text)
            elif not (plain and self.no_blanks):  # ASCII blanks, of any number, part units in any case
                text = self.replace[pattern].sub(content.replace("\\", r"\\"), text)
        return text

    def words(self, text: str) -> Iterable[str]:
        """What the splitter keeps of a clean text."""
        pattern = self.pattern if text.isascii() or not _ODD_LETTERS.search(text) else self.exact
        return pattern.findall(text) if len(text) <= AT_ONCE else (m.group() for m in pattern.finditer(text))

    def _units(self, text: str) -> Iterator[list]:
        """Lists, of bounded length, of what is encoded and cached as one: words or, if no word holds a blank, what stands
        between blanks (as bytes, which are split faster)."""
        if not self.no_blanks:
            yield from batched(self.words(self.clean(text)), AT_ONCE)
            return
        at = 0
        while at < len(text):
            cut = _BLANK.search(text, at + AT_ONCE)
            to = cut.start() if cut else len(text)
            yield self.clean(text[at:to]).encode().split()
            at = to

    def _encode_unit(self, unit: bytes | str) -> bytes:
        if isinstance(unit, bytes) and not unit.isalpha():
            words = list(self.words(unit.decode()))
            if len(words) != 1:  # each of them alone is split no further
                return b"".join([self.cache[w.encode()] for w in words])
        return array("i", self.bpe.encode_word(unit)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text. Strings of added tokens in it become those tokens."""
        out, get = [], self.cache.__getitem__
        for part in self.special.split(text) if self.special else [text]:
            if part in self.bpe.added:
                out.append(np.array([self.bpe.added[part]], np.int32).tobytes())
            elif part:
                out += [b"".join(map(get, units)) for units in self._units(part)]
        return np.frombuffer(b"".join(out), np.int32)


def _composed(text: str) -> str:
    """Canonical composition; a mark that it does not know is left as it is."""
    return text if _MARKS.fullmatch(text) else unicodedata.normalize("NFC", text)


def _lower(text: str) -> str:
    """Each character's small letter, whatever stands around it: a sigma at a word's end is no special case."""
    text = text.replace("Σ", "σ").lower()
    return text.translate(_MORE_SMALL) if _ODD_CAPITALS.search(text) else text


@lru_cache(1)
def _encoder(bpe: Bpe) -> Encoder:
    """A Python worker's encoder, with its cache, for the tasks that it runs one after the other."""
    return Encoder(bpe)


class Decoder:
    """Strings of ids: byte-level ones are put together and read as UTF-8, others are joined by a blank."""

    def __init__(self, bpe: Bpe):
        self.strings, self.joins_bytes = bpe.strings, bpe.joins_bytes
        if bpe.joins_bytes:
            letters = {c: b for b, c in enumerate(byte_letters())}
            own = {i: s.encode() for s, i in bpe.added.items()}
            self.strings = [own.get(i) or bytes(letters[c] for c in s) for i, s in enumerate(bpe.strings)]

    def decode(self, ids: np.ndarray) -> str:
        get = self.strings.__getitem__
        if self.joins_bytes:
            return b"".join(map(get, ids.tolist())).decode("utf-8", "replace")
        return " ".join(" ".join(map(get, ids[i : i + AT_ONCE].tolist())) for i in range(0, len(ids), AT_ONCE))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids) for each row of docs: the ids of its whole text, in order.

    Null and empty texts have no ids (an empty array). Strings of the vocabulary's special tokens in a text become
    those tokens; none is added. Repeated rows are encoded each, null ids stay, other columns are not read, an empty
    table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i, j in wh.chunks(texts):  # ids take up to four times a text's bytes
                found = [encoder.encode(t.as_py() or "") for t in texts[i:j]]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([ids[i:j], lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(common.in_batches, run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (doc_id, ids, text) for each row of ids: the vocabulary's strings put together. Null ids give an empty
    text; ids outside the vocabulary raise."""
    shared = rows.sparkSession.sparkContext.broadcast(Bpe.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            col = b.column("ids")
            off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            texts = pa.array([decoder.decode(flat[i:j]) for i, j in zip(off[:-1], off[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, texts], ["doc_id", "ids", "text"])

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")).transform(common.in_batches, run, "doc_id long, ids array<int>, text string")
