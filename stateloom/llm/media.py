"""Media columns: interleaved document sequences.

HTML is parsed into ordered segments, texts and media references; a join on digests resolves the references'
payloads; positions and captions stay with their segments. Media are stored as 8-bit grey images (binary PGM), which
hold any payload without loss, in a table of the shared folder, and all that is said of them comes from what is read
back."""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples of a row, and bytes to whose multiple payloads are padded: rows of 24 make blocks of 24 x 24.
WIDTH, BLOCK = 24, 576
SCHEME = "sha256:"

SEGMENTS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_SEGMENTS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


# Payloads and their stored form


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled with bytes 255 up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store(payload: bytes) -> bytes:
    """A binary PGM of WIDTH columns whose samples are the payload's bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"a payload is a positive multiple of {WIDTH} bytes")
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def load(media: bytes) -> bytes:
    """The samples of a binary PGM."""
    m = _HEADER.match(media)
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a binary PGM of 8-bit samples")
    return media[m.end() :]


def feature_of(samples: bytes) -> str:
    """Mean, deviation and a 64-bit difference hash of the image's 8 x 9 cell means, as text."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = np.linspace(0, len(a), 9).astype(int)
    # cells of at least one row, so that images lower than 8 rows (there are none of whole blocks) would do too
    sums = np.add.reduceat(a.astype(np.int64), np.minimum(rows[:-1], len(a) - 1), axis=0)
    cols = np.linspace(0, WIDTH, 10).astype(int)[:-1]
    cells = np.add.reduceat(sums, cols, axis=1)
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return f"{a.mean():.6f}:{a.std():.6f}:{bits}"


_STORED = "doc_id long, n_bytes long, media binary"
_MEDIA = "doc_id long, digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def _encode(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([store(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def _decode(keep_media: bool):
    def run(batches):
        for b in batches:
            rows = []
            for media in b.column("media").to_pylist():
                back = load(media)
                digest = hashlib.sha256(back).hexdigest()
                rows.append((digest, len(back), digest, zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back), media if keep_media else None))
            digest, *cols = zip(*rows) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            more = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.string()), b.column("n_bytes"), *more], ["doc_id", "digest", "n_bytes", *names])

    return run


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored medium, read back: doc_id, n_bytes (of the text) and media."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(rows.transform(common.in_batches, _encode, _STORED))


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as a medium: doc_id, digest (SHA-256 of the payload as read back), n_bytes (without filling),
    payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature and media
    (the stored form; null unless keep_media). Null texts are empty. Equal texts give equal values."""
    return store_media(docs, id_col, text_col).transform(common.in_batches, _decode(keep_media), _MEDIA)


# Interleaved documents


class _Sequence(HTMLParser):
    """Collects texts and media references in the order of the page. A figure's captions belong to all its media, before or
    after them; captions without media are texts; media without a caption take their alt text. The head ends at its end
    tag, at body, or at anything that can't stand in a head. ignored: numbers of start tags that count as not there."""

    SKIPPED = {"script", "style", "template"}
    HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template", "basefont", "bgsound"}
    MEDIA = {"img", "video", "audio", "source", "embed"}
    BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "section", "article", "body", "figure", "figcaption", "blockquote", "pre", "header", "footer", "main", "nav", "aside", "title"}

    def __init__(self, ignored: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self._text: list[str] = []
        self._figures: list[tuple[list[int], list[str]]] = []  # places of media, captions
        self._caption: tuple[int, list[str]] | None = None  # the start tag's number, and what it says
        self._left: list[int] = []  # captions in a row that only another start tag ended
        self._skip: list[tuple[str, int]] = []
        self._ignored, self._number = ignored, 0
        self._head = self._title = False

    def _flush(self):
        text = "".join(self._text)
        self._text = []
        if text.strip():
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        self._number += 1
        if self._number in self._ignored:
            return
        if tag in self.SKIPPED:
            self._skip.append((tag, self._number))
        if self._skip:
            return
        if tag == "head":
            self._head = True
        elif self._head and tag not in self.HEAD:
            self._head = False
        if self._head:
            self._title = tag == "title"
            return
        if tag in self.BLOCKS and self._caption is None:
            self._flush()
        if tag in ("figure", "figcaption"):
            if self._caption is not None:
                self._left.append(self._caption[0])
            self._close_caption()
            if tag == "figure":
                self._figures.append(([], []))
            else:
                self._caption = (self._number, [])
        elif tag in self.MEDIA:
            said = {k: v or "" for k, v in reversed(attrs)}
            src = said.get("src", "").strip()
            if src:
                self._flush()
                if self._figures:
                    self._figures[-1][0].append(len(self.out))
                digest = src[len(SCHEME) :].lower() if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()
                self.out.append({"pos": len(self.out), "kind": "media", "text": src, "digest": digest, "caption": said.get("alt") or None})

    def _close_caption(self):
        """To the figure around it; without one it is a text."""
        if self._caption is not None:
            caption, self._caption = " ".join("".join(self._caption[1]).split()), None
            if self._figures:
                self._figures[-1][1].append(caption)
            else:
                self._text.append(caption)
                self._flush()

    def _close_figure(self):
        self._close_caption()
        self._flush()
        places, captions = self._figures.pop()
        caption = " ".join(filter(None, captions))
        for i in places:
            self.out[i]["caption"] = caption or self.out[i]["caption"]
        if caption and not places:
            self._text.append(caption)
            self._flush()

    def handle_endtag(self, tag):
        if self._skip:
            at = [i for i, (name, _) in enumerate(self._skip) if name == tag]
            if at:
                del self._skip[at[-1] :]
        elif self._head:
            self._head, self._title = tag not in ("head", "body", "html"), False
        elif tag == "figcaption" or (tag == "figure" and self._figures):
            self._left = []
            if tag == "figure":
                self._close_figure()
            self._close_caption()
        elif tag in self.BLOCKS and self._caption is None:
            self._flush()

    def handle_data(self, data):
        if self._skip or (self._head and (self._title or not data.strip())):
            return
        self._head = False
        (self._text if self._caption is None else self._caption[1]).append(data)

    def finish(self) -> set[int]:
        """Ends the page; numbers of start tags that took all that followed, as nothing closed them."""
        self.close()
        open_tags = {n for tag, n in self._skip if tag == "template"} | ({*self._left, self._caption[0]} if self._caption else set())
        while self._figures:
            self._close_figure()
        self._close_caption()
        self._flush()
        return open_tags


def segments(page: str | None) -> list[dict]:
    """The ordered segments of a page. Texts keep their characters; blank ones between tags are dropped, and captions
    have single blanks. Unclosed templates and captions don't swallow the rest of a page: it is read again without them."""
    ignored: frozenset[int] = frozenset()
    while True:
        p = _Sequence(ignored)
        p.feed(page or "")
        more = p.finish()
        if not more:
            return p.out
        ignored |= more


def _parse(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([segments(x) for x in b.column("html").to_pylist()], _SEGMENTS)], ["doc_id", "segments"])


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, segments): each page as ordered text and media segments. A media segment's digest is that of a
    sha256: address, or the SHA-256 of any other address. Null pages have no segments; repeated rows give equal
    rows."""
    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html")).transform(common.in_batches, _parse, f"doc_id long, segments {SEGMENTS}")


def references(sequences: DataFrame) -> DataFrame:
    """A row (doc_id, pos, digest, caption) for each media segment."""
    return sequences.select("doc_id", F.explode("segments").alias("s")).where("s.kind = 'media'").select("doc_id", "s.pos", "s.digest", "s.caption")


def resolve(refs: DataFrame, media: DataFrame, *columns: str) -> DataFrame:
    """References with the named columns of their medium, by digest; null where there is none. The media are reduced
    to one row for each digest first, so a reference is never multiplied; rows of one digest must hold the same. That
    is a table of its own, so that Spark can split the references of a digest that stands everywhere."""
    one = common.stored(media.where("digest is not null").groupBy("digest").agg(*(F.min(c).alias(c) for c in columns)))
    return refs.join(one, "digest", "left").select("doc_id", "pos", "digest", "caption", *columns)


def assemble(sequences: DataFrame, resolved: DataFrame, *columns: str) -> DataFrame:
    """Sequences with each media segment's resolved columns in place, in order of position. Ids must be unique."""
    got = resolved.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*columns).alias("m")))).alias("at"))
    fill = lambda s: F.struct(s["pos"].alias("pos"), s["kind"].alias("kind"), s["text"].alias("text"), s["digest"].alias("digest"), s["caption"].alias("caption"), F.col("at")[s["pos"]].alias("media"))
    return sequences.join(got, "doc_id", "left").select("doc_id", F.transform("segments", fill).alias("segments"))


def page_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a page (page_id, html): its text and a figure of its own payload, captioned with the id."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int") * BLOCK - n
    payload = F.concat(raw, F.unhex(F.repeat(F.lit("FF"), fill)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    page = F.concat(F.lit("<article><p>"), text, F.lit('</p><figure><img src="' + SCHEME), F.sha2(payload, 256), F.lit('"><figcaption>'), name, F.lit("</figcaption></figure></article>"))
    return docs.select(F.col(id_col).cast("long").alias("page_id"), page.alias("html"))
