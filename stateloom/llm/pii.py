"""Personal data: high-recall generators propose overlapping spans, boosted trees score them by format and context,
and a calibrated threshold selects what is redacted beside the base patterns.

The base patterns are exact and stay whatever the model says. The model is trained at start, on the driver, from
generated examples of a fixed seed and number (TRAINING_ROWS); it takes about a second and a few kilobytes."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost, common
from .spans import Taken

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the model adds, listed after the base kinds.
ADDED = ("email_like", "ip_like", "phone_like")
_ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts, so later starts in a run need no try
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern. Each starts at the run of local characters before an @, so time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            i = at
            while i > done and _LOCAL.match(text[i - 1]):
                i -= 1
            if i < at:
                yield i, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed and then by start."""
    out = [("email", i, j) for i, j in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Generators: deliberately loose, and free to overlap. Their quantifiers are bounded, so time is linear.
_GENERATORS = (
    ("phone_like", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")),
    ("email_like", re.compile(r"(?i)\b[a-z0-9._%+-]{2,40}\x20?(?:[(\[{<]at[)\]}>]|\x20at\x20|@)\x20?[a-z0-9-]{2,40}(?:\x20?(?:[(\[{<]dot[)\]}>]|\x20dot\x20|\.)\x20?[a-z]{2,10}){1,3}\b")),
    ("ip_like", re.compile(r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){1,7}(?::?[0-9a-f]{1,4}){1,7}(?![0-9a-z:])")),
)
#: A text without one of these, in any case, has no candidate of the kind: a check before the pattern.
_GATES = {"email_like": ("at)", "at]", "at}", "at>", " at ", "@"), "ip_like": (":",), "phone_like": ()}
_TLD = re.compile(r"(?i)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|ch|at|eu|ru|cn|jp|br|au|ca|us)$")
_HINTS = (
    re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|whatsapp|sms)\b"),
    re.compile(r"(?i)\b(?:mail|e-mail|email|contact|write|reach|address)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|addr|ipv6|ping|gateway)\b"),
    re.compile(r"(?i)\b(?:order|invoice|version|page|pages|isbn|date|total|price|no|id|chapter|score|at|in|since)\b"),
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose, overlaps included."""
    out, low = [], text.lower()
    for kind, pattern in _GENERATORS:
        gates = _GATES[kind]
        if not gates or any(g in low for g in gates):
            # two colons are a time of day
            out += [(kind, *m.span()) for m in pattern.finditer(text) if kind != "ip_like" or m[0].count(":") > 2 or "::" in m[0]]
    return out


def features(text: str, kind: str, i: int, j: int) -> list[float]:
    """Format and context of a candidate, from its own characters and 32 on each side."""
    s, left, right = text[i:j], text[max(0, i - 32) : i], text[j : j + 16]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    n = sum(sizes)
    date = bool(re.fullmatch(r"(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[0-9]{2}|(?:19|20)[0-9]{2}))", s))
    return [
        float(ADDED.index(kind)), float(len(s)), float(n), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[-1]),
        float("(" in s and ")" in s), float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(s.count("/")), float(s.count(":")), float(date),
        float(bool(re.search(r"(?i)[(\[{<]at[)\]}>]", s))), float(bool(re.search(r"(?i)[(\[{<]dot[)\]}>]", s))), float(bool(re.search(r"(?i)\x20dot\x20", s))), float(len(set(sizes)) == 1),
        float(bool(_TLD.search(s))), float(". " in s), float("@" in s), float(s.islower()), float("AT" in s), float("::" in s), float(bool(re.search(r"[A-Fa-f]", s))), float(max(map(len, s.split(":")))), float(bool(re.search(r"[0-9._-]", s.split(" ")[0]))),
        *(float(bool(h.search(left))) for h in _HINTS),
        float(left[-1:] in "$€£#" and left != ""), float(right[:1] in "%€" and right != ""), float("0" <= right[:1] <= "9" if right else False), float(left.endswith(("+", "+ "))),
    ]


#: Generated examples that the model is fitted on, a fixed bound.
TRAINING_ROWS = 6000


def _example(r: random.Random) -> tuple[str, str, int]:
    """(text before, candidate, label)"""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    cased = lambda s: r.choice((str, str, str, str.capitalize, str.upper, str.title))(s)
    prose = " ".join(w() for _ in range(r.randint(1, 5)))
    pick = r.random()
    if pick < 0.2:
        number = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"])
        hint = r.choice(["call", "phone", "tel", "mobile", "fax:", "Tel.", "reach me:", "Phone:", ""])
        return f"{prose} {hint} ", number, 1
    if pick < 0.38:
        a, b = r.choice(["()", "[]", "{}", "<>"])
        at, dot = cased("at"), cased("dot")
        tld = r.choice(["com", "org", "net", "de", "io", "co", "edu", "fr"])
        sep = r.choice([(f"{a}{at}{b}", f"{a}{dot}{b}"), (f" {a}{at}{b} ", f" {a}{dot}{b} "), (f"{a}{at}{b}", "."), (f" {at} ", f" {dot} "), (f" {at} ", "."), (" @ ", "."), ("@", f" {dot} "), ("@", f"{a}{dot}{b}")])
        name = f"{w()}{r.choice(['', '.' + w(), '_' + w(), d(2)])}"
        return f"{prose} {r.choice(['mail', 'contact', 'email:', 'Reach me at', ''])} ", cased(f"{name}{sep[0]}{w()}{sep[1]}{tld}") if r.random() < 0.2 else f"{name}{sep[0]}{cased(w())}{sep[1]}{tld}", 1
    if pick < 0.46:
        h = lambda: f"{r.randrange(1 << r.choice([1, 4, 8, 16, 16, 16])):{r.choice(['x', 'x', 'X', '04x'])}}"
        groups = [r.choice(["fe80", "2001", "2a02", "fd00", h()]), *(h() for _ in range(7))]
        k = r.randint(2, 6)
        return f"{prose} {r.choice(['host', 'addr', 'ipv6', 'ping', ''])} ", ":".join(groups) if r.random() < 0.7 else ":".join(groups[:k]) + "::" + ":".join(groups[k : k + r.randint(1, 2)]), 1
    if pick < 0.54:
        return f"{prose} {r.choice(['score', 'at', 'ratio', 'time', ''])} ", ":".join(d(r.randint(1, 2)) for _ in range(r.choice([4, 4, 5, 6]))), 0
    if pick < 0.68:
        # a sentence that ends after "at", and one that goes on
        end = r.choice([". ", ". ", ". ", ".", " . "])
        return f"{prose} ", f"{cased(w())}{r.choice(['', '', '. At', ' at ' + w() + ' and'])} at {w()}{end}{w().capitalize()}{r.choice(['', '', end + w().capitalize()])}", 0
    if pick < 0.8:
        return f"{prose} {r.choice(['date', 'since', 'in', ''])} ", r.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}"]), 0
    if pick < 0.88:
        return f"{prose} {r.choice(['version', 'page', 'pages', 'no', 'order', 'invoice', '$', ''])} ", r.choice([f"{d(2)}.{d(2)}", f"{d(3)}-{d(3)}", f"{d(4)}-{d(2)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(5)} {d(5)}", f"{d(4)} {d(4)} {d(4)} {d(4)}"]), 0
    return f"{prose} ", " ".join(d(r.randint(2, 5)) for _ in range(r.choice([2, 2, 4, 5, 6]))), 0


@cache
def model(seed: int = 7, precision: float = 0.98) -> tuple[boost.Trees, float]:
    """(trees, threshold): the lowest calibrated score from which held-out examples reach the precision."""
    r = random.Random(seed)
    x, y = [], []
    while len(y) < TRAINING_ROWS:
        before, s, label = _example(r)
        text = f"{before}{s} {'abc' if r.random() < 0.8 else '.'}"
        for kind, i, j in candidates(text):
            if i < len(before) + len(s) and j > len(before):
                x.append(features(text, kind, i, j))
                y.append(label)
    x, y = np.array(x), np.array(y)
    trees = boost.fit(x, y)
    held = np.arange(len(y)) % 4 == 3
    p, t = trees.probability(x[held]), y[held]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    return trees, float(max(0.5, p[order][good[-1]])) if len(good) else 1.1


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def find(text: str, trees: boost.Trees, threshold: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). Added spans overlap no base span and not each other: the likelier one wins."""
    base = base_spans(text)
    taken = Taken((i, j) for _, i, j in base)
    found = [c for c in candidates(text) if not taken.overlaps(c[1], c[2])]
    if not found:
        return base, base
    p = trees.probability(np.array([features(text, *c) for c in found]))
    added: list[tuple[str, int, int]] = []
    for q, c in sorted(zip(p, found), key=lambda x: (-x[0], x[1][1], x[1])):
        if q >= threshold and not taken.overlaps(c[1], c[2]):
            taken.add(c[1], c[2])
            added.append(c)
    return base, base + sorted(added, key=lambda s: (_ORDER[s[0]], s[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by [KIND]; spans that overlap become one, named by the first."""
    out, at = [], 0
    for k, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"[{k.upper()}]"]
        at = max(at, j)
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted_text string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, the number of base spans of each kind, base_sha256, spans (all, as
    kind:start:end, code points, end exclusive, by kind and start), n_added, and redacted_text (null unless
    keep_text). Null texts are empty; null ids stay null; repeated rows give equal rows."""
    trees, threshold = model()

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base, spans = find(text, trees, threshold)
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), redact(text, spans) if keep_text else None))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted_text"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(common.in_batches, run, _SCHEMA)
