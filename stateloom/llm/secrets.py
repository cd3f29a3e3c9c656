"""Secret scans with corpus-wide ownership frequency.

Every candidate (the base patterns' matches and loose high-entropy tokens) is hashed; the hashes are counted over
the whole corpus by distinct repositories and owners. A hash is a widely copied example if several owners hold it in
several repositories, or if very many repositories do, be it of one owner; else it is owner-specific and looks live.
Loose tokens are reported only if they look live; base spans stay either way and are counted as live or copied."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import Taken

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate((*KINDS, "token"))}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Loose candidates: long runs of credential characters with letters and digits.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) by start and then kind as listed."""
    out = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def loose(text: str, least_bits: float = 3.5) -> list[tuple[str, int, int, str]]:
    out = []
    for m in _TOKEN.finditer(text):
        s = m[0]
        if any("0" <= c <= "9" for c in s) and any("A" <= c <= "Z" for c in s) and any("a" <= c <= "z" for c in s) and entropy(s) >= least_bits:
            out.append(("token", *m.span(), s))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


#: A secret is copied if so many owners hold it, in so many repositories; or so many repositories, whoever owns them.
OWNERS, REPOS, REPOS_ALONE = 3, 4, 20

_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))


def _extract(batches):
    for b in batches:
        base, extra = [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            found = base_spans(text)
            taken = Taken((i, j) for _, i, j, _ in found)
            told = lambda xs: [{"kind": k, "start": i, "end": j, "hash": hashlib.sha256(s.encode()).hexdigest()} for k, i, j, s in xs]
            base.append(told(found))
            extra.append(told(x for x in loose(text) if not taken.overlaps(x[1], x[2])))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "row", "repo", "owner")] + [pa.array(base, _FOUND), pa.array(extra, _FOUND)], ["doc_id", "row", "repo", "owner", "base", "extra"])


def _assemble(batches):
    """Base and live loose spans to the result's columns."""
    for b in batches:
        rows = []
        for base, extra, said in zip(*(b.column(c).to_pylist() for c in ("base", "extra", "said"))):
            live = {s["hash"] for s in said or () if s["live"]}
            repos, owners = (max((s[c] for s in said or ()), default=None) for c in ("repos", "owners"))
            at = [(s["kind"], s["start"], s["end"]) for s in base]
            more = [(s["kind"], s["start"], s["end"]) for s in extra if s["hash"] in live]
            n_live = sum(s["hash"] in live for s in base)
            all_spans = sorted(at + more, key=lambda s: (s[1], _ORDER[s[0]]))
            rows.append((*(sum(s[0] == k for s in at) for k in KINDS), hashlib.sha256(_joined(at).encode()).hexdigest(), _joined(all_spans), n_live + len(more), len(at) - n_live, repos, owners))
        cols = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_live", "n_copied", "most_repos", "most_owners"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", owners: int = OWNERS, repos: int = REPOS, repos_alone: int = REPOS_ALONE) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end in
    code points, end exclusive, by start and kind), n_live, n_copied, and most_repos and most_owners (of any of its
    candidates; null without one).

    A secret that `owners` owners hold in `repos` repositories, or that `repos_alone` repositories hold, is a copied
    example (at least so many of each). Null texts are empty; a null owner or repository counts as one of its own kind; null ids stay null; repeated rows
    give equal rows and count once, as they name the same repository and owner."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("")))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row"), named(repo_col).alias("repo"), named(owner_col).alias("owner"), text.alias("text"))
    span = "array<struct<kind:string,start:int,end:int,hash:string>>"
    found = common.cut(base.transform(common.in_batches, _extract, f"doc_id long, row long, repo string, owner string, base {span}, extra {span}"))
    held = found.select("row", "repo", "owner", F.explode(F.concat("base", "extra")).alias("s")).select("row", "repo", "owner", F.col("s.hash").alias("hash"))
    # distinct in two steps, so that a secret copied everywhere shrinks to its owners before it meets in one task
    by_owner = held.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    spread = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    copied = ((F.col("owners") >= owners) & (F.col("repos") >= repos)) | (F.col("repos") >= repos_alone)
    # a table of its own, so that Spark can split the rows of a secret that stands everywhere
    spread = common.cut(spread.withColumn("live", ~copied))
    said = F.collect_list(F.struct("hash", "live", "repos", "owners")).alias("said")
    by_row = held.select("row", "hash").distinct().join(spread, "hash").groupBy("row").agg(said)
    columns = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_copied long, most_repos long, most_owners long"
    return found.join(by_row, "row", "left").select("doc_id", "base", "extra", "said").transform(common.in_batches, _assemble, columns)
