"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, license_scan, media, mixing, near_dup, pii, quality, resample, secrets, sharding, substring, wand
from .common import table

#: Byte limit of a shard in the registered queries.
SHARD_BYTES = 1 << 20


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    refs = media.references(media.interleave(media.page_of(docs)))
    return media.resolve(refs, media.media_table(docs, keep_media=False), *found).select("doc_id", *found, "pos", "caption")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of the web pages in order, the media among them resolved against those of the documents."""
    sequences = media.interleave(table(spark, sf_dir, "pages"))
    refs = media.references(sequences)
    found = media.resolve(refs, media.media_table(table(spark, sf_dir, "documents"), keep_media=False), "payload_bytes", "media_sha256")
    placed = media.assemble(sequences, found, "payload_bytes", "media_sha256")
    s = placed.select(F.col("doc_id").alias("page_id"), F.explode("segments").alias("s"))
    return s.select("page_id", "s.pos", "s.kind", F.char_length("s.text").cast("long").alias("n_chars"), F.sha2("s.text", 256).alias("text_sha256"), "s.caption", "s.media.payload_bytes", "s.media.media_sha256")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), low=1, high=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    vocabulary = path("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_media, op3_pii, op4_license_scan, op5_quality, op6_secret_scan, op7_sharding, op8_decontamination, op9_mixing, op10_substring_dedup, op11_wand, op12_resample, op13_bpe, media_pages)}


_OP1_SQL = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM ws),
flat AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(id, r) AS (SELECT u, v FROM linked UNION SELECT reach.id, linked.v FROM reach JOIN linked ON reach.r = linked.u),
low AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(r, doc_id)) AS kept
FROM sets LEFT JOIN low ON doc_id = id"""

_OP7_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
a AS (
  SELECT d, h >> (60 - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS b FROM r, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d)
  GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h)),
l AS (SELECT r.h, min(a.d) AS d, arg_min(a.b, a.d) AS b FROM (SELECT DISTINCT h FROM r) r JOIN a ON r.h >> (60 - a.d) = a.p GROUP BY r.h)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN d = 0 THEN '' ELSE substr(lpad(bin(r.h >> (60 - d)), 60, '0'), 61 - d, d) END AS shard_id,
  d AS depth, b AS shard_bytes
FROM r JOIN l USING (h)"""

_OP9_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM r GROUP BY source),
w AS (SELECT *, [5, 2, 1][(pos - 1) % 3 + 1] AS w, 3 * source_size AS most FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY most / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT *, level * w > most AS filled FROM l),
t AS (
  SELECT source, source_size, pos, CASE WHEN filled THEN CAST(most AS DOUBLE)
    ELSE w * (SELECT arg_min(level, most / w) FROM f WHERE NOT filled) END AS target FROM f),
q AS (
  SELECT doc_id, size, h, source_size, pos, target,
    CAST(sum(size) OVER (PARTITION BY pos ORDER BY h, doc_id NULLS FIRST, size) AS BIGINT) AS cum
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CAST(e * source_size + cum AS DOUBLE) / target AS t FROM q, (SELECT unnest(range(0, 3)) AS e) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY t, pos, e, h, doc_id NULLS FIRST, size) AS upto FROM k),
g AS (SELECT doc_id, pos, size, count(*) AS copies FROM o WHERE upto <= (SELECT sum(size) FROM r) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id AND q.pos = g.pos AND q.size = g.size"""

_OP10_SQL = r"""
WITH ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM ws WHERE len(w) >= 13)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN low USING (g) WHERE doc_id > m),
sets AS (SELECT doc_id, list(i) AS x FROM gone GROUP BY doc_id),
kept AS (
  SELECT ws.doc_id, len(w) AS n, CASE WHEN x IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(x, i))), lambda i: w[i]) END AS k
  FROM ws LEFT JOIN sets ON ws.doc_id = sets.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
x AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
v AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, x GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, x WHERE len(w) > 0),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(v.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN v USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""

_OP12_SQL = f"""
WITH c AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS c),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
o AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest({_TERMS}) AS w FROM benchmark) GROUP BY w),
h AS (
  SELECT w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)),
    lambda a, y: xor(a >> 8, c[CAST(xor(a, y) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) % 10000 AS k
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM o UNION SELECT w FROM b)), c),
s AS (SELECT k, sum(n) AS s FROM o JOIN h USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM b JOIN h USING (w) GROUP BY k),
g AS (
  SELECT k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(s) FROM s), 0) + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(t) FROM t), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (k)),
e AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS x FROM o JOIN h USING (w) JOIN g USING (k) GROUP BY r),
v AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (x - (x % n + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u FROM d LEFT JOIN e USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(u AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS p FROM z)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND p <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN p END AS rank FROM y"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return {"op1_near_dedup": _OP1_SQL, "op7_sharding": _OP7_SQL, "op9_mixing": _OP9_SQL, "op10_substring_dedup": _OP10_SQL, "op11_wand": _OP11_SQL, "op12_resample": _OP12_SQL}
