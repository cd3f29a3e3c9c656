"""A corpus pipeline of five stages: quality, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateloom.llm import common, decontam, mixing, near_dup, quality, sharding

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labels of the documents at hand."""
    return quality.accepted_only(docs, common.table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    found = near_dup.near_duplicates(docs, shingle=5, percent=80)
    return common.without(docs, found.where("not kept").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return common.without(docs, decontam.leaks(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as weighted fair queueing takes it, which may be never or up to three times."""
    i, n, copies, each = (common.fresh(c, *docs.columns) for c in ("mix_id", "mix_size", "mix_copies", "mix_copy"))
    taken = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias(i), F.col("size").alias(n), F.col("copies").alias(copies)).distinct()
    size = mixing.count_words(F.col("text"))
    rows = docs.join(taken, (docs["doc_id"].cast("long").eqNullSafe(F.col(i))) & (size == F.col(n)))
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(docs[c] for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document of the mix."""
    return sharding.assign_shards(docs, limit_bytes=SHARD_BYTES)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder, read again by the next and then
    deleted; those of the last stage but one stay, as the result reads them."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)
            if before is not None:
                common.discard(before)
            before = docs
    return docs
