"""Rendezvous hashing of stable record keys over weighted shards.

Each shard gets the score -weight / ln(u), u a uniform number made from md5(key:shard); the highest
score owns the record.  The scores of the old shards don't depend on how many there are, so a new
shard only takes records, and takes its share of weight.

Slots are in the order of another digest of key and text.  Records are dealt over shards x buckets, a
bucket being a range of that digest; a slot is the count of all earlier buckets of the shard plus the
place in its own.  Equal rows are counted first and told apart last, so a much repeated row is one.

Defined cases: a null key is the text ``null`` (a row of its own); repeated rows all go to one shard
and get slots of their own; a null text has size 1 and the checksum of no bytes; very long texts are
read whole; ties of a score go to the larger shard number; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 16_384
ROWS_PER_BUCKET = 100_000


def _digest(key: Column, salt: str) -> Column:
    """52 bits of md5 as a whole number; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13), 16, 10).cast("long")


def scores(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """An array of (score, shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    out = []
    for shard, weight in enumerate(weights):
        u = (_digest(key, f"{seed}{shard}").cast("double") + F.lit(1.0)) / F.lit(float(2**52 + 1))
        # Equal weights need no logarithm: the score grows with u.
        score = u if min(weights) == max(weights) else F.lit(-float(weight)) / F.log(u)
        out.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return F.array(*out)


def owner(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    return F.array_max(scores(key, weights, seed))["shard"]


def assign(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: float = 1.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Shard, gapless slot in it and the shard after one more of weight grown joins, for every row."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        name.alias("name"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        scores(name, [*weights, grown]).alias("scores"),
    )
    old = F.slice("scores", 1, len(weights))
    rows = rows.select(
        "key", "size", "text_crc32", F.array_max(old)["shard"].alias("shard"), F.array_max("scores")["shard"].alias("grown_shard"), _digest(F.concat("name", F.lit(":"), F.col("text_crc32").cast("string")), "slot").alias("place")
    )
    grouped = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    total = grouped.agg(F.sum("n")).first()[0] or 0
    buckets = 64
    while buckets < BUCKETS and buckets * len(weights) * rows_per_bucket < total:
        buckets *= 2
    grouped = grouped.withColumn("bucket", F.floor(F.col("place") / (2**52 // buckets)).cast("int"))
    counts = grouped.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    so_far = W.partitionBy("shard", "bucket").orderBy("place", "key", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    # Bounded: len(weights) * BUCKETS rows.
    placed = grouped.withColumn("inside", F.coalesce(F.sum("n").over(so_far), F.lit(0))).join(F.broadcast(before), ["shard", "bucket"])
    first = F.col("before") + F.col("inside")
    return placed.select("key", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 16)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
