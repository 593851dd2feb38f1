"""Importance resampling of documents towards a target set.

Two generative models over hashed word unigrams and bigrams, one of the target texts and one of all
texts, each a smoothed distribution over BUCKETS counts.  A text's weight is the ratio of its
probabilities under the two: the sum of the log ratios of its n-grams.  Each row gets a Gumbel variable
from a keyed hash of its id and text; the rows with the largest sums of log weight and variable are a
sample without replacement in proportion to the weights (Gumbel top-k).

The query learns its target from at most TARGET labelled texts, those with the smallest hash of their
id.  The other counts cover all rows; the models are two tables of BUCKETS numbers, whatever the corpus.  The top k
are found by counting rows in bins of the sum, refining the one bin that holds the k-th, until it
holds BINS rows or one value; ties are settled by the key and then the row in the same way, so no task
gathers rows.

Defined cases: texts without words (null too) have log weight 0; very long texts are read whole; without
target texts the log weights are all 0 and the sample is uniform; a null id has a Gumbel variable like
any other and comes first among ties; repeated rows get equal sums, and as many as fit are taken; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, utf8
from .textvec import LOWER, digests, doc_chunks, mix, span_hashes, words

BUCKETS = 1 << 16
#: Parts of the rows to take: 85 in 100.
FRACTION = 85, 100
SMOOTH = 1.0
SEED = 11
TARGET = 20_000
BINS = 4096


def _grams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, where each text's begin); a text's unigrams come before its bigrams."""
    starts, ends, first = words(raw, offsets)
    h = span_hashes(raw, starts, ends, LOWER)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    grams = np.concatenate((h, mix(h[pair] * np.uint64(0xD6E8FEB86659FD93) + h[pair + 1], 9)))
    owner = np.concatenate((doc, doc[pair]))
    by = np.argsort(owner, kind="stable")
    return (grams[by] % np.uint64(buckets)).astype(np.int64), np.searchsorted(owner[by], np.arange(len(offsets)))


def gram_counts(docs: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: summed in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in doc_chunks(offsets):
                grams, _ = _grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                total += np.bincount(grams, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def model(counts: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> np.ndarray:
    """Log probabilities; buckets rows at most reach the driver."""
    total = np.full(buckets, smooth)
    for r in counts.collect():
        total[r["bucket"]] += r["n"]
    return np.log(total / total.sum())


def weights(docs: DataFrame, key: str, text: str, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(key, log_weight, gumbel_key); ratio: log ratio of the two models for each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids = np.asarray(batch.column(0).fill_null(-(2**63))).astype(np.int64).view(np.uint64)
            for a, b in doc_chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                grams, first = _grams(part, off, len(ratio))
                held = np.append(shared.value[grams], 0.0)
                log_weight = np.where(np.diff(first) > 0, np.add.reduceat(held, first[:-1]) if len(first) > 1 else 0.0, 0.0)
                code = mix(mix(ids[a:b], seed) ^ digests(part, off[:-1], off[1:])[0].view(np.uint64))
                u = ((code >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(log_weight), pa.array(log_weight - np.log(-np.log(u)))], ["key", "log_weight", "gumbel_key"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, log_weight double, gumbel_key double")


def _smallest(rows: DataFrame, value: Column, k: int, bins: int) -> tuple[object, int] | None:
    """(the k-th smallest value, number of rows below it); None if there are fewer than k rows."""
    rows = rows.select(value.alias("v"))
    v = F.col("v")
    low, high, n = rows.agg(F.min(v), F.max(v), F.count("*")).first()
    below = 0
    if n < k:
        return None
    while low < high and n > bins:
        inside = rows.filter((v >= F.lit(low)) & (v <= F.lit(high)))
        if isinstance(low, float):
            slot = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
        else:
            slot = F.floor((v.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit((high - low) // bins + 1).cast("decimal(20,0)"))
        counted = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("slot").collect()  # bins rows
        if len(counted) == 1:  # too close for floating point: as whole numbers of the same order
            raise ValueError("values can't be told apart")
        for r in counted:
            if below + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            below += r["n"]
    if low < high:  # bins rows at most
        held = sorted(r["v"] for r in rows.filter((v >= F.lit(low)) & (v <= F.lit(high))).collect())
        low = held[k - below - 1]
        below += sum(x < low for x in held)
    return low, below


def top_k(rows: DataFrame, k: int, score: str, tie: str, bins: int = BINS) -> DataFrame:
    """rows with selected: true for the k largest scores, ties by the whole number tie, null first, then by row.

    rows is read several times: pass what is written.
    """
    (place,) = fresh(rows.columns, "row")
    ranks = [-F.col(score), F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63))), F.col(place)]
    numbered = cut(rows.withColumn(place, F.monotonically_increasing_id()))
    chosen, equal = F.lit(False), F.lit(True)
    for rank in ranks:
        found = _smallest(numbered.filter(equal), rank, k, bins) if k > 0 else (None, 0)
        if found is None:
            chosen, equal = chosen | equal, F.lit(False)
            break
        if k <= 0:
            break
        value, below = found
        chosen = chosen | (equal & (rank < F.lit(value)))
        equal = equal & (rank == F.lit(value))
        k -= below
    if k > 0:
        chosen = chosen | equal  # the last rank is unique
    return numbered.withColumn("selected", chosen).drop(place)


def resample(docs: DataFrame, target: DataFrame, key: str, text: str, fraction: tuple[int, int] = FRACTION, seed: int = SEED) -> DataFrame:
    """(key, log_weight, gumbel_key, selected) for every row of docs; target: rows with good texts."""
    raw = model(gram_counts(docs, text))
    good = gram_counts(target, text)
    good = model(good) if not target.isEmpty() else raw
    scored = cut(weights(docs, key, text, good - raw, seed))
    part, whole = fraction
    return top_k(scored, -(-part * scored.count() // whole), "gumbel_key", "key")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("label_id")).distinct()
    # TARGET rows at most, so they may be broadcast, and no text is moved to meet its label.
    few = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(TARGET)
    target = docs.join(F.broadcast(few), F.col("doc_id") == F.col("label_id"), "left_semi")
    return resample(docs, target, "doc_id", "text").withColumnRenamed("key", "doc_id")
