"""Sequences of power-of-two length: a document is cut into the binary pieces of its token count.

A document of n tokens gives n // LONGEST pieces of LONGEST tokens, then one piece for each bit of the
rest, the longest first.  Every piece is a sequence of its own, so no sequence crosses documents and none
is padded.  Equal lengths are a bucket: a bucket's sequences are numbered without gaps and follow those
of the shorter buckets, so batches of one length are ranges of sequence ids.

Tokens are made in one pass over the texts.  Each task numbers its pieces of a length as it goes; what
comes before them is a sum over one row for each task and length, and meets the pieces by that key.

Defined cases: a null or empty text is an empty document and gets the end id alone; very long texts are
read whole; repeated rows are documents of their own; a null id is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table
from .tokens import byte_bpe

LONGEST = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n tokens, in order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(df: DataFrame, key: str, text: str, json_path: str, ranks_path: str, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its checksum, its task and its place among the task's pieces of that length; ids on request."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = byte_bpe(json_path, ranks_path), TaskContext.get().partitionId()
        seen = dict.fromkeys((1 << k for k in range(longest.bit_length())), 0)
        end = np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            flat, offsets = bpe.ids(texts)
            source, start, length, check, size, place, ids = [], [], [], [], [], [], []
            for d in range(len(texts)):
                raw = flat[offsets[d] : offsets[d + 1]].astype("<u4").tobytes() + end
                at = 0
                for n in binary_lengths(len(raw) // 4, longest):
                    part = raw[4 * at : 4 * (at + n)]
                    source.append(d)
                    start.append(at)
                    length.append(n)
                    check.append(zlib.crc32(part))
                    size.append(len(raw) // 4)
                    place.append(seen[n])
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                    seen[n] += 1
                    at += n
            long = [pa.array(x, pa.int64()) for x in (start, length, check, size)]
            out = [batch.column(0).take(pa.array(source, pa.int64())), *long, pa.array([task] * len(source), pa.int32()), pa.array(place, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def bucketed(cut_pieces: DataFrame) -> DataFrame:
    """pieces with sequence_id and offset instead of task and place.

    The driver sees one row for each length; the counts of tasks are summed in one window for each length.
    """
    rows = cut(cut_pieces)
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("held"))
    totals = {r["length"]: r["held"] for r in counts.groupBy("length").agg(F.sum("held").alias("held")).collect()}
    first, at = {}, 0
    for n in sorted(totals):
        first[n] = at
        at += totals[n]
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = F.lit(0)
    for n, k in first.items():  # one for each power of two
        base = F.when(F.col("length") == n, F.lit(k)).otherwise(base)
    before = counts.select("length", "task", (base + F.coalesce(F.sum("held").over(earlier), F.lit(0))).alias("before"))
    return rows.join(before, ["length", "task"]).withColumn("sequence_id", F.col("before") + F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("task", "place", "before")


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences with their ids, one folder for each length, ranges of sequence ids in its files."""
    sequences.repartitionByRange("length", "sequence_id").sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path)


def decompose(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return bucketed(pieces(docs, key, text, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), longest, with_ids=with_ids))


def op11_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decompose(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
