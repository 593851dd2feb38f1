"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector, less the mean of all, is divided by its length, turned by one random rotation and kept
as the signs of its components (packed bits), with two scalars: that length, and the inner product of
the unit vector with its code.  For a query, the inner product with a vector is estimated from the
bits and the scalars (a block's bits are unpacked to +1 and -1 for one matrix product with all its
queries); the estimate's error bound is BOUND standard deviations.

Vectors are encoded once.  Codes and turned queries are dealt into blocks by a hash of the id, and each
pair of blocks is a group of its own.  A first pass gives each query's FIRST best estimates; these are
computed exactly, which sets the score to beat.  A second pass takes the vectors whose upper bound
reaches that score, computes them exactly in their block, and gives those that reach it.  Vectors move
with their codes once for each block of queries, so the shuffle is linear in them for a given query set.

Equal vectors have equal scores, so of those only the k + 1 with the smallest ids can be among a query's
k nearest (one of them may be the query itself); the others are no candidates, and a vector that a
third of all rows share costs no more than another.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part; rows with a null id take none either; rows with one id count once
(the smallest vector); fewer than k candidates are all returned; equal scores go by id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, cut, table

K = 20
BOUND = 1.9
VECTORS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 1024
FIRST = 40
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), bool)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of vectors (rows of float64), and estimates of their inner products."""

    def __init__(self, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        self.turn, self.mean = turn, mean
        rest = vectors - mean
        length = np.linalg.norm(rest, axis=1)
        unit = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
        self.bits = pack_bits(unit > 0)
        align = np.abs(unit).sum(axis=1) / np.sqrt(len(mean))
        align = np.where(align > 0, align, 1.0)
        self.spread = (length * np.sqrt(np.maximum(1 - align**2, 0) / max(len(mean) - 1, 1)) / align).astype(np.float32)
        self.factor = (length / align / np.sqrt(len(mean))).astype(np.float32)

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, error bounds), queries x vectors."""
        return estimates(signs(self.bits, len(self.mean)), self.factor, self.spread, (queries @ self.turn).astype(np.float32), queries @ self.mean, np.linalg.norm(queries, axis=1))


def signs(bits: np.ndarray, dim: int) -> np.ndarray:
    """Packed bits as +1 and -1, one column for each vector."""
    return np.ascontiguousarray((np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=dim).astype(np.float32) * 2 - 1).T)


def estimates(sides: np.ndarray, factor: np.ndarray, spread: np.ndarray, turned: np.ndarray, shift: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = (turned @ sides) * factor[None, :]
    value += shift[:, None].astype(np.float32)
    return value, (BOUND * size)[:, None].astype(np.float32) * spread[None, :]


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length; v keeps float components as they are."""
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def mean(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """(mean, number of rows); dim + 1 rows reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1)
        for batch in batches:
            total[:dim] += _matrix(batch.column(0), dim).sum(axis=0)
            total[dim] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], ["place", "total"])

    found = {r["place"]: r["total"] for r in rows.select("v").mapInArrow(partial, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    n = int(found.get(dim, 0))
    return np.array([found.get(k, 0.0) for k in range(dim)]) / max(n, 1), n


def encode(rows: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(id, bits, factor, spread) of (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = Codes(_matrix(batch.column(1), len(centre)), centre, turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(codes.bits), pa.array(codes.factor), pa.array(codes.spread)], ["id", "bits", "factor", "spread"])

    return rows.select("id", "v").mapInArrow(run, "id long, bits binary, factor float, spread float")


def turned(rows: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(query_id, turned, shift, size): queries as the estimates need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1), len(centre))
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_column((q @ turn).astype(np.float32)), pa.array(q @ centre), pa.array(np.linalg.norm(q, axis=1))], ["query_id", "turned", "shift", "size"])

    return rows.select("id", "v").mapInArrow(run, "query_id long, turned binary, shift double, size double")


def _cells(codes: DataFrame, queries: DataFrame, dim: int, blocks: tuple[int, int], choose: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """(query_id, vec_id, estimate) of the pairs that choose marks in a block of codes and one of queries.

    With vectors (v of codes, q of queries), the marked pairs are computed exactly, and those whose score
    reaches the query's beat are given with that score.
    """

    def dealt(part: DataFrame, key: str, mine: str, own: int, other: str, others: int) -> DataFrame:
        return part.withColumn(mine, F.pmod(F.xxhash64(key, F.lit(mine)), F.lit(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def cell(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "estimate": np.zeros(0)})]
        if len(vectors) and len(asked):
            ids, factor, spread = (vectors[c].to_numpy() for c in ("id", "factor", "spread"))
            sides = signs(np.frombuffer(b"".join(vectors["bits"]), np.uint64).reshape(len(vectors), -1), dim)
            wide = np.stack(vectors["v"].to_list()).astype(np.float64) if "v" in vectors else None
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                own = part["query_id"].to_numpy()
                value, error = estimates(sides, factor, spread, np.frombuffer(b"".join(part["turned"]), np.float32).reshape(len(part), -1), part["shift"].to_numpy(), part["size"].to_numpy())
                value[own[:, None] == ids[None, :]] = -np.inf
                marked = choose(value, error, part) & (value > -np.inf)
                if "v" in vectors:
                    least, asked_v = part["beat"].to_numpy(), np.stack(part["q"].to_list()).astype(np.float64)
                    for k, found in enumerate(map(np.flatnonzero, marked)):
                        score = wide[found] @ asked_v[k]
                        exact = score >= least[k]
                        out.append(pd.DataFrame({"query_id": np.full(int(exact.sum()), own[k]), "vec_id": ids[found[exact]], "estimate": score[exact]}))
                    continue
                q, v = np.nonzero(marked)
                out.append(pd.DataFrame({"query_id": own[q], "vec_id": ids[v], "estimate": value[q, v].astype(np.float64)}))
        return pd.concat(out, ignore_index=True)

    x = dealt(codes, "id", "vb", blocks[0], "qb", blocks[1])
    y = dealt(queries, "query_id", "qb", blocks[1], "vb", blocks[0])
    return x.groupBy("vb", "qb").cogroup(y.groupBy("vb", "qb")).applyInPandas(cell, "query_id long, vec_id long, estimate double")


def _exact(pairs: DataFrame, rows: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """(query_id, vec_id, score) of pairs, in double precision on the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("nd,nd->n", _matrix(batch.column(2), dim), _matrix(batch.column(3), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    met = pairs.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "vec_id", "v", "q").mapInArrow(run, "query_id long, vec_id long, score double")


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = K, first: int = FIRST, vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows where is_query (of the column id) holds."""
    rows, dim = usable(df, key, vector)
    if not dim:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut(rows)
    asked = rows.filter(is_query)
    # Limited in each task before equal vectors meet.
    rows = cut(rows.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("copy") <= k + 1).drop("copy"))
    centre, n = mean(rows, dim)
    turn = rotation(dim)
    codes = cut(encode(rows, centre, turn))
    queries = cut(turned(asked, centre, turn))
    blocks = max(1, -(-n // vectors_per_block)), max(1, -(-queries.count() // queries_per_block))
    most = max(first, k)

    def best(value: np.ndarray, error: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        if value.shape[1] <= most:
            return np.ones(value.shape, bool)
        out = np.zeros(value.shape, bool)
        np.put_along_axis(out, np.argpartition(-value, most - 1, axis=1)[:, :most], True, axis=1)
        return out

    order = W.partitionBy("query_id").orderBy(F.desc("estimate"), "vec_id")
    pairs = _cells(codes, queries, dim, blocks, best).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "vec_id")
    scored = cut(_exact(pairs, rows, asked, dim))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    beat = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("query_id", F.col("score").alias("beat"))

    def reaches(value: np.ndarray, error: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        # A little slack, as bounds are single precision.
        least = part["beat"].to_numpy()
        return value + error >= (least - 1e-4 * np.abs(least))[:, None].astype(np.float32)

    # A query without a score to beat has all its candidates already.
    full = codes.join(rows, "id")
    own = queries.join(beat, "query_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    more = _cells(full, own, dim, blocks, reaches).join(scored, ["query_id", "vec_id"], "left_anti")
    every = scored.union(more.select("query_id", "vec_id", F.col("estimate").alias("score")))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
