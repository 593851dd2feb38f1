"""Codes of vectors: each part of a vector is named by its nearest entry of a trained codebook.

Components become the integers floor(SCALE * x), so distances, ties and means are exact and no order of
summing can change a code.  Codebooks start as the parts of the vectors with the smallest ids; a round
gives every part its nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found by exponion search.  A part starts at its previous entry a (entry 0 in the
first round), at squared distance u.  An entry at squared distance D from a with D > 2 * (u + v), v the
best squared distance so far, is farther than v, as (p + q)^2 <= 2 (p^2 + q^2); so a's list of entries,
sorted by D, is scanned in rings, and only as far as D <= 2 * (u + v).  Equal distances go to the lower
index.  Parts with one entry are scanned together, as one product of integers that doubles hold exactly.

Codebooks (parts x ENTRIES entries) live on the driver; vectors and their codes are written once a round,
as small integers.  Tasks add up their parts by entry, and those sums are added by Spark.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those
of another length than most (the longer, if as many); a length that the parts don't divide counts as
filled up with zeros; a null id comes after all others, and vectors of one id are ordered by themselves;
with fewer vectors than ENTRIES there are as many entries; repeated vectors are entries of their own, of
which the first is used; components of any size are exact, an error over 64 bits becomes the largest
long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, cut, fresh, spread, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
RINGS = (16, 64)
LARGEST = 2**63 - 1
#: Bits of the limbs in which sums of very large components travel.
LIMB = 24


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int, float]:
    """(rows whose vector takes part, their length, the largest absolute component)."""
    kind = df.schema[vector].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad))
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("held"), F.max(F.greatest(F.array_max(vector), -F.array_min(vector))).alias("most"))
    first = sizes.orderBy(F.desc("held"), F.desc("d")).first()
    return (rows, 0, 0.0) if first is None else (rows.filter(F.size(vector) == first["d"]), first["d"], float(first["most"]))


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite x."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


class Numbers:
    """How integers of a table of vectors are kept: as doubles if all sums of squares stay exact, else as Python's."""

    def __init__(self, dim: int, most: float, parts: int = PARTS):
        self.parts, self.width = parts, -(-dim // parts)
        self.dim, largest = dim, whole(most) + 1
        # Twice the sum of two squared distances is the largest number of a search.
        self.exact = 16 * self.width * largest * largest < 2**53
        self.stored = np.dtype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 and self.exact else np.float64)
        self.limbs = 1 if self.exact else -(-largest.bit_length() // LIMB)

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Vectors as stored: rounded if exact, as they are if not."""
        rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.dim)
        rows = np.pad(rows, ((0, 0), (0, self.width * self.parts - self.dim)))
        return np.floor(rows * SCALE).astype(self.stored) if self.exact else rows

    def read(self, column: pa.Array) -> np.ndarray:
        """Integers of stored vectors, rows x parts x width."""
        n = len(column)
        _, offsets, data = column.buffers()
        first = np.frombuffer(offsets, np.int32)[column.offset] if n else 0
        rows = np.frombuffer(data, self.stored, n * self.width * self.parts, first).reshape(n, self.parts, self.width) if n else np.zeros((0, self.parts, self.width), self.stored)
        return rows.astype(np.float64) if self.exact else np.vectorize(whole, otypes=[object])(rows)

    def codebook(self, entries: list) -> np.ndarray:
        return np.array(entries, np.float64 if self.exact else object)


class Book:
    """One part's entries, with the distance-sorted list of entries around each."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.square = entries, (entries * entries).sum(axis=1)
        apart = self.square[:, None] + self.square[None, :] - 2 * (entries @ entries.T)
        # Equal distances are listed by index; an entry leads its own list, or a copy of it does.
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of each row of x, from its previous entry on."""
        n, k = len(x), len(self.entries)
        moved = x - self.entries[previous]
        u = (moved * moved).sum(axis=1)
        best, found = u.copy(), previous.astype(np.int64)
        square = (x * x).sum(axis=1)
        edges = [0, *(r for r in RINGS if r < k), k]
        active = np.arange(n)
        for low, high in zip(edges, edges[1:]):
            # Lists are sorted, so a part whose radius ends before the ring is done.
            active = active[self.apart[previous[active], low] <= 2 * (u[active] + best[active])]
            by = active[np.argsort(previous[active], kind="stable")]
            heads = np.flatnonzero(np.diff(previous[by], prepend=-1))
            for at, to in zip(heads, np.append(heads[1:], len(by))):
                rows = by[at:to]
                ring = self.order[previous[rows[0]], low:high]
                apart = square[rows, None] + self.square[ring][None, :] - 2 * (x[rows] @ self.entries[ring].T)
                least = apart.min(axis=1)
                index = np.where(apart == least[:, None], ring[None, :], k).min(axis=1)
                better = (least < best[rows]) | ((least == best[rows]) & (index < found[rows]))
                best[rows[better]], found[rows[better]] = least[better], index[better]
        return found, best


def _start(rows: DataFrame, key: str, vector: str, numbers: Numbers, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids."""
    first = rows.select(key, vector).orderBy(F.asc_nulls_last(key), vector).limit(entries).collect()
    width, parts = numbers.width, numbers.parts
    whole_rows = [[whole(x) for x in r[1]] + [0] * (width * parts - numbers.dim) for r in first]
    return numbers.codebook([[v[p * width : (p + 1) * width] for v in whole_rows] for p in range(parts)])


def _assign(state: DataFrame, books: np.ndarray, numbers: Numbers) -> DataFrame:
    """state (id, label, vector, codes, error) with codes and error under the codebooks; starts at its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                x = numbers.read(batch.column(2))
                previous = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, numbers.parts)
                both = [ready[p].nearest(x[:, p], previous[:, p].astype(np.int64)) for p in range(numbers.parts)]
                codes = np.stack([f for f, _ in both], axis=1).astype(np.uint16)
                total = sum(e for _, e in both)
                error = pa.array([min(int(e), LARGEST) for e in total], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], binary_column(codes), error], ["id", "label", "vector", "codes", "error"])

    return state.mapInArrow(run, state.schema)


def _moved(state: DataFrame, books: np.ndarray, numbers: Numbers) -> np.ndarray:
    """The codebooks after every entry became the floor of its parts' mean; the driver sees a row for each component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        totals, counts = np.zeros(books.shape, np.int64 if numbers.exact else object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = numbers.read(batch.column(0))
                x = x.astype(np.int64) if numbers.exact else x
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, parts)
                for p in range(parts):
                    by = np.argsort(codes[:, p], kind="stable")
                    heads = np.flatnonzero(np.diff(codes[by, p].astype(np.int64), prepend=-1))
                    totals[p, codes[by[heads], p]] += np.add.reduceat(x[by, p], heads, axis=0)
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        limbs = [totals[part, entry]]
        for _ in range(numbers.limbs - 1):
            limbs[-1:] = [limbs[-1] & ((1 << LIMB) - 1), limbs[-1] >> LIMB]
        places = np.stack(limbs, axis=2).astype(np.int64).reshape(len(part), width * numbers.limbs)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(places), pa.list_(pa.int64()))], ["part", "entry", "held", "totals"])

    sums = state.select("vector", "codes").mapInArrow(add, "part long, entry long, held long, totals array<long>")
    rows = sums.select("part", "entry", "held", F.posexplode("totals").alias("place", "total")).groupBy("part", "entry", "place").agg(F.sum("held").alias("held"), F.sum("total").alias("total")).collect()
    out = books.astype(object)
    gathered: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    for r in rows:
        place, limb = divmod(r["place"], numbers.limbs)
        gathered.setdefault((r["part"], r["entry"], place), []).append((limb, r["total"], r["held"]))
    for (part, entry, place), found in gathered.items():
        out[part, entry, place] = sum(total << (LIMB * limb) for limb, total, _ in found) // found[0][2]
    return out.astype(books.dtype)


def train_and_encode(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((id, label, codes, error) of every usable vector, codebooks as integers); codes: one unsigned 16-bit index a part."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("entries must be 1 to 65536")
    rows, dim, most = usable(df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v")
    if not dim:
        return rows.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0), None
    numbers = Numbers(dim, most, parts)
    books = _start(rows, "id", "v", numbers, entries)
    schema = T.StructType([T.StructField("id", T.LongType()), rows.schema["label"], T.StructField("vector", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(numbers.matrix(batch.column(2))), binary_column(np.zeros((n, parts), np.uint16)), pa.array(np.zeros(n, np.int64))], schema.names)

    state = rows.mapInArrow(store, schema)
    for _ in range(rounds):
        state = cut(_assign(state, books, numbers))
        books = _moved(state, books, numbers)
    return _assign(state, books, numbers).select("id", "label", "codes", "error"), books


def fingerprint(books: np.ndarray) -> str:
    """sha256 of all components, in the order of part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (written) with label_error, the sum of error over equal labels, nulls together."""
    # A label that is no key by itself: null and text never meet.
    name, part = fresh(coded.columns, "name", "label_error")
    rows = coded.withColumn(name, F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), F.lit("")))
    sums = rows.groupBy(name).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LARGEST).cast("decimal(29,0)")).cast("long").alias(part))
    return spread(rows, sums, [name], "id").drop(name)


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = train_and_encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    if books is None:
        return coded.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # Two bytes an index, the low one first; indexes below 256 are the low bytes.
    digits = F.hex("codes")
    code = F.lower(F.concat(*(F.substring(digits, 4 * p + 1, 2) for p in range(PARTS))))
    out = with_label_error(cut(coded.select("id", "label", code.alias("code"), "error")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
