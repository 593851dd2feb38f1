"""What the operators of this subpackage share: table access, cut lineage, Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import settle as cut
from ..operators.graph import shared

__all__ = ["binary_column", "cut", "fresh", "shared", "slices", "spread", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Inner or left join of many and few on columns that are not null, where a key may hold a third of many.

    Keys with over 1/(4 * partitions) of the rows of many, 4 * partitions keys at most by that
    measure, get parts in proportion: the rows of many are dealt over them by a hash of the column
    by, and the rows of few are repeated, 8 * partitions times in all at most for each row of a key.
    many is read twice: pass what is written.
    """
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = many.groupBy(*on).agg(F.count("*").alias("held"))
    limit = max(many.count() // (4 * partitions), 1)
    hot = counted.filter(F.col("held") > limit).select(*on, F.ceil(F.col("held") / limit).cast("int").alias("parts"))
    hot = F.broadcast(hot)
    left = many.join(hot, on, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = few.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*on, "part"], how).drop("part")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that no column of taken has, in any case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying rows; null counts as empty."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about limit bytes in a string column; a longer text comes alone."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def binary_column(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value per row."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
