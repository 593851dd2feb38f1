"""Stable identities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """24 hex digits of SHA-1 over each part followed by a NUL; null counts as empty."""
    each = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.char(F.lit(0)))]
    return F.substring(F.sha1(F.concat(*each)), 1, 24)


def evidence_id(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the NUL-joined parts."""
    joined = F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "\0")
    return F.substring(F.sha2(joined, 256), 1, 32)


def workspace_id(*parts: Column) -> Column:
    """Readable id: lower-cased, slash-normalised, non-empty parts joined by colons; long ones are hashed."""
    cleaned = F.transform(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), lambda p: F.replace(F.lower(F.trim(p)), F.lit("\\"), F.lit("/")))
    joined = F.array_join(F.filter(cleaned, lambda p: p != ""), ":")
    return F.when((F.length(joined) > 180) | joined.rlike("[\n\t]"), stable_id(*parts)).otherwise(joined)


def fingerprints(files: DataFrame, by: str, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(by, files, fingerprint): SHA-256 over the sorted ``path NUL hash`` of each group, joined by NUL.

    A group is sorted and read once as a stream, with the hash carried from batch to batch, so no row
    or array ever holds a group.
    """
    kind = files.schema[by].dataType.simpleString()
    rows = files.select(F.col(by).alias("k"), F.concat(path, F.char(F.lit(0)), digest).alias("entry")).repartition("k").sortWithinPartitions("k", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, state = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], types), pa.array([count]), pa.array([state.hexdigest()])], ["k", "files", "fingerprint"])

        for batch in batches:
            types = batch.schema.field(0).type
            for k, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or k != key:
                    if state is not None:
                        yield done()
                    key, count, state = k, 0, hashlib.sha256()
                state.update((b"\0" if count else b"") + (entry or "").encode())
                count += 1
        if state is not None:
            yield done()

    return rows.mapInArrow(run, f"k {kind}, files long, fingerprint string").withColumnRenamed("k", by)


def unique_sorted(values: Column) -> Column:
    """Distinct non-empty values in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def ranked(value: Column, ranks: dict[str, int], other: int = 1) -> Column:
    """The rank of a label; empty or null is 0."""
    known = reduce(lambda acc, kv: acc.when(F.upper(value) == kv[0], kv[1]), ranks.items(), F.when(F.coalesce(value, F.lit("")) == "", 0))
    return known.otherwise(other)
