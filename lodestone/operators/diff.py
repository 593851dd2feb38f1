"""Snapshots compared: set deltas and entity changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_delta(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """(value, change): distinct values added or removed."""
    b = before.select(value).distinct().withColumn("_b", F.lit(True))
    a = after.select(value).distinct().withColumn("_a", F.lit(True))
    both = b.join(a, value, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
    return both.withColumn("change", change).filter("change is not null").select(value, "change")


def entity_diff(before: DataFrame, after: DataFrame, key: str, *attributes: str) -> DataFrame:
    """(key, change): new, removed, or changed in any attribute (null-safe); unchanged keys are left out."""
    b = before.select(key, F.struct(*attributes).alias("_b"))
    a = after.select(key, F.struct(*attributes).alias("_a"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).filter("change is not null").select(key, "change")
