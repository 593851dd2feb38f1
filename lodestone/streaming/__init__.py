"""Incremental extraction.

The extractors of single files keep no state between files, so the same expressions run on a stream
of source files; a file that changes is a new row, and tables keep the latest version of each path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import extract
from ..sources import files

SOURCE = "path string, content string, version bigint"


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, content, version, language) from Parquet files as they arrive."""
    return spark.readStream.schema(SOURCE).parquet(folder).withColumn("language", files.language(F.col("path")))


def symbols(stream: DataFrame) -> DataFrame:
    """Symbols of arriving files, with the version of their file."""
    marked = stream.withColumn("path", F.concat_ws("\x01", "path", F.col("version").cast("string")))
    found = extract.symbols(marked)
    part = lambda k: F.get(F.split("path", "\x01"), F.lit(k))
    return found.select(part(0).alias("path"), part(1).cast("long").alias("version"), "language", "line_no", "name", "kind")


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the newest version of each path."""
    newest = F.rank().over(W.partitionBy("path").orderBy(F.desc("version")))
    return rows.withColumn("_r", newest).filter("_r = 1").drop("_r")
