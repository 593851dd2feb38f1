"""Transcripts of tool use: one JSON event per line, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, thread_id string, item struct<id: string, type: string, command: string, tool: string, output: string>, usage struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"
# First words of commands that look for files, and that read them.
SEARCHERS = ("rg", "grep", "find", "fd", "ls", "tree", "ag", "ack")
READERS = ("cat", "head", "tail", "sed", "less", "more", "bat", "nl", "awk")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, line_no, event): lines that are no JSON have a null event; line_no is the place in its file."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("transcript"), F.posexplode(F.split("value", "\n")))
    return text.filter("trim(col) <> ''").select("transcript", (F.col("pos") + 1).alias("line_no"), F.from_json("col", EVENT).alias("event"))


def commands(command: Column) -> Column:
    """The first words of a command line's parts."""
    parts = F.split(command, r"[;|&\n]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(F.trim(p), r"^(?:\S*/)?([\w.-]+)", 1)), lambda w: w != "")


def metrics(events: DataFrame) -> DataFrame:
    """(transcript, items, tool_calls, navigation, reads, distinct_commands, tokens).

    Repeated items of one id count once; each command at most once per class, and readers navigate too;
    tokens are the last usage's total if positive, else input and output.
    """
    items = events.filter("event.item.id is not null").groupBy("transcript", F.col("event.item.id").alias("id")).agg(F.max_by("event.item", "line_no").alias("item"))
    words = commands(F.coalesce("item.command", F.lit("")))
    hit = lambda names: F.exists(words, lambda w: w.isin(*names))
    counted = items.groupBy("transcript").agg(
        F.count("*").alias("items"),
        F.count_if(F.coalesce(F.col("item.command"), F.col("item.tool")).isNotNull()).alias("tool_calls"),
        F.count_if(hit(SEARCHERS + READERS)).alias("navigation"),
        F.count_if(hit(READERS)).alias("reads"),
        F.count_distinct("item.command").alias("distinct_commands"),
    )
    usage = events.filter("event.usage is not null").groupBy("transcript").agg(F.max_by("event.usage", "line_no").alias("u"))
    total = F.when(F.coalesce("u.total_tokens", F.lit(0)) > 0, F.col("u.total_tokens")).otherwise(F.coalesce("u.input_tokens", F.lit(0)) + F.coalesce("u.output_tokens", F.lit(0)))
    return counted.join(usage, "transcript", "left").select(*counted.columns, F.coalesce(total, F.lit(0)).alias("tokens"))
