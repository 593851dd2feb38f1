"""Lines, identifier tokens, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exploded(df: DataFrame, name: str, array: Column) -> DataFrame:
    """df with a row for each element of an array, which is made once.

    Before a plain explode, Spark tests an array that it makes for the test alone.  Null elements have no row.
    """
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, line): a final newline gives a last empty line."""
    return df.select(*keys, F.posexplode_outer(F.split(F.col(text), "\n"))).filter("col is not null").select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def tokens(value: Column, shortest: int = 2, cased: bool = True) -> Column:
    """Distinct lower-case identifier tokens in order: cut at case and digit boundaries and at all other marks.

    cased=False says that the value has no capitals, so runs of letters or digits are the tokens; one
    simple pattern finds them, which is many times faster on long texts.
    """
    if not cased:
        runs = F.regexp_extract_all(value, F.lit(rf"\p{{L}}{{{shortest},}}+|\p{{Nd}}{{{shortest},}}+"), F.lit(0))
        return F.sort_array(F.array_distinct(runs))
    spaced = F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", " ")
    parts = F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+")
    return F.sort_array(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= shortest)))


def held_terms(value: Column, terms: list[str]) -> Column:
    """How many of the terms (runs of letters, or of digits) are tokens of a value without capitals."""
    kinds = [(r"\p{L}", [t for t in terms if not t[:1].isdigit()]), (r"\p{Nd}", [t for t in terms if t[:1].isdigit()])]
    patterns = [rf"(?<!{kind})(?:{'|'.join(sorted(own, key=len, reverse=True))})(?!{kind})" for kind, own in kinds if own]
    if not patterns:
        return F.lit(0)
    some = F.lit(False)
    for t in terms:
        some = some | F.contains(value, F.lit(t))
    found = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("|".join(patterns)), F.lit(0))))
    return F.when(some, found).otherwise(0)


def token_estimate(value: Column) -> Column:
    """A quarter of the characters of the value's JSON, rounded up."""
    return F.ceil(F.char_length(value) / 4).cast("long")


def count_of(value: Column, mark: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit("")))


def blocks(line_rows: DataFrame, key: str, opening: str = "{", closing: str = "}") -> DataFrame:
    """(key, start_line, end_line) of blocks: a line that opens at depth zero to the first that is back at it.

    The running depth is a window sum per text; a block's number is the count of returns to zero so
    far, so both ends come from one aggregation.
    """
    order = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    counted = line_rows.select(key, "line_no", (count_of(F.col("line"), opening) - count_of(F.col("line"), closing)).alias("step"), count_of(F.col("line"), opening).alias("opened"))
    depth = counted.withColumn("depth", F.sum("step").over(order)).withColumn("before", F.col("depth") - F.col("step"))
    starts = depth.withColumn("begins", ((F.col("before") <= 0) & (F.col("opened") > 0)).cast("int"))
    numbered = starts.withColumn("block", F.sum("begins").over(order)).filter("block > 0")
    ended = F.min(F.when(F.col("depth") <= 0, F.col("line_no")))
    return numbered.groupBy(key, "block").agg(F.min("line_no").alias("start_line"), ended.alias("end_line")).select(key, "start_line", "end_line")
