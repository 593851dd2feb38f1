"""Merkle manifest of a dataset: a digest of every row, of every group, and of all, with proofs.

A row's leaf is the digest of its columns, each with its length, so no two rows share a preimage.  The
leaves of a group, in order, are hashed by runs of FANOUT consecutive ones, level by level, until one is
left, the group's subroot; the subroots, in order of their group, are hashed the same way to the root.

A level is one window over (group, parent): the ordered list of a full frame is the parent's preimage
and gives each node its siblings, and the node in the first place of each run stands for the parent on
the next level.  A run has FANOUT rows, so no group is gathered, and a level is a FANOUT-th of the one
below.  A group of one node passes its level as it is.

Places come from rows that are sorted by ranges: a row's number in its partition, less the group's first
one there, plus the counts of the group in earlier partitions (one row for each partition and group).

Proofs come down from the root: a node hands its run's siblings and its own to its children, so the
leaves meet what is above them once for each run, in the partitioning of their own window.

Defined cases: a null column is ``-``; a null group is one group, before all others; null orders come
first; rows of equal order follow their leaves; repeated rows are leaves of their own; very long texts
are read whole; a lone leaf is its subroot, and a lone subroot the root, with no siblings (the digest of
no bytes); an empty table gives no rows; other columns are ignored, unless named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*(field(v) for v in values)))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with idx, the place in its group from 0, and n, the group's size; group and order are not null-safe keys."""
    # The number holds the partition in its upper bits.
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    rows = cut(sorted_rows.withColumn("part", F.spark_partition_id()))
    held = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = held.select(group, "part", "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(W.partitionBy(group)).alias("n"))
    return rows.join(runs, [group, "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def with_run(nodes: DataFrame, fanout: int = FANOUT, of: str = "digest") -> DataFrame:
    """nodes (g, idx, n, their digest in column of) with parent, place in the run, the run's digests, and the parent's digest."""
    nodes = nodes.withColumn("parent", F.floor(F.col("idx") / fanout)).withColumn("place", (F.col("idx") % fanout).cast("int"))
    frame = W.partitionBy("g", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nodes = nodes.withColumn("run", F.array_join(F.collect_list(of).over(frame), ""))
    return nodes.withColumn("above", F.when(F.col("n") == 1, F.col(of)).otherwise(digest(F.col("run"))))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level's nodes, one for each run."""
    return level.filter(F.col("place") == 0).select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.col("above").alias("digest"))


def siblings() -> Column:
    """What a node adds to the proofs below it: its place and its run without it; nothing if it passes."""
    others = F.concat(F.substring("run", F.lit(1), F.col("place") * HEX), F.substring("run", F.col("place") * HEX + HEX + 1, F.length("run")))
    return F.when(F.col("n") == 1, F.array().cast("array<struct<place:int,others:string>>")).otherwise(F.array(F.struct("place", others.alias("others"))))


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels over nodes, each written, up to the one where every group has one node."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(cut(with_run(nodes, fanout)))
        nodes, most = parents(out[-1], fanout), -(-most // fanout)
    return [*out, cut(nodes)]


def handed_down(tree: list[DataFrame], top: DataFrame) -> DataFrame:
    """(g, idx, up) of the lowest level of tree; up: siblings level by level to the root.  top has (g, up) of each group."""
    up = tree[-1].select("g", "idx").join(top, "g")
    for level in reversed(tree[:-1]):
        own = level.select("g", "idx", "parent", siblings().alias("own"))
        up = own.join(up.withColumnRenamed("idx", "parent"), ["g", "parent"]).select("g", "idx", F.concat("own", "up").alias("up"), *(c for c in up.columns if c not in ("g", "idx", "up")))
    return up


def proof(up: Column) -> Column:
    return digest(F.array_join(F.transform(up, lambda x: x["others"]), ""))


def folded(start: Column, up: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    put = lambda acc, x: digest(F.concat(F.substring(x["others"], F.lit(1), x["place"] * HEX), acc, F.substring(x["others"], x["place"] * HEX + 1, F.length(x["others"]))))
    return F.aggregate(up, start, put)


def manifest(rows: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """(rows with subroot and up, root) of rows with source (any string or null), ord and leaf.

    Other columns of rows stay; none may be one of g, idx, n, parent, place, run, above, rest, up, subroot.
    """
    keyed = rows.withColumn("g", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")))
    leaves = cut(numbered(keyed, "g", ["ord", "leaf"]))
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return leaves.select(*rows.columns, F.lit("").alias("subroot"), F.array().cast("array<struct<place:int,others:string>>").alias("up")), None
    # The lowest level is not written with its runs: they are made again where proofs are.
    lowest = with_run(leaves.select("g", "idx", "n", "leaf"), fanout, "leaf")
    tree = levels(cut(parents(lowest, fanout)), fanout)
    subroots = tree[-1].select("g", F.col("digest").alias("subroot"))
    ranked = numbered(subroots.select(F.lit("").alias("all"), F.col("g").alias("source"), F.col("subroot").alias("digest")), "all", ["source"])
    crown = levels(ranked.select(F.col("all").alias("g"), "idx", "n", "digest", "source"), fanout)
    root = crown[-1].first()["digest"]
    above = handed_down(crown, crown[-1].select("g").withColumn("up", F.array().cast("array<struct<place:int,others:string>>")))
    names = ranked.select(F.col("source").alias("g"), "idx") if len(crown) == 1 else crown[0].select(F.col("source").alias("g"), "idx")
    top = names.join(above.select("idx", "up"), "idx").join(subroots, "g").select("g", "up", "subroot")
    down = handed_down(tree, top).select("g", F.col("idx").alias("parent"), F.col("up").alias("rest"), "subroot")
    out = with_run(leaves, fanout, "leaf").join(down, ["g", "parent"])
    return out.withColumn("up", F.concat(siblings(), "rest")).select(*rows.columns, "subroot", "up"), root


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "source", F.col("doc_id").alias("ord"), leaf([F.col(c) for c in COLUMNS]).alias("leaf"), F.when(fifth, leaf(tampered)).alias("changed"))
    found, root = manifest(cut(rows))
    fold = folded(F.coalesce("changed", "leaf"), F.col("up"))
    return found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof(F.col("up")).alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
