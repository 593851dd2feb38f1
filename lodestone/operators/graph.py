"""Graphs as edge tables: reach, shortest paths, degrees, cycles, impact, components.

Level loops write each frontier to a checkpoint, so a plan never grows with the depth, and a lost
executor costs one level.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: read again with its size known and no trace of its plan."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast by its plan's guess: texts and their lines are many times the table they are made from."""
    return df.hint("merge")


def finely(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by key into many partitions: where whole partitions are sorted, a task's memory grows with its share."""
    spark = df.sparkSession
    return df.repartition(max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def keyed(edges: DataFrame, key: str) -> DataFrame:
    """Edges kept in partitions of key, so that the levels of a walk move only their frontier."""
    return settle(edges.repartition(key))


def reach(edges: DataFrame, start: DataFrame, depth: int, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, depth, path): nodes within depth steps of start (node), each by its smallest shortest path.

    Breadth-first over sorted neighbours reports the smallest of the shortest paths, which is the
    minimum per level.  Repeated edges are dropped by that minimum.  Each level is kept once, so the
    plan of a level reads the edges and the levels before it, and nothing twice.
    """
    e = keyed(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null").distinct(), "a")
    frontier = settle(start.filter("node is not null").select("node").distinct().select("node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path")))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("a"), "path").join(e, "a").select(F.col("b").alias("node"), F.concat_ws(" > ", "path", F.col("b").cast("string")).alias("path"))
        frontier = settle(step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bounded_reach(edges: DataFrame, start: DataFrame, depth: int, cap: int = params.REACH_CAP) -> DataFrame:
    """The first cap reached nodes in breadth-first order (start apart), and whether more were cut."""
    found = reach(edges, start, depth).filter("depth > 0")
    # The order is total; only cap + 1 rows of each task reach the last sort.
    first = found.orderBy("depth", "path").limit(cap + 1)
    numbered = first.withColumn("n", F.row_number().over(W.orderBy("depth", "path")))
    return numbered.select("node", "depth", "n", (F.max("n").over(W.partitionBy()) > cap).alias("truncated")).filter(F.col("n") <= cap)


def undirected(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    return edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).unionByName(edges.select(F.col(target).alias("src"), F.col(source).alias("dst"))).distinct()


def branches(edges: DataFrame, source: str = "src") -> DataFrame:
    """Nodes with more than one outgoing edge; repeated edges count."""
    return edges.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("out_degree")).filter("out_degree > 1")


def ends(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Every node with is_entry (nothing leads to it) and is_exit (it leads nowhere)."""
    into = edges.select(F.col(target).alias("node")).distinct().withColumn("_in", F.lit(True))
    out = edges.select(F.col(source).alias("node")).distinct().withColumn("_out", F.lit(True))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").select("node", F.col("_in").isNull().alias("is_entry"), F.col("_out").isNull().alias("is_exit"))


def cycles(edges: DataFrame, longest: int, source: str = "src", target: str = "dst") -> DataFrame:
    """(cycle, length): closed walks of up to longest distinct nodes; each rotation is a row of its own."""
    e = settle(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct())
    walks = e.select(F.col("a").alias("first"), F.col("b").alias("last"), F.array("a", "b").alias("walk"))
    found = walks.filter(F.col("first") == F.col("last")).select(F.array("first", "last").alias("walk"))
    walks = walks.filter(F.col("first") != F.col("last"))
    for _ in range(longest - 1):
        step = walks.join(e, F.col("last") == F.col("a")).select("first", F.col("b").alias("last"), "walk", "b")
        found = found.unionByName(step.filter(F.col("b") == F.col("first")).select(F.concat("walk", F.array("b")).alias("walk")))
        walks = settle(step.filter(~F.array_contains("walk", F.col("b"))).select("first", "last", F.concat("walk", F.array("b")).alias("walk")))
    return found.distinct().select(F.array_join(F.transform("walk", lambda x: x.cast("string")), " > ").alias("cycle"), (F.size("walk") - 1).alias("length"))


def neighbours(edges: DataFrame, node, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges at a node with their direction; a self edge appears both ways."""
    out = edges.filter(F.col(source) == node).select(F.lit("out").alias("direction"), F.col(target).alias("other"))
    into = edges.filter(F.col(target) == node).select(F.lit("in").alias("direction"), F.col(source).alias("other"))
    return out.unionByName(into)


def impact(edges: DataFrame, changed: DataFrame, depth: int, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, depth, hits): who consumes the changed nodes, breadth-first against the edges.

    Each edge into an expanded node is a hit, also of nodes met before; only new nodes are expanded.
    """
    # Edges between the same nodes are one row with a count, so every level moves less.
    counted = edges.groupBy(F.col(source).alias("consumer"), F.col(target).alias("used")).agg(F.count("*").alias("n"))
    e = keyed(counted, "used")
    seen = frontier = settle(changed.select("node").distinct())
    found = None
    for level in range(1, depth + 1):
        hits = settle(frontier.select(F.col("node").alias("used")).join(e, "used").groupBy(F.col("consumer").alias("node")).agg(F.sum("n").alias("hits")).withColumn("depth", F.lit(level)))
        found = hits if found is None else found.unionByName(hits)
        if level < depth:
            frontier = settle(hits.select("node").join(seen, "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return found.select("node", "depth", "hits")


def impact_risk(direct, indirect, api_surface, uncertain):
    """high for 5 direct, 10 indirect or uncertain with a direct one; medium for any direct or API surface."""
    return F.when((direct >= 5) | (indirect >= 10) | (uncertain & (direct > 0)), "high").when(api_surface | (direct > 0), "medium").otherwise("low")


def components(edges: DataFrame, source: str = "src", target: str = "dst", rounds: int = 50) -> DataFrame:
    """(node, component): smallest node of each weakly connected component, by alternating star steps."""
    pairs = settle(edges.select(F.greatest(source, target).alias("a"), F.least(source, target).alias("b")).filter("a > b").distinct())
    for _ in range(rounds):
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = settle(small.filter("a > b").distinct())
        # Stars are final: no node has two centres, and no centre has one.
        marks = pairs.select(F.col("a").alias("node"), F.lit(1).alias("has"), F.lit(0).alias("is")).union(pairs.select("b", F.lit(0), F.lit(1)))
        if marks.groupBy("node").agg(F.sum("has").alias("has"), F.max("is").alias("is")).filter("has > 1 or (has > 0 and is > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
