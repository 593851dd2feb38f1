"""Pieces of source text for an answer, and which paths may be read for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from . import graph

# Lines around a focus, and the most lines of a body and of a signature.
BEFORE, AFTER, BODY, SIGNATURE = 28, 32, 120, 12


def safe_path(path: Column) -> Column:
    """Whether a path is relative, not empty, and never leaves the folder it starts in."""
    p = F.trim(F.coalesce(path, F.lit("")))
    step = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    fold = F.aggregate(F.split(p, "/"), start, lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), F.least(a["least"], a["depth"] + step(s)).alias("least")), lambda a: a["least"])
    return (p != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (fold >= 0)


def ranges(sections: DataFrame, heights: DataFrame) -> DataFrame:
    """Sections with first and last line to show, or an error.

    sections: section_id, path, mode (body, focused, signature), line, start_line, end_line; heights: path,
    lines.  A body is its range, if that is short enough; a focus reaches some lines around its line; a
    signature is searched in the lines from its own on.
    """
    n = F.col("lines")
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), n)
    rows = sections.join(heights, "path")
    first = F.when(F.col("mode") == "focused", clamp(F.col("line") - BEFORE)).when(F.col("mode") == "body", clamp(F.col("start_line"))).otherwise(clamp(F.col("line")))
    last = F.when(F.col("mode") == "focused", clamp(F.col("line") + AFTER)).when(F.col("mode") == "body", clamp(F.col("end_line"))).otherwise(clamp(F.col("line") + SIGNATURE - 1))
    error = F.when(~F.col("mode").isin("body", "focused", "signature"), "unsupported mode").when(~safe_path(F.col("path")), "unsafe path").when((F.col("mode") == "body") & (F.col("end_line") - F.col("start_line") + 1 > BODY), "body too long").otherwise("")
    return rows.select("section_id", "path", "mode", first.alias("first"), last.alias("last"), error.alias("error"))


def render(sources: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, first, last, content, error): numbered lines of each section.

    Each section is exploded to its lines, 120 at most, which meet the lines of its file by number.  A
    signature ends at the first line that opens a body or ends a statement; without one it is an error.
    """
    text = lines(sources, "content", "path")
    heights = text.groupBy("path").agg(F.max("line_no").alias("lines"))
    asked = ranges(sections, heights)
    wanted = asked.filter("error = ''").withColumn("line_no", F.explode(F.sequence("first", "last")))
    held = wanted.join(text, ["path", "line_no"]).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("held"))
    out = asked.join(held, "section_id", "left")
    ends = F.filter("held", lambda x: x["line"].rlike(r"[{;]\s*$|:\s*$"))
    stop = F.when(F.col("mode") == "signature", F.get(ends, F.lit(0))["line_no"]).otherwise(F.col("last"))
    out = out.withColumn("stop", stop).withColumn("error", F.when((F.col("error") == "") & F.col("stop").isNull(), "no signature").otherwise(F.col("error")))
    numbered = F.transform(F.filter("held", lambda x: x["line_no"] <= F.col("stop")), lambda x: F.concat(x["line_no"].cast("string"), F.lit("\t"), x["line"]))
    good = F.col("error") == ""
    return out.select("section_id", F.when(good, F.col("first")).alias("first"), F.when(good, F.col("stop")).alias("last"), F.when(good, F.array_join(numbered, "\n")).otherwise("").alias("content"), "error")


# What an edge of a kind adds, what each level takes off, and the bounds of the sum.
UTILITY = {"http_contract": 180, "persistence": 180, "call": 140, "implements": 140, "extends": 140, "auth": 100, "use": 60, "consumes_endpoint": 60}
PER_LEVEL, LEVELS, MOST, DEAD_END = 20, 4, 480, -120


def forward_utility(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, utility): how much a start (node) leads to, by edges (edge_id, from_id, to_id, kind) within four levels.

    Each edge counts once, at the first level that meets it; a start without edges is a dead end.
    """
    weight = F.lit(0)
    for kind, points in UTILITY.items():
        weight = F.when(F.lower(F.trim("kind")) == kind, points).otherwise(weight)
    e = graph.keyed(edges.select("edge_id", "from_id", "to_id", weight.alias("w")), "from_id")
    begin = graph.settle(starts.select(F.col("node").alias("start")).distinct())
    frontier = seen = begin.select("start", F.col("start").alias("node"))
    hits = None
    for level in range(LEVELS):
        step = graph.settle(frontier.join(e, F.col("node") == F.col("from_id")).select("start", "edge_id", "to_id", F.greatest(F.col("w") - PER_LEVEL * level, F.lit(0)).alias("points")))
        if step.isEmpty() and hits is not None:
            break
        own = step.select("start", "edge_id", "points")
        hits = own if hits is None else hits.unionByName(own)
        if level + 1 < LEVELS:
            frontier = graph.settle(step.select("start", F.col("to_id").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
    # A level is a bound on the points, so the first one is the largest.
    once = hits.groupBy("start", "edge_id").agg(F.max("points").alias("points")).groupBy("start").agg(F.sum("points").alias("total"))
    return begin.join(once, "start", "left").select(F.col("start").alias("node"), F.when(F.col("total").isNull(), DEAD_END).otherwise(F.least("total", F.lit(MOST))).cast("int").alias("utility"))
