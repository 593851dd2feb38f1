"""Search facts: routes, symbols, contracts, steps and tests in one table, and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.ids import evidence_id, ranked, stable_id
from .graph import sized


def _fact(df: DataFrame, kind: str, name: Column, qualified: Column, file: Column, line: Column, confidence: Column, *text: Column) -> DataFrame:
    blank = F.lit("")
    return df.select(
        stable_id(F.lit(kind), file, qualified, line).alias("fact_id"), F.lit(kind).alias("kind"), F.coalesce(name, blank).alias("name"), F.coalesce(qualified, blank).alias("qualified_name"),
        F.coalesce(file, blank).alias("file"), F.coalesce(line, F.lit(0)).cast("int").alias("line"), confidence.alias("confidence"), F.concat_ws(" ", name, qualified, file, *text).alias("text"),
    )


def search_facts(symbols: DataFrame, routes: DataFrame, contracts: DataFrame, tests: DataFrame) -> DataFrame:
    """One row for each id: strongest confidence, smallest text.

    symbols: file, name, kind, line; routes: http_method, path, handler, file, line; contracts: http_method,
    path, caller, file, line; tests: test_file, test_method, target_method, line.
    """
    extracted = F.lit("EXTRACTED")
    rows = (
        _fact(symbols, "symbol", F.col("name"), F.col("name"), F.col("file"), F.col("line"), extracted, F.col("kind"))
        .unionByName(_fact(routes, "route", F.concat_ws(" ", "http_method", "path"), F.col("handler"), F.col("file"), F.col("line"), extracted))
        .unionByName(_fact(contracts, "api_contract", F.concat_ws(" ", "http_method", "path"), F.col("caller"), F.col("file"), F.col("line"), extracted))
        .unionByName(_fact(tests, "test", F.col("test_method"), F.col("test_method"), F.col("test_file"), F.col("line"), F.lit("MATCHED"), F.col("target_method")))
    )
    strength = ranked(F.col("confidence"), params.CONFIDENCE_RANK)
    return rows.groupBy("fact_id").agg(*(F.max_by(c, F.struct(strength, F.col(c))).alias(c) for c in ("kind", "name", "qualified_name", "file", "line", "confidence")), F.min("text").alias("text"))


def fact_edges(facts: DataFrame, calls: DataFrame, matches: DataFrame) -> DataFrame:
    """(edge_id, from_id, to_id, kind): calls between symbols, contracts to routes; self edges are dropped.

    A call's ends are the symbols of its files and names, where each is unique there; only matched and
    RESOLVED contracts have an edge.
    """
    named = facts.filter("kind = 'symbol'").groupBy("file", "name").agg(F.min("fact_id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    end = lambda side: named.select(F.col("file").alias(f"{side}_file"), F.col("name").alias(f"{side}_name"), F.col("id").alias(f"{side}_id"))
    called = calls.join(end("from"), ["from_file", "from_name"]).join(end("to"), ["to_file", "to_name"]).select("from_id", "to_id", F.lit("calls").alias("kind"))
    c = facts.filter("kind = 'api_contract'").select(F.col("name").alias("contract"), F.col("file").alias("c_file"), F.col("line").alias("c_line"), F.col("fact_id").alias("from_id"))
    r = facts.filter("kind = 'route'").groupBy(F.col("name").alias("route")).agg(F.min("fact_id").alias("to_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    m = matches.filter("issue = 'matched' and confidence in ('RESOLVED', '')").select(F.concat_ws(" ", "http_method", "path").alias("contract"), F.col("file").alias("c_file"), F.col("line").alias("c_line"), F.col("route_id").alias("route"))
    http = m.join(c, ["contract", "c_file", "c_line"]).join(r, "route").select("from_id", "to_id", F.lit("http_contract").alias("kind"))
    out = called.unionByName(http).filter("from_id <> to_id").distinct()
    return out.select(stable_id(F.lit("edge"), F.col("from_id"), F.col("to_id"), F.col("kind")).alias("edge_id"), "from_id", "to_id", "kind")


def evidence(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(evidence_id, file, line, analyzer, method, reason, sha256), one for each distinct set of parts.

    rows: file, line, analyzer, method, reason; a row of an unknown file gives none.
    """
    known = files.select(F.col("path").alias("file"), "sha256")
    parts = rows.select("file", "line", "analyzer", "method", "reason").distinct().join(sized(known), "file")
    return parts.withColumn("evidence_id", evidence_id(*(F.col(c) for c in ("file", "line", "analyzer", "method", "reason", "sha256"))))
