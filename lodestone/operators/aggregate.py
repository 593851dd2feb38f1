"""Summaries: contract buckets, service edges, families, coverage, inventories, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params
from ..functions.ids import ranked


def contract_summary(matches: DataFrame, *by: str) -> DataFrame:
    """Each match in the first bucket that fits."""
    issue, level = F.col("issue"), F.col("confidence")
    bucket = (
        F.when((issue == "matched") | (level == "RESOLVED"), "resolved")
        .when((issue == "method_mismatch") | (level == "MISMATCH"), "method_mismatch")
        .when(issue.isin("unsafe_dynamic", "dynamic_endpoint_unresolved"), "dynamic")
        .when((issue == "frontend_internal_api") | (level == "OUT_OF_SCOPE"), "out_of_scope")
        .when(issue.isin("missing_backend_route", "indexed_backend_route_missing", "scanned_service_no_route"), "missing")
        .otherwise("other")
    )
    b = matches.withColumn("bucket", bucket)
    count = lambda name: F.count_if(F.col("bucket") == name).alias(name)
    return b.groupBy(*by).agg(F.count("*").alias("total"), *(count(x) for x in ("resolved", "method_mismatch", "dynamic", "out_of_scope", "missing", "other")))


def first_distinct(value: Column, order: Column, k: int) -> Column:
    """Aggregate: the first k distinct values in order; for groups of bounded distinct values."""
    pairs = F.array_sort(F.collect_set(F.struct(order.alias("o"), value.alias("v"))))
    return F.slice(F.array_distinct(F.transform(pairs, lambda p: p["v"])), 1, k)


def service_edges(calls: DataFrame, endpoints: int = 12) -> DataFrame:
    """calls (from_service, to_service, status, endpoint) to one row per edge, self edges dropped.

    The first endpoints in order are ranked over distinct endpoints, after a first aggregation, so a
    busy edge never gathers its calls.
    """
    own = calls.filter(F.col("from_service") != F.col("to_service"))
    status = F.col("status")
    count = lambda name, s: F.sum(F.when(status == s, F.col("n")).otherwise(0)).alias(name)
    each = own.groupBy("from_service", "to_service", "status", "endpoint").agg(F.count("*").alias("n"))
    totals = each.groupBy("from_service", "to_service").agg(F.sum("n").alias("total"), count("resolved", "RESOLVED"), count("mismatched", "MISMATCH"), count("unresolved", "UNRESOLVED"), count("out_of_scope", "OUT_OF_SCOPE"))
    named = each.select("from_service", "to_service", "endpoint").distinct()
    order = W.partitionBy("from_service", "to_service").orderBy("endpoint")
    few = named.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= endpoints)
    few = few.groupBy("from_service", "to_service").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "endpoint"))), lambda x: x["endpoint"]), ",").alias("endpoints"))
    risk = F.when(F.col("mismatched") > 0, "mismatches").when(F.col("unresolved") > 0, "unresolved").when((F.col("out_of_scope") > 0) & (F.col("resolved") == 0), "out_of_scope_only").otherwise("resolved")
    return totals.join(few, ["from_service", "to_service"]).withColumn("risk", risk)


def node_degree(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """(node, outgoing, incoming): weights summed both ways."""
    out = edges.select(F.col(source).alias("node"), F.col(weight).alias("o"), F.lit(0).cast("long").alias("i"))
    into = edges.select(F.col(target).alias("node"), F.lit(0).cast("long").alias("o"), F.col(weight).alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def family_pattern(explanation: Column) -> Column:
    """The first word that starts with /, without its query; deeper paths collapse to their first segment."""
    word = F.regexp_extract(F.concat(F.lit(" "), explanation), r"\s(/[^\s?]*)", 1)
    first = F.regexp_extract(word, "^/([^/]+)", 1)
    return F.when(word.rlike("^/[^/]+/.+"), F.concat(F.lit("/"), first, F.lit("/{variant}"))).otherwise(word)


def diagnostic_families(diagnostics: DataFrame) -> DataFrame:
    """(code, project, pattern) groups of (id, code, project, explanation, resolution)."""
    rows = diagnostics.withColumn("pattern", family_pattern(F.col("explanation")))
    return rows.groupBy("code", "project", "pattern").agg(
        F.count("*").alias("count"),
        *(F.count_if(F.col("resolution") == r).alias(r.lower()) for r in params.RESOLUTIONS),
        F.min("id").alias("first_id"),
        F.min_by("explanation", "id").alias("first_explanation"),
    )


def known_and_missing(references: DataFrame, known: DataFrame) -> DataFrame:
    """references (service), known (service, project, indexed): one row each with its count and state."""
    counts = references.groupBy("service").agg(F.count("*").alias("contracts"))
    joined = counts.join(known, "service", "left")
    state = F.when(F.col("project").isNull(), "unknown").when(F.col("indexed"), "indexed").otherwise("missing")
    return joined.select("service", F.coalesce("project", F.lit("")).alias("project"), "contracts", state.alias("state"))


def next_scans(coverage: DataFrame, limit: int = params.TOP) -> DataFrame:
    """Missing services with a project, most contracts first, then by project and service."""
    rows = coverage.filter("state = 'missing'").orderBy(F.desc("contracts"), "project", "service").limit(limit)
    return rows.select("service", "project", "contracts", F.row_number().over(W.orderBy(F.desc("contracts"), "project", "service")).alias("rank"))


def capability_inventory(facts: DataFrame, languages: DataFrame, capabilities: tuple[str, ...] = params.CAPABILITIES) -> DataFrame:
    """languages x capabilities (both few) with the number of facts (language, capability)."""
    grid = languages.select("language").distinct().select("language", F.explode(F.array(*(F.lit(c) for c in capabilities))).alias("capability"))
    counts = facts.groupBy("language", "capability").agg(F.count("*").alias("n"))
    out = grid.join(counts, ["language", "capability"], "left").fillna({"n": 0})
    return out.withColumn("coverage", F.when(F.col("n") > 0, "COMPLETE").otherwise("UNAVAILABLE"))


# What is read from each language: scope, and symbols, relations, calls, endpoints, tests.
ANALYZERS = {
    "go": ("language+routes", 1, 1, 1, 1, 1),
    "java": ("language+spring", 1, 1, 1, 1, 1),
    "javascript": ("language+routes+api", 1, 1, 1, 1, 1),
    "typescript": ("language+react+routes+api", 1, 1, 1, 1, 1),
    "python": ("language+routes", 1, 1, 1, 1, 1),
    "php": ("language+routes", 1, 1, 1, 1, 1),
    "shell": ("language", 1, 1, 1, 0, 0),
    "rust": ("language+routes", 1, 1, 1, 1, 1),
    "kotlin": ("language", 1, 1, 0, 0, 0),
    "scala": ("language", 1, 1, 0, 0, 0),
    "swift": ("language", 1, 1, 0, 0, 0),
    "ruby": ("language", 1, 1, 0, 0, 0),
    "c": ("language", 1, 1, 0, 0, 0),
    "cpp": ("language", 1, 1, 0, 0, 0),
    "csharp": ("language", 1, 1, 0, 0, 0),
    "markdown": ("document", 0, 0, 0, 0, 0),
    "json": ("metadata", 1, 0, 0, 0, 0),
    "yaml": ("metadata", 0, 0, 0, 0, 0),
    "maven": ("workspace+dependencies", 0, 1, 0, 0, 0),
    "node": ("workspace", 1, 1, 0, 0, 0),
}


def analyzer_inventory(languages: DataFrame) -> DataFrame:
    """(language, scope, symbols, relations, calls, endpoints, tests) of the distinct languages of a project.

    A language without an entry gives symbols of single files; empty and unknown ones are left out.
    """
    own = languages.select("language").distinct().filter("language is not null and language not in ('', 'unknown')")
    names = ("symbols", "relations", "calls", "endpoints", "tests")
    table = F.create_map(*(x for k, (scope, *flags) in ANALYZERS.items() for x in (F.lit(k), F.struct(F.lit(scope).alias("scope"), *(F.lit(bool(f)).alias(n) for n, f in zip(names, flags))))))
    found = own.withColumn("a", table[F.col("language")])
    other = {"symbols": True}
    return found.select("language", F.coalesce("a.scope", F.lit("file")).alias("scope"), *(F.coalesce(f"a.{n}", F.lit(other.get(n, False))).alias(n) for n in names))


def catalog_order(catalog: DataFrame) -> DataFrame:
    """The API catalogue in its order: service, path, method, then the place in the source."""
    keys = [c for c in ("service", "project", "path", "http_method", "file", "line") if c in catalog.columns]
    return catalog.orderBy(*(F.col(k).asc_nulls_first() for k in keys))


def most_connected(weighted: DataFrame, limit: int = 20) -> DataFrame:
    """(file, weight) rows to the files of largest total weight."""
    return weighted.groupBy("file").agg(F.sum("weight").alias("connections")).orderBy(F.desc("connections"), "file").limit(limit)


def module_counts(files: DataFrame, *more: Column) -> DataFrame:
    """Files, and more aggregates, per top-level folder (. for the root) and language."""
    module = F.when(F.col("path").contains("/"), F.get(F.split("path", "/"), F.lit(0))).otherwise(".")
    return files.groupBy(module.alias("module"), "language").agg(F.count("*").alias("files"), *more)


def risk_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("risk").agg(F.count("*").alias("items"))


def merge_facts(facts: DataFrame, key: str) -> DataFrame:
    """One row for each id: the strongest confidence, the smallest non-empty text, all evidence in order.

    facts: key, confidence, text, evidence (string).
    """
    rank = F.struct(ranked(F.col("confidence"), params.CONFIDENCE_RANK), F.col("confidence"))
    # Evidence of an id is a set, made in the map side of the aggregation too.
    return facts.groupBy(key).agg(
        F.max_by("confidence", rank).alias("confidence"),
        F.min(F.when(F.col("text") != "", F.col("text"))).alias("text"),
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"),
    )


def merge_nodes(nodes: DataFrame, key: str, order: str, *attributes: str) -> DataFrame:
    """One row for each id: for every attribute the first non-empty value in order."""
    filled = lambda a: F.min_by(a, F.when(F.coalesce(F.col(a).cast("string"), F.lit("")) != "", F.col(order)))
    return nodes.groupBy(key).agg(*(filled(a).alias(a) for a in attributes))


def lowest_coverage(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by("coverage", ranked(F.col("coverage"), params.COVERAGE_RANK, 0)).alias("coverage"))
