"""Client calls (contracts) against server routes.

contracts: contract_id, http_method, path, service_candidate, unsafe_dynamic, internal
routes: route_id (its order), http_method, path, service_candidate
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths


def _sides(contracts: DataFrame, routes: DataFrame, mounts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((http_method, path, key, gateway) of distinct calls, (key, route_method, route_id, route_gateway)).

    Calls of one method and path share their routes, so each such shape is matched once.
    """
    shapes = contracts.select(F.upper("http_method").alias("call_method"), "path").distinct()
    keyed = lambda df, made, name, value, *cols: df.select(*cols, F.explode(made).alias("key"), F.lit(value).alias(name))
    own = ("call_method", "path")
    left = keyed(shapes, paths.keys(F.col("path"), mounts), "gateway", 0, *own).unionByName(keyed(shapes, paths.gateway_keys(F.col("path"), mounts), "gateway", 1, *own))
    r = routes.select("route_id", F.upper("http_method").alias("route_method"), F.col("path").alias("route_path"))
    own = ("route_id", "route_method")
    right = keyed(r, paths.keys(F.col("route_path"), mounts), "route_gateway", 0, *own).unionByName(keyed(r, paths.gateway_keys(F.col("route_path"), mounts), "route_gateway", 1, *own))
    return left, right


def contract_matches(contracts: DataFrame, routes: DataFrame, mounts: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Project form: the first tier that holds decides; within a tier, the first route.

    A tier only needs its first route, so routes are reduced to one for each key and method before
    they meet the calls, and no pair of a call and a route is made beyond those.  carry: more columns
    of contracts to keep.
    """
    left, right = _sides(contracts, routes, mounts)
    right = right.groupBy("key", "route_method", "route_gateway").agg(F.min("route_id").alias("route_id"))
    pairs = left.join(right, "key").withColumn("gateway", F.col("gateway") + F.col("route_gateway")).filter("gateway < 2")
    same = F.col("call_method") == F.col("route_method")
    first = lambda cond, name: F.min(F.when(cond, F.col("route_id"))).alias(name)
    direct = F.col("gateway") == 0
    tiers = pairs.groupBy("call_method", "path").agg(first(direct & same, "exact_route"), first(direct, "path_route"), first(same, "any_gateway"))
    # A route that fits without a gateway is found by an earlier tier.
    tiers = tiers.withColumn("gateway_route", F.when(F.col("exact_route").isNull() & F.col("path_route").isNull(), F.col("any_gateway"))).drop("any_gateway")
    # Services: few, each once; adaptive execution broadcasts them when they are small.
    scanned = routes.filter("service_candidate <> ''").select(F.col("service_candidate").alias("scanned_service")).distinct()
    c = contracts.withColumn("call_method", F.upper("http_method")).join(tiers, ["call_method", "path"], "left").join(scanned, F.col("service_candidate") == F.col("scanned_service"), "left")
    slot = F.lower(F.regexp_extract("path", "([^/]*)/?$", 1))
    named = F.col("service_candidate") != ""
    blank = F.trim("path") == ""
    issue = (
        F.when(F.col("internal"), "frontend_internal_api")
        .when(blank & F.col("unsafe_dynamic"), "unsafe_dynamic")
        .when(blank, "missing_backend_route")
        .when(F.col("exact_route").isNotNull(), "matched")
        .when(F.col("path_route").isNotNull(), "method_mismatch")
        .when(F.col("gateway_route").isNotNull(), "gateway_or_proxy_prefix")
        .when(F.col("unsafe_dynamic"), "unsafe_dynamic")
        .when(named & F.col("scanned_service").isNull(), "unscanned_service")
        .when(named & slot.isin("{endpoint}", "{dynamicendpoint}"), "dynamic_endpoint_unresolved")
        .when(named, "indexed_backend_route_missing")
        .otherwise("missing_backend_route")
    )
    confidence = F.col("issue")
    out = c.withColumn("issue", issue)
    level = (
        F.when(confidence == "matched", "RESOLVED")
        .when(confidence == "method_mismatch", "MISMATCH")
        .when(confidence == "gateway_or_proxy_prefix", "PARTIAL_MATCH")
        .when(confidence.isin("frontend_internal_api", "unscanned_service"), "OUT_OF_SCOPE")
        .otherwise("UNRESOLVED")
    )
    score = (
        F.when(confidence == "matched", 0.9)
        .when(confidence == "method_mismatch", 0.45)
        .when(confidence == "gateway_or_proxy_prefix", 0.4)
        .when(confidence == "frontend_internal_api", 0.8)
        .when(confidence == "unscanned_service", 0.75)
        .when(confidence.isin("dynamic_endpoint_unresolved", "indexed_backend_route_missing"), 0.35)
        .when((confidence == "unsafe_dynamic") & (F.trim("path") != ""), 0.35)
        .otherwise(0.3)
    )
    route = F.when(confidence == "matched", F.col("exact_route")).when(confidence == "method_mismatch", F.col("path_route")).when(confidence == "gateway_or_proxy_prefix", F.col("gateway_route"))
    return out.select("contract_id", "http_method", "path", "service_candidate", "issue", level.alias("confidence"), score.alias("confidence_score"), route.alias("route_id"), *carry)


def workspace_matches(contracts: DataFrame, routes: DataFrame, mounts: Sequence[str] = ()) -> DataFrame:
    """Workspace form: several exact routes are AMBIGUOUS; (contract_id, issue, confidence, candidates, route_id).

    Routes with one set of keys and method are one row with their number and first id: two such rows
    have different routes, so numbers of distinct rows add up to the number of distinct routes.
    """
    shapes = contracts.select(F.upper("http_method").alias("call_method"), "path").distinct().withColumn("call_keys", paths.keys(F.col("path"), mounts))
    r = routes.select("route_id", F.upper("http_method").alias("route_method"), F.array_sort(paths.keys(F.col("path"), mounts)).alias("keys"))
    r = r.groupBy("route_method", "keys").agg(F.count_distinct("route_id").alias("n"), F.min("route_id").alias("route_id"))
    left = shapes.select("call_method", "path", "call_keys", F.explode("call_keys").alias("key"))
    right = r.select("route_method", "keys", "n", "route_id", F.explode("keys").alias("key"))
    # A pair that shares several keys counts at the first of them.
    pairs = left.join(right, "key").filter(F.col("key") == F.array_min(F.array_intersect("call_keys", "keys")))
    same = F.col("call_method") == F.col("route_method")
    tiers = pairs.groupBy("call_method", "path").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("exact"),
        F.sum("n").alias("any_method"),
        F.min(F.when(same, F.col("route_id"))).alias("exact_route"),
        F.min("route_id").alias("path_route"),
    )
    c = contracts.withColumn("call_method", F.upper("http_method")).join(tiers, ["call_method", "path"], "left").fillna({"exact": 0, "any_method": 0})
    issue = F.when(F.col("exact") == 1, "matched").when(F.col("exact") > 1, "ambiguous_route").when(F.col("any_method") > 0, "method_mismatch").otherwise("missing_backend_route")
    level = F.when(F.col("exact") == 1, "RESOLVED").when(F.col("exact") > 1, "AMBIGUOUS").when(F.col("any_method") > 0, "MISMATCH").otherwise("UNRESOLVED")
    route = F.when(F.col("exact") == 1, F.col("exact_route")).when((F.col("exact") == 0) & (F.col("any_method") > 0), F.col("path_route"))
    return c.select("contract_id", issue.alias("issue"), level.alias("confidence"), F.col("exact").cast("long").alias("candidates"), route.alias("route_id"))


def similarity(method: Column, path: Column, route_method: Column, route_path: Column) -> Column:
    """3 for the method, 4 for the first segment, 2 for each later equal or placeholder pair, 1 for close lengths."""
    a, b = paths.segments(path), paths.segments(route_path)
    low = lambda x: F.lower(F.coalesce(F.get(x, F.lit(0)), F.lit("")))
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 0).when((paths.is_placeholder(x) & paths.is_placeholder(y)) | (F.lower(x) == F.lower(y)), 2).otherwise(0))
    later = F.aggregate(F.slice(both, F.lit(2), F.greatest(F.size(both) - 1, F.lit(0))), F.lit(0), lambda s, x: s + x)
    score = F.when(F.upper(method) == F.upper(route_method), 3).otherwise(0) + F.when(low(a) == low(b), 4).otherwise(0) + later + F.when(F.abs(F.size(a) - F.size(b)) <= 1, 1).otherwise(0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (score < 5), 0).otherwise(score)


def similar_routes(contracts: DataFrame, routes: DataFrame, limit: int = 3) -> DataFrame:
    """(contract_id, rank, route_label, score): the best routes of the same service, ties by label.

    Distinct calls (method, path) of a service meet distinct routes of it; each shape is ranked once
    and its answer given to all its calls.
    """
    label = F.concat_ws(" ", F.upper("route_method"), "route_path")
    r = routes.select("service_candidate", F.col("http_method").alias("route_method"), F.col("path").alias("route_path")).distinct()
    shapes = contracts.select("service_candidate", "http_method", "path").distinct()
    scored = shapes.join(r, "service_candidate").withColumn("score", similarity(F.col("http_method"), F.col("path"), F.col("route_method"), F.col("route_path"))).filter("score > 0")
    order = W.partitionBy("service_candidate", "http_method", "path").orderBy(F.desc("score"), "route_label")
    best = scored.withColumn("route_label", label).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return contracts.select("contract_id", "service_candidate", "http_method", "path").join(best.select("service_candidate", "http_method", "path", "rank", "route_label", "score"), ["service_candidate", "http_method", "path"]).select("contract_id", "rank", "route_label", "score")


def dynamic_candidates(contracts: DataFrame, routes: DataFrame) -> DataFrame:
    """(contract_id, candidate): routes that share method, service and all segments before the last."""

    def prefix(path: Column) -> Column:
        parts = paths.segments(path)
        return paths.canon(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))

    left = contracts.select("contract_id", F.upper("http_method").alias("m"), "service_candidate", prefix(F.col("path")).alias("prefix"), F.size(paths.segments(F.col("path"))).alias("n"))
    right = routes.select(F.upper("http_method").alias("m"), "service_candidate", prefix(F.col("path")).alias("prefix"), F.size(paths.segments(F.col("path"))).alias("n"), F.col("path").alias("candidate")).distinct()
    return left.join(right, ["m", "service_candidate", "prefix", "n"]).select("contract_id", "candidate").distinct()
