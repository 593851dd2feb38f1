"""Integrity checks: duplicates, dangling references, enumerations, order, stale hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("copies")).filter("copies > 1")


def dangling(references: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """References to an id that isn't known; an empty reference is no reference."""
    return references.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left_anti")


def invalid_values(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(value, n) of values outside an enumeration."""
    return rows.filter(~F.coalesce(F.col(column), F.lit("")).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def out_of_order(rows: DataFrame, order: str, keys: list[str], *by: str) -> DataFrame:
    """Rows that sort before the row stored in front of them."""
    w = W.partitionBy(*by).orderBy(order)
    here = F.struct(*keys)
    return rows.withColumn("_before", F.lag(here).over(w)).filter(F.col("_before") > here).drop("_before")


def stale(recorded: DataFrame, current: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, state): missing, unrecorded, or of another hash."""
    a = recorded.select(path, F.col(digest).alias("_a"))
    b = current.select(path, F.col(digest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unrecorded").when(F.col("_a") != F.col("_b"), "stale")
    return a.join(b, path, "full_outer").withColumn("state", state).filter("state is not null").select(path, "state")


def checks(spark, **counts: DataFrame) -> DataFrame:
    """One row per named check with its number of violations and pass or fail."""
    rows = None
    for name, violations in counts.items():
        row = violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def portable(path: Column) -> Column:
    """Whether a path is empty, or relative, with forward slashes and no segment that leaves its folder."""
    p = F.coalesce(path, F.lit(""))
    bad = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return (p == "") | ~(bad | p.contains("\\") | p.rlike("^[A-Za-z]:") | p.startswith("/"))


def _violations(rows: DataFrame, check: str, bad: Column, item: str) -> DataFrame:
    return rows.filter(F.coalesce(bad, F.lit(False))).select(F.lit(check).alias("check"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"))


def _blank(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return out


def index_violations(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, item) of a context index: empty and repeated ids, negative lines, paths that aren't portable, dangling ends, order.

    facts: position, fact_id, file, line, end_line; edges: position, edge_id, from_id, to_id, file, line.
    An id must be unique among facts and edges together; rows are stored in the order of their ids.
    """
    ids = facts.filter(~_blank("fact_id")).select(F.col("fact_id").alias("item")).unionByName(edges.filter(~_blank("edge_id")).select(F.col("edge_id").alias("item")))
    repeated = ids.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("check"), "item")
    out = (
        _violations(facts, "empty_fact_id", _blank("fact_id"), "fact_id")
        .unionByName(_violations(edges, "empty_edge_id", _blank("edge_id"), "edge_id"))
        .unionByName(repeated)
        .unionByName(_violations(facts, "negative_line", (F.col("line") < 0) | (F.col("end_line") < 0), "fact_id"))
        .unionByName(_violations(edges, "negative_line", F.col("line") < 0, "edge_id"))
        .unionByName(_violations(facts, "invalid_path", ~portable(F.col("file")), "fact_id"))
        .unionByName(_violations(edges, "invalid_path", ~portable(F.col("file")), "edge_id"))
        .unionByName(_violations(edges, "empty_end", _blank("from_id", "to_id"), "edge_id"))
    )
    for side in ("from_id", "to_id"):
        loose = dangling(edges.filter(~_blank(side)), side, facts, "fact_id")
        out = out.unionByName(loose.select(F.lit(f"dangling_{side}").alias("check"), F.col("edge_id").alias("item")))
    for rows, key in ((facts, "fact_id"), (edges, "edge_id")):
        out = out.unionByName(unsorted(rows, "position", key).select(F.lit("unsorted").alias("check"), F.col(key).cast("string").alias("item")))
    return out


def unsorted(rows: DataFrame, position: str, key: str, parts: int = 64) -> DataFrame:
    """Rows whose key is below that of a row stored before them.

    Rows are cut into ranges of position; each is compared inside, and with the largest key of all
    ranges before it, so no task gathers the table.
    """
    ends = rows.agg(F.min(position), F.max(position)).first()
    if ends[0] is None:
        return rows
    width = max((ends[1] - ends[0]) // parts + 1, 1)
    cut = rows.withColumn("_part", F.floor((F.col(position) - ends[0]) / width))
    tops = cut.groupBy("_part").agg(F.max(key).alias("_top"))  # parts rows
    before = tops.select("_part", F.max("_top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"))
    inside = F.max(key).over(W.partitionBy("_part").orderBy(position).rowsBetween(W.unboundedPreceding, -1))
    met = cut.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return met.filter((F.col("_inside") > F.col(key)) | (F.col("_earlier") > F.col(key))).drop("_part", "_inside", "_earlier")


def flow_violations(flows: DataFrame, nodes: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """(flow_id, check, item): flows of another model version, nodes and edges without identity or fields, repeated or dangling ones.

    flows: flow_id, model_version; nodes: flow_id, id, kind; edges: flow_id, id, from_node_id, to_node_id,
    edge_type, confidence, reason.  A flow of version 0 without nodes and edges is an old one and has none.
    """
    held = nodes.select("flow_id").unionByName(edges.select("flow_id")).distinct().withColumn("_held", F.lit(True))
    other = flows.join(held, "flow_id", "left").filter((F.col("model_version") != version) & ~((F.col("model_version") == 0) & F.col("_held").isNull()))
    row = lambda df, check, item: df.select("flow_id", F.lit(check).alias("check"), F.coalesce(item.cast("string"), F.lit("")).alias("item"))
    twice = lambda df: df.filter(~_blank("id")).groupBy("flow_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
    out = (
        row(other, "model_version", F.col("model_version"))
        .unionByName(row(nodes.filter(_blank("id", "kind")), "node_identity", F.col("id")))
        .unionByName(row(twice(nodes), "duplicate_node", F.col("id")))
        .unionByName(row(edges.filter(_blank("id", "edge_type", "confidence", "reason")), "edge_incomplete", F.col("id")))
        .unionByName(row(twice(edges), "duplicate_edge", F.col("id")))
    )
    known = nodes.select("flow_id", F.col("id").alias("_end")).distinct()
    for side in ("from_node_id", "to_node_id"):
        loose = edges.withColumn("_end", F.col(side)).join(known, ["flow_id", "_end"], "left_anti")
        out = out.unionByName(row(loose, "dangling_source" if side.startswith("from") else "dangling_target", F.col("id")))
    return out


# Code, category, severity and resolution of diagnostics; other codes are information.
DIAGNOSTICS = {
    "frontend_internal_api": ("expected_behavior", "INFO", "OUT_OF_SCOPE"),
    "method_mismatch": ("likely_defect", "ERROR", "PARTIAL"),
    "indexed_backend_route_missing": ("missing_scan_coverage", "WARNING", "UNRESOLVED"),
    "unscanned_service": ("missing_scan_coverage", "WARNING", "UNRESOLVED"),
    "dynamic_endpoint_unresolved": ("dynamic_or_ambiguous", "WARNING", "PARTIAL"),
    "analyzer_failed": ("missing_scan_coverage", "ERROR", "UNRESOLVED"),
}
# Confidence labels in common terms.
CONFIDENCE = {"EXACT": "EXACT", "EXTRACTED": "EXACT", "RESOLVED": "RESOLVED", "MATCHED": "RESOLVED", "NORMALIZED": "NORMALIZED", "INFERRED": "INFERRED", "WEAK": "WEAK", "WEAK_MATCH": "WEAK"}


def canonical_diagnostics(matches: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(id, code, category, severity, resolution, confidence, artifacts): one for each match, and for each failed capability.

    matches: issue, confidence, api_http_method, api_path, api_file, backend_file; capabilities: project, language, capability, coverage.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ident = lambda *parts: F.concat(F.lit("diagnostic:"), F.substring(F.sha2(F.array_join(F.array(*parts), "\0"), 256), 1, 32))
    solid = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: F.trim(x) != ""), ",")
    code = F.coalesce(F.nullif(text("issue"), F.lit("")), F.lit("information"))
    labels = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    rows = matches.select(
        ident(code, text("api_http_method"), text("api_path"), text("api_file"), text("backend_file")).alias("id"), code.alias("code"),
        F.coalesce(labels[F.upper(text("confidence"))], F.lit("UNKNOWN")).alias("confidence"),
        solid(text("api_file"), text("backend_file"), F.concat_ws(" ", text("api_http_method"), text("api_path"))).alias("artifacts"),
    )
    failed = capabilities.filter("coverage = 'FAILED'")
    more = failed.select(ident(F.lit("analyzer_failed"), text("project"), text("language"), text("capability")).alias("id"), F.lit("analyzer_failed").alias("code"), F.lit("EXACT").alias("confidence"), solid(text("project"), text("language"), text("capability")).alias("artifacts"))
    known = F.create_map(*(x for k, v in DIAGNOSTICS.items() for x in (F.lit(k), F.struct(*(F.lit(y).alias(n) for n, y in zip(("category", "severity", "resolution"), v))))))
    other = {"category": "information", "severity": "INFO", "resolution": "PARTIAL"}
    out = rows.unionByName(more).withColumn("d", known[F.col("code")])
    return out.select("id", "code", *(F.coalesce(f"d.{n}", F.lit(v)).alias(n) for n, v in other.items()), "confidence", "artifacts")


def untested(items: DataFrame, keys: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Items for which no key occurs among the tested ones: one anti join for each key."""
    for column, tested, name in keys:
        items = items.join(tested.select(F.col(name).alias("_t")).distinct(), F.col(column) == F.col("_t"), "left_anti")
    return items


def security_kind(kind: Column) -> Column:
    """Auth labels as one of ten categories."""
    k = F.lower(F.trim(kind))
    return (
        F.when(k.isin("basic", "httpbasic", "basicauth"), "basic")
        .when(k.isin("bearer", "jwt", "bearerauth", "token"), "bearer")
        .when(k.startswith("oauth"), "oauth2")
        .when(k.isin("api_key", "apikey", "api-key", "x-api-key"), "api_key")
        .when(k.isin("session", "cookie", "formlogin", "form_login"), "session")
        .when(k.isin("mtls", "x509"), "mtls")
        .when(k.startswith("hasrole") | k.startswith("hasanyrole") | k.startswith("hasauthority") | k.startswith("hasanyauthority") | (k == "role"), "role")
        .when(k.isin("authenticated", "isauthenticated()"), "authenticated")
        .when(k.isin("permitall", "permitall()", "public", "none", "anonymous"), "public")
        .otherwise("unknown")
    )


def security_mismatch(call_kinds: Column, provider_kinds: Column) -> Column:
    """The first rule that fits: conflict, credentials for a public endpoint, no credentials, other scheme."""
    public = F.array_contains(provider_kinds, "public")
    restricted = F.exists(provider_kinds, lambda k: ~k.isin("public", "unknown"))
    sent = F.filter(call_kinds, lambda k: ~k.isin("public", "unknown"))
    any_credential = F.exists(provider_kinds, lambda k: k.isin("role", "authenticated"))
    token = lambda ks: F.transform(ks, lambda k: F.when(k == "oauth2", "bearer").otherwise(k))
    return (
        F.when(public & restricted, "conflicting_provider_security")
        .when(public & (F.size(sent) > 0), "credentials_on_public_endpoint")
        .when(restricted & (F.size(sent) == 0), "missing_call_auth_evidence")
        .when(restricted & ~any_credential & ~F.arrays_overlap(token(sent), token(provider_kinds)), "auth_scheme_mismatch")
        .otherwise("")
    )
