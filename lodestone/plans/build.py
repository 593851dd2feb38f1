"""A project's tables from its source tree: scan, extract, resolve, match, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params
from ..functions import paths
from ..functions.ids import stable_id
from ..operators import aggregate, clients, extract, facts, flows, java, match, resolve, scripts, security, sequence
from ..sources import files as sources

# Folders that are never sources.
EXCLUDED = (".git", "node_modules", "vendor", "dist", "build", "target", ".gradle", ".idea", "coverage", "__pycache__")


def tables(spark: SparkSession, root: str, services: dict[str, str] | None = None, ignore: list[str] = ()) -> dict[str, DataFrame]:
    """Lazy tables: only those that are read are computed."""
    text = sources.scan(spark, root, list(EXCLUDED), ignore=list(ignore)).withColumn("language", sources.language(F.col("path")))
    return derive(text, services) | {"skipped": sources.skipped(spark, root, list(EXCLUDED), ignore=list(ignore))}


def derive(text: DataFrame, services: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of (path, content, language).

    The tables that most others start from are persisted: each is computed once for a build.
    """
    text = text.persist()
    files = sources.file_records(text.select("path", F.encode("content", "UTF-8").alias("content")))
    records = java.java_records(text).persist()
    symbols = extract.symbols(text).select(F.col("path").alias("file"), "language", "name", "kind", F.col("line_no").alias("line"))
    symbols = symbols.unionByName(records.filter("record = 'method'").select(F.col("path").alias("file"), F.lit("java").alias("language"), "name", F.lit("method").alias("kind"), "line"))
    symbols = symbols.select(stable_id(F.lit("symbol"), F.col("file"), F.col("kind"), F.col("name"), F.col("line")).alias("id"), "*", F.concat_ws("#", "file", "name").alias("qualified_name"))
    imported = extract.relations(text).filter("language <> 'java'").select(F.col("path").alias("from"), F.col("target").alias("to"), "type", F.col("line_no").alias("line"), "language")
    symbols = symbols.persist()
    relations = resolve.local_imports(imported, files).select("from", "to", "type", "line").unionByName(java.imports(records).select("from", "to", "type", "line"))
    order = F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 8, "0"), "name")
    bodies = extract.functions_with_ends(text).withColumnsRenamed({"path": "file", "line_no": "line"})
    functions = bodies.join(files.select(F.col("path").alias("file"), "language"), "file").select(order.alias("fn_id"), "language", "file", "owner", "name", "kind", "line", "end_line").persist()
    found = extract.calls(text).filter("language <> 'java'").select(F.col("path").alias("file"), F.concat_ws(":", "path", "line_no", "receiver", "name").alias("point_id"), "receiver", F.col("name").alias("method"), F.col("line_no").alias("line"))
    inside = sequence.enclosing(found, functions.select("file", F.col("line").alias("low"), F.col("end_line").alias("high"), "fn_id"), "file", "line", "low", "high", "fn_id")
    usage = extract.call_usage(text, functions, found)
    # A call on the object itself is one of the function's own class.
    owner = F.when(F.col("receiver").isin("self", "this", "$this"), F.col("fn_owner")).otherwise("")
    calls = found.join(inside, ["file", "point_id"]).join(functions.select("fn_id", F.col("owner").alias("fn_owner")), "fn_id").join(usage, ["file", "point_id"], "left")
    calls = calls.select(F.col("point_id").alias("call_id"), "fn_id", "receiver", owner.alias("owner"), "method", "line", F.coalesce("usage", F.lit("")).alias("usage"))
    generic = flows.call_edges(functions, calls)
    generic = generic.persist()
    edges = flows.union_call_graphs(generic.drop("call_id", "from_kind", "to_kind", "from_line"), java.call_edges(records)).persist()
    plain = extract.routes(text).select("http_method", F.col("route").alias("raw"), "handler", F.col("path").alias("file"), F.col("line_no").alias("line"), "language", "framework")
    served = plain.select("http_method", paths.normalise(F.col("raw")).alias("path"), "handler", "file", "line", "language", "framework")
    spring = java.endpoints(records).select("http_method", "path", F.concat_ws(".", "controller", "method").alias("handler"), "file", "line", F.lit("java").alias("language"), F.lit("spring").alias("framework"))
    routes = served.unionByName(spring)
    routes = routes.select(F.concat_ws(" ", "http_method", "path").alias("route_id"), "*", paths.service_candidate(F.col("path"), services).alias("service_candidate"), F.when(F.col("framework") == "react-router", "frontend").otherwise("backend").alias("kind")).persist()
    contracts = clients.contracts(text, services).persist()
    matches = match.contract_matches(contracts, routes.filter("kind = 'backend'")).join(contracts.select("contract_id", "file", "line", "caller", "auth"), "contract_id").persist()
    starts = _handlers(routes, functions, edges)
    test_map = flows.test_map(generic).select("test_file", "test_class", "test_method", "target_file", "target_class", "target_method", "line").unionByName(java.test_map(records))
    search = facts.search_facts(symbols, routes, contracts, test_map).persist()
    evidence = symbols.select("file", "line", F.lit("lines").alias("analyzer"), F.lit("pattern").alias("method"), F.concat_ws(" ", "kind", "name").alias("reason"))
    capability = (
        symbols.select("language", F.lit("symbols").alias("capability"))
        .unionByName(functions.select("language", F.lit("calls").alias("capability")))
        .unionByName(routes.select("language", F.lit("routes").alias("capability")))
        .unionByName(contracts.select(sources.language(F.col("file")).alias("language"), F.lit("api_clients").alias("capability")))
        .unionByName(test_map.select(sources.language(F.col("test_file")).alias("language"), F.lit("tests").alias("capability")))
    )
    # Aliases and packages of the project come from its configuration; without it, imports are files.
    spark = text.sparkSession
    none = spark.createDataFrame([], "prefix string, replacement string"), spark.createDataFrame([], "name string, entry string")
    declared, _, used = scripts.script_usages(text, *none)
    usages = used.select(F.col("usage_id").alias("id"), "symbol_id", F.lit("").alias("project"), "category", F.col("path").alias("file"), "line", "type", "name", "owner_id", "resolution", "reason")
    weighted = relations.select(F.col("from").alias("file"), F.lit(1).alias("weight")).unionByName(routes.select("file", F.lit(2).alias("weight")))
    return {
        "files": files,
        "symbols": symbols,
        "relations": relations,
        "functions": functions,
        "calls": calls,
        "routes": routes,
        "contracts": contracts,
        "contract_matches": matches,
        "call_edges": edges,
        "flows": flows.code_flows(starts, edges),
        "endpoint_flows": flows.endpoint_flows(starts, edges),
        "test_map": test_map,
        "components": java.components(records),
        "entities": java.entities(records),
        "repositories": java.repositories(records),
        "dtos": java.dtos(records),
        "endpoint_security": security.endpoint_security(records),
        "facts": search,
        "fact_edges": facts.fact_edges(search, edges, matches),
        "evidence": facts.evidence(evidence, files),
        "capabilities": aggregate.capability_inventory(capability, files.select("language"), params.CAPABILITIES),
        "most_connected": aggregate.most_connected(weighted),
        "modules": aggregate.module_counts(files),
        "script_symbols": declared,
        "usages": usages,
        "contract_summary": aggregate.contract_summary(matches),
    }


def _handlers(routes: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, key): the first handler of each route; Java handlers are owner.method of their file."""
    own = routes.filter("language <> 'java'").withColumn("app", paths.app_of(F.col("file"))).withColumn("package", paths.package_of(F.col("file")))
    found = flows.route_handlers(own, functions).join(functions, "fn_id").select("route_id", flows.method_key(F.col("file"), F.col("owner"), F.col("name")).alias("key"))
    spring = routes.filter("language = 'java'").select("route_id", flows.method_key(F.col("file"), F.regexp_extract("handler", r"^([^.]*)\.", 1), F.regexp_extract("handler", r"([^.]*)$", 1)).alias("key"))
    return found.unionByName(spring).groupBy("route_id").agg(F.min("key").alias("key"))


def diagnostics(t: dict[str, DataFrame], limit: int = params.TOP) -> dict[str, DataFrame]:
    """Entry points, risky contracts, unscanned services, untested endpoints and likely tests of a project, each bounded."""
    tested = t["test_map"].select(F.concat_ws(".", F.nullif("target_class", F.lit("")), "target_method").alias("k"))
    untested = t["routes"].filter("kind = 'backend'").join(tested.distinct(), F.col("handler") == F.col("k"), "left_anti")
    return {
        "entrypoints": t["routes"].orderBy("file", "line").limit(limit),
        "risky_contracts": t["contract_matches"].filter("issue <> 'matched'").orderBy("file", "line").limit(limit),
        "unscanned_services": t["contract_matches"].filter("issue = 'unscanned_service'").groupBy("service_candidate").count().orderBy(F.desc("count"), "service_candidate").limit(limit),
        "untested_endpoints": untested.orderBy("file", "line").limit(limit),
        "likely_tests": resolve.tests_by_name(t["files"]).orderBy("test").limit(limit),
    }


def explain(t: dict[str, DataFrame], target: str) -> DataFrame:
    """(section, label): a file's or symbol's symbols, relations out and in, and tests."""
    folder = target.rsplit("/", 1)[0] if "/" in target else ""
    rel = t["relations"]
    into = (F.col("to") == target) | ((F.col("type") == "imports") & F.lit(bool(folder)) & F.endswith(F.col("to"), F.lit(folder)))
    part = lambda df, section, label: df.select(F.lit(section).alias("section"), label.alias("label"))
    return (
        part(t["files"].filter(F.col("path") == target), "file", F.concat_ws(" ", "language", "kind"))
        .unionByName(part(t["symbols"].filter((F.col("file") == target) | (F.col("name") == target)), "symbol", F.concat_ws(" ", "kind", "name")))
        .unionByName(part(rel.filter(F.col("from") == target), "outbound", F.concat_ws(" ", "type", "to")))
        .unionByName(part(rel.filter(into), "inbound", F.concat_ws(" ", "type", "from")))
        .unionByName(part(t["test_map"].filter((F.col("target_file") == target) | (F.col("target_method") == target)), "test", F.col("test_method")))
        .distinct()
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a small answer with their place in order."""
    return df.withColumn("n", F.row_number().over(W.orderBy(*order)))
