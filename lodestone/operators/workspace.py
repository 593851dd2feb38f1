"""Several projects together: the graph of all that is known of them, and the map of their services.

Records of matches, flows, steps and dossiers become nodes and edges by unions; nodes and edges of one
id are merged, first filled value in a fixed order, so the result doesn't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import workspace_id
from . import aggregate

NODE = ("id", "kind", "label", "project", "file", "line", "symbol", "method", "path", "confidence", "risk")


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _filled(*columns: str | Column) -> Column:
    """The first value that is not empty."""
    return F.coalesce(*(F.nullif(_text(c), F.lit("")) for c in columns), F.lit(""))


def _joined(sep: str, *columns: str | Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.trim(_text(c)) for c in columns)), lambda x: x != ""), sep)


def _node(df: DataFrame, order: int, **values: Column) -> DataFrame:
    kinds = {"line": "int"}
    return df.select(F.lit(order).alias("_order"), *(values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODE))


def _edge(df: DataFrame, source: Column, target: Column, kind: str, confidence: Column) -> DataFrame:
    return df.select(source.alias("from_id"), target.alias("to_id"), F.lit(kind).alias("kind"), _text(confidence).alias("confidence"))


def workspace_graph(projects: DataFrame, matches: DataFrame, candidates: DataFrame, flows: DataFrame, frontend_steps: DataFrame, backend_steps: DataFrame, dossiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a workspace.

    projects: path, name, status; matches: match_id, api_project, api_http_method, api_path, api_file,
    api_line, api_caller, backend_project, backend_http_method, backend_path, backend_file, backend_line,
    backend_handler, issue, confidence; candidates: match_id, backend_project, candidate, issue; flows: flow_id,
    http_method, path, frontend_project, frontend_file, frontend_line, frontend_caller, frontend_confidence,
    backend_project, backend_controller, backend_method, backend_file, backend_line, confidence, risk; steps:
    flow_id, project, kind, owner, name, file, line, confidence; dossiers: id, route, frontend_project,
    backend_project, backend_handler, frontend_caller, flow_id, confidence, risk.
    """
    c = F.col
    pid = lambda p: workspace_id(F.lit("project"), _text(p))
    route_method, route_path = _filled("backend_http_method", "api_http_method"), _filled("backend_path", "api_path")
    contract = _filled("match_id", workspace_id(F.lit("contract"), *(_text(x) for x in ("api_project", "api_http_method", "api_path", "api_file"))))
    route = workspace_id(F.lit("route"), _text("backend_project"), route_method, route_path)
    served = matches.filter(_text("backend_project") != "")
    candidate = workspace_id(F.lit("candidate-route"), _text("backend_project"), _text("candidate"))
    handler = _joined(".", "backend_controller", "backend_method")
    begun, ended = flows.filter(_text("frontend_file") != ""), flows.filter(_text("backend_file") != "")
    file_id = workspace_id(F.lit("file"), _text("frontend_project"), _text("frontend_file"))
    handler_id = workspace_id(F.lit("symbol"), _text("backend_project"), _text("backend_file"), handler)
    step_name = _joined(".", "owner", "name")
    step_id = workspace_id(F.lit("symbol"), _text("project"), _text("file"), step_name, _text("kind"))
    step = lambda df, order, kind: _node(df, order, id=step_id, kind=_filled("kind", F.lit(kind)), label=_filled(step_name, "file"), project=c("project"), file=c("file"), line=c("line"), symbol=step_name, confidence=c("confidence"))
    nodes = (
        _node(projects, 0, id=pid("path"), kind=F.lit("project"), label=_filled("name", "path"), project=c("path"), risk=c("status"))
        .unionByName(_node(matches, 1, id=contract, kind=F.lit("contract"), label=_joined(" ", "api_http_method", "api_path"), project=c("api_project"), file=c("api_file"), line=c("api_line"), symbol=c("api_caller"), method=c("api_http_method"), path=c("api_path"), confidence=c("confidence"), risk=c("issue")))
        .unionByName(_node(served, 2, id=route, kind=F.lit("route"), label=_joined(" ", route_method, route_path), project=c("backend_project"), file=c("backend_file"), line=c("backend_line"), symbol=c("backend_handler"), method=route_method, path=route_path, confidence=c("confidence")))
        .unionByName(_node(candidates, 3, id=candidate, kind=F.lit("candidate_route"), label=c("candidate"), project=c("backend_project"), risk=c("issue")))
        .unionByName(_node(flows, 4, id=c("flow_id"), kind=F.lit("flow"), label=_joined(" ", "http_method", "path"), project=_filled("frontend_project", "backend_project"), file=c("frontend_file"), line=c("frontend_line"), symbol=_filled("frontend_caller", F.concat_ws(".", _text("backend_controller"), _text("backend_method"))), method=c("http_method"), path=c("path"), confidence=c("confidence"), risk=c("risk")))
        .unionByName(_node(begun, 5, id=file_id, kind=F.lit("file"), label=c("frontend_file"), project=c("frontend_project"), file=c("frontend_file")))
        .unionByName(_node(ended, 6, id=handler_id, kind=F.lit("backend_handler"), label=_filled(handler, "backend_file"), project=c("backend_project"), file=c("backend_file"), line=c("backend_line"), symbol=handler))
        .unionByName(step(frontend_steps, 7, "frontend_step"))
        .unionByName(step(backend_steps, 8, "backend_step"))
        .unionByName(_node(dossiers, 9, id=c("id"), kind=F.lit("feature"), label=_filled("route", "id"), project=_filled("frontend_project", "backend_project"), symbol=_filled("backend_handler", "frontend_caller"), confidence=c("confidence"), risk=c("risk")))
    )
    # The order is made total by the values themselves.
    nodes = nodes.withColumn("_order", F.struct("_order", *(x for x in NODE if x != "id")))
    nodes = aggregate.merge_nodes(nodes, "id", "_order", *(x for x in NODE if x != "id"))
    none = F.lit("")
    edges = (
        _edge(matches.filter(_text("api_project") != ""), pid("api_project"), contract, "declares_contract", c("confidence"))
        .unionByName(_edge(served, pid("backend_project"), route, "owns_route", c("confidence")))
        .unionByName(_edge(served, contract, route, "resolved_by", c("confidence")))
        .unionByName(_edge(candidates, _text("match_id"), candidate, "has_candidate", F.lit("PARTIAL_MATCH")))
        .unionByName(_edge(flows.filter(_text("frontend_project") != ""), pid("frontend_project"), c("flow_id"), "has_flow", c("confidence")))
        .unionByName(_edge(flows.filter(_text("backend_project") != ""), c("flow_id"), pid("backend_project"), "reaches_project", c("confidence")))
        .unionByName(_edge(begun, c("flow_id"), file_id, "starts_in", c("frontend_confidence")))
        .unionByName(_edge(ended, c("flow_id"), handler_id, "handled_by", c("confidence")))
        .unionByName(_edge(frontend_steps, c("flow_id"), step_id, "has_frontend_step", c("confidence")))
        .unionByName(_edge(backend_steps, c("flow_id"), step_id, "has_backend_step", c("confidence")))
        .unionByName(_edge(dossiers.filter(_text("flow_id") != ""), c("id"), c("flow_id"), "summarizes_flow", c("confidence")))
    )
    edges = edges.groupBy("from_id", "to_id", "kind").agg(F.min(F.nullif("confidence", none)).alias("confidence"))
    return nodes, edges.select(workspace_id(F.lit("edge"), c("from_id"), c("to_id"), c("kind")).alias("id"), "*")


def service_calls(matches: DataFrame, flows: DataFrame, services: DataFrame) -> DataFrame:
    """(from_service, to_service, status, endpoint): a workspace's calls between projects, for aggregate.service_edges.

    matches: api_project, api_http_method, api_path, backend_project, service_candidate, confidence; flows:
    frontend_project, backend_project, http_method, path, confidence; services: service, project.  A match
    without a backend goes to its service's project, or to the service's own name; flows count where
    no match has their route; calls inside a project are dropped.
    """
    known = services.groupBy(F.lower("service").alias("_s")).agg(F.min("project").alias("_p"))
    m = matches.withColumn("_s", F.lower(_text("service_candidate"))).join(known, "_s", "left")
    to = _filled("backend_project", "_p", "service_candidate")
    level = lambda c: F.when(c.isin("RESOLVED", "MATCHED", "EXACT", "EXTRACTED"), "RESOLVED").when(c == "OUT_OF_SCOPE", "OUT_OF_SCOPE").when(c == "MISMATCH", "MISMATCH").otherwise("UNRESOLVED")
    part = lambda df, source, target, verb, path: df.select(_text(source).alias("from_service"), target.alias("to_service"), level(F.upper(_text("confidence"))).alias("status"), _joined(" ", verb, path).alias("endpoint"))
    first = part(m, "api_project", to, "api_http_method", "api_path")
    more = part(flows, "frontend_project", _text("backend_project"), "http_method", "path")
    more = more.join(first.select("from_service", "to_service", "endpoint").distinct(), ["from_service", "to_service", "endpoint"], "left_anti")
    return first.unionByName(more).filter("from_service <> '' and to_service <> '' and from_service <> to_service")


# How much each sign of a workspace's root counts, and the folders that group projects.
ROOT_CONFIG, ROOT_REGISTRY, ROOT_FOLDER, ROOT_BOTH = 1000, 10, 5, 100


def workspace_root(folders: DataFrame, config: str, output: str, frontends: tuple[str, ...], backends: tuple[str, ...]) -> DataFrame:
    """(dir, score) of a folder's ancestors that may be the workspace's root, the best first, then the deepest.

    folders: dir, name: the entries of each ancestor.  A configuration file counts most, then groups of
    frontends and backends side by side, then an earlier output and its registry.
    """
    has = lambda *names: F.count_distinct(F.when(F.col("name").isin(*names), F.col("name")))
    found = folders.groupBy("dir").agg(has(config).alias("c"), has(f"{output}/registry.json").alias("r"), has(output).alias("o"), has(*frontends).alias("f"), has(*backends).alias("b"))
    groups = F.col("f") + F.col("b") + F.when((F.col("f") > 0) & (F.col("b") > 0), ROOT_BOTH).otherwise(0)
    score = F.col("c") * ROOT_CONFIG + F.col("r") * ROOT_REGISTRY + F.col("o") * ROOT_FOLDER + groups
    return found.select("dir", score.cast("int").alias("score")).filter("score > 0").orderBy(F.desc("score"), F.desc(F.length("dir")))
