"""Calls, endpoint and code flows, feature flows, traces, dossiers, impact, service map.

Records are flat tables; nesting happens only where an answer is rendered.  The two walkers whose
answer depends on visiting order run per route over the few edges that a level-bounded semi join
leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import stable_id, workspace_id
from . import graph, resolve, sequence


def method_key(file: Column, owner: Column, name: Column) -> Column:
    return F.concat_ws("#", file, F.coalesce(owner, F.lit("")), name)


def _same_place(a: Column, b: Column) -> Column:
    """Equal files, apps (outside apps/ all share one) or packages."""
    package = (paths.package_of(a) != "") & (paths.package_of(a) == paths.package_of(b))
    return (a == b) | (paths.app_of(a) == paths.app_of(b)) | package


def call_edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls resolved to functions; edges between unrelated places are dropped.

    functions: fn_id (its order), language, file, owner, name, kind, line
    calls: call_id, fn_id, receiver, owner, method, line, usage
    Tiers: owner.method, receiver.method, then by name: same file, app, package, language, any.
    A repeated owner.method takes the last function, a name the first.
    """
    caller = functions.select("fn_id", *(F.col(c).alias(f"from_{c}") for c in ("language", "file", "owner", "name", "kind", "line")))
    uses = calls.select("call_id", "fn_id", F.regexp_replace(F.coalesce("receiver", F.lit("")), r"^\$", "").alias("receiver"), F.coalesce("owner", F.lit("")).alias("call_owner"), F.col("method").alias("key"), F.col("line").alias("call_line"), "usage").join(graph.sized(caller), "fn_id").drop("fn_id")
    target = functions.select(F.col("name").alias("key"), F.col("fn_id").alias("to_id"), *(F.col(c).alias(f"to_{c}") for c in ("language", "file", "owner", "name", "kind", "line")))
    own = lambda c: F.coalesce(c, F.lit(""))
    other = F.col("key") != F.col("from_name")
    language = (F.col("from_language"), F.col("to_language"))
    both = lambda of: (of(F.col("from_file")), of(F.col("to_file")))
    tiers = [
        resolve.Tier("owner", ((F.col("call_owner"), F.col("to_owner")),), F.col("call_owner") != "", own(F.col("to_owner")) != "", last=True),
        resolve.Tier("receiver", ((F.col("receiver"), F.col("to_owner")),), F.col("receiver") != "", own(F.col("to_owner")) != "", last=True),
        resolve.Tier("file", (language, both(lambda f: f)), other),
        resolve.Tier("app", (language, both(paths.app_of)), other),
        resolve.Tier("package", (language, both(paths.package_of)), other & (paths.package_of(F.col("from_file")) != "")),
        resolve.Tier("language", (language,), other),
        resolve.Tier("any", (), other),
        # A call to the caller's own name.
        resolve.Tier("any", apart=both(lambda f: f)),
    ]
    found = resolve.by_priority(uses, target, "key", "call_id", "to_id", tiers, "to_id")
    joined = uses.join(graph.sized(found), "call_id").join(graph.sized(target.drop("key")), "to_id")
    kept = joined.filter(_same_place(F.col("from_file"), F.col("to_file")))
    reason = F.concat_ws(" ", "from_language", F.when(F.col("usage") == "effect", "effect call match").when(F.col("usage") == "event_handler", "event handler call match").otherwise("static call match"))
    return kept.select(
        stable_id(F.lit("call"), F.col("from_file"), F.col("from_name"), F.col("to_file"), F.col("to_name"), F.col("call_line")).alias("id"),
        "call_id", "from_file", "from_owner", "from_name", "from_kind", "from_line", "to_file", "to_owner", "to_name", "to_kind", "to_line", "call_line",
        F.lit("EXTRACTED").alias("confidence"), F.lit(0.9).alias("confidence_score"), reason.alias("reason"),
    )


def union_call_graphs(*graphs: DataFrame) -> DataFrame:
    """First wins for each (from file, method, to file, method, line)."""
    out = None
    for k, g in enumerate(graphs):
        g = g.withColumn("_source", F.lit(k))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return sequence.first_per_key(out, ["from_file", "from_name", "to_file", "to_name", "call_line"], [F.col("_source"), F.col("id")]).drop("_source")


def file_relations(edges: DataFrame) -> DataFrame:
    """Distinct cross-file pairs of a call graph, each with its first line."""
    return edges.filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.min("call_line").alias("line"))


def test_map(edges: DataFrame) -> DataFrame:
    """Calls of tests to production functions."""
    rows = edges.filter("from_kind = 'test' and to_kind <> 'test'")
    return rows.select(F.col("from_file").alias("test_file"), F.col("from_owner").alias("test_class"), F.col("from_name").alias("test_method"), F.col("to_file").alias("target_file"), F.col("to_owner").alias("target_class"), F.col("to_name").alias("target_method"), F.col("call_line").alias("line"), F.lit("MATCHED").alias("confidence"), F.lit(0.9).alias("confidence_score"))


def test_case(name: Column) -> tuple[Column, Column]:
    """(case, expected status) of a test name; the first rule that fits."""
    low = F.lower(name)
    # Words, case, status.
    rules = (
        (("unauthorized", "noauth", "no_auth"), "auth_error", "401"),
        (("forbidden",), "permission_error", "403"),
        (("badrequest", "bad_request"), "validation_error", "400"),
        (("notfound", "not_found"), "not_found", "404"),
        (("error", "exception"), "error", ""),
        (("okay", "success", "isok"), "success", "2xx"),
    )
    case, status = F.lit("unspecified"), F.lit("")
    for words, c, s in reversed(rules):
        hit = low.rlike("|".join(words))
        case, status = F.when(hit, c).otherwise(case), F.when(hit, s).otherwise(status)
    return case, status


def endpoint_tests(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Test requests (test_id, http_method, path) to endpoints (endpoint_id, http_method, path).

    A placeholder of the endpoint matches any one segment; the smallest endpoint wins.  Endpoints have
    few masks (where their placeholders stand); a request is looked up once for each mask of its method
    and length, by its segments at the other places.
    """
    r = requests.select("test_id", F.upper("http_method").alias("m"), paths.segments(F.col("path")).alias("a"))
    e = endpoints.select("endpoint_id", F.upper("http_method").alias("m"), paths.segments(F.col("path")).alias("b"))
    e = e.select("endpoint_id", "m", F.transform("b", paths.is_placeholder).alias("mask"), "b")
    key = lambda parts: F.zip_with(parts, "mask", lambda x, any_: F.when(any_, F.lit("")).otherwise(x))
    e = e.groupBy("m", "mask", key("b").alias("key")).agg(F.min("endpoint_id").alias("endpoint_id"))
    masks = e.select("m", "mask").distinct().withColumn("n", F.size("mask"))
    asked = r.withColumn("n", F.size("a")).join(masks, ["m", "n"]).withColumn("key", key("a"))
    return asked.join(e, ["m", "mask", "key"]).groupBy("test_id").agg(F.min("endpoint_id").alias("endpoint_id"))


def _near_edges(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(route_id, start, edges within depth of the route's start): one semi-naive level at a time."""
    e = edges.withColumn("from_key", method_key(F.col("from_file"), F.col("from_owner"), F.col("from_name"))).withColumn("to_key", method_key(F.col("to_file"), F.col("to_owner"), F.col("to_name")))
    # Every level reads the edges, so they are made once.
    e = graph.sized(graph.written(e))
    starts = graph.written(starts.select("route_id", "key"))
    frontier, nodes = starts, starts
    for _ in range(depth - 1):
        step = frontier.join(e.select(F.col("from_key").alias("key"), "to_key"), "key").select("route_id", F.col("to_key").alias("key")).distinct()
        frontier = graph.written(step.join(graph.sized(nodes), ["route_id", "key"], "left_anti"))
        nodes = nodes.unionByName(frontier)
    near = nodes.distinct().join(e.withColumnRenamed("from_key", "key"), "key").withColumnRenamed("key", "from_key")
    return near.join(graph.sized(starts.select("route_id", F.col("key").alias("start"))), "route_id")


STEPS = "route_id string, pos int, name string, owner string, file string, line int, caller string, confidence string, reason string"


def _steps(kind: str, start: str, rows: list[tuple]) -> Iterator[tuple]:
    """Edges in the order of a walk from start: dfs to depth 4 with visits shared by all branches, or the first four of a queue.

    rows: the edges of one route in order, each beginning with from_key and to_key.
    """
    by: dict[str, list] = {}
    for row in rows:
        if row[0] is not None:
            by.setdefault(row[0], []).append(row)
    visited = set()
    if kind == "dfs":

        def walk(key: str, depth: int) -> Iterator[tuple]:
            if depth >= 4 or key in visited:
                return
            visited.add(key)
            for row in by.get(key, ()):
                yield row  # before its target is tested for a visit
                yield from walk(row[1], depth + 1)

        yield from walk(start, 0)
        return
    visited.add(start)
    queue = [start]
    for _ in range(4):
        if not queue:
            break
        for row in by.get(queue.pop(0), ()):
            if row[1] not in visited:
                visited.add(row[1])
                yield row
                queue.append(row[1])


def _walked(near: DataFrame, kind: str) -> DataFrame:
    """The steps of every route; routes are read one after the other from sorted partitions."""
    order = [F.col(c).asc_nulls_last() for c in ("from_file", "from_name", "call_line", "to_file", "to_name", "id")]
    rows = near.repartition("route_id").sortWithinPartitions("route_id", "start", *order)
    rows = rows.select("route_id", "start", "from_key", "to_key", "from_owner", "from_name", "to_name", "to_owner", "to_file", F.col("to_line").cast("int"), "confidence", "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in STEPS.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in STEPS.split(", ")]
        held: list[tuple] = []

        def steps() -> list[tuple]:
            if not held:
                return []
            route, start = held[0][:2]
            walk = _steps(kind, start, [row[2:] for row in held])
            held.clear()
            return [(route, k, name, owner, file, line, ".".join(x for x in own if x), confidence, reason) for k, (_, _, *own, name, owner, file, line, confidence, reason) in enumerate(walk, 1)]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * len(names), kinds)], names)

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    found += steps()
                held.append(row)
            yield out(found)
        yield out(steps())

    return rows.mapInArrow(run, STEPS)


def code_flows(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, pos, step): depth-first walk of each route's handler; starts: route_id, key."""
    return _walked(_near_edges(edges, starts, 4), "dfs")


def endpoint_flows(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """As code_flows, by the queue that expands at most four nodes."""
    return _walked(_near_edges(edges, starts, 4), "fifo")


def route_handlers(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """(route_id, fn_id): exact owner.name, then file, app, package, language, any."""
    handler = F.trim("handler")
    uses = routes.select("route_id", "language", "file", "app", "package", handler.alias("handler"), F.regexp_extract(handler, r"([^.]*)$", 1).alias("key")).filter("handler <> ''")
    target = functions.select(F.col("name").alias("key"), "fn_id", F.col("language").alias("fl"), F.col("file").alias("ff"), F.col("owner").alias("fo"))
    same = (F.col("language"), F.col("fl"))
    tiers = [
        resolve.Tier("owner", ((F.col("handler"), F.concat_ws(".", "fo", "key")),), candidate=F.coalesce("fo", F.lit("")) != ""),
        resolve.Tier("file", (same, (F.col("file"), F.col("ff")))),
        resolve.Tier("app", (same, (F.col("app"), paths.app_of(F.col("ff")))), F.col("app") != ""),
        resolve.Tier("package", (same, (F.col("package"), paths.package_of(F.col("ff")))), F.col("package") != ""),
        resolve.Tier("language", (same,)),
        resolve.Tier("any"),
    ]
    return resolve.by_priority(uses, target, "key", "route_id", "fn_id", tiers, "fn_id").select("route_id", "fn_id")


def frontend_usage(contracts: DataFrame, steps: DataFrame) -> DataFrame:
    """(contract_id, route_id, confidence, score): the best frontend flow of the contract's app, first on ties.

    contracts: contract_id, app, file, caller; steps: route_id, route_order, app, pos, kind, name, file, reason.
    """
    c = contracts.select("contract_id", "app", F.col("file").alias("api_file"), F.coalesce("caller", F.lit("")).alias("api_caller"))
    reached = (F.col("file") == F.col("api_file")) & (F.col("api_file") != "")
    called = reached & (F.col("api_caller") != "") & ((F.col("name") == F.col("api_caller")) | F.endswith(F.col("name"), F.concat(F.lit("."), F.col("api_caller"))))
    by_kind = F.when(F.col("kind") == "event_handler", 0.95).when(F.col("kind") == "effect_call", 0.92).otherwise(0.90)
    score = F.when(called, by_kind).when(reached, 0.82).otherwise(0.35)
    # Steps that reach the file join on it; every other flow of the app only scores 0.35, so its first
    # flow is enough.
    near = c.join(steps.drop("app"), c["api_file"] == steps["file"]).join(steps.select(F.col("route_id").alias("r2"), F.col("app").alias("flow_app")).distinct(), F.col("route_id") == F.col("r2"))
    near = near.filter((F.col("app") == F.col("flow_app")) | (F.col("app") == "") | (F.col("flow_app") == "")).select("contract_id", score.alias("score"), "route_order", "route_id")
    first = steps.groupBy("app").agg(F.min(F.struct("route_order", "route_id")).alias("f"))
    weak = c.join(first, "app").select("contract_id", F.lit(0.35).alias("score"), "f.route_order", "f.route_id")
    best = near.unionByName(weak).groupBy("contract_id").agg(F.max(F.struct("score", (-F.col("route_order")).alias("o"), "route_id")).alias("m"))
    level = F.when(F.col("m.score") > 0.35, "RESOLVED").otherwise("WEAK_MATCH")
    return best.select("contract_id", F.col("m.route_id").alias("route_id"), level.alias("confidence"), F.col("m.score").alias("score"))


def persistence_path(steps: DataFrame, repositories: DataFrame, entities: DataFrame) -> DataFrame:
    """(flow_id, pos, repository, method, entity, table): steps owned by a repository, each method once."""
    r = repositories.select(F.col("name").alias("repository"), "entity")
    e = entities.select(F.col("name").alias("entity"), "table")
    rows = steps.join(r, steps["owner"] == r["repository"]).join(e, "entity", "left")
    rows = rows.groupBy("flow_id", "repository", "method").agg(F.min("pos").alias("pos"), F.min("entity").alias("entity"), F.min("table").alias("table"))
    return rows.select("flow_id", F.row_number().over(W.partitionBy("flow_id").orderBy("pos", "repository", "method")).alias("pos"), "repository", "method", "entity", F.coalesce("table", F.lit("")).alias("table"))


def feature_flows(matches: DataFrame, endpoint_steps: DataFrame, tests: DataFrame) -> DataFrame:
    """One row for each matched contract: its flow id, number of backend steps and of tests.

    matches: api_project, api_file, api_line, api_http_method, api_path, backend_project, backend_http_method,
    backend_path, issue, confidence; endpoint_steps and tests carry backend_project, http_method, path.
    """
    m = matches.filter("issue = 'matched'")
    key = paths.canon(paths.segments(F.col("path")))
    steps = endpoint_steps.groupBy(F.col("backend_project").alias("p"), F.upper("http_method").alias("hm"), key.alias("k")).agg(F.count("*").alias("steps"))
    tested = tests.groupBy(F.col("backend_project").alias("p"), F.upper("http_method").alias("hm"), key.alias("k")).agg(F.count("*").alias("tests"))
    own = m.withColumn("p", F.col("backend_project")).withColumn("hm", F.upper("backend_http_method")).withColumn("k", paths.canon(paths.segments(F.col("backend_path"))))
    out = own.join(steps, ["p", "hm", "k"], "left").join(tested, ["p", "hm", "k"], "left").fillna({"steps": 0, "tests": 0})
    flow_id = stable_id(F.lit("workspace-flow"), F.col("api_project"), F.col("api_file"), F.col("api_line"), F.col("api_http_method"), F.col("api_path"), F.col("backend_project"))
    return out.select(flow_id.alias("flow_id"), "api_project", "api_file", "api_line", "api_http_method", "api_path", "backend_project", "steps", "tests", "confidence")


def field_risks(frontend_fields: DataFrame, backend_fields: DataFrame, key: str = "flow_id") -> DataFrame:
    """Frontend fields that a flow's backend type lacks, only where both sides have fields."""
    f, b = frontend_fields.select(key, "field").distinct(), backend_fields.select(key, "field").distinct()
    return f.join(b.select(key), key, "left_semi").join(b, [key, "field"], "left_anti")


def dossiers(flows: DataFrame, risks: DataFrame, matches: DataFrame) -> DataFrame:
    """Flows as dossiers, with their risks counted, and one dossier for each open contract.

    flows: flow_id, http_method, path, frontend_project, frontend_file, backend_project, backend_file, tests, confidence
    matches: match_id, api_project, api_http_method, api_path, issue, confidence
    """
    n = risks.groupBy("flow_id").agg(F.count("*").alias("field_risks"))
    own = flows.join(n, "flow_id", "left").fillna({"field_risks": 0})
    risk = F.when(F.col("field_risks") > 0, "risk").when(F.col("tests") == 0, "missing_tests").otherwise("low")
    closed = own.select(
        stable_id(F.lit("feature-dossier"), F.col("flow_id"), F.col("http_method"), F.col("path")).alias("id"), F.concat_ws(" ", "http_method", "path").alias("route"),
        "flow_id", "frontend_project", "frontend_file", "backend_project", "backend_file", risk.alias("risk"), "confidence",
    )
    left = matches.filter("issue <> 'matched' and confidence <> 'RESOLVED'")
    blank = F.lit("")
    opened = left.select(
        stable_id(F.lit("feature-dossier-open-contract"), F.col("match_id")).alias("id"), F.concat_ws(" ", "api_http_method", "api_path").alias("route"), blank.alias("flow_id"),
        F.col("api_project").alias("frontend_project"), blank.alias("frontend_file"), blank.alias("backend_project"), blank.alias("backend_file"), F.lit("risk").alias("risk"), "confidence",
    )
    return closed.unionByName(opened)


def change_impact(dossier_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Dossiers hit by a changed path: a side's project/file, or a whole project."""
    clean = lambda c: F.trim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/"))
    both = lambda p, f: F.concat_ws("/", p, f)
    keys = F.array(both("frontend_project", "frontend_file"), both("backend_project", "backend_file"), F.col("frontend_project"), F.col("backend_project"))
    rows = dossier_rows.withColumn("_key", F.explode(F.transform(keys, clean))).filter("_key <> ''")
    hit = rows.join(changed.select(clean(F.col("path")).alias("_key")).distinct(), "_key", "left_semi")
    return hit.drop("_key").dropDuplicates(["id"])


def trace_steps(matches: DataFrame, frontend_steps: DataFrame, backend_steps: DataFrame, tests: DataFrame) -> DataFrame:
    """Steps of each match's trace in order: frontend, contract, route, handler, backend, tests.

    matches: trace_id, api_project, api_http_method, api_path, api_file, api_line, api_caller, backend_project,
    backend_http_method, backend_path, backend_file, backend_line, backend_handler, confidence; steps: trace_id, pos, name, file, line.
    A step of an id seen earlier in its trace is dropped.
    """
    filled = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    route = F.concat_ws(" ", "api_http_method", "api_path")
    backend = F.concat_ws(" ", filled(F.col("backend_http_method"), F.col("api_http_method")), filled(F.col("backend_path"), F.col("api_path")))

    def part(df: DataFrame, stage: int, kind: str, label: Column, *ident: Column, file: Column, line: Column, pos: Column = F.lit(0)) -> DataFrame:
        return df.select("trace_id", F.lit(stage).alias("stage"), pos.alias("pos"), workspace_id(F.lit("trace-step"), F.col("trace_id"), *ident).alias("step_id"), F.lit(kind).alias("kind"), label.alias("label"), file.alias("file"), line.alias("line"))

    ours = {"file": F.col("file"), "line": F.col("line"), "pos": F.col("pos")}
    hit = matches.filter("coalesce(backend_project, '') <> '' or coalesce(backend_path, '') <> ''")
    rows = (
        part(frontend_steps, 0, "frontend_step", filled(F.col("name"), F.col("file")), F.lit("frontend"), F.col("file"), F.col("name"), F.col("line"), **ours)
        .unionByName(part(matches, 1, "api_contract", filled(F.col("api_caller"), route), F.lit("api-contract"), F.col("api_file"), F.col("api_caller"), file=F.col("api_file"), line=F.col("api_line")))
        .unionByName(part(hit, 2, "backend_route", backend, F.lit("backend-route"), F.col("backend_project"), backend, file=F.col("backend_file"), line=F.col("backend_line")))
        .unionByName(part(matches.filter("coalesce(backend_handler, '') <> ''"), 3, "backend_handler", F.col("backend_handler"), F.lit("backend-handler"), F.col("backend_project"), F.col("backend_file"), F.col("backend_handler"), file=F.col("backend_file"), line=F.col("backend_line")))
        .unionByName(part(backend_steps, 4, "backend_step", filled(F.col("name"), F.col("file")), F.lit("backend"), F.col("file"), F.col("name"), F.lit("step"), **ours))
        .unionByName(part(tests, 5, "test", filled(F.col("name"), F.col("file")), F.lit("test"), F.col("file"), F.col("name"), **ours))
        .filter("label <> ''")
    )
    # Every window below lies within a trace: rows are moved once.
    once = sequence.first_per_key(rows.repartition("trace_id"), ["trace_id", "step_id"], [F.col("stage"), F.col("pos"), F.col("label")])
    order = W.partitionBy("trace_id").orderBy("stage", "pos", "label", "step_id")
    return once.withColumn("n", F.row_number().over(order)).drop("stage", "pos")


def trace_role(kind: Column, label: Column) -> Column:
    text = F.lower(F.concat_ws(" ", kind, label))
    return (
        F.when(kind == "api_contract", "api_client")
        .when(kind == "backend_route", "http_route")
        .when(kind == "backend_handler", "controller")
        .when(kind == "test", "test")
        .when(text.rlike("repository|dao"), "repository")
        .when(text.rlike("validation|validate"), "validation")
        .when(text.contains("component"), "component")
        .when(kind == "frontend_step", "event_handler")
        .otherwise("function")
    )


def directed_traces(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with role, is_entry and is_exit, edges between consecutive steps)."""
    edges = sequence.step_edges(steps, "trace_id", ["n"], "step_id", "kind")
    # A node is left or entered if any of its steps is; both windows lie within a trace, so it is moved once.
    along, node = W.partitionBy("trace_id").orderBy("n"), W.partitionBy("trace_id", "step_id")
    nodes = steps.withColumns({"_in": F.lag(F.lit(True)).over(along), "_out": F.lead(F.lit(True)).over(along)})
    nodes = nodes.withColumns({c: F.max(c).over(node) for c in ("_in", "_out")})
    nodes = nodes.select("trace_id", "n", "step_id", trace_role(F.col("kind"), F.col("label")).alias("role"), "label", "file", "line", F.col("_in").isNull().alias("is_entry"), F.col("_out").isNull().alias("is_exit"))
    return nodes, edges


def data_flow(stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, gaps) of flows whose stages (flow_id, stage, pos, label) are request, request_field, persistence, response_field.

    Stages are chained in order; a step into persistence has no field mapping and leaves a gap, and a
    flow without request fields leaves one.
    """
    rank = F.when(F.col("stage") == "request", 0).when(F.col("stage") == "request_field", 1).when(F.col("stage") == "persistence", 2).otherwise(3)
    w = W.partitionBy("flow_id").orderBy("_r", "pos", "label")
    rows = graph.finely(stages.select("flow_id", rank.cast("byte").alias("_r"), "pos", "label"), "flow_id").withColumn("_before", F.lag("label").over(w))
    relation = F.when(F.col("_r") == 1, "binds").when(F.col("_r") == 2, "persists").otherwise("returns")
    edges = rows.filter("_before is not null").select("flow_id", F.col("_before").alias("from_label"), F.col("label").alias("to_label"), relation.alias("relation"))
    # The last row of a flow has seen all of it, so both kinds of gaps come from one sorted stream.
    seen = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = rows.withColumns({"_next": F.lead(F.lit(True)).over(w), "_fields": F.count_if(F.col("_r") == 1).over(seen), "_request": F.min(F.when(F.col("_r") == 0, F.col("label"))).over(seen)})
    gap = lambda stage, a, b: F.struct(F.lit(stage).alias("stage"), a.alias("from_label"), b.alias("to_label"))
    crossing = F.when((F.col("_r") == 2) & F.col("_before").isNotNull(), gap("transformation", F.col("_before"), F.col("label")))
    bare = F.when(F.col("_next").isNull() & (F.col("_fields") == 0), gap("request", F.col("_request"), F.lit("")))
    return edges, ends.select("flow_id", F.explode(F.array_compact(F.array(crossing, bare))).alias("gap")).select("flow_id", "gap.*")


def impact_summary(nodes: DataFrame, edges: DataFrame, depth: int, uncertain: bool = False) -> DataFrame:
    """(flow_id, target, direct, indirect, tests, api, risk): consumers of each flow's endpoint, against the edges.

    nodes: flow_id, id, kind, pos; edges: flow_id, from_id, to_id.  Every edge into an expanded node is
    a consumer, seen before or not.
    """
    target = nodes.groupBy("flow_id").agg(F.coalesce(F.min_by("id", F.when(F.col("kind") == "endpoint", F.col("pos"))), F.max_by("id", "pos")).alias("id"))
    counts = nodes.groupBy("flow_id").agg(F.count_if(F.col("kind") == "test").alias("tests"), F.count_if(F.col("kind").isin("endpoint", "api_call")).alias("api"))
    known = edges.join(nodes.select("flow_id", F.col("id").alias("from_id")), ["flow_id", "from_id"], "left_semi")
    seen = frontier = target.select("flow_id", "id")
    hits = None
    for level in range(1, max(depth, 1) + 1):
        step = graph.settle(frontier.join(known, (known["to_id"] == frontier["id"]) & (known["flow_id"] == frontier["flow_id"])).select(frontier["flow_id"], F.col("from_id").alias("id"), F.lit(level).alias("depth")))
        hits = step if hits is None else hits.unionByName(step)
        frontier = step.select("flow_id", "id").distinct().join(seen, ["flow_id", "id"], "left_anti")
        seen = seen.unionByName(frontier)
    found = hits.groupBy("flow_id").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))
    out = target.withColumnRenamed("id", "target").join(counts, "flow_id").join(found, "flow_id", "left").fillna({"direct": 0, "indirect": 0})
    return out.withColumn("risk", graph.impact_risk(F.col("direct"), F.col("indirect"), F.col("api") > 0, F.lit(uncertain)))


def test_links(flows: DataFrame, tests: DataFrame) -> DataFrame:
    """(flow_id, test, link): how firmly each test belongs to its flow; not_detected where there is none."""
    c = F.upper("confidence")
    link = F.when(c.contains("WEAK"), "candidate").when(c == "INFERRED", "inferred").when(c.isin("EXACT", "EXTRACTED", "MATCHED", "RESOLVED"), "direct").otherwise("indirect")
    return flows.select("flow_id").join(tests, "flow_id", "left").select("flow_id", F.coalesce("test", F.lit("")).alias("test"), F.when(F.col("test").isNull(), "not_detected").otherwise(link).alias("link"))
