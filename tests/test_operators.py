"""Operators on small records."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, paths
from lodestone.functions.text import tokens
from lodestone.operators import aggregate, diff, extract, graph, integrity, match, resolve, sequence
from lodestone.plans.tasks import Catalogue
from lodestone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CONTRACTS = "contract_id string, http_method string, path string, service_candidate string, unsafe_dynamic boolean, internal boolean"
ROUTES = "route_id string, http_method string, path string, service_candidate string"


def test_contract_cascade(spark):
    contracts = [
        ("exact", "GET", "/users/{id}", "ms-user", False, False),
        ("method", "POST", "/users/{id}", "ms-user", False, False),
        ("gateway", "GET", "/api/users/{id}", "ms-api", False, False),
        ("unsafe-empty", "GET", "", "", True, False),
        ("unsafe", "GET", "/x/{dynamic}/y", "ms-x", True, False),
        ("unscanned", "GET", "/orders/1", "ms-order", False, False),
        ("gap", "GET", "/users/{id}/more", "ms-user", False, False),
        ("slot", "GET", "/users/a/{endpoint}", "ms-user", False, False),
        ("internal", "GET", "/users/{id}", "ms-user", False, True),
        ("typed", "GET", "/tree/new", "ms-tree", False, False),
        ("base", "GET", "/userservice/users/{x}", "ms-userservice", False, False),
    ]
    routes = [("1", "GET", "/users/{userId}", "ms-user"), ("2", "GET", "/", ""), ("3", "GET", "/tree/{type}", "ms-tree"), ("0", "PUT", "/USERS/{u}", "ms-user")]
    got = {r["contract_id"]: (r["issue"], r["confidence"], r["route_id"]) for r in match.contract_matches(spark.createDataFrame(contracts, CONTRACTS), spark.createDataFrame(routes, ROUTES)).collect()}
    assert got == {
        "exact": ("matched", "RESOLVED", "1"),
        "method": ("method_mismatch", "MISMATCH", "0"),
        "gateway": ("gateway_or_proxy_prefix", "PARTIAL_MATCH", "1"),
        "unsafe-empty": ("unsafe_dynamic", "UNRESOLVED", None),
        "unsafe": ("unsafe_dynamic", "UNRESOLVED", None),
        "unscanned": ("unscanned_service", "OUT_OF_SCOPE", None),
        "gap": ("indexed_backend_route_missing", "UNRESOLVED", None),
        "slot": ("dynamic_endpoint_unresolved", "UNRESOLVED", None),
        "internal": ("frontend_internal_api", "OUT_OF_SCOPE", None),
        "typed": ("matched", "RESOLVED", "3"),
        "base": ("matched", "RESOLVED", "1"),
    }


def test_paths(spark):
    assert one(spark, paths.normalise(F.lit("https://h/a//b/${x.userId}/?q=1#f"))) == "/a/b/{userId}"
    assert one(spark, paths.normalise(F.lit("/a/${f(x)}/:id"))) == "/a/{dynamic}/{id}"
    assert one(spark, paths.unsafe(F.lit("/a/${f(x)}"))) and not one(spark, paths.unsafe(F.lit("/a/${x.y}")))
    assert one(spark, paths.query_params(F.lit("/a?b=2&a&c=1"))) == ["a=", "b=2", "c=1"]
    assert one(spark, paths.hide_parameter_names(F.lit("/a/{id}/{n:[0-9]+}"))) == "/a/{_}/{_:[0-9]+}"
    assert one(spark, paths.app_of(F.lit("apps/web/x.ts"))) == "web" and one(spark, paths.app_of(F.lit("x.ts"))) == "workspace-root"


def test_identities(spark):
    import hashlib

    assert one(spark, ids.stable_id(F.lit("a"), F.lit("b"))) == hashlib.sha1(b"a\0b\0").hexdigest()[:24]
    assert one(spark, ids.workspace_id(F.lit(" Route "), F.lit(""), F.lit("A\\B"))) == "route:a/b"
    assert len(one(spark, ids.workspace_id(F.lit("x" * 200)))) == 24


def test_tokens(spark):
    assert one(spark, tokens(F.lit("getHTTPResponse2xx a user_id"))) == ["get", "http", "id", "response", "user", "xx"]


def test_families(spark):
    rows = [("b", "missing", "p", "no route /tree/new?x=1", "UNRESOLVED"), ("a", "missing", "p", "call /tree/changed", "UNRESOLVED"), ("c", "method", "p", "call /tree/new", "PARTIAL")]
    got = aggregate.diagnostic_families(spark.createDataFrame(rows, "id string, code string, project string, explanation string, resolution string")).orderBy("code").collect()
    assert [(r["code"], r["pattern"], r["count"], r["first_id"]) for r in got] == [("method", "/tree/{variant}", 1, "c"), ("missing", "/tree/{variant}", 2, "a")]


def test_next_scans(spark):
    coverage = spark.createDataFrame([("a", "pa", 2, "missing"), ("b", "pb", 7, "missing"), ("c", "", 9, "unknown")], "service string, project string, contracts long, state string")
    assert [(r["service"], r["rank"]) for r in aggregate.next_scans(coverage).collect()] == [("b", 1), ("a", 2)]


def test_reach_paths_and_cycles(spark):
    edges = spark.createDataFrame([("entry", "handler"), ("handler", "repo"), ("handler", "test"), ("repo", "entry")], "src string, dst string")
    start = spark.createDataFrame([("handler",)], "node string")
    got = {r["node"]: (r["depth"], r["path"]) for r in graph.reach(edges, start, 3).collect()}
    assert got == {"handler": (0, "handler"), "repo": (1, "handler > repo"), "test": (1, "handler > test"), "entry": (2, "handler > repo > entry")}
    cut = graph.bounded_reach(edges, start, 3, 1).collect()
    assert [(r["node"], r["truncated"]) for r in cut] == [("repo", True)]
    assert {r["cycle"] for r in graph.cycles(edges, 3).collect()} == {"entry > handler > repo > entry", "handler > repo > entry > handler", "repo > entry > handler > repo"}
    assert [(r["node"], r["out_degree"]) for r in graph.branches(edges).collect()] == [("handler", 2)]


def test_impact_counts_edges_before_visits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "src string, dst string")
    got = sorted((r["node"], r["depth"], r["hits"]) for r in graph.impact(edges, spark.createDataFrame([("b",)], "node string"), 2).collect())
    assert got == [("a", 1, 1), ("b", 2, 1), ("c", 1, 1)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 40)], "g string, n int, cost long")
    assert [r["taken"] for r in sequence.budget_fold(rows, "g", ["n"], "cost", 100).orderBy("n").collect()] == [True, False, True]


def test_nearest_before_ties_give_none(spark):
    facts = spark.createDataFrame([("k", 5, 1), ("k", 5, 2), ("k", 1, 3)], "key string, at int, fact int")
    probes = spark.createDataFrame([("k", 7, 10), ("k", 3, 11), ("k", 0, 12), ("k", 1, 13)], "key string, at int, probe_id long")
    got = {r["probe_id"]: r["fact"] for r in sequence.nearest_before(probes, facts, "key", "at", "fact").collect()}
    assert got == {10: None, 11: 3, 12: None, 13: 3}


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, v string")
    assert {(r["k"], r["change"]) for r in diff.entity_diff(a, b, "k", "v").collect()} == {(1, "changed"), (3, "new")}
    assert {(r["v"], r["change"]) for r in diff.set_delta(a.filter("v is not null"), b.filter("v is not null"), "v").collect()} == {("x", "removed"), ("y", "added"), ("z", "added")}


def test_checks(spark):
    rows = spark.createDataFrame([("a", "INFO"), ("a", "BAD")], "id string, severity string")
    got = integrity.checks(spark, duplicates=integrity.duplicate_ids(rows, "id"), severities=integrity.invalid_values(rows, "severity", ("INFO",)), dangling=integrity.dangling(rows, "id", rows, "id"))
    assert {(r["check"], r["violations"], r["status"]) for r in got.collect()} == {("duplicates", 1, "fail"), ("severities", 1, "fail"), ("dangling", 0, "pass")}


SOURCES = [
    ("main.go", 'package main\nimport (\n\t"fmt"\n\tx "app/pkg/util"\n)\nimport "os"\nfunc Run(a int) {\n\tif a {\n\t}\n\tfmt.Println(a)\n}\nfunc TestRun(t *T) {}\n'),
    ("pkg/util/a.go", "package util\n"),
    ("svc/app.py", "import os\nfrom svc.util import x\nclass A:\n    def m(self):\n        return go(1)\n\n@app.get('/items/{id}')\ndef items(id):\n    return 1\n\ndef test_items():\n    pass\n"),
    ("svc/util.py", "def x():\n    pass\n"),
    ("svc/test_util.py", "import svc.util\n"),
    ("web/server.ts", "import express from 'express'\nconst app = express()\napp.get('/users', listUsers)\nother.get('/no', nope)\nexport class Page {\n}\nimport { y } from './lib'\n"),
    ("web/lib.ts", "export function y() {\n  return call(2);\n}\n"),
    ("README.md", "# Title\ntext\n"),
    ("lib.rs", "use a::b;\n#[get(\"/r\")]\npub async fn root() {\n}\npub trait T {}\n"),
]


@pytest.fixture(scope="module")
def sources(spark):
    df = spark.createDataFrame(SOURCES, "path string, content string")
    return df.withColumn("language", files.language(F.col("path")))


def test_symbols(spark, sources):
    got = {(r["path"], r["name"], r["kind"]) for r in extract.symbols(sources).collect()}
    assert {("main.go", "Run", "function"), ("main.go", "TestRun", "test"), ("svc/app.py", "A", "class"), ("svc/app.py", "m", "method"), ("svc/app.py", "test_items", "test"), ("web/server.ts", "Page", "class"), ("README.md", "Title", "heading"), ("lib.rs", "T", "interface"), ("lib.rs", "root", "function")} <= got


def test_imports_resolve_to_files(spark, sources):
    rel = extract.relations(sources)
    targets = {(r["path"], r["target"]) for r in rel.collect()}
    assert {("main.go", "fmt"), ("main.go", "app/pkg/util"), ("main.go", "os"), ("svc/app.py", "svc.util"), ("web/server.ts", "./lib"), ("lib.rs", "a::b")} <= targets
    local = resolve.local_imports(rel.select(F.col("path").alias("from"), F.col("target").alias("to"), "type", F.col("line_no").alias("line"), "language"), sources.select("path", "language"), "app")
    found = {(r["from"], r["to"]) for r in local.filter("local").collect()}
    assert found == {("main.go", "pkg/util/a.go"), ("svc/app.py", "svc/util.py"), ("svc/test_util.py", "svc/util.py"), ("web/server.ts", "web/lib.ts")}


def test_routes(spark, sources):
    got = {(r["http_method"], r["route"], r["handler"]) for r in extract.routes(sources).collect()}
    assert got == {("GET", "/items/{id}", "items"), ("GET", "/users", "listUsers"), ("GET", "/r", "root")}


def test_function_ends_and_calls(spark, sources):
    ends = {(r["path"], r["name"]): (r["line_no"], r["end_line"]) for r in extract.functions_with_ends(sources).collect()}
    assert ends["main.go", "Run"] == (7, 11) and ends["web/lib.ts", "y"] == (1, 3) and ends["main.go", "TestRun"] == (12, 12)
    assert ends["svc/app.py", "m"][0] == 4
    got = {(r["path"], r["receiver"], r["name"]) for r in extract.calls(sources).collect()}
    assert ("web/lib.ts", "", "call") in got and ("main.go", "fmt", "Println") in got


def test_tests_by_name(spark, sources):
    assert [(r["test"], r["source"]) for r in resolve.tests_by_name(sources.select("path")).collect()] == [("svc/test_util.py", "svc/util.py")]


def test_scan(spark, tmp_path):
    for name, body in {"a.go": b"package a\n", "vendor/b.go": b"package b\n", "c.bin.py": b"x\0y", "d.md": b"# D\n", "e.txt": b"no", "big.py": b"x" * 100}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"] for r in files.scan(spark, str(tmp_path), folders=["Vendor"], ignore=["*.md", "!d.md"], largest=50).collect()}
    assert got == {"a.go", "d.md"}
    left = {(r["path"], r["reason"]) for r in files.skipped(spark, str(tmp_path), folders=["Vendor"], largest=50).collect()}
    assert left == {("big.py", "too_large"), ("c.bin.py", "binary")}


def test_ignore_rules(spark):
    rows = spark.createDataFrame([("a/x.log",), ("keep.log",), ("build/o.txt",), ("src/build.go",)], "path string")
    got = {r["path"] for r in rows.filter(files.ignored(F.col("path"), ["*.log", "!keep.log", "build/"])).collect()}
    assert got == {"a/x.log", "build/o.txt"}


def test_tasks_page_through(spark):
    symbols = spark.createDataFrame([(f"s{k}", f"Name{k}", f"pkg.Name{k}", "class", "f") for k in range(5)], "id string, name string, qualified_name string, kind string, file string")
    tasks = Catalogue({"symbols": symbols})
    seen, token = [], ""
    while True:
        rows, token = tasks.run("symbol-inventory", "name", 2, "summary", token)
        seen += [r["id"] for r in rows.collect()]
        if not token:
            break
    assert seen == ["s0", "s1", "s2", "s3", "s4"]
    assert [r["resolution"] for r in tasks.run("symbol-resolve", "NAME1")[0].collect()] == ["EXACT"]
    with pytest.raises(ValueError):
        tasks.run("no-such-task")


def test_calls_resolve_and_flows_walk(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import flows

    functions = spark.createDataFrame(
        [(1, "go", "a.go", "", "handler", "function", 1), (2, "go", "a.go", "", "load", "function", 5), (3, "go", "b.go", "Repo", "find", "method", 1), (4, "go", "apps/x/c.go", "", "far", "function", 1), (5, "go", "a_test.go", "", "TestLoad", "test", 1)],
        "fn_id int, language string, file string, owner string, name string, kind string, line int",
    )
    calls = spark.createDataFrame([(1, 1, "", "", "load", 2, ""), (2, 2, "$Repo", "", "find", 6, ""), (3, 1, "", "", "far", 3, ""), (4, 5, "", "", "load", 2, ""), (5, 3, "", "", "load", 2, "effect")], "call_id int, fn_id int, receiver string, owner string, method string, line int, usage string")
    edges = flows.call_edges(functions, calls)
    got = {(r["from_name"], r["to_name"], r["reason"]) for r in edges.collect()}
    assert got == {("handler", "load", "go static call match"), ("load", "find", "go static call match"), ("TestLoad", "load", "go static call match"), ("find", "load", "go effect call match")}
    assert [(r["test_method"], r["target_method"]) for r in flows.test_map(edges).collect()] == [("TestLoad", "load")]
    starts = spark.createDataFrame([("r", "a.go##handler")], "route_id string, key string")
    # The depth-first walk emits a step before it tests the target for a visit; the queue does not.
    assert [r["name"] for r in flows.code_flows(starts, edges).orderBy("pos").collect()] == ["load", "find", "load"]
    assert [r["name"] for r in flows.endpoint_flows(starts, edges).orderBy("pos").collect()] == ["load", "find"]
    routes = spark.createDataFrame([("r", "go", "a.go", "", "", "pkg.handler")], "route_id string, language string, file string, app string, package string, handler string")
    assert [(r["route_id"], r["fn_id"]) for r in flows.route_handlers(routes, functions).collect()] == [("r", 1)]
    assert one(spark, F.struct(*flows.test_case(F.lit("returnsNotFound")))) == ("not_found", "404")


def test_flow_records(spark):
    from lodestone.operators import flows

    nodes = spark.createDataFrame([("f", "e", "endpoint", 0), ("f", "a", "api_call", 1), ("f", "b", "component", 2), ("f", "t", "test", 3)], "flow_id string, id string, kind string, pos int")
    edges = spark.createDataFrame([("f", "a", "e"), ("f", "e", "a"), ("f", "b", "a")], "flow_id string, from_id string, to_id string")
    at = lambda d, u=False: tuple(flows.impact_summary(nodes, edges, d, u).select("target", "direct", "indirect", "tests", "api", "risk").first())
    assert at(1) == ("e", 1, 0, 1, 2, "medium") and at(2) == ("e", 1, 2, 1, 2, "medium") and at(1, True)[-1] == "high"
    stages = spark.createDataFrame([("f", "request", 0, "GET /x"), ("f", "persistence", 0, "Repo.find"), ("f", "response_field", 0, "name")], "flow_id string, stage string, pos int, label string")
    chain, gaps = flows.data_flow(stages)
    assert {(r["from_label"], r["to_label"], r["relation"]) for r in chain.collect()} == {("GET /x", "Repo.find", "persists"), ("Repo.find", "name", "returns")}
    assert {r["stage"] for r in gaps.collect()} == {"transformation", "request"}
    tests = spark.createDataFrame([("f", "t1", "MATCHED"), ("f", "t2", "WEAK_MATCH")], "flow_id string, test string, confidence string")
    links = flows.test_links(spark.createDataFrame([("f",), ("g",)], "flow_id string"), tests)
    assert {(r["flow_id"], r["link"]) for r in links.collect()} == {("f", "direct"), ("f", "candidate"), ("g", "not_detected")}
    requests = spark.createDataFrame([("t", "get", "/a/7")], "test_id string, http_method string, path string")
    endpoints = spark.createDataFrame([("1", "GET", "/a/{id}"), ("2", "GET", "/a/b")], "endpoint_id string, http_method string, path string")
    assert [r["endpoint_id"] for r in flows.endpoint_tests(requests, endpoints).collect()] == ["1"]


def test_traces_have_entries_and_exits(spark):
    from lodestone.operators import flows

    cols = "trace_id api_project api_http_method api_path api_file api_line api_caller backend_project backend_http_method backend_path backend_file backend_line backend_handler confidence".split()
    kinds = {"api_line": "int", "backend_line": "int"}
    matches = spark.createDataFrame([("t", "web", "GET", "/x", "a.ts", 3, "load", "svc", "GET", "/x", "C.java", 9, "C.get", "RESOLVED")], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))
    steps = lambda rows: spark.createDataFrame(rows, "trace_id string, pos int, name string, file string, line int")
    trace = flows.trace_steps(matches, steps([("t", 1, "Page", "p.tsx", 1)]), steps([("t", 1, "UserRepository.find", "R.java", 2), ("t", 2, "UserRepository.find", "R.java", 2)]), steps([("t", 1, "CTest.ok", "T.java", 4)]))
    nodes, edges = flows.directed_traces(trace)
    got = [(r["role"], r["is_entry"], r["is_exit"]) for r in nodes.orderBy("n").collect()]
    assert [g[0] for g in got] == ["event_handler", "api_client", "http_route", "controller", "repository", "test"]
    assert got[0][1:] == (True, False) and got[-1][1:] == (False, True) and edges.count() == 5
