"""A tree to tables, written, read back and asked."""

import json

import pytest
from test_operators import SOURCES
from test_scanners import JAVA, SCRIPT

from lodestone import cli
from lodestone.plans import build, context
from lodestone.sources import sinks


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("out")
    for name, body in [*SOURCES, *JAVA, *SCRIPT]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    sinks.write(spark, build.tables(spark, str(root), ignore=["README.md"]), str(out))
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, project):
    return sinks.read(spark, project)


def test_tables(tables):
    paths = {r["path"] for r in tables["files"].collect()}
    assert "main.go" in paths and "README.md" not in paths and "vendor/lib.js" not in paths
    routes = {r["route_id"] for r in tables["routes"].collect()}
    assert {"GET /users/{id}", "POST /users/all", "GET /items/{id}", "GET /users", "GET /r"} <= routes
    matches = {(r["http_method"], r["path"]): r["issue"] for r in tables["contract_matches"].collect()}
    assert matches[("GET", "/users/{id}")] == "matched" and matches[("POST", "/users/all")] == "matched"
    edges = {(r["from_name"], r["to_name"]) for r in tables["call_edges"].collect()}
    assert ("get", "find") in edges and ("find", "findById") in edges
    steps = {(r["route_id"], r["name"]) for r in tables["endpoint_flows"].collect()}
    assert ("GET /users/{id}", "find") in steps and ("GET /users/{id}", "findById") in steps
    coverage = {(r["language"], r["capability"]): r["coverage"] for r in tables["capabilities"].collect()}
    assert coverage["java", "routes"] == "COMPLETE" and coverage["shell" if ("shell", "routes") in coverage else "rust", "messaging"] == "UNAVAILABLE"
    assert tables["evidence"].count() == tables["evidence"].select("evidence_id").distinct().count() > 0


def test_integrity(spark, tables):
    from lodestone.operators import integrity

    got = integrity.checks(
        spark,
        facts=integrity.duplicate_ids(tables["facts"], "fact_id"),
        edges=integrity.duplicate_ids(tables["fact_edges"], "edge_id"),
        from_ends=integrity.dangling(tables["fact_edges"], "from_id", tables["facts"], "fact_id"),
        to_ends=integrity.dangling(tables["fact_edges"], "to_id", tables["facts"], "fact_id"),
    )
    assert {r["status"] for r in got.collect()} == {"pass"}


def test_incomplete_folders_are_refused(spark, tmp_path):
    sinks.manifest(spark, str(tmp_path), "incomplete", [])
    with pytest.raises(ValueError):
        sinks.read(spark, str(tmp_path))


def test_several_projects_and_cleaning(spark, tmp_path):
    rows = spark.createDataFrame([("a.go",)], "path string")
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    sinks.write(spark, {"files": rows}, one)
    sinks.write(spark, {"files": rows, "more": rows}, one)
    sinks.manifest(spark, two, "incomplete", [])
    held, failed = sinks.read_projects(spark, {"p": one, "q": two, "r": f"{tmp_path}/none"})
    assert {(r["path"], r["project"]) for r in held["files"].collect()} == {("a.go", "p")} and set(held) == {"files", "more"}
    assert sorted(r["project"] for r in failed.collect()) == ["q", "r"]
    plan = sinks.clean_plan(spark, one)
    assert len(plan) == 1 and sinks.clean_plan(spark, one) == plan
    sinks.clean(spark, one, plan)
    assert sinks.clean_plan(spark, one) == [] and sinks.read(spark, one)["files"].count() == 1


def test_context(tables):
    pack = context.compile_context(tables["facts"], tables["fact_edges"], "How does GET /users/{id} find a user?")
    assert pack.status == "ok" and pack.seed["kind"] in ("route", "api_contract")
    assert pack.facts and pack.tokens <= 4000
    again = context.compile_context(tables["facts"], tables["fact_edges"], pack.query, known=pack.context_id)
    assert again.status == "duplicate"
    assert context.compile_context(tables["facts"], tables["fact_edges"], "zzzz qqqq").status == "no_match"
    small = context.compile_context(tables["facts"], tables["fact_edges"], pack.query, tokens=256)
    assert small.tokens <= 256


def test_anchors_and_primary():
    assert context.anchors("see GET /a/b and src/x.go, `Foo bar` or pkg.Type#m") == ["GET /a/b", "src/x.go", "Foo bar", "pkg.Type#m"]
    assert context.primary("Why does it fail? More.\n\nOther") == "Why does it fail?"


def test_explain_and_diagnostics(tables):
    rows = {(r["section"], r["label"]) for r in build.explain(tables, "svc/util.py").collect()}
    assert {("symbol", "function x"), ("inbound", "imports svc/app.py")} <= rows
    found = {k: v.count() for k, v in build.diagnostics(tables).items()}
    assert found["entrypoints"] and found["likely_tests"]


def test_cli(project, capsys):
    assert cli.main(["query", project, "endpoint-search", "--query", "users", "--limit", "2"]) == 0
    first = json.loads(capsys.readouterr().out)
    assert len(first["items"]) == 2 and first["continuation"]
    assert cli.main(["explain", project, "main.go"]) == 0 and "Run" in capsys.readouterr().out
    assert cli.main(["context", project, "--query", "user repository"]) == 0 and json.loads(capsys.readouterr().out)["context_id"]
    assert cli.main(["report", project]) == 0 and "# Routes" in capsys.readouterr().out
