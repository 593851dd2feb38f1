"""Usages, modules, groups, catalogue, transcripts and the stream of sources."""

import json

from lodestone import streaming
from lodestone.operators import symbols
from lodestone.sources import transcripts


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_usages_need_dependencies(spark):
    usages = spark.createDataFrame([(1, "p", "java", "", "a.B"), (2, "q", "java", "", "a.B"), (3, "r", "java", "", "a.B"), (4, "p", "java", "", "x.Y"), (5, "p", "java", "symbol:9", ""), (6, "q", "typescript", "", "m#f")], "usage_id int, project string, language string, local_id string, key string")
    declarations = spark.createDataFrame([("symbol:1", "p", "art-p", "java", "a.B"), ("symbol:2", "z", "art-z", "java", "a.B"), ("symbol:3", "z", "art-z", "typescript", "m#f")], "id string, project string, artifact string, language string, key string")
    dependencies = spark.createDataFrame([("p", "other"), ("q", "art-z")], "project string, artifact string")
    got = rows(symbols.resolve_usages(usages, declarations, dependencies), "usage_id", "resolution", "symbol_id")
    assert got == {(1, "EXACT", "symbol:1"), (2, "EXACT", "symbol:2"), (3, "AMBIGUOUS", None), (4, "UNRESOLVED", None), (5, "EXACT", "symbol:9"), (6, "EXACT", "symbol:3")}


def test_modules(spark):
    imports = spark.createDataFrame([(1, "web/a.ts", "./lib"), (2, "web/a.ts", "@app/util"), (3, "web/a.ts", "shared"), (4, "web/a.ts", "react"), (5, "web/a.ts", "twice"), (6, "web/x/b.ts", "../lib/index")], "import_id int, file string, module string")
    files = spark.createDataFrame([("web/lib/index.ts",), ("src/util.tsx",), ("web/a.ts",)], "path string")
    aliases = spark.createDataFrame([("@app/", "src/")], "prefix string, replacement string")
    packages = spark.createDataFrame([("shared", "packages/shared/index.ts"), ("twice", "a"), ("twice", "b")], "name string, entry string")
    got = rows(symbols.module_targets(imports, files, aliases, packages), "import_id", "target", "how")
    assert got == {(1, "web/lib/index.ts", "relative"), (2, "src/util.tsx", "alias"), (3, "packages/shared/index.ts", "package"), (4, None, "external"), (5, None, "ambiguous"), (6, None, "external")} or (6, "web/lib/index.ts", "relative") in got


def test_exports_pass_through_stars(spark):
    exports = spark.createDataFrame(
        [("a", "f", "declared", None, None, "s1"), ("a", "default", "declared", None, None, "s2"), ("b", None, "star", "a", None, None), ("c", "g", "named", "b", "f", None), ("b", None, "star", "c", None, None), ("c", None, "star", "b", None, None)],
        "module string, name string, kind string, source_module string, source_name string, symbol_id string",
    )
    got = rows(symbols.exported(exports), "module", "name", "symbol_id")
    assert got == {("a", "f", "s1"), ("a", "default", "s2"), ("b", "f", "s1"), ("c", "g", "s1"), ("c", "f", "s1"), ("b", "g", "s1")}


def test_groups(spark):
    names = spark.createDataFrame([("p", "com.acme.shop.a", 1.0), ("p", "com.acme.shop.b", 1.0), ("p", "com.acme.user.c", 1.0), ("q", "x.a", 1.0), ("q", "y.b", 1.0)], "project string, namespace string, confidence double")
    assert rows(symbols.namespace_groups(names), "project", "group_id", "depth") == {("p", "com.acme.shop", 3)}


def test_catalog_needs_one_candidate(spark):
    endpoints = spark.createDataFrame([("e1", "s", "GET", "/a/{x}", "C.a", "C.java", 3), ("e2", "t", "GET", "/a/{y}", "D.a", "D.java", 4)], "endpoint_id string, project string, http_method string, path string, handler string, file string, line int")
    matches = spark.createDataFrame([("m1", "web", "s", "GET", "/a/{id}", "", "", 0), ("m2", "web", "", "GET", "/a/{id}", "", "", 0)], "match_id string, api_project string, backend_project string, backend_http_method string, backend_path string, backend_handler string, backend_file string, backend_line int")
    catalog, doubtful = symbols.api_catalog(endpoints, matches)
    assert rows(catalog, "endpoint_id", "consumers") == {("e1", 1), ("e2", 0)}
    assert rows(doubtful, "match_id", "candidates") == {("m2", 2)}


def test_transcripts(spark, tmp_path):
    events = [
        {"type": "item.completed", "item": {"id": "1", "type": "command", "command": "rg foo src | head -3; cat a.go"}},
        {"type": "item.completed", "item": {"id": "1", "type": "command", "command": "rg foo src | head -3; cat a.go"}},
        {"type": "item.completed", "item": {"id": "2", "type": "command", "command": "go test ./..."}},
        {"type": "turn.completed", "usage": {"input_tokens": 5, "output_tokens": 2}},
        {"type": "turn.completed", "usage": {"input_tokens": 9, "output_tokens": 1, "total_tokens": 0}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    got = transcripts.metrics(transcripts.read(spark, str(tmp_path / "t.jsonl"))).first()
    assert (got["items"], got["tool_calls"], got["navigation"], got["reads"], got["tokens"]) == (2, 2, 1, 1, 10)


def test_stream_of_sources(spark, tmp_path):
    def arrive(version, body):
        spark.createDataFrame([("a.py", body, version)], streaming.SOURCE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive(1, "def old():\n    pass\n")
    query = streaming.symbols(streaming.sources(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("append").start()
    try:
        query.processAllAvailable()
        arrive(2, "def new():\n    pass\n")
        query.processAllAvailable()
    finally:
        query.stop()
    arrived = spark.table("arrived")
    assert rows(arrived, "name", "version") == {("old", 1), ("new", 2)}
    assert rows(streaming.latest(arrived), "name") == {("new",)}
