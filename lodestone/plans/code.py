"""Queries over source code: every part of the part table is a small file in one of four languages.

The files are written from templates by the part's key, so SQL can say from the keys alone what the
extractors and resolvers must find in them.  ~ stands for the part's key and ^ for that of the next
file in the same language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregate, capabilities, clients, extract, facts, flows, graph, java, resolve, sequence
from ..sources import files, sinks
from .registry import Tables, query

GO = """package p~
import "fmt"
func Run~(a int) {
	if a {
		load~(a)
	}
	save^(a)
}
func load~(a int) {
	fmt.Println(a)
}
func save~(a int) {
	load~(a)
}
func TestRun~(t T) {
	Run~(1)
}
http.HandleFunc("/go/~/{id}", Run~)
"""
PYTHON = """import os
from py.base import x
class C~:
    def get~(self):
        return work~(1)

@app.get('/items/~/{id}')
def items~(id):
    return get~(1)

def test_items~():
    items~(2)
"""
SCRIPT = """import express from 'express'
import { Page^ } from './t^'
const app~ = express()
app~.get('/users/~', list~)
export function list~(a) {
  return fetch(`/items/^/${a.id}`)
}
export class Page~ {
}
"""
JAVA = """package shop;
import shop.S^;
@RestController
@RequestMapping("/j~")
public class S~ {
    private final S^ next;
    @GetMapping("/{id}")
    public Long get~(Long id) {
        return next.get^(id);
    }
}
"""
LANGUAGES = 4
_PATHS = ("svc/p~.go", "py/m~.py", "apps/web/t~.ts", "src/main/java/shop/S~.java")


def _filled(template: str, key: Column) -> Column:
    text = F.replace(F.lit(template), F.lit("~"), key.cast("string"))
    return F.replace(text, F.lit("^"), (key + LANGUAGES).cast("string"))


def code(t: Tables) -> DataFrame:
    """(path, language, content)."""
    key = F.col("p_partkey")
    pick = lambda values: F.when(key % LANGUAGES == 0, values[0]).when(key % LANGUAGES == 1, values[1]).when(key % LANGUAGES == 2, values[2]).otherwise(values[3])
    rows = t.dealt("part", "p_partkey").select(pick([_filled(p, key) for p in _PATHS]).alias("path"), pick([_filled(c, key) for c in (GO, PYTHON, SCRIPT, JAVA)]).alias("content"))
    return rows.withColumn("language", files.language(F.col("path")))


_FILES = """f AS (SELECT p_partkey AS k, p_partkey % 4 AS l, p_partkey + 4 AS n, p_partkey + 4 IN (SELECT p_partkey FROM part) AS linked,
CASE p_partkey % 4 WHEN 0 THEN 'svc/p' || p_partkey || '.go' WHEN 1 THEN 'py/m' || p_partkey || '.py' WHEN 2 THEN 'apps/web/t' || p_partkey || '.ts' ELSE 'src/main/java/shop/S' || p_partkey || '.java' END AS path,
CASE p_partkey % 4 WHEN 0 THEN 'svc/p' || (p_partkey + 4) || '.go' WHEN 1 THEN 'py/m' || (p_partkey + 4) || '.py' WHEN 2 THEN 'apps/web/t' || (p_partkey + 4) || '.ts' ELSE 'src/main/java/shop/S' || (p_partkey + 4) || '.java' END AS next FROM part)"""


def _expected(*rows: tuple, columns: str) -> str:
    """SQL rows of a fixed list (language, values ...) for every file: ~ and ^ in a value are keys."""
    names = columns.split()
    parts = []
    for language, *values in rows:
        cells = []
        for name, v in zip(names, values):
            if isinstance(v, int):
                cells.append(f"{v} AS {name}")
            elif "~" in v or "^" in v:
                cells.append(f"replace(replace('{v}', '~', CAST(k AS VARCHAR)), '^', CAST(n AS VARCHAR)) AS {name}")
            else:
                cells.append(f"'{v}' AS {name}")
        parts.append(f"SELECT path, {', '.join(cells)} FROM f WHERE l = {language}")
    return f"WITH {_FILES} " + " UNION ALL ".join(parts)


_SYMBOLS = (
    (0, 1, "p~", "package"), (0, 3, "Run~", "function"), (0, 9, "load~", "function"), (0, 12, "save~", "function"), (0, 15, "TestRun~", "test"),
    (1, 3, "C~", "class"), (1, 4, "get~", "method"), (1, 8, "items~", "function"), (1, 11, "test_items~", "test"),
    (2, 5, "list~", "function"), (2, 8, "Page~", "class"), (3, 5, "S~", "class"),
)


@query(_expected(*_SYMBOLS, columns="line_no name kind"))
def code_symbols(t: Tables) -> DataFrame:
    return extract.symbols(code(t)).select("path", "line_no", "name", "kind")


@query(_expected((0, 2, "fmt", "imports"), (1, 1, "os", "imports"), (1, 2, "py.base", "imports"), (2, 1, "express", "imports"), (2, 2, "./t^", "imports"), (3, 2, "shop.S^", "imports"), columns="line_no target type"))
def code_relations(t: Tables) -> DataFrame:
    return extract.relations(code(t)).select("path", "line_no", "target", "type")


_ENDS = ((0, "Run~", 3, 8, ""), (0, "load~", 9, 11, ""), (0, "save~", 12, 14, ""), (0, "TestRun~", 15, 17, ""), (1, "get~", 4, 6, "C~"), (1, "items~", 8, 10, ""), (1, "test_items~", 11, 13, ""), (2, "list~", 5, 7, ""))


@query(_expected(*_ENDS, columns="name line_no end_line owner"))
def code_function_ends(t: Tables) -> DataFrame:
    return extract.functions_with_ends(code(t)).select("path", "name", "line_no", "end_line", "owner")


COMPONENT = """export function Page~() {
  useEffect(() => {
    load~()
  }, [])
  function save~() {
    post~()
  }
  return <button onClick={save~}>x</button>
}
"""


@query("SELECT 'c' || s_suppkey || '.tsx' AS file, 3 AS line, 'load' || s_suppkey AS name, 'effect' AS usage FROM supplier UNION ALL SELECT 'c' || s_suppkey || '.tsx', 6, 'post' || s_suppkey, 'event_handler' FROM supplier")
def call_usage_kinds(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    own = t.dealt("supplier", "s_suppkey").select(_filled("c~.tsx", key).alias("path"), F.lit("typescript").alias("language"), _filled(COMPONENT, key).alias("content"))
    fns = extract.functions_with_ends(own).withColumnsRenamed({"path": "file", "line_no": "line"})
    points = extract.calls(own).select(F.col("path").alias("file"), F.concat_ws(":", "line_no", "name").alias("point_id"), F.col("line_no").alias("line"), "name")
    return points.join(extract.call_usage(own, fns, points), ["file", "point_id"]).select("file", "line", "name", "usage")


PHP = """<?php
namespace App~;
class Repo~ {
    public function find~($id) {
        return $id;
    }
}
function main~() {
    $Repo~->find~(1);
    Repo~::find~(2);
}
"""


@query("SELECT 'r' || s_suppkey || '.php' AS from_file, 'main' || s_suppkey AS from_name, 'Repo' || s_suppkey AS to_owner, 'find' || s_suppkey AS to_name, unnest([9, 10]) AS call_line FROM supplier")
def call_receiver_owner(t: Tables) -> DataFrame:
    """Calls on a receiver that names a class go to the class's method."""
    key = F.col("s_suppkey")
    own = t.dealt("supplier", "s_suppkey").select(_filled("r~.php", key).alias("path"), F.lit("php").alias("language"), _filled(PHP, key).alias("content"))
    fns = extract.functions_with_ends(own).withColumnsRenamed({"path": "file", "line_no": "line"}).select(F.concat_ws(":", "file", "name").alias("fn_id"), F.lit("php").alias("language"), "file", "owner", "name", "kind", "line", "end_line")
    found = extract.calls(own).select(F.col("path").alias("file"), F.concat_ws(":", "path", "line_no", "receiver", "name").alias("point_id"), "receiver", F.col("name").alias("method"), F.col("line_no").alias("line"))
    inside = sequence.enclosing(found, fns.select("file", F.col("line").alias("low"), F.col("end_line").alias("high"), "fn_id"), "file", "line", "low", "high", "fn_id")
    calls = found.join(inside, ["file", "point_id"]).select(F.col("point_id").alias("call_id"), "fn_id", "receiver", F.lit("").alias("owner"), "method", "line", F.lit("").alias("usage"))
    return flows.call_edges(fns, calls).select("from_file", "from_name", "to_owner", "to_name", "call_line")


@query(
    _expected(
        (0, 3, "", "Run~"), (0, 5, "", "load~"), (0, 7, "", "save^"), (0, 9, "", "load~"), (0, 10, "fmt", "Println"), (0, 12, "", "save~"), (0, 13, "", "load~"), (0, 15, "", "TestRun~"), (0, 16, "", "Run~"), (0, 18, "http", "HandleFunc"),
        (1, 4, "", "get~"), (1, 5, "", "work~"), (1, 7, "app", "get"), (1, 8, "", "items~"), (1, 9, "", "get~"), (1, 11, "", "test_items~"), (1, 12, "", "items~"),
        (2, 3, "", "express"), (2, 4, "app~", "get"), (2, 5, "", "list~"), (2, 6, "", "fetch"),
        (3, 4, "", "RequestMapping"), (3, 7, "", "GetMapping"), (3, 8, "", "get~"), (3, 9, "next", "get^"),
        columns="line_no receiver name",
    )
)
def code_calls(t: Tables) -> DataFrame:
    return extract.calls(code(t)).select("path", "line_no", "receiver", "name")


@query(_expected((0, "", "/go/~/{id}", "Run~", "net/http"), (1, "GET", "/items/~/{id}", "items~", "decorator"), (2, "GET", "/users/~", "list~", "script-server"), columns="http_method route handler framework"))
def code_routes(t: Tables) -> DataFrame:
    return extract.routes(code(t)).select("path", "http_method", "route", "handler", "framework")


def java_records(t: Tables) -> DataFrame:
    """Scanned once: the steps that follow read them several times."""
    return graph.written(java.java_records(code(t)))


def functions(t: Tables) -> DataFrame:
    own = code(t)
    bodies = extract.functions_with_ends(own).withColumnsRenamed({"path": "file", "line_no": "line"})
    order = F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 8, "0"), "name")
    # Kept once: calls, their callers and their targets all read it.
    return graph.written(bodies.select(order.alias("fn_id"), files.language(F.col("file")).alias("language"), "file", "owner", "name", "kind", "line", "end_line"))


def edges(t: Tables) -> DataFrame:
    return call_edges(t, functions(t))


def call_edges(t: Tables, fns: DataFrame) -> DataFrame:
    found = extract.calls(code(t)).filter("language <> 'java'").select(F.col("path").alias("file"), F.concat_ws(":", "path", "line_no", "receiver", "name").alias("point_id"), "receiver", F.col("name").alias("method"), F.col("line_no").alias("line"))
    found = graph.written(found)  # the lines are searched once
    inside = sequence.enclosing(found, fns.select("file", F.col("line").alias("low"), F.col("end_line").alias("high"), "fn_id"), "file", "line", "low", "high", "fn_id")
    calls = found.join(graph.sized(inside), ["file", "point_id"]).select(F.col("point_id").alias("call_id"), "fn_id", "receiver", F.lit("").alias("owner"), "method", "line", F.lit("").alias("usage"))
    return flows.call_edges(fns, graph.written(calls))


_CALL_EDGES = f"""{_FILES}, e AS (
SELECT path AS from_file, 'Run' || k AS from_name, path AS to_file, 'load' || k AS to_name, 5 AS call_line, 'go static call match' AS reason FROM f WHERE l = 0
UNION ALL SELECT path, 'Run' || k, next, 'save' || n, 7, 'go static call match' FROM f WHERE l = 0 AND linked
UNION ALL SELECT path, 'save' || k, path, 'load' || k, 13, 'go static call match' FROM f WHERE l = 0
UNION ALL SELECT path, 'TestRun' || k, path, 'Run' || k, 16, 'go static call match' FROM f WHERE l = 0
UNION ALL SELECT path, 'items' || k, path, 'get' || k, 9, 'python static call match' FROM f WHERE l = 1
UNION ALL SELECT path, 'test_items' || k, path, 'items' || k, 12, 'python static call match' FROM f WHERE l = 1)"""


@query(f"WITH {_CALL_EDGES} SELECT * FROM e")
def code_call_edges(t: Tables) -> DataFrame:
    return edges(t).select("from_file", "from_name", "to_file", "to_name", "call_line", "reason")


_JAVA_EDGES = """SELECT path AS from_file, 'get' || k AS from_name, next AS to_file, 'get' || n AS to_name, 9 AS call_line, 'method declaration matched' AS reason FROM f WHERE l = 3 AND linked"""


@query(f"WITH {_CALL_EDGES} SELECT * FROM e UNION ALL {_JAVA_EDGES}")
def code_call_graph(t: Tables) -> DataFrame:
    own = graph.written(edges(t))
    both = flows.union_call_graphs(own.drop("call_id", "from_kind", "to_kind", "from_line"), java.call_edges(java_records(t)), own.drop("call_id", "from_kind", "to_kind", "from_line"))
    return both.select("from_file", "from_name", "to_file", "to_name", "call_line", "reason")


@query(f"WITH {_CALL_EDGES} SELECT from_file, to_file, min(call_line) AS line FROM e WHERE from_file <> to_file GROUP BY 1, 2")
def code_file_relations(t: Tables) -> DataFrame:
    return flows.file_relations(edges(t))


@query(f"""WITH {_FILES} SELECT path AS test_file, 'TestRun' || k AS test_method, path AS target_file, 'Run' || k AS target_method, 16 AS line FROM f WHERE l = 0
UNION ALL SELECT path, 'test_items' || k, path, 'items' || k, 12 FROM f WHERE l = 1""")
def code_test_map(t: Tables) -> DataFrame:
    return flows.test_map(edges(t)).select("test_file", "test_method", "target_file", "target_method", "line")


def routes(t: Tables) -> DataFrame:
    plain = extract.routes(code(t)).select("http_method", paths.normalise(F.col("route")).alias("path"), "handler", F.col("path").alias("file"), "language")
    return plain.select(F.trim(F.concat_ws(" ", "http_method", "path")).alias("route_id"), "*", paths.app_of(F.col("file")).alias("app"), paths.package_of(F.col("file")).alias("package"))


def handlers(t: Tables, fns: DataFrame) -> DataFrame:
    return flows.route_handlers(routes(t), fns).join(graph.sized(fns), "fn_id").select("route_id", flows.method_key(F.col("file"), F.col("owner"), F.col("name")).alias("key"))


_ROUTE = "CASE l WHEN 0 THEN '/go/' || k || '/{id}' WHEN 1 THEN 'GET /items/' || k || '/{id}' ELSE 'GET /users/' || k END"


@query(f"WITH {_FILES} SELECT {_ROUTE} AS route_id, path || '##' || CASE l WHEN 0 THEN 'Run' WHEN 1 THEN 'items' ELSE 'list' END || k AS key FROM f WHERE l < 3")
def code_route_handlers(t: Tables) -> DataFrame:
    return handlers(t, functions(t))


_STEPS = f"""WITH {_FILES} SELECT {_ROUTE} AS route_id, 1 AS pos, 'load' || k AS name, 'Run' || k AS caller FROM f WHERE l = 0
UNION ALL SELECT {_ROUTE}, 2, 'save' || n, 'Run' || k FROM f WHERE l = 0 AND linked UNION ALL SELECT {_ROUTE}, 3, 'load' || n, 'save' || n FROM f WHERE l = 0 AND linked
UNION ALL SELECT {_ROUTE}, 1, 'get' || k, 'items' || k FROM f WHERE l = 1"""


@query(_STEPS)
def code_flow_steps(t: Tables) -> DataFrame:
    fns = functions(t)
    return flows.code_flows(handlers(t, fns), call_edges(t, fns)).select("route_id", "pos", "name", "caller")


@query(_STEPS)
def endpoint_flow_steps(t: Tables) -> DataFrame:
    fns = functions(t)
    return flows.endpoint_flows(handlers(t, fns), call_edges(t, fns)).select("route_id", "pos", "name", "caller")


@query(f"""WITH {_FILES}, g AS (SELECT {_ROUTE} AS route_id FROM f WHERE l = 2 ORDER BY 1 LIMIT 10) SELECT route_id, 'WEAK_MATCH' AS confidence, 'flow has no resolved handler or call steps' AS reason FROM g""")
def weak_flows_first10(t: Tables) -> DataFrame:
    fns = functions(t)
    return capabilities.weak_flows(routes(t), flows.code_flows(handlers(t, fns), call_edges(t, fns)))


@query(f"""WITH {_FILES} SELECT path, CASE WHEN linked THEN next ELSE './t' || n END AS target, linked AS local FROM f WHERE l = 2 UNION ALL SELECT path, 'express', false FROM f WHERE l = 2
UNION ALL SELECT path, 'fmt', false FROM f WHERE l = 0 UNION ALL SELECT path, 'os', false FROM f WHERE l = 1 UNION ALL SELECT path, 'py.base', false FROM f WHERE l = 1""")
def code_local_imports(t: Tables) -> DataFrame:
    own = code(t)
    imported = extract.relations(own).filter("language <> 'java'").select(F.col("path").alias("from"), F.col("target").alias("to"), "type", F.col("line_no").alias("line"), "language")
    return resolve.local_imports(imported, own.select("path", "language")).select(F.col("from").alias("path"), F.col("to").alias("target"), "local")


@query(f"WITH {_FILES} SELECT path AS \"from\", CASE WHEN linked THEN next ELSE 'shop.S' || n END AS \"to\", CASE WHEN linked THEN 'imports_internal' ELSE 'imports_external' END AS type, 2 AS line FROM f WHERE l = 3")
def java_imports(t: Tables) -> DataFrame:
    return java.imports(java_records(t))


@query(f"WITH {_FILES} SELECT 'GET' AS http_method, '/j' || k || '/{{id}}' AS path, 'S' || k AS controller, 'get' || k AS method, path AS file FROM f WHERE l = 3")
def java_endpoints(t: Tables) -> DataFrame:
    return java.endpoints(java_records(t)).select("http_method", "path", "controller", "method", "file")


@query(f"WITH {_FILES} SELECT 'S' || k AS \"from\", 'S' || n AS \"to\", 'next' AS field, 'field' AS injection, path AS from_file, next AS to_file FROM f WHERE l = 3 AND linked")
def java_dependencies(t: Tables) -> DataFrame:
    return java.dependencies(java_records(t)).select("from", "to", "field", "injection", "from_file", "to_file")


@query(f"WITH {_FILES} SELECT 'S' || k AS name, 'rest_controller' AS kind, path AS file, 'shop' AS package FROM f WHERE l = 3")
def java_components(t: Tables) -> DataFrame:
    return java.components(java.java_records(code(t))).select("name", "kind", "file", "package")


@query(f"WITH {_FILES} SELECT path AS file, 6 AS line, 'GET' AS http_method, '/items/' || n || '/{{id}}' AS path, 'list' || k AS caller, 'web' AS app FROM f WHERE l = 2")
def client_contracts(t: Tables) -> DataFrame:
    return clients.contracts(code(t)).select("file", "line", "http_method", "path", "caller", "app")


@query(
    f"""WITH {_FILES}, s AS (SELECT 'go' AS language, 'symbols' AS capability, 5 AS each, 0 AS l UNION ALL SELECT 'python', 'symbols', 4, 1 UNION ALL SELECT 'typescript', 'symbols', 2, 2 UNION ALL SELECT 'java', 'symbols', 1, 3),
g AS (SELECT language, c.capability FROM (SELECT DISTINCT s.language, s.l FROM s JOIN f USING (l)) s, (SELECT unnest(['symbols','relations','calls','routes','api_clients','tests','persistence','messaging','data_flow']) AS capability) c)
SELECT language, capability, CAST(CASE WHEN capability = 'symbols' THEN (SELECT count(*) * any_value(each) FROM s JOIN f USING (l) WHERE s.language = g.language) ELSE 0 END AS BIGINT) AS n, CASE WHEN capability = 'symbols' THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS coverage FROM g"""
)
def code_capability_inventory(t: Tables) -> DataFrame:
    own = code(t)
    return aggregate.capability_inventory(extract.symbols(own).select("language", F.lit("symbols").alias("capability")), own.select("language"))


@query(
    f"""WITH {_FILES} SELECT path, 7 AS line_no, 'routes' AS capability FROM f WHERE l = 1 UNION ALL SELECT path, 11, 'tests' FROM f WHERE l = 1"""
)
def python_capability_facts(t: Tables) -> DataFrame:
    return capabilities.capability_facts(code(t)).filter("language = 'python' and capability in ('routes', 'tests')").select("path", "line_no", "capability").distinct()


@query(f"""WITH {_FILES} SELECT DISTINCT CASE l WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'java' END AS language,
CASE l WHEN 0 THEN 'language+routes' WHEN 1 THEN 'language+routes' WHEN 2 THEN 'language+react+routes+api' ELSE 'language+spring' END AS scope, true AS symbols, true AS relations, true AS calls, true AS endpoints, true AS tests FROM f""")
def analyzer_inventory(t: Tables) -> DataFrame:
    return aggregate.analyzer_inventory(code(t))


@query(
    f"""WITH {_FILES}, s AS (SELECT 'symbol' AS kind, count(*) AS n FROM ({_expected(*_SYMBOLS, columns="line_no name kind").replace("WITH " + _FILES, "")})), r AS (SELECT 'route' AS kind, count(*) AS n FROM f WHERE l < 3),
c AS (SELECT 'api_contract' AS kind, count(*) AS n FROM f WHERE l = 2), m AS (SELECT 'test' AS kind, count(*) AS n FROM f WHERE l < 2) SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM m"""
)
def search_fact_kinds(t: Tables) -> DataFrame:
    own = code(t)
    symbols = extract.symbols(own).select(F.col("path").alias("file"), "name", "kind", F.col("line_no").alias("line"))
    served = extract.routes(own).select("http_method", paths.normalise(F.col("route")).alias("path"), "handler", F.col("path").alias("file"), F.col("line_no").alias("line"))
    return facts.search_facts(symbols, served, clients.contracts(own), flows.test_map(edges(t))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_FILES}, e AS (SELECT path, unnest(CASE l WHEN 0 THEN [3, 9, 12, 15] WHEN 1 THEN [4, 8, 11] WHEN 2 THEN [5] ELSE [] END) AS line FROM f) SELECT path AS file, line FROM e""")
def evidence_rows(t: Tables) -> DataFrame:
    rows = functions(t).select("file", "line", F.lit("lines").alias("analyzer"), F.lit("pattern").alias("method"), F.col("name").alias("reason"))
    return facts.evidence(rows.union(rows), files.file_records(code(t))).select("file", "line")


@query(f"WITH {_FILES} SELECT count(*) AS files, true AS fresh FROM f")
def freshness_check(t: Tables) -> DataFrame:
    """The fingerprint of all files doesn't depend on row order."""
    own = files.file_records(code(t))
    again = files.file_records(code(t).orderBy(F.desc("path")))
    both = sinks.freshness(own).unionByName(sinks.freshness(again))
    return both.groupBy("files").agg((F.count_distinct("fingerprint") == 1).alias("fresh"))


@query(f"""WITH {_FILES} SELECT 'files' AS "table", count(*) AS "rows" FROM f UNION ALL SELECT 'routes', count(*) FROM f WHERE l < 3""")
def audit_counts(t: Tables) -> DataFrame:
    return sinks.audit({"files": code(t), "routes": extract.routes(code(t))})
