"""Flows, dossiers, checks and workspaces over the order tables.

Stand-ins: an order is a feature flow, its customer's segment the frontend, its lines are steps, tests
or fields; suppliers and nations are services and repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..operators import aggregate, flows, integrity, rendering, resolve, symbols, workspace
from ..sources import files, transcripts
from ..sources import workspace as projects
from .registry import Tables, query


def _s(letter: str, *columns: str) -> Column:
    return F.concat(F.lit(letter), *(F.col(c).cast("string") for c in columns))


_STAGES = """s AS (SELECT o_orderkey AS flow_id, 0 AS r, 0 AS pos, 'GET /orders/' || o_orderkey AS label FROM orders UNION ALL SELECT l_orderkey, 1, l_linenumber, 'f' || l_linenumber FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT o_orderkey, 2, 0, 'Repo.find' || o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 3, 0, 'price' FROM orders),
w AS (SELECT *, lag(label) OVER (PARTITION BY flow_id ORDER BY r, pos, label) AS b FROM s)"""


def stages(t: Tables) -> DataFrame:
    part = lambda df, key, stage, pos, label: df.select(F.col(key).alias("flow_id"), F.lit(stage).alias("stage"), pos.alias("pos"), label.alias("label"))
    zero = F.lit(0)
    return (
        part(t.orders, "o_orderkey", "request", zero, _s("GET /orders/", "o_orderkey"))
        .unionByName(part(t.lineitem.filter("l_returnflag <> 'N'"), "l_orderkey", "request_field", F.col("l_linenumber"), _s("f", "l_linenumber")))
        .unionByName(part(t.orders.filter("o_orderstatus = 'F'"), "o_orderkey", "persistence", zero, _s("Repo.find", "o_custkey")))
        .unionByName(part(t.orders, "o_orderkey", "response_field", zero, F.lit("price")))
    )


@query(f"WITH {_STAGES} SELECT flow_id, b AS from_label, label AS to_label, CASE r WHEN 1 THEN 'binds' WHEN 2 THEN 'persists' ELSE 'returns' END AS relation FROM w WHERE b IS NOT NULL")
def data_flow_chain(t: Tables) -> DataFrame:
    return flows.data_flow(stages(t))[0]


@query(
    f"""WITH {_STAGES} SELECT flow_id, 'transformation' AS stage, b AS from_label, label AS to_label FROM w WHERE r = 2 AND b IS NOT NULL
UNION ALL SELECT flow_id, 'request', min(label) FILTER (r = 0), '' FROM s GROUP BY 1 HAVING count(*) FILTER (r = 1) = 0"""
)
def data_flow_gaps(t: Tables) -> DataFrame:
    return flows.data_flow(stages(t))[1]


@query(
    """WITH l AS (SELECT l_orderkey AS flow_id, count(*) FILTER (l_linenumber = 1) AS one, count(*) FILTER (l_linenumber = 2) AS two, count(*) FILTER (l_returnflag = 'R') AS tests, count(*) FILTER (l_returnflag = 'A') AS calls FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS flow_id, coalesce(one, 0) AS direct, CASE WHEN coalesce(one, 0) > 0 THEN coalesce(two, 0) ELSE 0 END AS indirect, coalesce(tests, 0) AS tests, coalesce(calls, 0) + 1 AS api FROM orders LEFT JOIN l ON l.flow_id = o_orderkey)
SELECT flow_id, 'e' AS target, direct, indirect, tests, api, CASE WHEN direct >= 5 OR indirect >= 10 THEN 'high' ELSE 'medium' END AS risk FROM x"""
)
def impact_summaries(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "test").when(F.col("l_returnflag") == "A", "api_call").otherwise("component")
    nodes = t.orders.select(F.col("o_orderkey").alias("flow_id"), F.lit("e").alias("id"), F.lit("endpoint").alias("kind"), F.lit(0).alias("pos"))
    nodes = nodes.unionByName(t.lineitem.select(F.col("l_orderkey").alias("flow_id"), _s("l", "l_linenumber").alias("id"), kind.alias("kind"), F.col("l_linenumber").alias("pos")))
    to = F.when(F.col("l_linenumber") == 1, "e").otherwise(F.concat(F.lit("l"), (F.col("l_linenumber") - 1).cast("string")))
    edges = t.lineitem.select(F.col("l_orderkey").alias("flow_id"), _s("l", "l_linenumber").alias("from_id"), to.alias("to_id"))
    return flows.impact_summary(nodes, edges, 2)


@query(
    """SELECT o_orderkey AS flow_id, coalesce('t' || l_linenumber, '') AS test, CASE l_returnflag WHEN 'R' THEN 'candidate' WHEN 'A' THEN 'direct' ELSE 'not_detected' END AS link
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'N') ON l_orderkey = o_orderkey"""
)
def test_links(t: Tables) -> DataFrame:
    tests = t.lineitem.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("flow_id"), _s("t", "l_linenumber").alias("test"), F.when(F.col("l_returnflag") == "R", "WEAK_MATCH").otherwise("matched").alias("confidence"))
    return flows.test_links(t.orders.select(F.col("o_orderkey").alias("flow_id")), tests)


_FLOWS = """fl AS (SELECT o_orderkey, 'f' || o_orderkey AS flow_id, 'GET' AS http_method, '/o/' || o_orderkey AS path, 'web' || o_custkey % 5 AS frontend_project, 'a' || o_custkey || '.ts' AS frontend_file, 'svc' AS backend_project, 'B' || o_orderkey % 50 || '.java' AS backend_file,
CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS tests, 'RESOLVED' AS confidence FROM orders), ri AS (SELECT DISTINCT 'f' || l_orderkey AS flow_id FROM lineitem WHERE l_returnflag = 'R'),
ds AS (SELECT substr(sha1('feature-dossier' || chr(0) || flow_id || chr(0) || http_method || chr(0) || path || chr(0)), 1, 24) AS id, http_method || ' ' || path AS route, flow_id, frontend_project, frontend_file, backend_project, backend_file,
CASE WHEN flow_id IN (SELECT flow_id FROM ri) THEN 'risk' WHEN tests = 0 THEN 'missing_tests' ELSE 'low' END AS risk, confidence FROM fl
UNION ALL SELECT substr(sha1('feature-dossier-open-contract' || chr(0) || 'm' || c_custkey || chr(0)), 1, 24), 'GET /c/' || c_custkey, '', 'web' || c_custkey % 5, '', '', '', 'risk', 'UNRESOLVED' FROM customer WHERE c_acctbal < 0)"""


def feature_rows(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        _s("f", "o_orderkey").alias("flow_id"), F.lit("GET").alias("http_method"), _s("/o/", "o_orderkey").alias("path"), F.concat(F.lit("web"), (F.col("o_custkey") % 5).cast("string")).alias("frontend_project"),
        F.concat(_s("a", "o_custkey"), F.lit(".ts")).alias("frontend_file"), F.lit("svc").alias("backend_project"), F.concat(F.lit("B"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".java")).alias("backend_file"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("tests"), F.lit("RESOLVED").alias("confidence"),
    )


def dossier_rows(t: Tables) -> DataFrame:
    risks = t.lineitem.filter("l_returnflag = 'R'").select(_s("f", "l_orderkey").alias("flow_id"))
    closed = F.col("c_acctbal") >= 0
    matches = t.customer.select(
        _s("m", "c_custkey").alias("match_id"), F.concat(F.lit("web"), (F.col("c_custkey") % 5).cast("string")).alias("api_project"), F.lit("GET").alias("api_http_method"), _s("/c/", "c_custkey").alias("api_path"),
        F.when(closed, "matched").otherwise("missing_backend_route").alias("issue"), F.when(closed, "RESOLVED").otherwise("UNRESOLVED").alias("confidence"),
    )
    return flows.dossiers(feature_rows(t), risks, matches)


@query(f"WITH {_FLOWS} SELECT * FROM ds")
def feature_dossiers(t: Tables) -> DataFrame:
    return dossier_rows(t)


@query(f"WITH {_FLOWS} SELECT id, route, risk FROM ds WHERE (backend_project || '/' || backend_file) IN ('svc/B7.java', 'svc/B9.java') OR frontend_project = 'web3'")
def dossier_change_impact(t: Tables) -> DataFrame:
    changed = t.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("svc/B7.java", "/svc\\B9.java/", "web3", "nowhere"))) ).alias("path"))
    return flows.change_impact(dossier_rows(t), changed).select("id", "route", "risk")


@query(f"WITH {_FLOWS} SELECT risk, count(*) AS items FROM ds GROUP BY 1")
def dossier_risk_counts(t: Tables) -> DataFrame:
    return aggregate.risk_counts(dossier_rows(t))


@query(
    """WITH st AS (SELECT DISTINCT l_orderkey AS flow_id, l_suppkey % 30 AS r, 'm' || l_partkey % 3 AS method, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey % 30, 'm' || l_partkey % 3) AS p FROM lineitem),
x AS (SELECT flow_id, 'Repo' || r AS repository, method, 'E' || n_regionkey AS entity, CASE WHEN n_regionkey < 3 THEN r_name ELSE '' END AS "table", p FROM st JOIN nation ON n_nationkey = r JOIN region ON r_regionkey = n_regionkey)
SELECT flow_id, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY p, repository, method) AS INTEGER) AS pos, repository, method, entity, "table" FROM x"""
)
def persistence_paths(t: Tables) -> DataFrame:
    steps = t.lineitem.select(F.col("l_orderkey").alias("flow_id"), F.concat(F.lit("Repo"), (F.col("l_suppkey") % 30).cast("string")).alias("owner"), F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string")).alias("method"), F.col("l_linenumber").alias("pos"))
    repositories = t.nation.select(_s("Repo", "n_nationkey").alias("name"), _s("E", "n_regionkey").alias("entity"))
    entities = t.region.filter("r_regionkey < 3").select(_s("E", "r_regionkey").alias("name"), F.col("r_name").alias("table"))
    return flows.persistence_path(steps, repositories, entities)


@query(
    """WITH st AS (SELECT o_custkey % 100 AS r, count(*) AS steps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), te AS (SELECT s_nationkey AS r, count(*) AS tests FROM supplier GROUP BY 1)
SELECT substr(sha1('workspace-flow' || chr(0) || 'web' || chr(0) || 'a.ts' || chr(0) || c_custkey || chr(0) || 'get' || chr(0) || '/r/' || c_custkey % 100 || '/7' || chr(0) || 'svc' || chr(0)), 1, 24) AS flow_id, c_custkey AS api_line, coalesce(steps, 0) AS steps, coalesce(tests, 0) AS tests, 'RESOLVED' AS confidence
FROM customer LEFT JOIN st ON st.r = c_custkey % 100 LEFT JOIN te ON te.r = c_custkey % 100 WHERE c_acctbal >= 0"""
)
def feature_flow_rows(t: Tables) -> DataFrame:
    at = F.concat(F.lit("/r/"), (F.col("c_custkey") % 100).cast("string"))
    matches = t.customer.select(
        F.lit("web").alias("api_project"), F.lit("a.ts").alias("api_file"), F.col("c_custkey").alias("api_line"), F.lit("get").alias("api_http_method"), F.concat(at, F.lit("/7")).alias("api_path"), F.lit("svc").alias("backend_project"),
        F.lit("GET").alias("backend_http_method"), F.concat(at, F.lit("/{id}")).alias("backend_path"), F.when(F.col("c_acctbal") >= 0, "matched").otherwise("method_mismatch").alias("issue"), F.lit("RESOLVED").alias("confidence"),
    )
    served = lambda df, key: df.select(F.lit("svc").alias("backend_project"), F.lit("get").alias("http_method"), F.concat(F.lit("/R/"), key.cast("string"), F.lit("/{key}/")).alias("path"))
    steps = served(t.orders.join(t.lineitem.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("o_custkey") % 100)
    return flows.feature_flows(matches, steps, served(t.supplier, F.col("s_nationkey"))).select("flow_id", "api_line", "steps", "tests", "confidence")


@query(
    """WITH r AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'event_handler' ELSE 'call' END AS kind FROM supplier)
SELECT c_custkey AS contract_id, s_suppkey AS route_id, CASE WHEN c_custkey % 3 = 0 THEN 'RESOLVED' ELSE 'WEAK_MATCH' END AS confidence, CASE WHEN c_custkey % 3 <> 0 THEN 0.35::DOUBLE WHEN kind = 'event_handler' THEN 0.95 ELSE 0.9 END AS score
FROM customer JOIN r ON s_suppkey = CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 + 1 ELSE (SELECT min(s_suppkey) FROM supplier) END"""
)
def frontend_usages(t: Tables) -> DataFrame:
    caller = F.concat(F.lit("load"), (F.col("c_custkey") % 9 + 1).cast("string"))
    near = F.col("c_custkey") % 3 == 0
    contracts = t.customer.select(F.col("c_custkey").alias("contract_id"), F.lit("web").alias("app"), F.when(near, F.concat(F.lit("s"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(".ts"))).otherwise("other.ts").alias("file"), caller.alias("caller"))
    steps = t.supplier.select(
        F.col("s_suppkey").alias("route_id"), F.col("s_suppkey").alias("route_order"), F.lit("web").alias("app"), F.lit(1).alias("pos"), F.when(F.col("s_acctbal") >= 5000, "event_handler").otherwise("call").alias("kind"),
        _s("Api.load", "s_suppkey").alias("name"), F.concat(_s("s", "s_suppkey"), F.lit(".ts")).alias("file"), F.lit("").alias("reason"),
    )
    return flows.frontend_usage(contracts, steps).select("contract_id", "route_id", "confidence", "score")


_TRACE = """st AS (SELECT o_orderkey AS k, 1 AS stage, 0 AS pos, 'api_contract' AS kind, CASE WHEN o_custkey % 2 = 0 THEN 'load' || o_custkey ELSE 'GET /o/' || o_orderkey END AS label, 'load' || o_custkey AS u FROM orders
UNION ALL SELECT o_orderkey, 2, 0, 'backend_route', 'GET /o/' || o_orderkey, 'route' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 3, 0, 'backend_handler', 'Ctl' || o_custkey % 7, 'handler' FROM orders WHERE o_orderpriority LIKE '1%'
UNION ALL SELECT k, 4, p, 'backend_step', 'UserRepository.find' || s, 'step' || s FROM (SELECT l_orderkey AS k, min(l_linenumber) AS p, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 3)
UNION ALL SELECT o_orderkey, 0, i, 'frontend_step', CASE WHEN i = 1 THEN 'Page' || o_custkey % 5 ELSE 'validateOrder' END, 'page' || i FROM orders, (VALUES (1), (2)) v(i)
UNION ALL SELECT o_orderkey, 5, 1, 'test', 'OrderTest.case' || o_custkey % 4, 'test' FROM orders WHERE o_custkey % 3 = 0),
tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stage, pos, label) AS n, count(*) OVER (PARTITION BY k) AS m FROM st)"""


def trace_rows(t: Tables) -> DataFrame:
    blank = F.lit("")
    served = F.col("o_orderstatus") == "F"
    matches = t.orders.select(
        F.col("o_orderkey").cast("string").alias("trace_id"), F.lit("web").alias("api_project"), F.lit("GET").alias("api_http_method"), _s("/o/", "o_orderkey").alias("api_path"), F.lit("a.ts").alias("api_file"), F.lit(3).alias("api_line"),
        F.when(F.col("o_custkey") % 2 == 0, _s("load", "o_custkey")).otherwise(blank).alias("api_caller"), F.when(served, "svc").otherwise(blank).alias("backend_project"), blank.alias("backend_http_method"), blank.alias("backend_path"),
        F.lit("C.java").alias("backend_file"), F.lit(9).alias("backend_line"), F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("Ctl"), (F.col("o_custkey") % 7).cast("string"))).otherwise(blank).alias("backend_handler"), F.lit("RESOLVED").alias("confidence"),
    )
    steps = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    steps = steps.select(F.col("l_orderkey").cast("string").alias("trace_id"), F.col("l_linenumber").alias("pos"), _s("UserRepository.find", "l_suppkey").alias("name"), F.lit("R.java").alias("file"), F.lit(2).alias("line"))
    page = F.array(F.struct(F.lit(1).alias("pos"), F.concat(F.lit("Page"), (F.col("o_custkey") % 5).cast("string")).alias("name")), F.struct(F.lit(2).alias("pos"), F.lit("validateOrder").alias("name")))
    pages = t.orders.select(F.col("o_orderkey").cast("string").alias("trace_id"), F.explode(page).alias("p")).select("trace_id", "p.*", F.lit("p.tsx").alias("file"), F.lit(5).alias("line"))
    case = F.concat(F.lit("OrderTest.case"), (F.col("o_custkey") % 4).cast("string"))
    tests = t.orders.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("trace_id"), F.lit(1).alias("pos"), case.alias("name"), F.lit("OrderTest.java").alias("file"), F.lit(8).alias("line"))
    return flows.trace_steps(matches, pages, steps, tests)


@query(f"WITH {_TRACE} SELECT CAST(k AS VARCHAR) AS trace_id, CAST(n AS INTEGER) AS n, kind, label FROM tr")
def trace_step_rows(t: Tables) -> DataFrame:
    return trace_rows(t).select("trace_id", "n", "kind", "label")


@query(f"""WITH {_TRACE} SELECT CAST(k AS VARCHAR) AS trace_id, CAST(n AS INTEGER) AS n, CASE kind WHEN 'api_contract' THEN 'api_client' WHEN 'backend_route' THEN 'http_route' WHEN 'backend_handler' THEN 'controller' WHEN 'test' THEN 'test' WHEN 'frontend_step' THEN CASE WHEN label = 'validateOrder' THEN 'validation' ELSE 'event_handler' END ELSE 'repository' END AS role, n = 1 AS is_entry, n = m AS is_exit FROM tr""")
def directed_trace_nodes(t: Tables) -> DataFrame:
    return flows.directed_traces(trace_rows(t))[0].select("trace_id", "n", "role", "is_entry", "is_exit")


@query("""SELECT c_custkey AS test_id, CASE WHEN c_custkey % 7 = 0 THEN 'e1' WHEN c_custkey % 7 < 3 THEN 'e0' ELSE 'e2' END AS endpoint_id FROM customer WHERE c_custkey % 7 < 5""")
def endpoint_test_matches(t: Tables) -> DataFrame:
    shape = F.col("c_custkey") % 7
    path = F.when(shape == 0, F.lit("/orders/all")).when(shape < 3, F.concat(F.lit("/orders/"), F.col("c_custkey").cast("string"), F.lit("/lines"))).when(shape < 5, F.concat(F.lit("/users/"), F.col("c_custkey").cast("string"))).otherwise(F.lit("/nothing/here/at/all"))
    endpoints = [("e0", "GET", "/orders/{id}/lines"), ("e1", "get", "/orders/all"), ("e2", "GET", "/{kind}/{id}"), ("e3", "POST", "/users/{id}")]
    rows = F.array(*(F.struct(F.lit(a).alias("endpoint_id"), F.lit(b).alias("http_method"), F.lit(c).alias("path")) for a, b, c in endpoints))
    table = t.spark.range(1).select(F.explode(rows).alias("e")).select("e.*")
    return flows.endpoint_tests(t.customer.select(F.col("c_custkey").alias("test_id"), F.lit("get").alias("http_method"), path.alias("path")), table)


@query("SELECT 'n' || n_nationkey || '_test.go' AS test, 'n' || n_nationkey || '.go' AS source FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'p/test_m' || s_suppkey || '.py', 'p/m' || s_suppkey || '.py' FROM supplier")
def tests_by_name(t: Tables) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    go = t.nation.select(F.explode(F.array(F.concat(F.lit("n"), key, F.lit("_test.go")), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n"), key, F.lit(".go"))))).alias("path")).filter("path is not null")
    key = F.col("s_suppkey").cast("string")
    python = t.supplier.select(F.explode(F.array(F.concat(F.lit("p/test_m"), key, F.lit(".py")), F.concat(F.lit("p/m"), key, F.lit(".py")))).alias("path"))
    return resolve.tests_by_name(go.unionByName(python))


@query(
    """WITH d AS (SELECT s_suppkey AS id, s_nationkey AS p, s_nationkey AS n, s_suppkey % 40 AS key FROM supplier), u AS (SELECT c_custkey AS usage_id, c_nationkey AS p, c_custkey % 40 AS key, c_custkey % 10 = 0 AS local FROM customer),
c AS (SELECT usage_id, count(DISTINCT d.id) AS candidates, min(d.id) AS one FROM u LEFT JOIN d ON d.key = u.key AND (d.p = u.p OR (u.p < 20 AND d.n = u.p + 1)) WHERE NOT local GROUP BY 1)
SELECT usage_id, CASE candidates WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS resolution, CASE WHEN candidates = 1 THEN 'd' || one END AS symbol_id, candidates FROM c UNION ALL SELECT usage_id, 'EXACT', 'own' || usage_id, 1 FROM u WHERE local"""
)
def usage_resolution(t: Tables) -> DataFrame:
    """A project is a nation; it depends on the artifact of the next one, up to the twentieth."""
    declarations = t.supplier.select(_s("d", "s_suppkey").alias("id"), F.col("s_nationkey").alias("project"), F.col("s_nationkey").alias("artifact"), F.lit("typescript").alias("language"), (F.col("s_suppkey") % 40).alias("key"))
    usages = t.customer.select(F.col("c_custkey").alias("usage_id"), F.col("c_nationkey").alias("project"), F.lit("typescript").alias("language"), F.when(F.col("c_custkey") % 10 == 0, _s("own", "c_custkey")).otherwise("").alias("local_id"), (F.col("c_custkey") % 40).alias("key"))
    needs = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("project"), (F.col("n_nationkey") + 1).alias("artifact"))
    return symbols.resolve_usages(usages, declarations, needs)


@query("""SELECT s_suppkey AS import_id, CASE s_suppkey % 4 WHEN 0 THEN 'src/m' || s_suppkey || '/index.ts' WHEN 1 THEN 'src/m' || (s_suppkey - 1) || '/index.ts' WHEN 2 THEN 'lib/main.js' END AS target, CASE s_suppkey % 4 WHEN 0 THEN 'relative' WHEN 1 THEN 'alias' WHEN 2 THEN 'package' ELSE 'external' END AS how FROM supplier""")
def import_targets(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    module = F.when(k % 4 == 0, F.concat(F.lit("./m"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("@/m"), (k - 1).cast("string"))).when(k % 4 == 2, F.lit("lib")).otherwise(F.lit("react"))
    imports = t.supplier.select(k.alias("import_id"), F.lit("src/app.ts").alias("file"), module.alias("module"))
    known = t.supplier.select(F.concat(F.lit("src/m"), k.cast("string"), F.lit("/index.ts")).alias("path")).union(t.spark.range(1).select(F.lit("src/m0/index.ts")))
    one = t.spark.range(1)
    return symbols.module_targets(imports, known, one.select(F.lit("@/").alias("prefix"), F.lit("src/").alias("replacement")), one.select(F.lit("lib").alias("name"), F.lit("lib/main.js").alias("entry")))


@query("""SELECT 'f' || o_orderkey AS flow_id, 'duplicate_node' AS "check", 'n' || l_linenumber AS item FROM orders JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) ON l_orderkey = o_orderkey
UNION ALL SELECT 'f' || o_orderkey, 'dangling_target', 'e' || o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)
UNION ALL SELECT 'f' || o_orderkey, 'dangling_source', 'e' || o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2)
UNION ALL SELECT 'f' || o_orderkey, 'edge_incomplete', 'e' || o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'f' || o_orderkey, 'model_version', '2' FROM orders WHERE o_orderpriority LIKE '2%'""")
def flow_check(t: Tables) -> DataFrame:
    flow = _s("f", "o_orderkey").alias("flow_id")
    own = t.orders.select(flow, F.when(F.col("o_orderpriority").startswith("2"), 2).otherwise(1).alias("model_version"))
    nodes = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(_s("f", "l_orderkey").alias("flow_id"), _s("n", "l_linenumber").alias("id"), F.lit("step").alias("kind"))
    edges = t.orders.select(flow, _s("e", "o_orderkey").alias("id"), F.lit("n2").alias("from_node_id"), F.lit("n1").alias("to_node_id"), F.lit("calls").alias("edge_type"), F.lit("EXACT").alias("confidence"), F.when(F.col("o_orderstatus") == "P", "").otherwise("seen").alias("reason"))
    return integrity.flow_violations(own, nodes, edges, 1)


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT 'negative_line' AS "check", 'p' || p_partkey AS item FROM part WHERE p_size = 1 UNION ALL SELECT 'invalid_path', 'p' || p_partkey FROM part WHERE p_size = 2
UNION ALL SELECT 'dangling_to_id', 'e' || k FROM e WHERE p % 5 = 0 UNION ALL SELECT 'empty_end', 'e' || k FROM e WHERE f = 'R'
UNION ALL SELECT 'unsorted', 'p' || p_partkey FROM (SELECT *, max('p' || p_partkey) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM part) WHERE b > 'p' || p_partkey
UNION ALL SELECT 'unsorted', 'e' || k FROM (SELECT *, max('e' || k) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) WHERE b > 'e' || k""")
def index_check(t: Tables) -> DataFrame:
    facts = t.part.select(F.col("p_partkey").alias("position"), _s("p", "p_partkey").alias("fact_id"), F.when(F.col("p_size") == 2, "../x.go").otherwise("a/x.go").alias("file"), F.when(F.col("p_size") == 1, -1).otherwise(3).alias("line"), F.lit(4).alias("end_line"))
    rows = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    to = F.when(F.col("p") % 5 == 0, _s("gone", "p")).otherwise(_s("p", "p"))
    edges = rows.select(F.col("k").alias("position"), _s("e", "k").alias("edge_id"), F.when(F.col("f") == "R", "").otherwise(_s("p", "p")).alias("from_id"), to.alias("to_id"), F.lit("").alias("file"), F.lit(1).alias("line"))
    return integrity.index_violations(facts, edges)


_ISSUES = "CASE c_mktsegment WHEN 'BUILDING' THEN 'method_mismatch' WHEN 'MACHINERY' THEN 'unscanned_service' WHEN 'AUTOMOBILE' THEN 'matched' ELSE '' END"


@query(
    f"""WITH m AS (SELECT c_custkey, CASE WHEN {_ISSUES} = '' THEN 'information' ELSE {_ISSUES} END AS code FROM customer),
r AS (SELECT 'diagnostic:' || substr(sha256(code || chr(0) || 'GET' || chr(0) || '/c/' || c_custkey || chr(0) || 'a.ts' || chr(0)), 1, 32) AS id, code, 'RESOLVED' AS confidence, 'a.ts,GET /c/' || c_custkey AS artifacts FROM m
UNION ALL SELECT 'diagnostic:' || substr(sha256('analyzer_failed' || chr(0) || 'web' || chr(0) || n_name || chr(0) || 'calls'), 1, 32), 'analyzer_failed', 'EXACT', 'web,' || n_name || ',calls' FROM nation WHERE n_regionkey = 1)
SELECT id, code, CASE code WHEN 'method_mismatch' THEN 'likely_defect' WHEN 'unscanned_service' THEN 'missing_scan_coverage' WHEN 'analyzer_failed' THEN 'missing_scan_coverage' ELSE 'information' END AS category,
CASE code WHEN 'method_mismatch' THEN 'ERROR' WHEN 'unscanned_service' THEN 'WARNING' WHEN 'analyzer_failed' THEN 'ERROR' ELSE 'INFO' END AS severity, CASE code WHEN 'unscanned_service' THEN 'UNRESOLVED' WHEN 'analyzer_failed' THEN 'UNRESOLVED' ELSE 'PARTIAL' END AS resolution, confidence, artifacts FROM r"""
)
def diagnostics_by_code(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    issue = F.when(segment == "BUILDING", "method_mismatch").when(segment == "MACHINERY", "unscanned_service").when(segment == "AUTOMOBILE", "matched").otherwise("")
    matches = t.customer.select(issue.alias("issue"), F.lit("matched").alias("confidence"), F.lit("GET").alias("api_http_method"), _s("/c/", "c_custkey").alias("api_path"), F.lit("a.ts").alias("api_file"), F.lit("").alias("backend_file"))
    capabilities = t.nation.select(F.lit("web").alias("project"), F.col("n_name").alias("language"), F.lit("calls").alias("capability"), F.when(F.col("n_regionkey") == 1, "FAILED").otherwise("COMPLETE").alias("coverage"))
    return integrity.canonical_diagnostics(matches, capabilities)


def _workspace(t: Tables) -> tuple[DataFrame, DataFrame]:
    blank = F.lit("")
    owned = t.nation.select(_s("n", "n_nationkey").alias("path"), F.col("n_name").alias("name"), F.lit("indexed").alias("status"))
    served = F.col("c_acctbal") >= 0
    matches = t.customer.select(
        _s("m", "c_custkey").alias("match_id"), _s("n", "c_nationkey").alias("api_project"), F.lit("GET").alias("api_http_method"), _s("/c/", "c_custkey").alias("api_path"), F.lit("a.ts").alias("api_file"), F.lit(1).alias("api_line"), blank.alias("api_caller"),
        F.when(served, "n0").otherwise(blank).alias("backend_project"), blank.alias("backend_http_method"), F.lit("/c/{id}").alias("backend_path"), F.lit("C.java").alias("backend_file"), F.lit(2).alias("backend_line"), F.lit("C.get").alias("backend_handler"),
        F.when(served, "matched").otherwise("missing_backend_route").alias("issue"), F.lit("RESOLVED").alias("confidence"),
    )
    candidates = t.customer.filter("c_acctbal < 0").select(_s("m", "c_custkey").alias("match_id"), blank.alias("backend_project"), F.lit("GET /c/{id}").alias("candidate"), F.lit("missing").alias("issue"))
    flow = t.orders.select(
        _s("f", "o_orderkey").alias("flow_id"), F.lit("GET").alias("http_method"), _s("/o/", "o_orderkey").alias("path"), F.lit("n1").alias("frontend_project"), F.lit("o.ts").alias("frontend_file"), F.lit(1).alias("frontend_line"), blank.alias("frontend_caller"),
        F.lit("EXACT").alias("frontend_confidence"), F.lit("n2").alias("backend_project"), F.lit("O").alias("backend_controller"), F.lit("get").alias("backend_method"), F.lit("O.java").alias("backend_file"), F.lit(3).alias("backend_line"), F.lit("RESOLVED").alias("confidence"), blank.alias("risk"),
    )
    steps = t.lineitem.select(_s("f", "l_orderkey").alias("flow_id"), F.lit("n2").alias("project"), blank.alias("kind"), F.lit("Repo").alias("owner"), _s("find", "l_suppkey").alias("name"), F.lit("R.java").alias("file"), F.lit(4).alias("line"), F.lit("EXACT").alias("confidence"))
    features = t.orders.filter("o_orderstatus = 'F'").select(_s("d", "o_orderkey").alias("id"), _s("GET /o/", "o_orderkey").alias("route"), F.lit("n1").alias("frontend_project"), F.lit("n2").alias("backend_project"), blank.alias("backend_handler"), blank.alias("frontend_caller"), _s("f", "o_orderkey").alias("flow_id"), F.lit("RESOLVED").alias("confidence"), F.lit("low").alias("risk"))
    return workspace.workspace_graph(owned, matches, candidates, flow, steps.limit(0), steps, features)


@query("""SELECT 'project' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'contract', count(*) FROM customer UNION ALL SELECT 'route', 1 UNION ALL SELECT 'candidate_route', 1 UNION ALL SELECT 'flow', count(*) FROM orders UNION ALL SELECT 'file', 1 UNION ALL SELECT 'backend_handler', 1
UNION ALL SELECT 'backend_step', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'feature', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def workspace_graph_nodes(t: Tables) -> DataFrame:
    return _workspace(t)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'declares_contract' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'owns_route', 1 UNION ALL SELECT 'resolved_by', count(*) FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'has_candidate', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'has_flow', count(*) FROM orders UNION ALL SELECT 'reaches_project', count(*) FROM orders UNION ALL SELECT 'starts_in', count(*) FROM orders UNION ALL SELECT 'handled_by', count(*) FROM orders
UNION ALL SELECT 'has_backend_step', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT 'summarizes_flow', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def workspace_graph_edges(t: Tables) -> DataFrame:
    return _workspace(t)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 'n' || c_nationkey AS f, CASE WHEN c_custkey % 3 = 0 THEN 'n0' ELSE 'n' || c_custkey % 25 END AS s, 'GET /c/' || c_custkey % 4 AS e, CASE WHEN c_acctbal >= 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM customer),
f AS (SELECT 'n' || s_nationkey AS f, 'n0' AS s, 'GET /c/' || s_suppkey % 8 AS e, 'MISMATCH' AS status FROM supplier), a AS (SELECT * FROM m UNION ALL SELECT * FROM f WHERE (f, s, e) NOT IN (SELECT f, s, e FROM m)),
g AS (SELECT f AS from_service, s AS to_service, count(*) AS total, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'MISMATCH') AS mismatched, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, CAST(0 AS BIGINT) AS out_of_scope, array_to_string(list_sort(list(DISTINCT e))[1:12], ',') AS endpoints FROM a WHERE f <> s GROUP BY 1, 2)
SELECT *, CASE WHEN mismatched > 0 THEN 'mismatches' WHEN unresolved > 0 THEN 'unresolved' ELSE 'resolved' END AS risk FROM g""")
def service_map(t: Tables) -> DataFrame:
    direct = F.col("c_custkey") % 3 == 0
    matches = t.customer.select(_s("n", "c_nationkey").alias("api_project"), F.lit("GET").alias("api_http_method"), F.concat(F.lit("/c/"), (F.col("c_custkey") % 4).cast("string")).alias("api_path"), F.when(direct, "n0").otherwise("").alias("backend_project"), F.concat(F.lit("MS-"), (F.col("c_custkey") % 25).cast("string")).alias("service_candidate"), F.when(F.col("c_acctbal") >= 0, "RESOLVED").otherwise("UNRESOLVED").alias("confidence"))
    flow = t.supplier.select(_s("n", "s_nationkey").alias("frontend_project"), F.lit("n0").alias("backend_project"), F.lit("GET").alias("http_method"), F.concat(F.lit("/c/"), (F.col("s_suppkey") % 8).cast("string")).alias("path"), F.lit("MISMATCH").alias("confidence"))
    services = t.nation.select(_s("ms-", "n_nationkey").alias("service"), _s("n", "n_nationkey").alias("project"))
    return aggregate.service_edges(workspace.service_calls(matches, flow, services))


@query("""WITH d AS (SELECT 'w' AS dir, 0 AS k UNION ALL SELECT 'w/g', 1 UNION ALL SELECT 'w/g/p', 2) SELECT dir, CASE k WHEN 0 THEN 1005 WHEN 1 THEN 102 ELSE 1 END AS score FROM d""")
def workspace_roots(t: Tables) -> DataFrame:
    rows = [("w", "conf.yml"), ("w", ".out"), ("w", "docs"), ("w/g", "frontend"), ("w/g", "services"), ("w/g/p", "backends"), ("w/g/p/q", "src")]
    table = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("dir"), F.lit(b).alias("name")) for a, b in rows))).alias("x")).select("x.*")
    return workspace.workspace_root(table, "conf.yml", ".out", projects.FRONTENDS, projects.BACKENDS)


@query("""SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'auth_error' WHEN 1 THEN 'permission_error' WHEN 2 THEN 'validation_error' WHEN 3 THEN 'not_found' WHEN 4 THEN 'error' WHEN 5 THEN 'success' ELSE 'unspecified' END AS kind,
CASE s_suppkey % 7 WHEN 0 THEN '401' WHEN 1 THEN '403' WHEN 2 THEN '400' WHEN 3 THEN '404' WHEN 5 THEN '2xx' ELSE '' END AS status FROM supplier""")
def test_case_kinds(t: Tables) -> DataFrame:
    names = ("returnsUnauthorized", "isForbidden", "bad_request_x", "userNotFound", "throwsException", "statusIsOk", "worksFine")
    kind, status = flows.test_case(F.get(F.array(*(F.lit(n) for n in names)), (F.col("s_suppkey") % 7).cast("int")))
    return t.supplier.select("s_suppkey", kind.alias("kind"), status.alias("status"))


@query("""SELECT p_partkey, '/p/{_}/' || p_size || '/{_:[0-9]+}' AS hidden, 'web' || p_size % 3 AS app, 'apps/web' || p_size % 3 AS package, p_size % 5 = 0 AS low_signal, p_size % 2 = 0 AS internal FROM part""")
def path_predicates(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    app = F.concat(F.lit("apps/web"), (F.col("p_size") % 3).cast("string"))
    file = F.concat(app, F.when(F.col("p_size") % 5 == 0, F.lit("/Generated/x.ts")).otherwise(F.lit("/src/x.ts")))
    url = F.when(F.col("p_size") % 2 == 0, F.lit("/api/x")).otherwise(F.lit("/x"))
    route = F.concat(F.lit("/p/{id}/"), size, F.lit("/{n:[0-9]+}"))
    return t.part.select("p_partkey", paths.hide_parameter_names(route).alias("hidden"), paths.app_of(file).alias("app"), paths.package_of(file).alias("package"), paths.low_signal(file).alias("low_signal"), paths.frontend_internal(url, F.concat(app, F.lit("/src/x.ts"))).alias("internal"))


_SCAN = """(SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'src/a' || s_suppkey || '.go' WHEN 1 THEN 'Vendor/b' || s_suppkey || '.py' WHEN 2 THEN 'logs/c' || s_suppkey || '.log' WHEN 3 THEN 'keep/c' || s_suppkey || '.log' WHEN 4 THEN 'docs/d' || s_suppkey || '.md' ELSE 'build/e' || s_suppkey || '.sh' END AS path FROM supplier)"""


@query(f"SELECT path, k % 6 = 1 AS excluded, k % 6 IN (2, 5) AS ignored, k % 6 IN (0, 4) AS included FROM {_SCAN}")
def path_filters(t: Tables) -> DataFrame:
    k, key = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    forms = (("src/a", ".go"), ("Vendor/b", ".py"), ("logs/c", ".log"), ("keep/c", ".log"), ("docs/d", ".md"), ("build/e", ".sh"))
    path = F.get(F.array(*(F.concat(F.lit(a), key, F.lit(b)) for a, b in forms)), k.cast("int"))
    rows = t.supplier.select(path.alias("path"))
    globs = "|".join(files.glob_regex(g) for g in ("src/**", "docs/*.md"))
    return rows.select("path", files.excluded(F.col("path"), ["vendor"]).alias("excluded"), files.ignored(F.col("path"), ["*.log", "!keep/*.log", "build/"]).alias("ignored"), F.col("path").rlike(globs).alias("included"))


@query(
    """SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'mvn -Dtest=T' || s_suppkey || '#m test' WHEN 1 THEN 'npx jest a/t' || s_suppkey || '.test.ts' ELSE '' END AS command FROM supplier"""
)
def verification_commands(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    runner = F.when(k % 3 == 0, "maven").when(k % 3 == 1, "jest").otherwise("")
    file = F.concat(F.lit("a/t"), k.cast("string"), F.lit(".test.ts"))
    return t.supplier.select(k.alias("k"), projects.verification_command(runner, file, _s("T", "s_suppkey"), F.lit("m")).alias("command"))


@query("""WITH p AS (SELECT 'n' || n_nationkey AS name, 'n' || (n_nationkey + 1) AS dep FROM nation) SELECT 'node' AS system, name AS "from", dep AS "to", dep IN (SELECT name FROM p) AS internal FROM p UNION ALL SELECT 'node', name, 'react', false FROM p""")
def package_graph(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"name":"n'), F.col("n_nationkey").cast("string"), F.lit('","dependencies":{"n'), (F.col("n_nationkey") + 1).cast("string"), F.lit('":"1"},"devDependencies":{"react":"18"}}'))
    sources = t.nation.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/package.json")).alias("path"), body.alias("content"))
    return projects.package_graph(projects.packages(sources))


@query("SELECT 'p' || n_nationkey || '/package.json' AS path, 'build' || n_nationkey AS name, 'script' AS kind, 1 AS line_no FROM nation")
def manifest_scripts(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"name":"x","scripts":{"build'), F.col("n_nationkey").cast("string"), F.lit('":"tsc"}}'))
    return projects.manifest_symbols(t.nation.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/package.json")).alias("path"), body.alias("content")))


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'frontends/w' ELSE 'services/s' END || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'frontend' ELSE 'backend' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'node' ELSE 'maven' END AS build_system, CASE WHEN n_nationkey % 2 = 0 THEN 'jest' ELSE '' END AS test_runner, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 's' || n_nationkey END AS service FROM nation""")
def workspace_projects(t: Tables) -> DataFrame:
    even, key = F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")
    base = F.concat(F.when(even, F.lit("frontends/w")).otherwise(F.lit("services/s")), key)
    main = F.concat(base, F.when(even, F.lit("/package.json")).otherwise(F.lit("/pom.xml")))
    below = F.concat(base, F.lit("/inner/package.json"))
    rows = t.nation.select(F.explode(F.array(F.struct(main.alias("path"), F.when(even, F.lit('{"devDependencies":{"jest":"1"}}')).otherwise(F.lit("<x/>")).alias("content")), F.struct(below.alias("path"), F.lit("{}").alias("content")))).alias("x")).select("x.*")
    return projects.projects(rows).select("path", "kind", "build_system", "test_runner", "service")


@query("""WITH c AS (SELECT s_nationkey AS k, min(CASE WHEN s_acctbal < 0 THEN 1 WHEN s_acctbal < 3000 THEN 2 WHEN s_acctbal < 6000 THEN 3 ELSE 4 END) AS r FROM supplier GROUP BY 1) SELECT k, CASE r WHEN 1 THEN 'FAILED' WHEN 2 THEN 'UNAVAILABLE' WHEN 3 THEN 'PARTIAL' ELSE 'COMPLETE' END AS coverage FROM c""")
def lowest_coverage(t: Tables) -> DataFrame:
    b = F.col("s_acctbal")
    state = F.when(b < 0, "FAILED").when(b < 3000, "UNAVAILABLE").when(b < 6000, "PARTIAL").otherwise("COMPLETE")
    return aggregate.lowest_coverage(t.supplier.select(F.col("s_nationkey").alias("k"), state.alias("coverage")), "k")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1")
def unique_sorted_values(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return rows.select("l_orderkey", F.array_join(ids.unique_sorted(F.concat("f", F.array(F.lit(""), F.lit(None)))), ",").alias("flags"))


@query("""WITH e AS (SELECT s_suppkey AS id, s_suppkey % 20 AS path, s_nationkey AS project FROM supplier), m AS (SELECT c_custkey AS match_id, c_custkey % 20 AS path, c_nationkey AS project, c_nationkey % 4 AS ap FROM customer),
x AS (SELECT match_id, ap, count(*) AS n, min(id) AS id FROM m JOIN e ON e.path = m.path AND e.project = m.project GROUP BY 1, 2), c AS (SELECT id, count(*) AS consumers, count(DISTINCT ap) AS projects FROM x WHERE n = 1 GROUP BY 1)
SELECT e.id AS endpoint_id, coalesce(consumers, 0) AS consumers, coalesce(projects, 0) AS projects FROM e LEFT JOIN c USING (id)""")
def api_catalog_consumers(t: Tables) -> DataFrame:
    endpoints = t.supplier.select(F.col("s_suppkey").alias("endpoint_id"), F.col("s_nationkey").cast("string").alias("project"), F.lit("GET").alias("http_method"), F.concat(F.lit("/r/"), (F.col("s_suppkey") % 20).cast("string"), F.lit("/{x}")).alias("path"), F.lit("h").alias("handler"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    matches = t.customer.select(F.col("c_custkey").alias("match_id"), (F.col("c_nationkey") % 4).alias("api_project"), F.col("c_nationkey").cast("string").alias("backend_project"), F.lit("get").alias("backend_http_method"), F.concat(F.lit("/R/"), (F.col("c_custkey") % 20).cast("string"), F.lit("/{y}")).alias("backend_path"), F.lit("").alias("backend_handler"), F.lit("").alias("backend_file"), F.lit(0).alias("backend_line"))
    return symbols.api_catalog(endpoints, matches)[0].select("endpoint_id", "consumers", "projects")


@query(
    """WITH o AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_custkey AS c, count(*) AS n FROM (SELECT DISTINCT o_custkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1)
SELECT 'c' || c_custkey AS node, CAST(CASE WHEN o.n IS NULL THEN -120 ELSE least(480, 180 * o.n + 40 * coalesce(l.n, 0)) END AS INTEGER) AS utility FROM customer LEFT JOIN o ON o.c = c_custkey LEFT JOIN l ON l.c = c_custkey"""
)
def forward_utilities(t: Tables) -> DataFrame:
    calls = t.orders.select(_s("co", "o_orderkey").alias("edge_id"), _s("c", "o_custkey").alias("from_id"), _s("o", "o_orderkey").alias("to_id"), F.lit("HTTP_contract ").alias("kind"))
    uses = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("edge_id"), _s("o", "l_orderkey").alias("from_id"), _s("p", "l_partkey").alias("to_id"), F.lit("use").alias("kind"))
    return rendering.forward_utility(calls.unionByName(uses), t.customer.select(_s("c", "c_custkey").alias("node")))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier) SELECT k AS section_id, CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS "first", CASE m WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 4 END AS "last",
CASE m WHEN 0 THEN '2' || chr(9) || 'b' || k || chr(10) || '3' || chr(9) || 'def f' || k || '(' WHEN 1 THEN '1' || chr(9) || 'a' || chr(10) || '2' || chr(9) || 'b' || k || chr(10) || '3' || chr(9) || 'def f' || k || '(' || chr(10) || '4' || chr(9) || '    x):' || chr(10) || '5' || chr(9) || '    pass' || chr(10) || '6' || chr(9)
WHEN 2 THEN '3' || chr(9) || 'def f' || k || '(' || chr(10) || '4' || chr(9) || '    x):' ELSE '' END AS content, CASE m WHEN 3 THEN 'body too long' ELSE '' END AS error FROM s"""
)
def source_sections(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(_s("f", "s_suppkey"), F.lit(".py"))
    sources = t.supplier.select(path.alias("path"), F.replace(F.lit("a\nb~\ndef f~(\n    x):\n    pass\n"), F.lit("~"), k.cast("string")).alias("content"))
    mode = F.when(k % 4 == 1, "focused").when(k % 4 == 2, "signature").otherwise("body")
    sections = t.supplier.select(k.alias("section_id"), path.alias("path"), mode.alias("mode"), F.lit(3).alias("line"), F.lit(2).alias("start_line"), F.when(k % 4 == 3, 500).otherwise(3).alias("end_line"))
    return rendering.render(sources, sections)


@query("SELECT n_nationkey AS k, n_nationkey % 6 IN (0, 3) AS safe FROM nation")
def path_safety(t: Tables) -> DataFrame:
    forms = F.array(*(F.lit(x) for x in ("a/b.go", "../a.go", "/etc/x", "a/../b/./c.go", "a/../../c.go", " ")))
    return t.nation.select(F.col("n_nationkey").alias("k"), rendering.safe_path(F.get(forms, F.col("n_nationkey") % 6)).alias("safe"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS transcript, count(DISTINCT turn) AS items, count(DISTINCT turn) AS tool_calls, count(DISTINCT turn) FILTER (turn % 3 < 2) AS navigation, count(DISTINCT turn) FILTER (turn % 3 = 0) AS reads,
count(DISTINCT turn % 3) FILTER (turn % 3 < 2) AS distinct_commands, CAST(max(turn) * 10 + 5 AS BIGINT) AS tokens FROM conversations GROUP BY 1"""
)
def transcript_costs(t: Tables) -> DataFrame:
    turn, none = F.col("turn"), F.lit(None).cast("string")
    command = F.when(turn % 3 == 0, "cat a | rg b").when(turn % 3 == 1, "/bin/ls -l")
    item = F.struct(_s("i", "turn").alias("id"), none.alias("type"), command.alias("command"), F.when(turn % 3 == 2, "edit").alias("tool"), none.alias("output"))
    usage = F.struct((turn * 4).alias("input_tokens"), (turn * 6 + 5).alias("output_tokens"), F.lit(0).cast("long").alias("total_tokens"))
    return transcripts.metrics(t.conversations.select(F.col("conv_id").cast("string").alias("transcript"), turn.alias("line_no"), F.struct(item.alias("item"), usage.alias("usage")).alias("event")))
