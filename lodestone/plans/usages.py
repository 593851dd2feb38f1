"""What names in sources mean: script and Java files made from the tables, with imports through barrels, hidden names,
and security rules by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import java, scripts, security, symbols
from ..operators.graph import sized, written
from .registry import Tables, query

PROVIDER = """export function load~() {}
export class Box~ {}
export interface Shape~ {}
function hidden~() {}
export { hidden~ as shown~ };
export function common() {}
"""
CONSUMER = """import { load~, shown~, Box~, gone~, common } from '../lib/r^';
import type { Shape~ } from '../lib/n~';
import * as all from '../lib/n~';
import { far } from 'outside';
export function work@(value: Shape~) {
  load~(value); shown~(); gone~();
  const b: Box~ = new Box~();
  far(); common(); all.load~();
  return help@(b);
}
function help@(shown~) {
  shown~();
  [1].map((load~) => load~());
  { const Box~ = 1; new Box~(); }
  new Other();
  return load~();
}
"""


def script_sources(t: Tables) -> DataFrame:
    """(path, language, content): a provider for each nation, a barrel for each region, a consumer for each customer."""
    fill = lambda text, nation: F.replace(F.lit(text), F.lit("~"), nation.cast("string"))
    nation = F.col("n_nationkey")
    name = lambda folder, key: F.concat(F.lit(folder), key.cast("string"), F.lit(".ts"))
    providers = t.nation.select(name("lib/n", nation).alias("path"), fill(PROVIDER, nation).alias("content"))
    line = F.concat(F.lit("export * from './n"), nation.cast("string"), F.lit("';\n"))
    barrels = t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("content")).select(name("lib/r", F.col("n_regionkey")).alias("path"), "content")
    who = t.dealt("customer", "c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == nation)
    text = F.replace(F.replace(fill(CONSUMER, nation), F.lit("^"), F.col("n_regionkey").cast("string")), F.lit("@"), F.col("c_custkey").cast("string"))
    consumers = who.select(name("app/c", F.col("c_custkey")).alias("path"), text.alias("content"))
    return providers.unionByName(barrels).unionByName(consumers).withColumn("language", F.lit("typescript")).select("path", "language", "content")


def _rows(*rows: tuple) -> str:
    """SQL of the usages of every consumer: (line, type, name, what it means, why it means nothing)."""
    text = lambda v: "replace(replace('" + v + "', '~', CAST(n AS VARCHAR)), '@', CAST(k AS VARCHAR))"
    parts = []
    for line, kind, name, meaning, reason in rows:
        resolution = "CASE WHEN m > 1 THEN 'AMBIGUOUS' ELSE 'EXACT' END" if meaning == "common" else f"'{'EXACT' if meaning else 'UNRESOLVED'}'"
        symbol = "CASE WHEN m = 1 THEN 'lib/n' || n || '#common' END" if meaning == "common" else text(meaning) if meaning else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT 'app/c' || k || '.ts' AS path, {line} AS line, '{kind}' AS type, {text(name)} AS name, {resolution} AS resolution, {symbol} AS symbol, '{reason}' AS reason FROM c")
    return "WITH c AS (SELECT c_custkey AS k, n_nationkey AS n, count(*) OVER (PARTITION BY n_regionkey, c_custkey) AS one, (SELECT count(*) FROM nation x WHERE x.n_regionkey = nation.n_regionkey) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey) " + " UNION ALL ".join(parts)


_HIDDEN, _FREE = "lexically shadowed by an inner scope", "constructor has no static module binding"


@query(
    _rows(
        (5, "type_reference", "Shape~", "lib/n~#Shape~", ""), (6, "calls_export", "load~", "lib/n~#load~", ""), (6, "calls_export", "shown~", "lib/n~#hidden~", ""), (6, "calls_export", "gone~", "", ""),
        (7, "type_reference", "Box~", "lib/n~#Box~", ""), (7, "instantiates", "Box~", "lib/n~#Box~", ""), (8, "calls_export", "far", "", ""), (8, "calls_export", "common", "common", ""), (8, "calls_export", "load~", "lib/n~#load~", ""),
        (9, "calls_local", "help@", "app/c@#help@", ""), (12, "calls_export", "shown~", "", _HIDDEN), (13, "calls_export", "load~", "", _HIDDEN), (14, "instantiates", "Box~", "", _HIDDEN), (15, "instantiates", "Other", "", _FREE),
        (16, "calls_export", "load~", "lib/n~#load~", ""),
    )
)
def script_symbol_usages(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "prefix string, replacement string"), t.spark.createDataFrame([], "name string, entry string")
    declared, _, used = scripts.script_usages(script_sources(t), *none)
    named = declared.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol"))
    # Usages without a symbol are spread by their file.
    used = used.withColumn("symbol_id", F.coalesce("symbol_id", F.concat(F.lit("-"), "path")))
    return used.join(sized(named), "symbol_id", "left").select("path", "line", "type", "name", "resolution", "symbol", "reason")


@query(
    """WITH m AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (SELECT k, k * 2 + i AS f, c FROM m, (VALUES (0), (1)) v(i) WHERE c % 5 <> 0 AND (i = 0 OR c % 5 = 1)),
g AS (SELECT k, f, 'page' || c AS u FROM f WHERE c % 7 <> 0), w AS (SELECT k, c, count(f) AS nf, min(f) AS ff FROM m LEFT JOIN f USING (k, c) GROUP BY 1, 2),
st AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'N'), p AS (SELECT s, CASE WHEN s % 4 = 0 THEN 0 WHEN s % 3 = 0 THEN 2 ELSE 1 END AS n FROM st GROUP BY 1),
r AS (SELECT g.k, g.f, g.u, st.s, p.n, nf, CASE WHEN n > 0 THEN 'j' || st.s || '-' || i END AS id FROM g JOIN w USING (k) LEFT JOIN st USING (k) LEFT JOIN p USING (s) LEFT JOIN (VALUES (1), (2)) v(i) ON i <= n),
x AS (SELECT k, f, u, s, id, CASE WHEN s IS NULL THEN 'backend_implementation_steps_missing' WHEN n = 0 THEN 'declaration_missing' WHEN n > 1 THEN 'several_declarations' WHEN nf > 1 THEN 'several_origins' ELSE '' END AS reason FROM r
UNION ALL SELECT k, ff, NULL, NULL, NULL, CASE WHEN nf = 0 THEN 'workspace_feature_flow_missing' ELSE 'frontend_origin_unresolved' END FROM w WHERE k NOT IN (SELECT k FROM g))
SELECT k AS match_id, f AS flow_id, u AS consumer_id, s AS step_id, id AS provider_id, reason, CASE WHEN reason = '' THEN 'EXACT' WHEN reason LIKE 'several%' THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolution,
CASE WHEN reason = '' THEN 'reached_through_api' WHEN reason LIKE 'several%' THEN 'ambiguous' ELSE 'unresolved' END AS category FROM x"""
)
def api_symbol_usages(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    matches = t.orders.select(F.col("o_orderkey").alias("match_id"), F.lit("svc").alias("backend_project"))
    both = F.when(c % 5 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = t.orders.filter(c % 5 != 0).select(F.col("o_orderkey").alias("match_id"), c.alias("c"), F.explode(both).alias("i")).withColumn("flow_id", F.col("match_id") * 2 + F.col("i"))
    origins = each.filter("c % 7 <> 0").select("flow_id", F.concat(F.lit("page"), F.col("c").cast("string")).alias("consumer_id"))
    used = t.lineitem.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("step_id"))
    owner = F.concat(F.lit("S"), F.col("step_id").cast("string"))
    steps = used.join(each.select("match_id", "flow_id"), "match_id").select("flow_id", "step_id", F.concat(owner, F.lit(".java")).alias("file"), owner.alias("owner"))
    k = F.col("s_suppkey")
    name = F.concat(F.lit("S"), k.cast("string"))
    copies = F.when(k % 4 == 0, F.array().cast("array<int>")).when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    java = t.supplier.select(k, F.explode(copies).alias("i")).select(
        F.concat(F.lit("j"), k.cast("string"), F.lit("-"), F.col("i").cast("string")).alias("id"), F.lit("svc").alias("project"), F.concat(name, F.lit(".java")).alias("file"),
        F.when(F.col("i") == 1, name).otherwise("").alias("name"), F.lit("").alias("export_name"), F.concat(F.lit("shop.p"), F.col("i").cast("string"), F.lit("."), name).alias("qualified_name"),
    )
    return symbols.reached_through_api(matches, each.select("match_id", "flow_id"), origins, steps, java)


# A controller for each part; ^ is its project (the part's size), & its path, and @ what stands above its method.
CONTROLLER = """package shop;
@RestController
@Secured("ROLE_^")
class C~ {
  @
  @GetMapping("&")
  String get() { return ""; }
}
"""
PATHS = ("/api/k", "/api/k/{id}", "/other/~", "/base/~")
ABOVE = ("@PermitAll", '@Secured("OWN")', "@PreAuthorize(\"hasRole('A')\")", "@Deprecated")
ROUTES = 'class Routes {\n  static final String ROOT = "/api";\n  static final String KEYS = ROOT + Names.KEY;\n}\nclass Names {\n  static final String KEY = "/k";\n}\n'
# Security of a project by its number mod 6: (order, matcher or none, rule).
CHAINS = (
    (),
    ((1, "Routes.KEYS", "permitAll()"), (2, 'Routes.ROOT + "/**"', "authenticated()")),
    ((1, '"/api/**"', "permitAll()"), (1, '"/api/**"', "authenticated()"), (2, '"/**"', "x509()")),
    ((7, '"/api/k/**", "/other/**"', "httpBasic()"), (7, '"/api/**"', "formLogin()"), (9, "on ? Routes.KEYS : Routes.ROOT", "permitAll()")),
    ((3, "", 'hasRole("ADMIN")'), (1, '"/base/**"', "authenticated()"), (2, "find()", "permitAll()")),
    ((1, "find()", "oauth2Login()"), (2, 'find(), "/api/k"', "authenticated()")),
)


def java_sources(t: Tables) -> DataFrame:
    """(path, language, content): a controller for each part, and for each size of parts the constants and configurations of a project."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))
    text = F.lit(CONTROLLER)
    for mark, value in (("@\n", F.concat(pick(ABOVE, key), F.lit("\n"))), ("&", pick(PATHS, F.floor(key / 4))), ("^", size.cast("string")), ("~", key.cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    controllers = t.dealt("part", "p_partkey", "p_size").select(F.concat(F.lit("m"), size.cast("string"), F.lit("/src/main/java/C"), key.cast("string"), F.lit(".java")).alias("path"), text.alias("content"))
    method = lambda n, order, matcher, rule: f"  @Order({order})\n  SecurityFilterChain c{n}(HttpSecurity http) {{\n" + (f"    http.securityMatcher({matcher});\n" if matcher else "") + f"    http.authorize(r -> r.anyRequest().{rule});\n    return http.build();\n  }}\n"
    head = "import org.springframework.security.config.annotation.web.builders.HttpSecurity;\nimport org.springframework.security.web.SecurityFilterChain;\n@Configuration\nclass Config {\n"
    configs = [head + "".join(method(n, *chain) for n, chain in enumerate(chains)) + "}\n" for chains in CHAINS]
    folder = F.concat(F.lit("m"), size.cast("string"), F.lit("/src/main/java/"))
    each = F.array(F.struct(F.concat(folder, F.lit("Config.java")).alias("path"), pick(configs, size).alias("content")), F.struct(F.concat(folder, F.lit("Routes.java")).alias("path"), F.lit(ROUTES).alias("content")))
    projects = t.part.select("p_size").distinct().select(F.explode(each).alias("f")).select("f.*")
    return controllers.unionByName(projects).withColumn("language", F.lit("java")).select("path", "language", "content")


@query(
    """WITH e AS (SELECT 'm' || p_size AS project, p_size % 6 AS c, 'C' || p_partkey AS controller, p_partkey % 4 AS a, p_size AS s, (p_partkey // 4) % 4 AS r,
CASE (p_partkey // 4) % 4 WHEN 0 THEN '/api/k' WHEN 1 THEN '/api/k/{id}' WHEN 2 THEN '/other/' || p_partkey ELSE '/base/' || p_partkey END AS path FROM part),
g(c, r, kind, category, confidence) AS (VALUES (1, 0, 'permit_all', 'public', 'EXTRACTED'), (1, 1, 'authenticated', 'authenticated', 'EXTRACTED'),
(2, 0, 'permit_all', 'public', 'PARTIAL'), (2, 0, 'authenticated', 'authenticated', 'PARTIAL'), (2, 1, 'permit_all', 'public', 'PARTIAL'), (2, 1, 'authenticated', 'authenticated', 'PARTIAL'), (2, 2, 'x509', 'mtls', 'EXTRACTED'), (2, 3, 'x509', 'mtls', 'EXTRACTED'),
(3, 0, 'http_basic', 'basic', 'EXTRACTED'), (3, 1, 'http_basic', 'basic', 'EXTRACTED'), (3, 2, 'http_basic', 'basic', 'EXTRACTED'),
(4, 0, 'has_role', 'role', 'EXTRACTED'), (4, 1, 'has_role', 'role', 'EXTRACTED'), (4, 2, 'has_role', 'role', 'EXTRACTED'), (4, 3, 'authenticated', 'authenticated', 'EXTRACTED'),
(5, 0, 'authenticated', 'authenticated', 'PARTIAL'), (5, 1, 'oauth2_login', 'oauth2', 'PARTIAL'), (5, 2, 'oauth2_login', 'oauth2', 'PARTIAL'), (5, 3, 'oauth2_login', 'oauth2', 'PARTIAL')),
u AS (SELECT project, controller, path, kind, category, CASE kind WHEN 'has_role' THEN '"ADMIN"' ELSE '' END AS expression, 'security_config_call' AS source, confidence FROM e JOIN g USING (c, r)
UNION ALL SELECT project, controller, path, 'secured', 'role', 'ROLE_' || s, 'class_annotation', 'EXTRACTED' FROM e WHERE a <> 1
UNION ALL SELECT project, controller, path, 'secured', 'role', 'OWN', 'method_annotation', 'EXTRACTED' FROM e WHERE a = 1
UNION ALL SELECT project, controller, path, 'permit_all', 'public', '', 'method_annotation', 'EXTRACTED' FROM e WHERE a = 0
UNION ALL SELECT project, controller, path, 'pre_authorize', 'role', 'hasRole(''A'')', 'method_annotation', 'EXTRACTED' FROM e WHERE a = 2)
SELECT *, bool_or(category = 'public') OVER w AND bool_or(category NOT IN ('public', 'unknown')) OVER w AS conflicting FROM u WINDOW w AS (PARTITION BY project, controller, path)"""
)
def endpoint_security(t: Tables) -> DataFrame:
    # Files are scanned once: nearly every step below reads their records.
    records = written(java.java_records(java_sources(t))).withColumn("project", F.split("path", "/")[0])
    return security.endpoint_security(records).select("project", "controller", "path", "kind", "category", "expression", "source", "confidence", "conflicting")
