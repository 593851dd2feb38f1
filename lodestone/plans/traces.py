"""Traces, graphs, service edges and snapshots over events, conversations and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregate, diff, flows, graph, integrity, rank, sequence
from .registry import Tables, query


@query(
    """SELECT * FROM (SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS pos, event_id AS from_node, lead(event_id) OVER w AS to_node, event_type || '_to_' || lead(event_type) OVER w AS edge_kind
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE to_node IS NOT NULL"""
)
def event_trace_edges(t: Tables) -> DataFrame:
    return sequence.step_edges(t.events, "user_id", ["ts", "event_id"], "event_id", "event_type").select("user_id", "pos", "from_node", "to_node", "edge_kind")


_TRANSITIONS = """(SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"""


def transitions(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null")


@query(
    """WITH e AS (SELECT user_id % 10 AS g, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT event_id AS node, event_id NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL) AS is_entry, event_id NOT IN (SELECT src FROM e WHERE dst IS NOT NULL) AS is_exit FROM events"""
)
def event_entry_exit(t: Tables) -> DataFrame:
    edges = sequence.step_edges(t.events, "user_id", ["ts", "event_id"], "event_id", "event_type")
    return graph.ends(edges, t.events.select(F.col("event_id").alias("node")), "from_node", "to_node")


@query(
    """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
k AS (SELECT conv_id, turn, role, text FROM c WHERE before IS NULL OR before <> role),
n AS (SELECT conv_id, turn, row_number() OVER w AS pos, role || '_to_' || lead(role) OVER w AS edge_kind FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, CAST(pos AS INTEGER) AS pos, turn AS from_node, edge_kind FROM n WHERE edge_kind IS NOT NULL"""
)
def conversation_chain(t: Tables) -> DataFrame:
    steps = sequence.collapsed(t.conversations, "conv_id", ["turn", "role", "text"], "role")
    return sequence.step_edges(steps, "conv_id", ["turn", "role", "text"], "turn", "role").select("conv_id", "pos", "from_node", "edge_kind")


@query(
    """SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'user') AS user_turns,
count(*) - count(DISTINCT sha256(text)) AS repeated, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY 1"""
)
def transcript_metrics(t: Tables) -> DataFrame:
    once = t.conversations.select("conv_id", "turn", "role", "text").distinct()
    return once.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_distinct("role").alias("roles"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("repeated"),
        F.sum(F.ceil(F.length("text") / 4)).cast("long").alias("tokens"),
    )


@query(
    """SELECT DISTINCT o.o_orderkey, l.l_linenumber, c.c_name, p.p_name, s.s_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE o.o_orderstatus = 'F'"""
)
def order_flow(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    flow = (
        o.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return flow.select("o_orderkey", "l_linenumber", "c_name", "p_name", "s_name").distinct()


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def endpoints_without_tests(t: Tables) -> DataFrame:
    tested = t.orders.filter("o_custkey % 3 <> 0")
    return integrity.untested(t.customer, [("c_custkey", tested, "o_custkey"), ("c_nationkey", t.supplier.filter("s_acctbal < 0"), "s_nationkey")]).select("c_custkey", "c_name")


@query(
    """WITH f AS (SELECT user_id, list(DISTINCT event_type) AS front FROM events WHERE value >= 50 GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS back FROM events WHERE value < 50 OR value IS NULL GROUP BY 1)
SELECT user_id, field FROM (SELECT user_id, unnest(list_filter(front, lambda x: NOT list_contains(back, x))) AS field FROM f JOIN b USING (user_id))"""
)
def field_risk(t: Tables) -> DataFrame:
    front = F.coalesce(F.col("value") >= 50, F.lit(False))
    rows = t.events.select("user_id", F.col("event_type").alias("field"), front.alias("front"))
    return flows.field_risks(rows.filter("front"), rows.filter("not front"), "user_id")


_CALLS = """(SELECT c.c_nationkey AS f, s.s_nationkey AS s, CASE WHEN l_returnflag = 'R' THEN 'MISMATCH' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, p.p_type || '/' || l_linestatus AS endpoint
FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey JOIN part p ON p_partkey = l_partkey)"""


def nation_calls(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "MISMATCH").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "UNRESOLVED").otherwise("RESOLVED")
    rows = (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return rows.select(F.col("c_nationkey").alias("from_service"), F.col("s_nationkey").alias("to_service"), status.alias("status"), F.concat_ws("/", "p_type", "l_linestatus").alias("endpoint"))


@query(
    f"""WITH a AS (SELECT f, s, count(*) AS total, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'MISMATCH') AS mismatched, count(*) FILTER (status = 'UNRESOLVED') AS unresolved,
array_to_string(list_sort(list(DISTINCT endpoint))[1:12], ',') AS endpoints FROM {_CALLS} WHERE f <> s GROUP BY 1, 2)
SELECT f AS from_service, s AS to_service, total, resolved, mismatched, unresolved, CAST(0 AS BIGINT) AS out_of_scope, endpoints, CASE WHEN mismatched > 0 THEN 'mismatches' WHEN unresolved > 0 THEN 'unresolved' ELSE 'resolved' END AS risk FROM a"""
)
def service_edge_rollup(t: Tables) -> DataFrame:
    return aggregate.service_edges(nation_calls(t))


@query(
    f"""WITH e AS (SELECT f, s, count(*) AS n FROM {_CALLS} WHERE f <> s GROUP BY 1, 2)
SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT f AS node, n AS o, 0 AS i FROM e UNION ALL SELECT s, 0, n FROM e) GROUP BY 1"""
)
def service_degree(t: Tables) -> DataFrame:
    edges = nation_calls(t).filter("from_service <> to_service").groupBy("from_service", "to_service").agg(F.count("*").alias("n"))
    return aggregate.node_degree(edges, "from_service", "to_service", "n")


@query(
    """WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS code, l_linestatus AS project, CASE WHEN l_linenumber % 2 = 0 THEN '/' || strftime(l_shipdate, '%Y') || '/{variant}' ELSE '/' || strftime(l_shipdate, '%Y') END AS pattern,
  CASE l_returnflag WHEN 'R' THEN 'UNRESOLVED' WHEN 'A' THEN 'PARTIAL' ELSE 'MATCHED' END AS r FROM lineitem)
SELECT code, project, pattern, count(*) AS count, count(*) FILTER (r = 'MATCHED') AS matched, count(*) FILTER (r = 'PARTIAL') AS partial, count(*) FILTER (r = 'UNRESOLVED') AS unresolved, CAST(0 AS BIGINT) AS out_of_scope, min(id) AS first_id FROM d GROUP BY 1, 2, 3"""
)
def diagnostic_families(t: Tables) -> DataFrame:
    year = F.date_format("l_shipdate", "yyyy")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("call to /"), year, F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("?q=1 fails"))).otherwise(F.concat(F.lit("no route /"), year))
    resolution = F.when(F.col("l_returnflag") == "R", "UNRESOLVED").when(F.col("l_returnflag") == "A", "PARTIAL").otherwise("MATCHED")
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("project"), text.alias("explanation"), resolution.alias("resolution"))
    return aggregate.diagnostic_families(rows).drop("first_explanation")


@query(
    """WITH r AS (SELECT l_suppkey AS service, count(*) AS contracts FROM lineitem GROUP BY 1)
SELECT service, project, contracts, CAST(row_number() OVER (ORDER BY contracts DESC, project, service) AS INTEGER) AS rank FROM (
SELECT service, s_name AS project, contracts FROM r JOIN supplier ON s_suppkey = service WHERE s_acctbal >= 5000 ORDER BY contracts DESC, project, service LIMIT 10)"""
)
def coverage_next(t: Tables) -> DataFrame:
    references = t.lineitem.select(F.col("l_suppkey").alias("service"))
    known = t.supplier.select(F.col("s_suppkey").alias("service"), F.col("s_name").alias("project"), (F.col("s_acctbal") < 5000).alias("indexed"))
    return aggregate.next_scans(aggregate.known_and_missing(references, known))


@query(
    """WITH b AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT o_custkey, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (o_custkey) WHERE b.n IS DISTINCT FROM a.n OR b.p IS DISTINCT FROM a.p"""
)
def snapshot_diff(t: Tables) -> DataFrame:
    day = F.lit("1997-01-01").cast("timestamp")
    state = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return diff.entity_diff(state(t.orders.filter(F.col("o_orderdate") < day)), state(t.orders.filter(F.col("o_orderdate") >= day)), "o_custkey", "n", "p")


@query(
    """SELECT COALESCE(b.p, a.p) AS p_partkey, CASE WHEN b.p IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-07-01') b
FULL JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1992-07-01') a ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL"""
)
def set_delta(t: Tables) -> DataFrame:
    parts = lambda cond: t.lineitem.filter(cond).select(F.col("l_partkey").alias("p_partkey"))
    early = F.col("l_shipdate") < F.lit("1992-07-01").cast("timestamp")
    return diff.set_delta(parts(early), parts(~early), "p_partkey")


_EDGES = """e AS (SELECT 'o' || o_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def order_edges(t: Tables) -> DataFrame:
    """Customers use orders, orders use parts (once for each line)."""
    p = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    uses = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(p("o", "l_orderkey").alias("src"), p("p", "l_partkey").alias("dst"))
    return uses.unionByName(t.orders.select(p("c", "o_custkey").alias("src"), p("o", "o_orderkey").alias("dst")))


@query(
    f"""WITH {_EDGES}, c AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1),
h1 AS (SELECT src AS node, count(*) AS hits FROM e WHERE dst IN (SELECT node FROM c) GROUP BY 1), h2 AS (SELECT src AS node, count(*) AS hits FROM e WHERE dst IN (SELECT node FROM h1) GROUP BY 1)
SELECT node, 1 AS depth, hits FROM h1 UNION ALL SELECT node, 2, hits FROM h2"""
)
def change_impact(t: Tables) -> DataFrame:
    changed = t.part.filter("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.impact(order_edges(t), changed, 3)


_TREE = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def hierarchy(t: Tables) -> DataFrame:
    p = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda df, a, x, b, y: df.select(p(a, x).alias("src"), p(b, y).alias("dst"))
    return (
        edge(t.nation, "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(edge(t.supplier, "n", "s_nationkey", "s", "s_suppkey"))
        .unionByName(edge(t.customer, "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(edge(t.orders, "c", "o_custkey", "o", "o_orderkey"))
    )


_PATHS = f"""WITH RECURSIVE {_TREE}, r AS (SELECT 'r1' AS node, 0 AS depth, 'r1' AS path UNION ALL SELECT e.dst, depth + 1, path || ' > ' || e.dst FROM r JOIN e ON e.src = r.node WHERE depth < 4)"""


@query(f"{_PATHS} SELECT node, depth FROM r")
def hierarchy_reach(t: Tables) -> DataFrame:
    return graph.reach(hierarchy(t), t.spark.range(1).select(F.lit("r1").alias("node")), 4).select("node", "depth")


@query(f"{_PATHS} SELECT node, depth, min(path) AS path FROM r WHERE node LIKE 's%' GROUP BY 1, 2")
def shortest_paths(t: Tables) -> DataFrame:
    return graph.reach(hierarchy(t), t.spark.range(1).select(F.lit("r1").alias("node")), 4).filter("node like 's%'")


@query(f"{_PATHS}, f AS (SELECT node, depth, path FROM r WHERE depth > 0 ORDER BY depth, path LIMIT 101) SELECT node, depth, CAST(n AS INTEGER) AS n, truncated FROM (SELECT node, depth, row_number() OVER (ORDER BY depth, path) AS n, (SELECT count(*) FROM f) > 100 AS truncated FROM f) WHERE n <= 100")
def bounded_reach_truncated(t: Tables) -> DataFrame:
    return graph.bounded_reach(hierarchy(t), t.spark.range(1).select(F.lit("r1").alias("node")), 4, 100).select("node", "depth", "n", "truncated")


@query(f"WITH {_TREE} SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1 HAVING count(*) > 1")
def out_degree_branches(t: Tables) -> DataFrame:
    return graph.branches(hierarchy(t))


@query(f"WITH {_TREE} SELECT 'out' AS direction, dst AS other FROM e WHERE src = 'n3' UNION ALL SELECT 'in', src FROM e WHERE dst = 'n3'")
def explain_node(t: Tables) -> DataFrame:
    return graph.neighbours(hierarchy(t), "n3")


@query(
    """SELECT node, label, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS k FROM (
SELECT 'n' || n_nationkey AS node, n_name AS label, CASE WHEN lower(n_name) = 'nation_1' THEN 100 WHEN contains(lower(n_name), 'nation_1') THEN 60 END AS score FROM nation) WHERE score IS NOT NULL) WHERE k = 1"""
)
def node_best_match(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    return rank.lookup(nodes, " Nation_1 ").limit(1).withColumnRenamed("id", "node")


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_TRANSITIONS} WHERE dst IS NOT NULL),
w AS (SELECT src AS first, dst AS last, [src, dst] AS walk, src = dst AS closed FROM e UNION ALL SELECT first, dst, list_append(walk, dst), dst = first FROM w JOIN e ON e.src = w.last WHERE NOT closed AND len(walk) <= 3 AND (dst = first OR NOT list_contains(walk, dst)))
SELECT DISTINCT array_to_string(walk, ' > ') AS cycle, CAST(len(walk) - 1 AS INTEGER) AS length FROM w WHERE closed"""
)
def cycles_small(t: Tables) -> DataFrame:
    return graph.cycles(transitions(t).select("src", "dst"), 3)


@query(
    f"""WITH RECURSIVE e AS (SELECT c_custkey AS a, 100000 + (c_custkey * 7 + c_nationkey) % 211 * 7 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1"""
)
def weak_components(t: Tables) -> DataFrame:
    e = t.customer.select(F.col("c_custkey").alias("src"), (100000 + (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 211 * 7).alias("dst"))
    return graph.components(e)


@query(
    """WITH p AS (SELECT event_id AS probe_id, user_id, ts FROM events WHERE event_type = 'view'), f AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT probe_id, user_id, (SELECT CASE WHEN count(DISTINCT event_id) = 1 THEN min(event_id) END FROM f WHERE f.user_id = p.user_id AND f.ts = (SELECT max(ts) FROM f WHERE f.user_id = p.user_id AND f.ts <= p.ts)) AS event_id FROM p"""
)
def asof_fact(t: Tables) -> DataFrame:
    probes = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("probe_id"), "user_id", "ts")
    facts = t.events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return sequence.nearest_before(probes, facts, "user_id", "ts", "event_id").select("probe_id", "user_id", "event_id")


@query(
    """WITH i AS (SELECT user_id, event_id AS name, ts AS low, lead(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high FROM events QUALIFY high IS NOT NULL), p AS (SELECT event_id AS point_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT p.user_id, p.point_id, (SELECT max({'l': low, 'n': name}).n FROM i WHERE i.user_id = p.user_id AND p.ts BETWEEN low AND high) AS name FROM p WHERE EXISTS (SELECT 1 FROM i WHERE i.user_id = p.user_id AND p.ts BETWEEN low AND high)"""
)
def enclosing_interval(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    intervals = t.events.select("user_id", F.col("event_id").alias("name"), F.col("ts").alias("low"), F.lead("ts", 3).over(w).alias("high")).filter("high is not null")
    points = t.events.filter("event_type = 'click'").select(F.col("event_id").alias("point_id"), "user_id", "ts")
    return sequence.enclosing(points, intervals, "user_id", "ts", "low", "high", "name")


@query(
    """SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank, all_rows FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS all_rows FROM events) WHERE rank <= 24"""
)
def cap_per_node(t: Tables) -> DataFrame:
    return sequence.cap_per_key(t.events, ["user_id"], [F.col("value"), F.col("event_id")], 24).select("user_id", "event_id", "rank", "all_rows")


@query("SELECT user_id, arg_min(event_id, {'t': ts, 'e': event_id}) AS first_event, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event FROM events GROUP BY 1")
def first_and_last(t: Tables) -> DataFrame:
    first = sequence.first_per_key(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_id").alias("first_event"))
    last = sequence.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("last_event"))
    return first.join(last, "user_id")
