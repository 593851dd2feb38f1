"""What keeps large tables within limits: work dealt over cores, reduced candidates, no guessed broadcasts, rows moved once."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract, flows, resolve, scripts, symbols
from lodestone.plans import code, features, usages
from lodestone.plans.registry import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [code.code, usages.script_sources, usages.java_sources])
def test_texts_of_a_small_file_are_made_by_all_cores(spark, data, made):
    assert made(Tables(spark, data)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_lines_are_read_once_for_the_ends_of_functions(spark, data):
    assert "Join" not in plan(extract.functions_with_ends(code.code(Tables(spark, data))))


def test_candidates_of_one_key_are_reduced_before_they_meet_uses(spark):
    uses = spark.range(300).select(F.col("id").alias("use"), F.lit("get").alias("key"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("own"))
    candidates = spark.range(200).select(F.lit("get").alias("key"), F.col("id").alias("one"), (F.col("id") % 9 + 2).alias("b"), F.floor(F.col("id") / 100).alias("of"))
    tiers = [
        resolve.Tier("last", ((F.col("a"), F.col("b")),), use=F.col("own") == 1, last=True),
        resolve.Tier("same", ((F.col("a"), F.col("b")),), candidate=F.col("of") == 1),
        resolve.Tier("far", use=F.col("own") < 4, apart=(F.col("own"), F.col("of"))),
        resolve.Tier("any"),
    ]
    found = resolve.by_priority(uses, candidates, "key", "use", "one", tiers, "one")
    rows = [(i, i % 9 + 2, i // 100) for i in range(200)]

    def best(use):
        a, own = use % 7, use % 5
        if own == 1 and (hit := [i for i, b, _ in rows if b == a]):
            return use, max(hit), "last"
        if hit := [i for i, b, of in rows if b == a and of == 1]:
            return use, min(hit), "same"
        if own < 4:
            return use, min(i for i, _, of in rows if of != own), "far"
        return use, 0, "any"

    assert sorted(map(tuple, found.collect())) == [best(u) for u in range(300)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "_tier" in joins[0] and "_same" in joins[0]


@pytest.mark.parametrize("made", [code.edges, lambda t: code.handlers(t, code.functions(t)), lambda t: code.java_dependencies(t), lambda t: code.code_flow_steps(t), lambda t: code.endpoint_flow_steps(t), lambda t: code.evidence_rows(t)])
def test_texts_are_not_broadcast_by_the_size_of_their_keys(spark, data, made):
    assert "BroadcastHashJoin" not in plan(made(Tables(spark, data)))


def test_walks_read_routes_as_a_stream(spark, data):
    said = plan(code.code_flow_steps(Tables(spark, data)))
    assert "FlatMapGroupsInPandas" not in said and "MapInArrow" in said


def test_traces_are_moved_once(spark, data):
    steps = features.trace_rows(Tables(spark, data))
    each = lambda df: plan(df).count("Exchange hashpartitioning(trace_id")
    assert each(steps) == each(flows.directed_traces(steps)[0]) == 1


def test_nodes_of_a_trace_that_come_again(spark):
    rows = [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "a"), ("u", 1, "a")]
    steps = spark.createDataFrame([(*r, "test", r[2], "f", 1) for r in rows], "trace_id string, n int, step_id string, kind string, label string, file string, line int")
    nodes, _ = flows.directed_traces(steps)
    got = sorted((r["trace_id"], r["n"], r["is_entry"], r["is_exit"]) for r in nodes.collect())
    assert got == [("t", 1, False, False), ("t", 2, False, False), ("t", 3, False, False), ("u", 1, True, True)]


def moves(df):
    """Keys of the shuffles that a query has run, each once however often it is read."""
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0].split("\n")
    return [re.sub(r"#\d+L?", "", x.group(1)) for line in final if "ReusedExchange" not in line and (x := re.search(r"Exchange hashpartitioning\((.*), \d+\)", line))]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def api_links(spark, some):
    """Small tables of all four links, dealt by chance: with equal rows, projects of one match, places of one step, and nulls."""
    pick = lambda n, *of: [tuple(some.choice(x) for x in of) for _ in range(n)]
    matches, flows_ = pick(9, range(8), ("p", "q", None)), pick(12, range(8), range(9))
    origins, steps = pick(9, range(9), ("a", "b", None)), pick(25, range(9), range(4), ("f", "g", None), ("A", "x.A", "B"))
    java = [(f"j{i}", *r, "") for i, r in enumerate(pick(6, ("p", "q"), ("f", "g"), ("A", "")))]
    java = [(*r, "x.A" if r[3] else "x.B") for r in java]
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return (matches, flows_, origins, steps, java), (
        table(matches, "match_id long, backend_project string"), table(flows_, "match_id long, flow_id long"), table(origins, "flow_id long, consumer_id string"),
        table(steps, "flow_id long, step_id long, file string, owner string"), table(java, "id string, project string, file string, name string, export_name string, qualified_name string"),
    )


def api_rows(matches, flows_, origins, steps, java):
    """reached_through_api by loops."""
    out = set()
    for m, p in set(matches):
        fs = {f for k, f in flows_ if k == m}
        led = {(f, c) for f, c in origins if f in fs and c is not None}
        if not led:
            out.add((m, min(fs, default=None), None, None, None, "frontend_origin_unresolved" if fs else "workspace_feature_flow_missing"))
        several = len(fs) > 1 or len({c for _, c in led}) > 1
        for f, c in led:
            mine = {s for k, s, _, _ in steps if k == f} if p is not None else set()
            if not mine:
                out.add((m, f, c, None, None, "backend_implementation_steps_missing"))
            for s in mine:
                places = {(file, owner) for k, t, file, owner in steps if (k, t) == (f, s)}
                hits = [j[0] for (file, owner), j in product(places, java) if (j[1], j[2]) == (p, file) and owner in (j[3], j[5], j[5][2:])]
                reason = "declaration_missing" if not hits else "several_declarations" if len(hits) > 1 else "several_origins" if several else ""
                out |= {(m, f, c, s, j, reason) for j in hits or [None]}
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", range(4))
def test_symbols_reached_through_api_by_loops(spark, seed):
    rows, tables = api_links(spark, random.Random(seed))
    got = symbols.reached_through_api(*tables).select("match_id", "flow_id", "consumer_id", "step_id", "provider_id", "reason").collect()
    assert sorted(repr(tuple(r)) for r in got) == api_rows(*rows)


def test_links_through_api_are_moved_once(spark, data, no_broadcast):
    found = usages.api_symbol_usages(Tables(spark, data))
    keys = moves(found)
    assert len(keys) <= 12 and keys.count("flow_id") <= 4 and not any("reason" in k for k in keys)


@pytest.mark.parametrize("part", [0, 1])
def test_stages_of_a_flow_are_moved_once_and_dealt_finely(spark, data, part):
    found = flows.data_flow(features.stages(Tables(spark, data)))[part]
    assert plan(found).count("Exchange hashpartitioning(flow_id") == 1
    assert found.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism


def test_data_flow_by_loops(spark):
    some, kinds = random.Random(1), ("request", "request_field", "persistence", "response_field")
    rows = [(some.randrange(40), some.choice(kinds), some.randrange(3), some.choice(("a", "b", "c", None))) for _ in range(120)]
    edges, gaps = flows.data_flow(spark.createDataFrame(rows, "flow_id long, stage string, pos int, label string"))
    steps, holes = [], []
    for flow in {r[0] for r in rows}:
        mine = sorted((kinds.index(k), p, label is not None, label or "") for f, k, p, label in rows if f == flow)
        for (_, _, there, a), (r, _, known, b) in zip(mine, mine[1:], strict=False):
            if there:
                steps.append((flow, a, b if known else None, ("returns", "binds", "persists", "returns")[r]))
                holes += [(flow, "transformation", a, b if known else None)] if r == 2 else []
        if all(r != 1 for r, *_ in mine):
            holes.append((flow, "request", min((b for r, _, known, b in mine if r == 0 and known), default=None), ""))
    said = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert said(edges) == sorted(map(repr, steps)) and said(gaps) == sorted(map(repr, holes))


@pytest.fixture
def eager(spark, monkeypatch):
    """Plans of the tables that a query writes or settles on its way."""
    plans = []
    for place, name in ((scripts, "written"), (symbols, "settle")):
        keep = getattr(place, name)
        monkeypatch.setattr(place, name, lambda df, keep=keep: plans.append(plan(df)) or keep(df))
    return plans


def test_names_of_scripts_are_not_broadcast_by_a_guessed_size(spark, eager):
    texts = {"src/a.ts": "export function load() {}\nexport class Box {}\n", "src/b.ts": "export * from './a';\n", "src/c.ts": "import { load as x, Box } from './b';\nexport { load as y } from './a';\nexport { x };\nfunction f() { x(); new Box(); f(); far(); }\n"}
    sources = spark.createDataFrame([(p, "typescript", c) for p, c in texts.items()], "path string, language string, content string")
    none = spark.createDataFrame([], "prefix string, replacement string"), spark.createDataFrame([], "name string, entry string")
    _, _, used = scripts.script_usages(sources, *none)
    assert len(eager) > 6 and not [x for x in [*eager, plan(used)] if "BroadcastHashJoin" in x]
    assert not any("Window" in x for x in eager)  # tokens are not moved to find their neighbours
    assert sorted((r["name"], r["resolution"]) for r in used.collect()) == [("Box", "EXACT"), ("f", "EXACT"), ("x", "EXACT")]


def test_usages_of_scripts_meet_names_that_are_reduced(spark, data):
    said = plan(usages.script_symbol_usages(Tables(spark, data)))
    assert "BroadcastHashJoin" not in said and "hashpartitioning(usage_id" not in said
