"""The few facts that best fit a question, under a token budget.

Scoring, ranking and the walk along edges run on the fact tables; what reaches the driver is bounded
by the limits here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ranked
from ..operators import graph, rank, sequence
from .. import params

# Bounds of an answer, and costs and gains of paths.
LEAST_TOKENS, DEFAULT_TOKENS, MOST_TOKENS = 256, 4000, 6000
METADATA_TOKENS, SECTIONS, MAX_HOPS, EXPANSIONS, SEED_SCORE = 1100, 12, 7, 256, 180
EDGE_COST = {"calls": 1, "http_contract": 1, "implements": 2, "extends": 2, "uses": 2}
EDGE_WEIGHT = {"http_contract": 180, "calls": 140, "implements": 100, "extends": 100}
SEED_KINDS = ("route", "symbol", "api_contract", "flow_step")


@dataclass
class Pack:
    query: str
    status: str
    seed: dict | None = None
    facts: list[dict] = field(default_factory=list)
    paths: list[list[str]] = field(default_factory=list)
    coverage: str = "none"
    tokens: int = 0

    @property
    def context_id(self) -> str:
        ids = {"facts": sorted(f["fact_id"] for f in self.facts), "paths": sorted(map(tuple, self.paths))}
        return hashlib.sha256(json.dumps(ids, sort_keys=True).encode()).hexdigest()[:24]


def budget(tokens: int = 0) -> int:
    return DEFAULT_TOKENS if not tokens else max(LEAST_TOKENS, min(tokens, MOST_TOKENS))


def anchors(query: str, limit: int = 8) -> list[str]:
    """Verb and path, source files, dotted names and quoted text, in that order; the first few."""
    forms = (r"\b(?:GET|POST|PUT|DELETE|PATCH)\s+/\S+", r"\b[\w./-]+\.(?:go|java|kt|ts|tsx|js|py|php|rs|rb|sh)\b", r"`([^`]{1,256})`", r"\b[A-Za-z_]\w*(?:[.#][A-Za-z_]\w*)+")
    found = [m[1] if m.lastindex else m[0] for f in forms for m in re.finditer(f, query)]
    # A file's last segment is part of its path.
    kept = [x for k, x in enumerate(found) if not any(x in y for y in found[:k])]
    return list(dict.fromkeys(x[:256] for x in kept))[:limit]


def primary(query: str) -> str:
    """The first sentence of the first paragraph."""
    first = next((p for p in re.split(r"\n\s*\n", query.strip()) if p.strip()), "")
    return re.split(r"(?<=[.!?])\s", first.strip())[0]


def scored(facts: DataFrame, query: str) -> DataFrame:
    """Facts with score: exact and term matches, their kind and confidence, and anchors."""
    terms = rank.query_tokens(facts.sparkSession, query)
    matched = rank.matched_terms(terms, F.col("text"))
    score = rank.lexical_score(terms, primary(query), F.col("name"), F.col("qualified_name"), matched)
    kind = F.when(F.col("kind") == "route", 80).when(F.col("kind").isin("symbol", "api_contract"), 60).otherwise(20)
    level = F.when(ranked(F.col("confidence"), params.CONFIDENCE_RANK) >= 6, 30).otherwise(15)
    bonus = F.lit(0)
    for a in anchors(query):
        bonus = bonus + F.when(F.lower("name") == a.lower(), 1000).when(F.contains(F.lower("text"), F.lit(a.lower())), 100).otherwise(0)
    rows = facts.withColumn("matched", matched).withColumn("lexical", score + bonus).filter("lexical > 0")
    return rows.withColumn("score", F.col("lexical") + kind + level)


def seed(ranked_facts: DataFrame) -> dict | None:
    """The best reliable production fact of enough score, else the best test."""
    order = [F.desc("score"), F.desc("matched"), "fact_id"]
    production = ranked_facts.filter(F.col("kind").isin(*SEED_KINDS) & (F.col("score") >= SEED_SCORE) & ~F.lower("file").rlike("(^|/)tests?/|[._]test[._]|_test|test_"))
    for rows in (production, ranked_facts.filter("kind = 'test'")):
        if first := rows.orderBy(*order).limit(1).collect():
            return first[0].asDict()
    return None


def subgraph(edges: DataFrame, start: str, hops: int = MAX_HOPS, cap: int = EXPANSIONS, per_node: int = params.FACTS_PER_NODE) -> list[dict]:
    """Edges within some hops of a fact, at most per_node from each node, from at most cap nodes."""
    few = sequence.cap_per_key(edges, ["from_id"], [F.col("kind"), F.col("edge_id")], per_node).select("from_id", "to_id", "kind", "edge_id")
    begin = edges.sparkSession.createDataFrame([(start,)], "node string")
    nodes = graph.reach(few, begin, hops, "from_id", "to_id").orderBy("depth", "node").limit(cap)
    return [r.asDict() for r in few.join(nodes.select(F.col("node").alias("from_id")), "from_id", "left_semi").collect()]


def cheapest_paths(edges: list[dict], start: str, hops: int = MAX_HOPS, expansions: int = EXPANSIONS) -> list[tuple[int, tuple[str, ...]]]:
    """(cost, nodes) in order of cost: uniform-cost search without repeated nodes in a path."""
    out: dict[str, list[dict]] = {}
    for e in sorted(edges, key=lambda e: (EDGE_COST.get(e["kind"], 3), e["edge_id"])):
        out.setdefault(e["from_id"], []).append(e)
    heap, found = [(0, (start,))], []
    while heap and expansions:
        cost, path = heapq.heappop(heap)
        expansions -= 1
        if len(path) > 1:
            found.append((cost, path))
        if len(path) <= hops:
            for e in out.get(path[-1], ()):
                if e["to_id"] not in path:
                    heapq.heappush(heap, (cost + EDGE_COST.get(e["kind"], 3), (*path, e["to_id"])))
    return found


def greedy_paths(paths: list[tuple[int, tuple[str, ...]]], facts: dict[str, dict], most: int = 8) -> list[tuple[str, ...]]:
    """Paths by gain: new kinds of fact, new folders, lexical score; hops and cost count against them."""
    chosen, kinds, folders = [], set(), set()
    left = list(paths)
    while left and len(chosen) < most:

        def gain(p):
            own = [facts[n] for n in p[1] if n in facts]
            new_kinds = {f["kind"] for f in own} - kinds
            new_folders = {f["file"].rsplit("/", 1)[0] for f in own} - folders
            return 1000 * len(new_kinds) + 300 * len(new_folders) + sum(f.get("score") or 0 for f in own) - 40 * (len(p[1]) - 1) - p[0]

        best = max(left, key=lambda p: (gain(p), p[1]))
        if gain(best) <= 0:
            break
        left.remove(best)
        chosen.append(best[1])
        for n in best[1]:
            if n in facts:
                kinds.add(facts[n]["kind"])
                folders.add(facts[n]["file"].rsplit("/", 1)[0])
    return chosen


def tokens_of(value) -> int:
    return math.ceil(len(json.dumps(value, ensure_ascii=False)) / 4)


def compile_context(facts: DataFrame, edges: DataFrame, query: str, tokens: int = 0, known: str = "") -> Pack:
    """The answer: seed, paths from it, and as many facts as fit; a repeated answer is a short duplicate."""
    limit = budget(tokens)
    rows = scored(facts, query)
    start = seed(rows)
    if start is None:
        return Pack(query, "no_match")
    near = subgraph(edges, start["fact_id"])
    wanted = {start["fact_id"], *(e["from_id"] for e in near), *(e["to_id"] for e in near)}
    ids = facts.sparkSession.createDataFrame([(x,) for x in sorted(wanted)], "fact_id string")
    held = {r["fact_id"]: r.asDict() for r in facts.join(ids, "fact_id", "left_semi").join(rows.select("fact_id", "score"), "fact_id", "left").collect()}
    paths = greedy_paths(cheapest_paths(near, start["fact_id"]), held)
    order = list(dict.fromkeys([start["fact_id"], *(n for p in paths for n in p)]))
    pack = Pack(query, "ok", start)
    room = limit - min(METADATA_TOKENS, limit // 2)
    for n in order:
        fact = {k: held[n][k] for k in ("fact_id", "kind", "name", "qualified_name", "file", "line", "confidence")} if n in held else None
        # What doesn't fit is skipped, not the end.
        if fact and len(pack.facts) < SECTIONS * 2 and pack.tokens + tokens_of(fact) <= room:
            pack.facts.append(fact)
            pack.tokens += tokens_of(fact)
    inside = {f["fact_id"] for f in pack.facts}
    pack.paths = [list(p) for p in paths if set(p) <= inside]
    kinds = {f["kind"] for f in pack.facts}
    pack.coverage = "none" if not pack.facts else "complete" if {"route", "symbol"} <= kinds or len(order) == len(pack.facts) else "partial"
    if known and known == pack.context_id:
        return Pack(query, "duplicate", start)
    return pack
