"""Queries whose SQL leaves rows out, against brute force on whole tables."""

import math
import random
from collections import Counter
from itertools import permutations

from lodestone.operators import sequence
from lodestone.plans.catalogue import QUERIES


def test_cycles_of_all_transitions(spark, data):
    traces = {}
    for r in spark.read.parquet(f"{data}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        traces.setdefault(r["user_id"], []).append(r["event_type"])
    edges = {(a, b) for kinds in traces.values() for a, b in zip(kinds, kinds[1:])}
    kinds = sorted({x for e in edges for x in e})
    want = {(" > ".join((*walk, walk[0])), n) for n in (1, 2, 3) for walk in permutations(kinds, n) if all(e in edges for e in zip(walk, (*walk[1:], walk[0])))}
    got = [(r["cycle"], r["length"]) for r in QUERIES["cycles_small"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any("view" in cycle for cycle, _ in got)


def fold(items, budget):
    used = 0
    for *_, cost in items:
        fits = None if cost is None else used + cost <= budget
        used += cost if fits else 0
        yield fits


def test_every_document_has_a_taken_flag(spark, data):
    sources = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        sources.setdefault(r["source"], []).append((r["n_chars"], r["doc_id"], math.ceil(len(r["text"]) / 4)))
    want = Counter((source, d, cost, fits) for source, items in sources.items() for (_, d, cost), fits in zip(sorted(items), fold(sorted(items), 4000)))
    assert want == Counter((r["source"], r["doc_id"], r["cost"], r["taken"]) for r in QUERIES["budget_pack"](spark, data).collect())


def test_budget_fold_of_any_order_and_repeated_rows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1, 2, 3, 5, 8, 13, 40, 90, 200])) for _ in range(1500)]
    got = sequence.budget_fold(spark.createDataFrame(rows, "g string, n int, cost long"), "g", ["n"], "cost", 150).collect()
    want = Counter()
    for g in ("a", "b", None):
        # Nulls come first, as in the sort of structs.
        own = sorted((x[1:] for x in rows if x[0] == g), key=lambda x: tuple((v is not None, v or 0) for v in x))
        want.update((g, n, cost, fits) for (n, cost), fits in zip(own, fold(own, 150)))
    assert Counter((r["g"], r["n"], r["cost"], r["taken"]) for r in got) == want


def test_weak_labels_are_merged_too(spark, data):
    facts = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        facts.setdefault(r["doc_id"], []).append((4, "INFERRED", r["lang"], "doc"))
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    for r in labels:
        facts.setdefault(r["doc_id"], []).append((9, "EXACT", None, "label") if r["quality"] == 1 else (3, "WEAK", None, "label"))
    want = sorted((d, max(own, key=lambda x: x[0])[1], min((x[2] for x in own if x[2]), default=None), ",".join(sorted({x[3] for x in own}))) for d, own in facts.items())
    assert any(r["quality"] == 0 for r in labels)
    assert sorted((r["doc_id"], r["confidence"], r["text"], r["evidence"]) for r in QUERIES["merge_stronger"](spark, data).collect()) == want
