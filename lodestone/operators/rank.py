"""Lexical ranking and free-text filters over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ranked
from ..functions.text import held_terms, tokens
from .. import params

# Scores.
EXACT_QUALIFIED, EXACT_NAME, ALL_TERMS, PER_TERM = 900, 800, 500, 60


def free_text(query: str, *columns: str) -> Column:
    """An empty query keeps all; else a case-insensitive substring of the joined values."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q))


def query_tokens(spark, query: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def matched_terms(terms: list[str], text: Column, cased: bool = True) -> Column:
    """How many of the terms are tokens of the text; cased=False: the text has no capitals."""
    if not cased:
        return held_terms(text, terms)
    asked = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    some = F.lit(False)
    for t in terms:
        some = some | F.contains(F.lower(text), F.lit(t))
    return F.when(some, F.size(F.array_intersect(asked, tokens(text)))).otherwise(0)


def lexical_score(terms: list[str], query: str, name: Column, qualified: Column, matched: Column) -> Column:
    """Exact names, all terms, and a share for each term."""
    q = query.strip().lower()
    exact = F.when(F.lower(qualified) == q, EXACT_QUALIFIED).when(F.lower(name) == q, EXACT_NAME).otherwise(0)
    every = F.when((matched == len(terms)) & F.lit(len(terms) > 0), ALL_TERMS).otherwise(0)
    return exact + every + matched * PER_TERM


def rank_facts(facts: DataFrame, query: str, limit: int, cased: bool = True) -> DataFrame:
    """Facts (fact_id, name, qualified_name, kind, confidence, text) by score, matches, confidence and id."""
    terms = query_tokens(facts.sparkSession, query)
    # The terms are counted once, in a projection of their own, and not again for the score and the filter.
    counted = facts.withColumn("matched", matched_terms(terms, F.col("text"), cased))
    scored = counted.withColumn("score", lexical_score(terms, query, F.col("name"), F.col("qualified_name"), F.col("matched"))).filter("score > 0")
    scored = scored.withColumn("_c", ranked(F.col("confidence"), params.CONFIDENCE_RANK))
    return scored.orderBy(F.desc("score"), F.desc("matched"), F.desc("_c"), "fact_id").limit(limit).drop("_c")


def search(query: str, limit: int, *tables: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """(source, label) of rows of several tables that hold the query, in table order."""
    out = None
    for k, (name, df, columns) in enumerate(tables):
        rows = df.filter(free_text(query, *columns)).select(F.lit(k).alias("ordinal"), F.lit(name).alias("source"), F.concat_ws(" ", *columns).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("ordinal", "label").limit(limit).select("source", "label")


def lookup(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes (id, kind, label, project, file, symbol, method, path) that fit a text, with score, best first, then by id.

    A node's score is the first rule that holds; absent columns count as empty.
    """
    q = text.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in nodes.columns else F.lit("")
    node, label, project, file, symbol, kind = (low(c) for c in ("id", "label", "project", "file", "symbol", "kind"))
    route = F.trim(F.concat(low("method"), F.lit(" "), low("path")))
    holds = lambda c: F.contains(c, F.lit(q))
    # The scores of the rules, in order.
    rules = (
        (node == q, 120),
        ((kind == "file") & (file == q), 115),
        ((kind == "backend_handler") & (symbol == q), 114),
        (symbol == q, 110),
        (project == q, 105),
        (label == q, 100),
        (route == q, 95),
        (file == q, 90),
        (holds(node), 70),
        (holds(symbol), 65),
        (holds(label), 60),
        (holds(project), 55),
        (holds(file) & (kind == "file"), 54),
        (holds(file), 45),
        (holds(F.concat_ws(" ", node, label, project, file, symbol, route)), 30),
    )
    score = F.lit(None).cast("int")
    for rule, points in reversed(rules):
        score = F.when(rule, points).otherwise(score)
    return nodes.withColumn("score", score if q else F.lit(None).cast("int")).filter("score is not null").orderBy(F.desc("score"), "id")
