"""Ordered computations: steps, chains, first and last records, caps, budgets, intervals, as-of lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_edges(steps: DataFrame, trace: str, order: list[str], node: str, kind: str) -> DataFrame:
    """An edge from each step to the next of its trace; its kind is both kinds."""
    w = W.partitionBy(trace).orderBy(*order)
    nxt = F.lead(F.struct(F.col(node).alias("n"), F.col(kind).alias("k"))).over(w)
    rows = steps.select(trace, F.row_number().over(w).alias("pos"), F.col(node).alias("from_node"), F.col(kind).alias("from_kind"), nxt.alias("next")).filter("next is not null")
    return rows.select(trace, "pos", "from_node", F.col("next.n").alias("to_node"), F.concat_ws("_to_", "from_kind", F.col("next.k")).alias("edge_kind"))


def collapsed(steps: DataFrame, trace: str, order: list[str], value: str) -> DataFrame:
    """Steps without those that repeat the one before."""
    w = W.partitionBy(trace).orderBy(*order)
    return steps.withColumn("_previous", F.lag(value).over(w)).filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(value))).drop("_previous")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def cap_per_key(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most cap rows for each key, and how many the key has."""
    w = W.partitionBy(*keys)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("all_rows", F.count("*").over(w)).filter(F.col("rank") <= cap)


def budget_fold(rows: DataFrame, group: str, order: list[str], cost: str, budget: int, salts: int = 64) -> DataFrame:
    """Rows with taken: in order, each that still fits is taken, and a miss is only skipped.

    Costs are not negative; without a cost, taken is null.  The room never grows, so after a miss
    every later row of that cost or more misses too: of a cost c only the first budget / c rows of a
    group can be taken, and only those are folded, about budget * ln(budget) of a group however large.
    """
    keys = [group, *order, "_cost"]
    # Equal rows are one item with a count, as they are next to each other in order.
    items = rows.select(group, *order, F.col(cost).cast("long").alias("_cost")).groupBy(*keys).agg(F.count("*").alias("_n"))
    most = F.floor(F.lit(budget) / F.col("_cost"))
    first = items.filter(F.col("_cost").between(1, budget)).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    # First within salts, so that a large group is not ranked by one task.
    for part in ([group, "_cost", "_salt"], [group, "_cost"]):
        first = first.withColumn("_k", F.row_number().over(W.partitionBy(*part).orderBy(*order))).filter(F.col("_k") <= most)
    packed = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, "_cost", "_n"))).alias("items"))
    kind = packed.schema["items"].dataType
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        n = F.least(x["_n"], F.floor((F.lit(budget) - acc["used"]) / x["_cost"]))
        some = F.struct(*(x[c].alias(c) for c in order), x["_cost"].alias("_cost"), n.alias("_n"))
        return F.struct((acc["used"] + n * x["_cost"]).cast("long").alias("used"), F.when(n > 0, F.concat(acc["taken"], F.array(some))).otherwise(acc["taken"]).alias("taken"))

    found = packed.select(F.col(group).alias("_g"), F.explode(F.aggregate("items", start, step, lambda acc: acc["taken"])).alias("_x"))
    same = [F.col(group).eqNullSafe(F.col("_g")), *(F.col(c).eqNullSafe(F.col(f"_x.{c}")) for c in order), F.col("_cost") == F.col("_x._cost")]
    fits = F.when(F.col("_cost") == 0, F.lit(budget >= 0)).when(F.col("_cost").isNotNull(), F.col("_i") <= F.coalesce("_x._n", F.lit(0)))
    each = items.join(found, same, "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return each.select(group, *order, F.col("_cost").alias(cost), fits.alias("taken"))


def nearest_before(probes: DataFrame, facts: DataFrame, key: str, at: str, fact: str) -> DataFrame:
    """For each probe the facts of its key at the latest time not after it; a tie of facts gives none.

    One union and one window: the latest fact seen so far is carried along, so no pair of a probe
    and an earlier fact is formed.
    """
    latest = facts.groupBy(key, at).agg(F.count_distinct(fact).alias("_ties"), F.min(fact).alias("_fact"))
    both = latest.select(key, at, F.struct("_ties", "_fact").alias("_f"), F.lit(None).cast("long").alias("probe_id")).unionByName(
        probes.select(key, at, F.lit(None).cast(latest.select(F.struct("_ties", "_fact").alias("_f")).schema["_f"].dataType).alias("_f"), F.col("probe_id").cast("long"))
    )
    # At one time, facts stand before probes.
    w = W.partitionBy(key).orderBy(at, F.col("_f").isNull(), "probe_id").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_f", ignorenulls=True).over(w)).filter("probe_id is not null")
    return seen.select(key, at, "probe_id", F.when(F.col("_last._ties") == 1, F.col("_last._fact")).alias(fact))


def enclosing(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, name: str) -> DataFrame:
    """For each point the interval of its key that holds it and starts last, later names on ties.

    Points and intervals of a key are read once in order, with a stack of the intervals that may still
    hold a point, so no pair of a point and an interval is made.  Points outside all intervals have no row.
    """
    own = intervals.select(F.col(key).alias("k"), F.col(low).alias("t"), F.lit(0).alias("o"), F.col(name).alias("n"), F.col(high).alias("h"))
    rows = own.unionByName(points.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("o"), F.col("point_id").alias("p")), allowMissingColumns=True)
    rows = rows.filter("k is not null and t is not null").repartition("k").sortWithinPartitions("k", "t", "o", "n").select("k", "t", "o", "n", "h", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            found = []
            for k, t, o, n, h, p in zip(*(c.to_pylist() for c in batch.columns)):
                if k != current:
                    current, stack = k, []
                if o == 0:
                    if h is not None and h >= t:
                        stack.append((h, n))
                    continue
                while stack and stack[-1][0] < t:
                    stack.pop()
                if stack:
                    found.append((k, p, stack[-1][1]))
            kinds = [batch.schema.field(c).type for c in ("k", "p", "n")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(3)], ["k", "p", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"k {kinds['k']}, p {kinds['p']}, n {kinds['n']}").select(F.col("k").alias(key), F.col("p").alias("point_id"), F.col("n").alias(name))
