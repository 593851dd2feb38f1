"""String expressions of sources, folded to the few values they can have.

An expression is a sum of literals and names, or a choice between such sums.  Names are resolved in
rounds: the values settled in one round are joined to the names that the next one still waits for, so
an expression is known one round after the last name in it, however many refer to that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written

_TEXT = r'"(?:\\.|[^"\\])*"'
_NAME = r"[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*"
_SUM = rf"^\s*(?:{_TEXT}|{_NAME})(?:\s*\+\s*(?:{_TEXT}|{_NAME}))*\s*$"
DEPTH, MOST = 8, 4


def arms(expression: Column) -> Column:
    """The results of a choice, those of choices within it too, else the expression alone; conditions are dropped."""
    tokens = F.regexp_extract_all(expression, F.lit(rf"{_TEXT}|[?:]|[^\"?:]+|\""), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, token: Column) -> Column:
        done = F.when(token == ":", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(token.isin("?", ":"), F.lit("")).otherwise(F.concat(acc["now"], token)).alias("now"))

    whole = F.aggregate(tokens, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.transform(whole, lambda p: F.regexp_replace(F.trim(p), r"^\(([^()]*)\)$", "$1"))


def fold(expressions: DataFrame, constants: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """(project, node, values): the sorted values of each expression; no row for one that stays unknown.

    expressions: project, node, owner, expression (owner is the type it stands in); constants: project,
    owner, name, expression.  Owner.NAME names a constant of that type; NAME alone one of the own type,
    else the only value of that name in the project.  Unknown are: a call or any other operator, a name
    without a value or declared with different values in types of one name, a null, more than `most`
    values, cycles, and chains of more than `depth` names.  Empty tables give an empty table.
    """
    declared = constants.select("project", F.concat_ws(".", "owner", "name").alias("node"), "owner", "name", "expression", F.lit(True).alias("constant")).distinct()
    asked = expressions.select("project", "node", "owner", F.lit("").alias("name"), "expression", F.lit(False).alias("constant"))
    nodes = declared.unionByName(asked).filter("expression is not null").withColumn("at", F.xxhash64("project", "node", "expression", "constant"))
    arm = nodes.withColumn("arms", arms(F.col("expression"))).withColumn("n_arms", F.size("arms")).select("*", F.posexplode("arms").alias("arm", "sum")).filter(F.col("sum").rlike(_SUM))
    pieces = F.regexp_extract_all("sum", F.lit(rf"{_TEXT}|{_NAME}"), F.lit(0))
    part = arm.select("project", "node", "owner", "name", "constant", "at", "n_arms", "arm", F.posexplode(pieces).alias("pos", "piece"))
    part = part.withColumn("n_parts", F.count("*").over(W.partitionBy("project", "node", "constant", "at", "arm")))
    text = F.when(F.col("piece").startswith('"'), F.regexp_replace(F.expr("substring(piece, 2, length(piece) - 2)"), r"\\(.)", "$1"))
    ref = F.regexp_replace(F.regexp_replace("piece", r"\s+", ""), r"^this\.", "")
    dotted = F.regexp_extract(ref, r"([^.]+\.[^.]+)$", 1)
    names = F.when(text.isNotNull(), F.array(F.lit(None).cast("string"))).when(dotted != "", F.array(dotted)).otherwise(F.array(F.concat_ws(".", "owner", ref), F.concat(F.lit("."), ref)))
    part = written(part.select("*", text.alias("text"), F.posexplode(names).alias("tier", "key")))

    def resolved(values: DataFrame | None) -> DataFrame:
        known = part.withColumn("found", F.when(F.col("text").isNotNull(), F.array("text")))
        if values is not None:
            known = known.join(values.select("project", "key", F.col("values").alias("_v")), ["project", "key"], "left").withColumn("found", F.coalesce("found", "_v")).drop("_v")
        keys = ["project", "node", "name", "constant", "at", "n_arms", "arm"]
        best = known.groupBy(*keys, "n_parts", "pos").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("tier"))).alias("found"))
        sums = best.filter("found is not null").groupBy(*keys, "n_parts").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("parts")).filter(F.size("parts") == F.col("n_parts"))
        both = lambda acc, p: F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(p["found"], lambda v: F.concat(a, v)))))
        grow = lambda acc, p: F.when(F.size(both(acc, p)) <= most, both(acc, p))
        each = sums.withColumn("values", F.aggregate("parts", F.array(F.lit("")), grow))
        whole = each.groupBy(*keys[:-1]).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
        return whole.filter((F.col("n") == F.col("n_arms")) & (F.size("values") <= most))

    def named(values: DataFrame) -> DataFrame:
        """Keys under which names find the values: Owner.NAME, and .NAME; one with different values is no key."""
        rows = values.filter("constant").select("project", "values", F.explode(F.array(F.col("node"), F.concat(F.lit("."), F.col("name")))).alias("key"))
        return rows.groupBy("project", "key").agg(F.min("values").alias("values"), F.max("values").alias("_other")).filter("values = _other").drop("_other")

    values, last = None, None
    for _ in range(depth + 1):
        found = written(resolved(values))
        state = tuple(found.agg(F.count("*"), F.bit_xor(F.xxhash64("project", "node", "values"))).first())
        if state == last:
            break
        values, last = named(found), state
    return found.filter(~F.col("constant")).select("project", "node", "values")

