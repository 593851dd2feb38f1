"""Names resolved to records by tiers of priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import sized


@dataclass(frozen=True)
class Tier:
    """Which candidates fit a use: their values equal the use's in every pair of same (use, candidate).

    use and candidate are conditions on one side alone; apart is a pair that must differ; last takes the last
    candidate instead of the first.
    """

    name: str
    same: tuple[tuple[Column, Column], ...] = ()
    use: Column | None = None
    candidate: Column | None = None
    apart: tuple[Column, Column] | None = None
    last: bool = False


def by_priority(uses: DataFrame, candidates: DataFrame, key: str, use_id: str, order: str, tiers: list[Tier], result: str) -> DataFrame:
    """(use_id, result, tier): for each use the first candidate of the best tier that holds.

    Candidates share key with the use; tiers are best first.  Candidates are reduced to the first one for
    each tier and its values (two, where a pair must differ) before they meet uses, so a use meets at most
    two rows of a tier, however many candidates have its key.
    """

    def told(df: DataFrame, side: int, *kept: str) -> DataFrame:
        each = []
        for k, t in enumerate(tiers):
            values = [pair[side].cast("string") for pair in t.same]
            other = F.lit(None).cast("string") if t.apart is None else t.apart[side].cast("string")
            ok = F.lit(True)
            for c in [(t.use, t.candidate)[side], *(v.isNotNull() for v in values), *((other.isNotNull(),) if t.apart else ())]:
                ok = ok if c is None else ok & c
            each.append(F.when(ok, F.struct(F.lit(k).alias("tier"), F.array(*values).cast("array<string>").alias("same"), other.alias("apart"))))
        return df.select(key, *kept, F.explode(F.array(*each)).alias("_t")).filter("_t is not null").select(key, *kept, F.col("_t.tier").alias("_tier"), F.col("_t.same").alias("_same"), F.col("_t.apart").alias("_apart"))

    at = [key, "_tier", "_same"]
    lasts = [k for k, t in enumerate(tiers) if t.last]
    one = F.struct(F.col(order).alias("_order"), F.col(result).alias("_result"))
    mine = candidates.select(key, one.alias("_c"), *(c for c in candidates.columns if c != key))
    best = F.min("_c")
    best = F.when(F.first("_tier").isin(*lasts), F.max("_c")).otherwise(best) if lasts else best
    first = told(mine, 1, "_c").groupBy(*at, F.col("_apart").alias("_other")).agg(best.alias("_c"))
    if any(t.apart for t in tiers):
        # The first of the two differs from the use, or the second does.
        first = first.withColumn("_n", F.row_number().over(W.partitionBy(*at).orderBy("_c"))).filter("_n <= 2").drop("_n")
    met = told(uses, 0, use_id).join(sized(first), at).filter("_apart is null or _apart <> _other")
    chosen = met.groupBy(use_id).agg(F.min(F.struct("_tier", "_c")).alias("m"))
    names = F.array(*(F.lit(t.name) for t in tiers))
    return chosen.select(use_id, F.col("m._c._result").alias(result), F.get(names, F.col("m._tier")).alias("tier"))


def with_cardinality(uses: DataFrame, candidates: DataFrame, key: str, use_id: str, result: str) -> DataFrame:
    """(use_id, resolution, result): none, one or several distinct candidates."""
    found = uses.join(candidates, key, "left").groupBy(use_id).agg(F.count_distinct(result).alias("n"), F.min(result).alias("one"))
    resolution = F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "EXACT").otherwise("AMBIGUOUS")
    return found.select(use_id, resolution.alias("resolution"), F.when(F.col("n") == 1, F.col("one")).alias(result))


def scored_once(uses: DataFrame, candidates: DataFrame, key: str, use_id: str, score: Column, result: str) -> DataFrame:
    """(use_id, result): the best scored candidate, null if several share the best score."""
    s = uses.join(candidates, key).withColumn("_s", score).filter(F.col("_s").isNotNull())
    top = s.withColumn("_r", F.rank().over(W.partitionBy(use_id).orderBy(F.desc("_s")))).filter("_r = 1")
    return top.groupBy(use_id).agg(F.count("*").alias("n"), F.min(result).alias("one")).select(use_id, F.when(F.col("n") == 1, F.col("one")).alias(result))


def clean_path(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0)
        return F.when((s == "") | (s == "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def local_imports(relations: DataFrame, files: DataFrame, go_module: str = "") -> DataFrame:
    """Import targets rewritten to files of the project, where there is one.

    relations: from, to, type, line, language; files: path, language.  Go packages go to the first
    file of their folder, Python modules to their file or package, Shell and script paths are taken
    relative to the importing file.
    """
    go = files.filter("language = 'go'").groupBy(folder(F.col("path")).alias("_key")).agg(F.min("path").alias("_file")).withColumn("_lang", F.lit("go"))
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    python = files.filter("language = 'python'").select(F.replace(module, F.lit("/"), F.lit(".")).alias("_key"), F.col("path").alias("_file"), F.lit("python").alias("_lang"))
    plain = files.filter("language in ('shell', 'php', 'javascript', 'typescript')").select(F.col("path").alias("_key"), F.col("path").alias("_file"), F.col("language").alias("_lang"))
    stem = files.filter("language in ('javascript', 'typescript')").groupBy(F.regexp_replace("path", r"(/index)?\.[jt]sx?$", "").alias("_key"), F.col("language").alias("_lang")).agg(F.min("path").alias("_file"))
    targets = go.unionByName(python).unionByName(plain).unionByName(stem).groupBy("_key", "_lang").agg(F.min("_file").alias("_file"))
    near = clean_path(F.concat_ws("/", folder(F.col("from")), F.col("to")))
    want = (
        F.when((F.col("language") == "go") & F.lit(bool(go_module)) & F.col("to").startswith(go_module), F.regexp_replace(F.substr("to", F.lit(len(go_module) + 1)), "^/", ""))
        .when(F.col("language") == "python", F.col("to"))
        .when(F.col("language").isin("shell", "php"), near)
        .when(F.col("to").startswith("."), near)
    )
    r = relations.withColumn("_want", want)
    out = r.join(targets, (r["_want"] == targets["_key"]) & (r["language"] == targets["_lang"]), "left")
    return out.select("from", F.coalesce("_file", "to").alias("to"), "type", "line", F.col("_file").isNotNull().alias("local"))


def tests_by_name(files: DataFrame) -> DataFrame:
    """(test, source) by naming rules, only where the source exists."""
    p = F.col("path")
    source = (
        F.when(p.endswith("_test.go"), F.regexp_replace(p, r"_test\.go$", ".go"))
        .when(p.rlike(r"(^|/)test_[^/]*\.py$"), F.regexp_replace(p, r"(^|/)test_([^/]*\.py)$", "$1$2"))
        .when(p.rlike(r"_test\.py$"), F.regexp_replace(p, r"_test\.py$", ".py"))
        .when(p.rlike(r"\.(test|spec)\.[jt]sx?$"), F.regexp_replace(p, r"\.(test|spec)(\.[jt]sx?)$", "$2"))
        .when(p.rlike(r"Test\.(php|java)$"), F.regexp_replace(p, r"Test(\.(php|java))$", "$1"))
    )
    tests = files.select(p.alias("test"), source.alias("source")).filter("source is not null")
    return tests.join(files.select(F.col("path").alias("source")), "source", "left_semi").select("test", "source")
