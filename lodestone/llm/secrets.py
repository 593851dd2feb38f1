"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of a text is a blob named by its SHA-256.  A scan takes the blobs whose pair with the
rule version isn't in the ledger, scans each once however many paths hold it, and appends its
findings; a report joins findings, old and new, back to every path.  A changed rule set has another
version, so it scans every blob again.

A ledger is a folder of three tables, each with a part for every run: paths (path, blob), findings and
scanned (blob, rule_version).  A run writes scanned last, and findings count only for runs that have
it; a run that is lost on the way leaves its blobs unseen.

Defined cases: a null text is the empty blob; very long texts are scanned whole; repeated rows and equal
texts share a blob and each get its findings; a null key is a path like any other; an empty table gives
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared, spread, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least least characters; guard: what a text with one holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    guard: str = ""
    base: bool = False


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 12, "", True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA", True),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, "", True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
)


def version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(path, blob) of every row."""
    return docs.select(F.col(key).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def _hits(text: Column, rule: Rule, order: int) -> Column:
    """Every match as (rule, ordinal, characters since the last match, its length, its group's length).

    split gives the gaps between matches, regexp_extract_all the matches; both only where one exists.
    """
    p = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(order).alias("rule"), i.alias("ordinal"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), F.length(x["value"]).alias("value")),
    )
    found = F.contains(text, F.lit(rule.guard)) if rule.guard else F.rlike(text, p)
    return F.when(found, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<rule:int,ordinal:int,gap:int,size:int,value:int>>"))


def scan(docs: DataFrame, key: str, text: str, paths: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows (blob, rule_version), their findings (blob, rule_version, rule, kind, base, start, end)).

    paths: index(docs).  One path stands for each unseen blob; its text is fetched by path, so a blob
    that a third of all paths share still costs one row.
    """
    ruled = version(rules)
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == ruled).select("blob"), "blob", "left_anti")
    own = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("b", F.sha2("t", 256))
    fresh = own.join(unseen, F.col("k").eqNullSafe(F.col("path")) & (F.col("b") == F.col("blob")), "left_semi")
    hits = fresh.select(F.col("b").alias("blob"), F.explode(F.concat(*(_hits(F.col("t"), r, i) for i, r in enumerate(rules)))).alias("hit")).select("blob", "hit.*")
    # Repeated rows give the same hits again.
    hits = hits.dropDuplicates(["blob", "rule", "ordinal"])
    so_far = W.partitionBy("blob", "rule").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    ends = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far))
    named = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (i, r.kind)))
    least = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (i, r.least)))
    based = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (i, r.base)))
    findings = ends.filter(F.col("value") >= least[F.col("rule")]).select(
        "blob", F.lit(ruled).alias("rule_version"), "rule", named[F.col("rule")].alias("kind"), based[F.col("rule")].alias("base"), (F.col("end") - F.col("size")).alias("start"), "end"
    )
    return unseen.select("blob", F.lit(ruled).alias("rule_version")), findings


def by_blob(findings: DataFrame) -> DataFrame:
    """One row per blob with findings: counts by kind and its spans in order."""
    span = F.struct("start", "rule", "kind", "end", "base")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))


def report(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings at every path that holds their blob; found is null where there are none.

    A blob with very many paths is dealt over several tasks.
    """
    return spread(paths, by_blob(findings), ["blob"], "path", "left")


class Ledger:
    """The tables of a ledger's folder, which driver and executors must share."""

    FINDINGS = "blob string, rule_version string, rule int, kind string, base boolean, start long, end long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, columns: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{columns}, run string").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{columns}, run string")

    def paths(self, key_type: str = "long") -> DataFrame:
        """(path, blob, run): every version that any run saw."""
        return self._read("paths", f"path {key_type}, blob string")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule_version string")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of these rules from all finished runs."""
        runs = self.scanned().select("run").distinct()
        return self._read("findings", self.FINDINGS).filter(F.col("rule_version") == version(rules)).join(runs, "run", "left_semi").drop("run")

    def update(self, docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what no run has scanned under these rules; returns the run's (path, blob)."""
        run = uuid.uuid4().hex
        put = lambda df, name: df.write.parquet(f"{self.folder}/{name}/run={run}")
        put(index(docs, key, text), "paths")
        own = self.spark.read.parquet(f"{self.folder}/paths/run={run}").select("path", "blob")
        # The ledger as it was when the run began.
        fresh, findings = scan(docs, key, text, own, rules, self.scanned())
        put(findings, "findings")
        put(fresh, "scanned")
        return own


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced; found is in order of start."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(keep, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.aggregate(found, state, step, tail)).otherwise(text)


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run on a new ledger, and its report."""
    ledger = Ledger(spark, f"{shared(spark)}/ledger-{uuid.uuid4().hex}")
    paths = ledger.update(table(spark, sf_dir, "documents"), "doc_id", "text")
    return digest(report(paths, ledger.findings()))


def digest(reported: DataFrame) -> DataFrame:
    """Counts, base checksum and spans of each path of a report."""
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    spans = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint,base:boolean>>"))
    return reported.withColumn("found", spans).select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
