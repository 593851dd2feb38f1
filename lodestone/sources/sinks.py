"""Written tables: an incomplete marker first, tables and fingerprints, the complete manifest last."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

SCHEMA_VERSION = 3
# Which tables each target needs.
TARGETS = {
    "agent": ("files", "symbols", "relations", "routes", "contracts", "contract_matches", "call_edges", "flows", "test_map", "evidence", "capabilities", "facts", "fact_edges"),
    "dashboard": ("files", "symbols", "routes", "contracts", "contract_matches", "flows", "most_connected", "modules"),
}


def selected(tables: dict[str, DataFrame], target: str) -> dict[str, DataFrame]:
    """Tables of a target; others are never computed."""
    if target == "all":
        return tables
    if target not in TARGETS:
        raise ValueError(f"unknown target: {target}")
    return {k: v for k, v in tables.items() if k in TARGETS[target]}


def manifest(spark: SparkSession, folder: str, status: str, names: list[str], stamp: str = "") -> None:
    rows = spark.createDataFrame([(SCHEMA_VERSION, status, n) for n in names or [""]], "schema_version int, status string, table string")
    rows.withColumn("stamp", F.lit(stamp)).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")


def write(spark: SparkSession, tables: dict[str, DataFrame], folder: str, target: str = "all") -> list[str]:
    """All tables of a target as Parquet; readers trust a folder only if its manifest is complete.

    Tables go to a folder of this run that the manifest names, so a failed run leaves the last
    complete one readable.
    """
    chosen = selected(tables, target)
    run = uuid.uuid4().hex
    for name, df in chosen.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run}/{name}")
    manifest(spark, folder, "complete", sorted(chosen), run)
    return sorted(chosen)


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a complete folder; another version or an incomplete one is an error."""
    head = spark.read.json(f"{folder}/manifest.json").collect()
    if not head or any(r["schema_version"] != SCHEMA_VERSION for r in head):
        raise ValueError("the folder has another schema version")
    if any(r["status"] != "complete" for r in head):
        raise ValueError("the folder is incomplete")
    return {r["table"]: spark.read.parquet(f"{folder}/{r['stamp']}/{r['table']}") for r in head if r["table"]}


def read_projects(spark: SparkSession, folders: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of several projects with a project column, (project, reason) of those that can't be read).

    Tables of one name are put together by column name; a project that lacks one has no rows in it.
    """
    out: dict[str, DataFrame] = {}
    failed = []
    for project, folder in sorted(folders.items()):
        try:
            own = read(spark, folder)
        except (ValueError, AnalysisException) as e:
            failed.append((project, str(e).split("\n")[0][:200]))
            continue
        for name, df in own.items():
            df = df.withColumn("project", F.lit(project))
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out, spark.createDataFrame(failed, "project string, reason string")


def clean_plan(spark: SparkSession, folder: str) -> list[str]:
    """What a cleaning of the folder would remove: runs that the manifest doesn't name.  Nothing is removed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {r["stamp"] for r in spark.read.json(f"{folder}/manifest.json").collect()}
    held = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n for n in held if re.fullmatch("[0-9a-f]{32}", n) and n not in named)


def clean(spark: SparkSession, folder: str, plan: list[str]) -> None:
    """Removes the runs of a plan that a new one would still name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in sorted(set(plan) & set(clean_plan(spark, folder))):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON file of a small answer."""
    df.coalesce(1).write.mode("overwrite").json(path)


def freshness(files: DataFrame) -> DataFrame:
    """(fingerprint, files): of all sorted paths and hashes, folder by folder."""
    own = files.withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))
    folders = ids.fingerprints(own, "folder").withColumn("all", F.lit(0))
    total = folders.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files")).withColumn("all", F.lit(0))
    one = ids.fingerprints(folders.drop("files"), "all", "folder", "fingerprint").select("all", "fingerprint")
    return total.join(one, "all", "left").select(F.coalesce("fingerprint", F.sha2(F.lit(""), 256)).alias("fingerprint"), "files")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def markdown(df: DataFrame, title: str, template: str, *columns: str, limit: int = 100) -> str:
    """A bounded report: a heading and one line for each row of an ordered table."""
    rows = df.select(F.format_string(template, *columns).alias("line")).limit(limit).collect()
    return "\n".join([f"# {title}", "", *(r["line"] for r in rows)]) + "\n"
