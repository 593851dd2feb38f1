"""Source trees as tables: files, languages, kinds, path filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By special name, then extension, else text."""
    name = F.lower(basename(path))
    names = F.create_map(*(F.lit(x) for kv in params.LANGUAGE_BY_NAME.items() for x in kv))
    extensions = F.create_map(*(F.lit(x) for kv in params.LANGUAGE_BY_EXTENSION.items() for x in kv))
    return F.coalesce(names[name], extensions[F.regexp_extract(name, r"(\.[^.]*)$", 1)], F.lit("text"))


def kind(path: Column) -> Column:
    name = F.lower(basename(path))
    return F.when(name.isin(*params.BUILD_FILES), "build").when(name == "readme.md", "documentation").otherwise("source")


def is_binary(content: Column) -> Column:
    return (F.locate(chr(0), content.cast("string")) > 0) | ~F.is_valid_utf8(content)


def glob_regex(pattern: str) -> str:
    """``dir/**`` and ``dir/`` cover a folder; otherwise a shell match on the whole path."""
    if pattern.endswith("/**") or pattern.endswith("/"):
        return "^" + re.escape(pattern.rstrip("*").rstrip("/")) + "(/|$)"
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    return f"^{out}$"


def excluded(path: Column, folders: list[str], custom: list[str] = ()) -> Column:
    """Known folders at any depth and in any case; custom excludes only from the root."""
    any_depth = F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(*[f.lower() for f in folders]))
    rooted = F.lit(False)
    for c in custom:
        rooted = rooted | (path == c.rstrip("/")) | path.startswith(c.rstrip("/") + "/")
    return any_depth | rooted


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore rules in order; the last that matches wins, ! keeps."""
    hits = []
    for k, rule in enumerate(r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        keeps, body = rule.startswith("!"), rule.lstrip("!")
        folder, rooted, body = body.endswith("/"), body.startswith("/") or "/" in body.strip("/"), body.strip("/")
        text = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in body).replace("[^/]*[^/]*", ".*")
        match = path.rlike(f"{'^' if rooted else '(^|/)'}{text}{'/' if folder else '(/|$)'}")
        hits.append(F.when(match, F.lit(-(k + 1) if keeps else k + 1)))
    if not hits:
        return F.lit(False)
    last = F.array_max(F.transform(F.filter(F.array(*hits), lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x).alias("at"), x.alias("rule"))))
    return F.coalesce(last["rule"] > 0, F.lit(False))


def file_records(files: DataFrame) -> DataFrame:
    """(path, language, size, sha256, kind) from (path, content)."""
    return files.select("path", language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content"), 256).alias("sha256"), kind(F.col("path")).alias("kind"))


def _listed(spark: SparkSession, root: str, folders: list[str], include: list[str], ignore: list[str]) -> DataFrame:
    """(path, length, content) of the files that path rules keep; content is only read where it is used."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(re.sub("^[a-z]+:/*", "/", base)) + "/", "")
    rows = raw.select(path.alias("path"), "length", "content").filter(language(F.col("path")) != "text")
    if folders:
        rows = rows.filter(~excluded(F.col("path"), list(folders)))
    if ignore:
        rows = rows.filter(~ignored(F.col("path"), list(ignore)))
    if include:
        rows = rows.filter(F.col("path").rlike("|".join(glob_regex(g) for g in include)))
    return rows


def scan(spark: SparkSession, root: str, folders: list[str] = (), include: list[str] = (), ignore: list[str] = (), largest: int = params.MAX_FILE_BYTES) -> DataFrame:
    """(path, content) of a tree's text files; size and path are tested before content is read."""
    rows = _listed(spark, root, folders, include, ignore).filter(F.col("length") <= largest)
    return rows.filter(~is_binary(F.col("content"))).select("path", F.col("content").cast("string").alias("content"))


def skipped(spark: SparkSession, root: str, folders: list[str] = (), include: list[str] = (), ignore: list[str] = (), largest: int = params.MAX_FILE_BYTES) -> DataFrame:
    """(path, size, reason) of the files that scan leaves out though its path rules keep them: too_large or binary."""
    rows = _listed(spark, root, folders, include, ignore)
    big = rows.filter(F.col("length") > largest).select("path", F.col("length").alias("size"), F.lit("too_large").alias("reason"))
    odd = rows.filter(F.col("length") <= largest).filter(is_binary(F.col("content"))).select("path", F.col("length").alias("size"), F.lit("binary").alias("reason"))
    return big.unionByName(odd)
