"""Projects of a workspace from its file paths, and the packages that their descriptors name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that mark a project's root, folders that are skipped, and groups of projects.
MARKERS = (
    "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "go.mod", "pyproject.toml", "requirements.txt", "setup.py",
    "Cargo.toml", "composer.json", "build.sbt", "Package.swift", "Gemfile", "CMakeLists.txt", "meson.build",
)
MARKER_PATTERN = r"\.(gemspec|sln|csproj)$"
SKIPPED = ("node_modules", "vendor", "target", "build", "dist", "coverage")
FRONTENDS = ("frontend", "frontends")
BACKENDS = ("microservices", "services", "backends")
RUNNER_CONFIGS = {"playwright": ("playwright.config.ts", "playwright.config.js", "playwright.config.mjs"), "vitest": ("vitest.config.ts", "vitest.config.js", "vitest.config.mts"), "jest": ("jest.config.ts", "jest.config.js", "jest.config.cjs")}
RUNNER_WORDS = (("playwright", "@playwright/test"), ("vitest", "vitest"), ("jest", "jest"))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def projects(files: DataFrame) -> DataFrame:
    """(path, name, kind, build_system, test_runner, service) of folders that hold a marker.

    files: path, content (content of package.json only is read).  A marked folder hides those below it;
    hidden and skipped folders are not looked into, and the workspace itself is no project.
    """
    parts = F.split(F.col("path"), "/")
    held = files.select("path", F.when(_name(F.col("path")) == "package.json", F.lower("content")).alias("manifest"), _folder(F.col("path")).alias("dir"), _name(F.col("path")).alias("file"))
    seen = held.filter((F.col("dir") != "") & ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: s.startswith(".") | F.lower(s).isin(*SKIPPED)))
    has = lambda *names: F.max(F.col("file").isin(*names))
    word = F.max("manifest")
    runner = F.lit("")
    for kind, text in reversed(RUNNER_WORDS):
        runner = F.when(F.coalesce(F.contains(word, F.lit(text)), F.lit(False)), kind).otherwise(runner)
    for kind, names in reversed(RUNNER_CONFIGS.items()):
        runner = F.when(has(*names), kind).otherwise(runner)
    build = F.when(has("pom.xml"), "maven").when(has("build.gradle", "build.gradle.kts"), "gradle").when(has("package.json"), "node").when(has("go.mod"), "go").otherwise("")
    marked = F.max(F.col("file").isin(*MARKERS) | F.col("file").rlike(MARKER_PATTERN))
    folders = seen.groupBy("dir").agg(marked.alias("marked"), build.alias("build_system"), runner.alias("test_runner")).filter("marked")
    # Each marked folder meets the marked folders among its ancestors: an equi-join on the exploded prefixes.
    segments = F.split("dir", "/")
    above = folders.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(F.split(F.col("dir"), "/"), F.lit(1), k), "/"))).alias("top")).filter("top <> dir")
    nested = above.join(folders.select(F.col("dir").alias("top")), "top", "left_semi").select("dir").distinct()
    roots = folders.join(nested, "dir", "left_anti")
    groups = F.filter(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: s.isin(*FRONTENDS, *BACKENDS))
    group = F.coalesce(F.element_at(F.when(F.size(groups) > 0, groups), -1), F.lit(""))
    name = _name(F.col("dir"))
    kind = F.when(group.isin(*FRONTENDS), "frontend").when(group.isin(*BACKENDS), "backend").when(F.col("build_system") == "node", "frontend").when(F.col("build_system").isin("maven", "gradle", "go"), "backend").otherwise("project")
    out = roots.select(F.col("dir").alias("path"), name.alias("name"), kind.alias("kind"), "build_system", "test_runner", group.alias("_g"))
    return out.withColumn("service", F.when(F.col("_g").isin(*BACKENDS) | (F.col("kind") == "backend"), F.col("name")).otherwise("")).drop("_g")


_NODE = "name string, version string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, autoload struct<`psr-4`: map<string,string>>"


def manifest_symbols(sources: DataFrame) -> DataFrame:
    """(path, name, kind, line_no): scripts of package.json, namespaces of composer.json."""
    own = sources.filter(_name(F.col("path")).isin("package.json", "composer.json")).select("path", F.from_json("content", _NODE).alias("j"))
    scripts = own.filter("path like '%package.json'").select("path", F.explode(F.map_keys("j.scripts")).alias("name"), F.lit("script").alias("kind"))
    spaces = own.filter("path like '%composer.json'").select("path", F.explode(F.map_keys(F.col("j.autoload.psr-4"))).alias("name"))
    spaces = spaces.select("path", F.regexp_replace("name", r"\\$", "").alias("name"), F.lit("autoload").alias("kind"))
    return scripts.unionByName(spaces).withColumn("line_no", F.lit(1))


def packages(sources: DataFrame) -> DataFrame:
    """(path, system, name, dependency): package.json and pom.xml; a package without any has an empty one."""
    node = sources.filter(_name(F.col("path")) == "package.json").select("path", F.from_json("content", _NODE).alias("j"))
    needed = F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("j.devDependencies"), F.array().cast("array<string>")))
    first = node.select("path", F.lit("node").alias("system"), F.col("j.name").alias("name"), F.explode_outer(F.when(F.size(needed) > 0, F.array_distinct(needed))).alias("dependency"))
    xml = F.regexp_replace("content", r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\w+=\"[^\"]*\"", "")
    pom = sources.filter(_name(F.col("path")) == "pom.xml").select("path", xml.alias("x"))
    group = F.expr("coalesce(nullif(xpath_string(x, '/project/groupId'), ''), xpath_string(x, '/project/parent/groupId'))")
    pairs = F.expr("zip_with(xpath(x, '/project/dependencies/dependency/groupId/text()'), xpath(x, '/project/dependencies/dependency/artifactId/text()'), (g, a) -> concat(g, ':', a))")
    second = pom.select("path", F.lit("maven").alias("system"), F.concat_ws(":", group, F.expr("xpath_string(x, '/project/artifactId')")).alias("name"), F.explode_outer(F.when(F.size(pairs) > 0, pairs)).alias("dependency"))
    return first.unionByName(second).filter("name is not null and name <> ''").fillna({"dependency": ""})


def package_graph(named: DataFrame) -> DataFrame:
    """(system, from, to, internal): internal if the dependency is a package of the workspace."""
    known = named.select("system", F.col("name").alias("to")).distinct().withColumn("_known", F.lit(True))
    edges = named.filter("dependency <> ''").select("system", F.col("name").alias("from"), F.col("dependency").alias("to")).distinct()
    return edges.join(known, ["system", "to"], "left").select("system", "from", "to", F.coalesce("_known", F.lit(False)).alias("internal"))


def verification_command(runner: Column, test_file: Column, test_class: Column, test_method: Column) -> Column:
    """The command text for a test; empty without a known runner. Text only, never run."""
    stem = F.regexp_replace(_name(test_file), r"\.[^.]*$", "")
    own = F.when(F.coalesce(test_class, F.lit("")) != "", test_class).otherwise(stem)
    method = F.coalesce(test_method, F.lit(""))
    maven = F.concat(F.lit("mvn -Dtest="), own, F.when(method != "", F.concat(F.lit("#"), method)).otherwise(""), F.lit(" test"))
    gradle = F.concat(F.lit("./gradlew test --tests "), own, F.when(method != "", F.concat(F.lit("."), method)).otherwise(""))
    return (
        F.when(runner == "maven", maven)
        .when(runner == "gradle", gradle)
        .when(runner == "jest", F.concat(F.lit("npx jest "), test_file))
        .when(runner == "vitest", F.concat(F.lit("npx vitest run "), test_file))
        .when(runner == "playwright", F.concat(F.lit("npx playwright test "), test_file))
        .otherwise("")
    )
