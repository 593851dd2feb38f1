"""Symbol usages resolved across projects, module resolution through re-exports, namespace groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import stable_id
from .graph import finely, settle, sized
from .resolve import clean_path, folder


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """Adds id: a hash of project, language, kind, qualified name and file."""
    return symbols.withColumn("id", F.concat(F.lit("symbol:"), stable_id(*(F.col(c) for c in ("project", "language", "kind", "qualified_name", "file")))))


def resolve_usages(usages: DataFrame, declarations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(usage_id, resolution, symbol_id, candidates): a usage's own id, else its key's declarations.

    usages: usage_id, project, language, local_id, key (qualified name, or module and export)
    declarations: id, project, artifact, language, key; dependencies: project, artifact
    Declarations of the same project always count; those of others only through a declared dependency.
    Without any dependency data of the project, Java keeps all if there are several.
    """
    d = declarations.select("key", "language", F.col("id").alias("symbol_id"), F.col("project").alias("d_project"), "artifact")
    declared = dependencies.select("project", "artifact").distinct().withColumn("declared", F.lit(True))
    informed = dependencies.select("project").distinct().withColumn("informed", F.lit(True))
    local = usages.filter("coalesce(local_id, '') <> ''").select("usage_id", F.lit(1).cast("long").alias("candidates"), F.col("local_id").alias("one"))
    wide = usages.filter("coalesce(local_id, '') = ''")
    # What a name means to a project is found once, however often the project uses it.
    asked = wide.select("project", "language", "key").distinct()
    met = asked.join(d, ["key", "language"]).join(declared, ["project", "artifact"], "left").join(informed, "project", "left")
    allowed = (F.col("d_project") == F.col("project")) | F.coalesce("declared", F.lit(False)) | ((F.col("language") == "java") & F.col("informed").isNull())
    means = met.filter(allowed).groupBy("project", "language", "key").agg(F.count_distinct("symbol_id").alias("candidates"), F.min("symbol_id").alias("one"))
    found = wide.join(means, ["project", "language", "key"], "left").select("usage_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "one").unionByName(local)
    resolution = F.when(F.col("candidates") == 0, "UNRESOLVED").when(F.col("candidates") == 1, "EXACT").otherwise("AMBIGUOUS")
    return found.select("usage_id", resolution.alias("resolution"), F.when(F.col("candidates") == 1, F.col("one")).alias("symbol_id"), "candidates")


def usage_category(resolution: Column, through_api: Column) -> Column:
    return F.when(resolution == "AMBIGUOUS", "ambiguous").when(resolution == "UNRESOLVED", "unresolved").when(through_api, "reached_through_api").otherwise("direct_reference")


def module_targets(imports: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """(import_id, target, how): relative file, then alias, then workspace package, else external.

    imports: import_id, file, module; files: path; aliases: prefix, replacement (prefix ends in / or is
    whole); packages: name, entry.  A path means the file itself, with a script extension, or its index;
    of several packages of one name, the import is ambiguous.
    """
    stem = F.regexp_replace("path", r"(/index)?\.(?:d\.ts|[cm]?[jt]sx?)$", "")
    known = files.select(F.col("path").alias("key"), F.col("path").alias("target")).unionByName(files.select(stem.alias("key"), F.col("path").alias("target")))
    known = known.groupBy("key").agg(F.min("target").alias("target"))
    near = imports.filter("module like '.%'").select("import_id", clean_path(F.concat_ws("/", folder(F.col("file")), "module")).alias("key"), F.lit(0).alias("rank"))
    # Aliases are the few of the configuration; the join is on the module's first segment.
    first = lambda c: F.regexp_extract(c, r"^([^/]*)", 1)
    other = imports.filter("module not like '.%'").withColumn("_s", first("module"))
    by_alias = other.join(sized(aliases.withColumn("_s", first("prefix"))), "_s").filter(F.startswith("module", F.col("prefix")))
    by_alias = by_alias.select("import_id", clean_path(F.concat("replacement", F.expr("substring(module, length(prefix) + 1)"))).alias("key"), F.lit(1).alias("rank"))
    files_found = near.unionByName(by_alias).join(sized(known), "key").groupBy("import_id").agg(F.min(F.struct("rank", "target")).alias("m"))
    entry = packages.groupBy("name").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry"))
    out = imports.join(sized(files_found), "import_id", "left").join(entry, imports["module"] == entry["name"], "left")
    how = F.when(F.col("m.rank") == 0, "relative").when(F.col("m.rank") == 1, "alias").when(F.col("n") == 1, "package").when(F.col("n") > 1, "ambiguous").otherwise("external")
    return out.select("import_id", F.coalesce("m.target", F.when(F.col("n") == 1, F.col("entry"))).alias("target"), how.alias("how"))


def exported(exports: DataFrame, depth: int = 8) -> DataFrame:
    """(module, name, symbol_id) of every name a module exports, through re-exports.

    exports: module, name, kind (declared, named, star), source_module, source_name, symbol_id.  A direct
    declaration hides re-exports of the name; a star passes on every name but default; cycles end by
    the depth.  Any side of a join may hold every export of a workspace, so none is broadcast by a guess.
    """
    direct = exports.filter("kind = 'declared'").select("module", "name", "symbol_id")
    known = settle(direct.distinct())
    frontier = known
    for _ in range(depth):
        named = exports.filter("kind = 'named'").select("module", "name", F.col("source_module").alias("sm"), F.col("source_name").alias("sn"))
        step = named.join(sized(frontier.select(F.col("module").alias("sm"), F.col("name").alias("sn"), "symbol_id")), ["sm", "sn"]).select("module", "name", "symbol_id")
        star = exports.filter("kind = 'star'").select("module", F.col("source_module").alias("sm"))
        step = step.unionByName(star.join(sized(frontier.filter("name <> 'default'").select(F.col("module").alias("sm"), "name", "symbol_id")), "sm").select("module", "name", "symbol_id"))
        hidden = step.join(sized(direct.select("module", "name")), ["module", "name"], "left_anti")
        frontier = settle(hidden.distinct().join(sized(known), ["module", "name", "symbol_id"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def namespace_groups(names: DataFrame, longest: int = 8) -> DataFrame:
    """(project, group_id, depth): the namespace prefix down to where a project's evidence splits.

    names: project, namespace, confidence.  From the root, the child with the most names is taken,
    then the most confidence; a tie stops there if two segments are settled, else there is no group.
    """
    parts = names.select("project", F.filter(F.split("namespace", "[./]"), lambda s: s != "").alias("parts"), "confidence")
    each = parts.select("project", "confidence", F.posexplode(F.transform(F.slice("parts", 1, longest), lambda s, i: F.slice(F.col("parts"), F.lit(1), i + 1))))
    counts = settle(each.groupBy("project", (F.col("pos") + 1).alias("depth"), F.array_join("col", ".").alias("prefix")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c")))
    counts = counts.withColumn("parent", F.when(F.col("prefix").contains("."), F.regexp_replace("prefix", r"\.[^.]*$", "")).otherwise(""))
    state = names.select("project").distinct().select("project", F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.lit(True).alias("going"))
    for level in range(1, longest + 1):
        kids = counts.filter(F.col("depth") == level).select("project", "parent", F.col("prefix").alias("child"), "n", "c")
        joined = state.filter("going").join(kids, (kids["project"] == state["project"]) & (kids["parent"] == state["prefix"])).select(state["project"], "child", "n", "c")
        w = W.partitionBy("project").orderBy(F.desc("n"), F.desc("c"))
        top = joined.withColumn("r", F.rank().over(w)).filter("r = 1").groupBy("project").agg(F.count("*").alias("ties"), F.min("child").alias("child"))
        moved = state.join(top, "project", "left")
        on = F.col("going") & (F.coalesce("ties", F.lit(0)) == 1)
        state = settle(moved.select("project", F.when(on, F.col("child")).otherwise(F.col("prefix")).alias("prefix"), F.when(on, F.lit(level)).otherwise(F.col("depth")).alias("depth"), on.alias("going")))
    return state.filter("depth >= 2").select("project", F.col("prefix").alias("group_id"), "depth")


def api_catalog(endpoints: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints with their consumers, consumers that fit several endpoints).

    endpoints: endpoint_id, project, http_method, path, handler, file, line; matches: match_id, api_project,
    backend_project, backend_http_method, backend_path, backend_handler, backend_file, backend_line.
    Every attribute of the match that is not empty must agree; the path is the join key.
    """
    key = lambda c: paths.canon(paths.segments(F.col(c)))
    e = endpoints.withColumn("k", key("path"))
    attributes = [f"b_{c}" for c in ("project", "http_method", "handler", "file", "line")]
    said = [F.lower(F.coalesce(F.col(f"backend_{c[2:]}").cast("string"), F.lit(""))).alias(c) for c in attributes]
    m = matches.withColumn("k", key("backend_path")).select("match_id", "api_project", "k", *said)
    # Matches that say the same fit the same endpoints: each such shape meets the endpoints once.
    pairs = m.select("k", *attributes).distinct().join(e, "k")
    for c in attributes:
        empty = F.col(c).isin("", "0") if c == "b_line" else F.col(c) == ""
        pairs = pairs.filter(empty | (F.col(c) == F.lower(F.col(c[2:]).cast("string"))))
    fits = pairs.groupBy("k", *attributes).agg(F.count("*").alias("n"), F.min("endpoint_id").alias("endpoint_id"))
    found = m.join(fits, ["k", *attributes]).select("match_id", "api_project", "n", "endpoint_id")
    consumers = found.filter("n = 1").groupBy("endpoint_id").agg(F.count("*").alias("consumers"), F.count_distinct("api_project").alias("projects"))
    out = endpoints.join(consumers, "endpoint_id", "left").fillna({"consumers": 0, "projects": 0})
    return out, found.filter("n > 1").select("match_id", "api_project", F.col("n").alias("candidates"))


def named(symbols: DataFrame) -> DataFrame:
    """symbols (id, project, file, name, export_name, qualified_name) by every name they go by: also each tail of the qualified name."""
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    names = F.array_distinct(F.filter(F.concat(F.array("name", "export_name", "qualified_name"), tails), lambda x: F.coalesce(x, F.lit("")) != ""))
    return symbols.select("id", "project", "file", F.explode(names).alias("called"))


def reached_through_api(matches: DataFrame, flows: DataFrame, origins: DataFrame, steps: DataFrame, java: DataFrame) -> DataFrame:
    """(match_id, flow_id, consumer_id, step_id, provider_id, resolution, category, reason): frontend symbols that reach a declaration over HTTP.

    matches: match_id, backend_project (resolved ones); flows: flow_id, match_id; origins: flow_id,
    consumer_id; steps: flow_id, step_id, file, owner; java: symbols as in named.
    A missing link leaves one row with its reason, several flows or origins of a match make all of its
    rows ambiguous, and several declarations of a step give a row each.
    """
    # Rows are moved by one key at a time and made distinct where they then lie.
    f = finely(flows.select("flow_id", "match_id"), "flow_id").distinct()
    o = finely(origins.select("flow_id", "consumer_id"), "flow_id").distinct()
    m = finely(matches.select("match_id", "backend_project"), "match_id").distinct()
    w, project = W.partitionBy("match_id"), F.struct("backend_project")
    led = m.join(f.join(o, "flow_id", "left"), "match_id", "left").withColumns({
        "first_flow": F.min("flow_id").over(w), "far": F.min("consumer_id").over(w).isNotNull(), "several_projects": F.min(project).over(w) != F.max(project).over(w),
        "several": (F.min("flow_id").over(w) != F.max("flow_id").over(w)) | (F.min("consumer_id").over(w) != F.max("consumer_id").over(w)),
    })
    # Without any origin a match has one row, whatever its flows are, and needs no steps. All branches read the same columns, so they share what was moved.
    one = led.withColumn("n", F.row_number().over(w.orderBy("flow_id", "backend_project"))).filter("n = 1 and not far")
    none = lambda c: F.lit(None).cast(c)
    lost = one.select(
        "match_id", F.col("first_flow").alias("flow_id"), none(o.schema["consumer_id"].dataType).alias("consumer_id"), none(steps.schema["step_id"].dataType).alias("step_id"), none(java.schema["id"].dataType).alias("provider_id"),
        F.when(F.col("first_flow").isNull(), "workspace_feature_flow_missing").otherwise("frontend_origin_unresolved").alias("reason"),
    )
    counted = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    place = lambda file, owner: F.concat(counted(F.col(file)), counted(F.col(owner))).alias("place")
    s = finely(steps.filter("flow_id is not null").select("flow_id", "step_id", place("file", "owner")), "flow_id").groupBy("flow_id", "step_id").agg(F.sort_array(F.collect_set("place")).alias("each"))
    s = s.withColumn("places", F.array_join("each", ""))
    known = named(java).select(F.col("project").alias("backend_project"), place("file", "called"), "id").groupBy("backend_project", "place").agg(F.collect_set("id").alias("ids"))
    known = known.withColumn("candidates", F.size("ids"))
    # What a step that has several places means, once for each such set of places.
    sets = s.filter(F.size("each") > 1).select("places", "each").distinct().select("places", F.explode("each").alias("place")).join(known, "place")
    sets = sets.groupBy("backend_project", "places").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), F.sum("candidates").cast("int").alias("candidates"))
    means = known.withColumnRenamed("place", "places").unionByName(sets)

    def reached(led: DataFrame) -> DataFrame:
        led = led.select("match_id", "backend_project", "flow_id", "consumer_id", "several")
        on = (led["flow_id"] == s["flow_id"]) & led["backend_project"].isNotNull()
        # Without a place there is nothing to look up: such rows are spread by their match, under what no place begins with.
        spread = F.when(F.coalesce("places", F.lit("")) == "", F.concat(F.lit("-"), F.col("match_id").cast("string"))).otherwise(F.col("places")).alias("places")
        rows = led.join(s, on, "left").select(led["*"], "step_id", spread).join(means, ["backend_project", "places"], "left")
        reason = (
            F.when(F.col("step_id").isNull(), "backend_implementation_steps_missing").when(F.coalesce("candidates", F.lit(0)) == 0, "declaration_missing")
            .when(F.col("candidates") > 1, "several_declarations").when(F.col("several"), "several_origins").otherwise("")
        )
        return rows.select("match_id", "flow_id", "consumer_id", "step_id", F.explode_outer("ids").alias("provider_id"), reason.alias("reason"))

    near = led.filter("consumer_id is not null")
    # Only projects of one match can say the same twice.
    rows = reached(near.filter("not several_projects")).unionByName(reached(near.filter("several_projects")).distinct()).unionByName(lost)
    resolution = F.when(F.col("reason") == "", "EXACT").when(F.col("reason").startswith("several"), "AMBIGUOUS").otherwise("UNRESOLVED")
    return rows.select("match_id", "flow_id", "consumer_id", "step_id", "provider_id", resolution.alias("resolution"), usage_category(resolution, F.lit(True)).alias("category"), "reason")
