"""Who may call an endpoint: annotations of Java controllers, and security configurations scoped by path.

A configuration has an order and path patterns.  Of those that fit an endpoint's path the lowest order
wins, then the longest pattern; without a fit those without patterns hold, and last those whose
patterns are unknown.  A pattern is a key, and a path has one key for each of its prefixes, so
configurations are reduced to the lowest order of each key and then meet endpoints by equality.

Records are those of ``java.java_records``, with a column ``project`` if there are several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import java, literals
from .graph import written

# Calls that state a rule, annotations with the family in which a method's own replace those of its
# type, kinds to categories, and types that make a method a configuration.
CALLS = ("permitAll", "authenticated", "hasRole", "hasAnyRole", "hasAuthority", "hasAnyAuthority", "httpBasic", "oauth2ResourceServer", "oauth2Login", "formLogin", "x509")
FAMILIES = {"PreAuthorize": "pre_authorize", "PostAuthorize": "post_authorize", "Secured": "secured", "PermitAll": "jsr_250", "DenyAll": "jsr_250", "RolesAllowed": "jsr_250"}
CATEGORIES = {
    "http_basic": "basic", "basic": "basic", "oauth2_resource_server": "bearer", "bearer": "bearer", "oauth2_login": "oauth2", "oauth2": "oauth2", "openid_connect": "oauth2",
    "api_key": "api_key", "form_login": "session", "session": "session", "x509": "mtls", "mtls": "mtls", "mutual_tls": "mtls",
    "has_role": "role", "has_any_role": "role", "has_authority": "role", "has_any_authority": "role", "secured": "role", "roles_allowed": "role", "role": "role",
    "authenticated": "authenticated", "permit_all": "public", "public": "public",
}
CHAIN, BUILDER = "org.springframework.security.web.SecurityFilterChain", "org.springframework.security.config.annotation.web.builders.HttpSecurity"
LAST = 2**31 - 1
METHOD = ["project", "path", "owner", "name", "line"]


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def _snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", r"_$1"))


def category(kind: Column, expression: Column) -> Column:
    """A rule's category; of an authorization expression only a single plain call is understood."""
    e = F.trim(expression)
    value = r"\s*(?:'[^']*'|\"[^\"]*\")\s*"
    said = (
        F.when(e.rlike(r"^permitAll(\s*\(\s*\))?$"), "public")
        .when(e.rlike(rf"^(hasRole|hasAuthority)\s*\({value}\)$|^(hasAnyRole|hasAnyAuthority)\s*\({value}(,{value})*\)$"), "role")
        .when(e.rlike(r"^isAuthenticated\s*\(\s*\)$"), "authenticated")
        .otherwise("unknown")
    )
    return F.when(kind.isin("pre_authorize", "post_authorize"), said).otherwise(F.coalesce(_mapped(kind, CATEGORIES), F.lit("unknown")))


def _in_projects(records: DataFrame) -> DataFrame:
    return records if "project" in records.columns else records.withColumn("project", F.lit(""))


def scopes(records: DataFrame) -> DataFrame:
    """(scope, project, path, line, order, patterns, exact, rules): security configurations outside src/test that state a rule.

    rules: kind, expression, line of each stated rule.  Patterns are literals, sums and choices of known
    constants; a text that starts with no / or holds another * than a final /** is none.  exact is false
    if a pattern is unknown.  Without an @Order of a whole number the order is the last.
    """
    r = _in_projects(records)
    imported = r.filter("record = 'import'").groupBy("project", "path").agg(F.collect_set(F.when(F.col("name").startswith("org.springframework.security."), F.col("name"))).alias("imports"))
    known = lambda full: F.arrays_overlap("imports", F.array(F.lit(full), F.lit(full.rsplit(".", 1)[0] + ".*")))
    short = F.regexp_extract("type", r"([A-Za-z_]\w*)$", 1)
    takes = F.exists("arguments", lambda a: a.rlike(r"(^|[\s.])HttpSecurity\s+\w+$"))
    chain = ((short == "SecurityFilterChain") & known(CHAIN)) | (takes & known(BUILDER))
    order = F.regexp_extract(java.args_of("Order"), r"^\s*(?:value\s*=\s*)?(-?\d{1,9})\s*$", 1)
    own = r.filter("record = 'method'").filter(~F.concat(F.lit("/"), "path").contains("/src/test/")).join(imported, ["project", "path"]).filter(chain)
    own = own.select(F.concat_ws("#", "project", "path", "owner", "name", "line").alias("scope"), *METHOD, "end_line", F.when(order != "", order.cast("int")).otherwise(LAST).alias("order"))
    calls = r.filter("record = 'call'").filter(F.col("name").isin("securityMatcher", *CALLS)).select("project", "path", "owner", F.col("type").alias("name"), F.col("name").alias("call"), F.col("line").alias("at"), "arguments", "ordinal")
    inside = own.join(calls, ["project", "path", "owner", "name"]).filter("at between line and end_line")
    rule = F.struct(_snake(F.col("call")).alias("kind"), F.array_join("arguments", ", ").alias("expression"), F.col("at").alias("line"))
    stated = inside.groupBy("scope", "project", "path", "line", "order").agg(
        F.array_sort(F.collect_set(F.when(F.col("call") != "securityMatcher", rule))).alias("rules"),
        F.count_if((F.col("call") == "securityMatcher") & (F.size("arguments") == 0)).alias("bare"),
    )
    matcher = inside.filter("call = 'securityMatcher'").select("scope", "project", "owner", "ordinal", F.posexplode("arguments").alias("pos", "argument"))
    plain = rf"(?:{literals._TEXT}|[^\"(),])*"
    inner = F.regexp_extract("argument", rf"^.*\.matcher\(({plain})\)$", 1)
    matcher = matcher.select("scope", "project", "owner", F.concat_ws("#", "scope", "ordinal", "pos").alias("node"), F.when(inner != "", inner).otherwise(F.col("argument")).alias("expression"))
    constants = r.filter("record = 'field' and final and type = 'String' and value <> ''").select("project", "owner", "name", F.col("value").alias("expression"))
    values = literals.fold(matcher.drop("scope"), constants)
    value = F.trim("value")
    head = F.regexp_replace(value, r"/\*\*$", "")
    fits = value.startswith("/") & ~head.contains("*")
    base = paths.normalise(head)
    pattern = F.when(fits & value.endswith("/**"), F.concat(F.when(base == "/", "").otherwise(base), F.lit("/**"))).when(fits, paths.normalise(value))
    found = matcher.join(values, ["project", "node"], "left").select("scope", F.explode_outer("values").alias("value")).select("scope", pattern.alias("pattern"))
    found = found.groupBy("scope").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"), F.count_if(F.col("pattern").isNull()).alias("unknown"))
    joined = stated.filter(F.size("rules") > 0).join(found, "scope", "left")
    exact = (F.coalesce("unknown", F.lit(0)) == 0) & (F.col("bare") == 0)
    return joined.select("scope", "project", "path", "line", "order", F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"), exact.alias("exact"), "rules")


def choose(endpoints: DataFrame, scoped: DataFrame) -> DataFrame:
    """(project, path, scope, rules, file, line, exact): the configurations of each distinct (project, path) of endpoints.

    exact is false if the configuration's patterns are not all known, or if several win whose rules differ.
    A path that no configuration covers has no row.
    """
    tier = F.when(F.size("patterns") > 0, 0).when(F.col("exact"), 1).otherwise(2)
    # The keys of no pattern cannot be paths.
    keys = F.when(F.size("patterns") > 0, F.col("patterns")).otherwise(F.array(F.when(F.col("exact"), "any").otherwise("unknown")))
    policy = F.array_sort(F.transform("rules", lambda x: F.struct(x["kind"].alias("kind"), x["expression"].alias("expression"))))
    rows = scoped.select("project", "scope", "order", "exact", "rules", policy.alias("policy"), F.col("path").alias("file"), "line", tier.alias("tier"), F.explode(keys).alias("key"))
    first = rows.groupBy("project", "key", "tier").agg(F.min("order").alias("order"))
    places = endpoints.select("project", "path").distinct()
    parts = paths.segments(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda s: F.concat(F.lit("/"), s)), ""), F.lit("/**")))
    tried = places.select("project", "path", F.explode(F.array_distinct(F.concat(prefixes, F.array(paths.normalise(F.col("path")), F.lit("any"), F.lit("unknown"))))).alias("key"))
    length = F.when(F.col("tier") > 0, 0).when(F.col("key").endswith("/**"), F.length("key") - 3).otherwise(F.length("key") + 1)
    best = tried.join(first, ["project", "key"]).groupBy("project", "path").agg(F.min(F.struct("tier", "order", (-length).alias("rank"), "key")).alias("b")).select("project", "path", "b.tier", "b.order", "b.key")
    # How far the winners of a key agree is known before endpoints meet them.
    winners = rows.join(first, ["project", "key", "tier", "order"]).drop("tier")
    agreed = winners.groupBy("project", "key").agg((F.min("policy") == F.max("policy")).alias("agreed"))
    final = winners.join(agreed, ["project", "key"]).withColumn("exact", F.col("exact") & F.col("agreed")).drop("policy", "agreed", "order")
    return best.drop("tier", "order").join(final, ["project", "key"]).drop("key")


def _annotation_rules(found: Column, source: str) -> Column:
    """Rules of an array of annotations as structs."""
    text = lambda a: F.regexp_replace(F.regexp_replace(a["args"], r"^\s*value\s*=\s*", ""), r'^\s*"([^"]*)"\s*$', "$1")
    rule = lambda a: F.struct(_snake(a["name"]).alias("kind"), F.when(a["name"].isin("PermitAll", "DenyAll"), "").otherwise(text(a)).alias("expression"), F.lit(source).alias("source"), a["line"].alias("line"))
    return F.transform(found, rule)


def declared_rules(records: DataFrame) -> DataFrame:
    """(project, path, owner, name, line, kind, expression, source, auth_file, auth_line) of annotations on mapped methods.

    Annotations of the type hold for a method that has none of the same family.  Named requirements of an
    API description are looked up among the declared schemes; a method's own replace those of its type,
    and an empty one makes it public.
    """
    r = _in_projects(records)
    mapped = r.filter("record = 'method'").filter(F.exists("annotations", lambda a: a["name"].isin(*java.MAPPINGS))).select(*METHOD, F.col("annotations").alias("mine"))
    types = r.filter("record = 'type'").filter(java.has("RestController")).select("project", "path", F.col("name").alias("owner"), F.col("annotations").alias("above"))
    both = mapped.join(types, ["project", "path", "owner"])
    secured = lambda c: F.filter(c, lambda a: a["name"].isin(*FAMILIES))
    family = lambda a: _mapped(a["name"], FAMILIES)
    own = F.transform(secured("mine"), family)
    kept = F.filter(secured("above"), lambda a: ~F.array_contains(own, family(a)))
    rules = F.concat(_annotation_rules(kept, "class_annotation"), _annotation_rules(secured("mine"), "method_annotation"))
    plain = both.select(*METHOD, F.explode(rules).alias("rule")).select(*METHOD, "rule.kind", "rule.expression", "rule.source", F.col("path").alias("auth_file"), F.col("rule.line").alias("auth_line"))

    states = lambda a: a["name"].isin("SecurityRequirement", "SecurityRequirements") | ((a["name"] == "Operation") & a["args"].rlike(r"\bsecurity\s*="))
    heard = both.select(*METHOD, F.explode(F.when(F.exists("mine", states), F.filter("mine", states)).otherwise(F.filter("above", states))).alias("a"))
    named = F.regexp_extract("a.args", r'\bname\s*=\s*"([^"]*)"', 1)
    required = heard.filter("a.name = 'SecurityRequirement'").select(*METHOD, named.alias("expression")).filter("expression <> ''").distinct()
    schemes = r.filter("record in ('type', 'method', 'field')").select("project", F.col("path").alias("auth_file"), F.explode("annotations").alias("a")).filter("a.name = 'SecurityScheme'")
    of = F.upper(F.regexp_extract("a.args", r"\btype\s*=\s*(?:\w+\.)*(\w+)", 1))
    scheme = F.lower(F.regexp_extract("a.args", r'\bscheme\s*=\s*"\s*([^"]*?)\s*"', 1))
    kind = F.when(of == "APIKEY", "api_key").when(of == "OAUTH2", "oauth2").when(of == "OPENIDCONNECT", "openid_connect").when(of == "MUTUALTLS", "mutual_tls").when((of == "HTTP") & (scheme == "basic"), "http_basic").when((of == "HTTP") & (scheme == "bearer"), "bearer")
    schemes = schemes.select("project", named.alias("expression"), kind.alias("kind"), "auth_file", F.col("a.line").alias("auth_line")).filter("kind is not null").distinct()
    described = required.join(schemes, ["project", "expression"]).withColumn("source", F.lit("openapi_security_scheme"))
    empty = F.when(F.col("a.name") == "SecurityRequirement", F.regexp_extract("a.args", r'\bname\s*=\s*"([^"]+)"', 1) == "").when(F.col("a.name") == "SecurityRequirements", F.col("a.args").rlike(r"^\s*(value\s*=\s*)?(\{\s*(@SecurityRequirement(\(\s*\))?)?\s*\})?\s*$")).otherwise(F.col("a.args").rlike(r"\bsecurity\s*=\s*\{\s*(@SecurityRequirement(\(\s*\))?)?\s*\}"))
    opened = heard.filter(empty).select(*METHOD, F.lit("permit_all").alias("kind"), F.trim("a.args").alias("expression"), F.lit("openapi_security_override").alias("source"), F.col("path").alias("auth_file"), F.col("a.line").alias("auth_line"))
    return plain.unionByName(described).unionByName(opened)


def endpoint_security(records: DataFrame) -> DataFrame:
    """One row for each endpoint and rule that holds for it, and one of category unknown for an endpoint without a rule.

    (project, http_method, path, controller, method, file, line, kind, category, expression, source,
    confidence, auth_file, auth_line, conflicting).  confidence is PARTIAL where the configuration may not
    be the one that holds; conflicting marks endpoints that are both public and restricted.
    """
    r = _in_projects(records)
    served = java.endpoints(r, ["project"]).withColumnRenamed("file", "source_file").drop("return_type").distinct()
    own = declared_rules(r).withColumnsRenamed({"path": "source_file", "owner": "controller", "name": "method"}).withColumn("confidence", F.lit("EXTRACTED"))
    key = ["project", "source_file", "controller", "method", "line"]
    mine = served.join(own, key)
    # Configurations are few, and several steps read them.
    won = choose(served, written(scopes(r))).select("project", "path", F.col("file").alias("auth_file"), F.when(F.col("exact"), "EXTRACTED").otherwise("PARTIAL").alias("confidence"), F.explode("rules").alias("rule"))
    won = won.select("project", "path", "auth_file", "confidence", "rule.kind", "rule.expression", F.col("rule.line").alias("auth_line"), F.lit("security_config_call").alias("source"))
    rules = mine.unionByName(served.join(won, ["project", "path"])).distinct()
    grade = category(F.col("kind"), F.col("expression"))
    place = ["project", "http_method", "path", "controller", "method", "source_file", "line"]
    graded = rules.withColumn("category", grade)
    seen = graded.groupBy(*place).agg((F.bool_or(F.col("category") == "public") & F.bool_or(~F.col("category").isin("public", "unknown"))).alias("conflicting"))
    rows = served.join(seen, place, "left").join(graded, place, "left")
    return rows.select(*place[:5], F.col("source_file").alias("file"), "line", "kind", F.coalesce("category", F.lit("unknown")).alias("category"), "expression", "source", "confidence", "auth_file", "auth_line", F.coalesce("conflicting", F.lit(False)).alias("conflicting"))
