"""Folded strings, and the security rules that hold for an endpoint."""

from pyspark.sql import functions as F

from lodestone.operators import java, literals, security

IMPORTS = "import org.springframework.security.config.annotation.web.builders.HttpSecurity;\nimport org.springframework.security.web.*;\n"
CONTROLLER = """package shop;
@RestController
@PreAuthorize("hasRole('CLASS')")
@SecurityRequirement(name = "main")
class Controller {
  @GetMapping("/public/status")
  String open() { return ""; }
  @PermitAll
  @GetMapping("/internal/jobs")
  String jobs() { return ""; }
  @PreAuthorize("isAuthenticated()")
  @Operation(security = {})
  @GetMapping("/internal/deep/jobs")
  String deep() { return ""; }
  @GetMapping("/other")
  String other() { return ""; }
}
@RestController
class Plain {
  @GetMapping("/plain")
  String plain() { return ""; }
}
"""
ROUTES = 'class Routes {\n  static final String ROOT = "/internal";\n  static final String JOBS = ROOT + "/" + Names.JOBS;\n}\nclass Names { static final String JOBS = "jobs"; }\n'
SCHEMES = '@SecurityScheme(name = "main", type = SecuritySchemeType.HTTP, scheme = "bearer")\nclass Api {}\n'


def records(spark, *sources):
    df = spark.createDataFrame([(p, "java", c) for p, c in sources], "path string, language string, content string")
    return java.java_records(df.coalesce(1)).cache()


def config(*chains):
    body = "".join(f"  @Order({order})\n  SecurityFilterChain c{n}(HttpSecurity http) {{ {text} return http.build(); }}\n" if order else f"  SecurityFilterChain c{n}(HttpSecurity http) {{ {text} return http.build(); }}\n" for n, (order, text) in enumerate(chains))
    return "src/main/java/Config.java", IMPORTS + "@Configuration\nclass Config {\n" + body + "}\n"


def rules(spark, **projects):
    """Rules of configurations by project, each over the same controllers: {project: {(path, kind, confidence)}}."""
    sources = [(f"{p}/{name}", text) for p, chains in projects.items() for name, text in (("C.java", CONTROLLER), ("Routes.java", ROUTES), config(*chains))]
    rows = security.endpoint_security(records(spark, *sources).withColumn("project", F.split("path", "/")[0]))
    got = {p: set() for p in projects}
    for r in rows.filter("source = 'security_config_call'").collect():
        got[r["project"]].add((r["path"], r["kind"], r["confidence"]))
    return got


FOLDED = [
    ('"/a"', ["/a"]), ('Routes.JOBS + "/**"', ["/internal/jobs/**"]), ("ROOT", ["/internal"]), ("Names.JOBS", ["jobs"]), ('x.y() ? "/a" : ROOT', ["/a", "/internal"]),
    ('a ? "/a" : b ? "/b" : "/c:?"', ["/a", "/b", "/c:?"]), ('a ? b ? "1" : "2" : "1"', ["1", "2"]), ('"a\\"b" + "c"', ['a"bc']), ("missing", None), ("call()", None), ("Loop.A", None), ('a ? "/a" : gone', None),
    ('a ? "1" : b ? "2" : c ? "3" : d ? "4" : "5"', None), ('"p" + (a ? "1" : "2")', None), ("", None), (None, None), ("this.ROOT", ["/internal"]), ('(ROOT + "/x")', ["/internal/x"]), ("Twice.T", None),
    ("Chain.C4", ["end"]), ("Chain.C5", None),
]


def test_fold(spark):
    constants = [("Routes", "ROOT", '"/internal"'), ("Routes", "JOBS", 'ROOT + "/" + Names.JOBS'), ("Names", "JOBS", '"jobs"'), ("Loop", "A", "Loop.B"), ("Loop", "B", "Loop.A"), ("Twice", "T", '"1"'), ("Twice", "T", '"2"'), (None, "N", '"n"'), ("Chain", "C1", '"end"')]
    constants += [("Chain", f"C{n}", f"C{n - 1}") for n in range(2, 6)]
    constants = spark.createDataFrame([("", *c) for c in constants], "project string, owner string, name string, expression string")
    asked = spark.createDataFrame([("", str(n), "Other", e) for n, (e, _) in enumerate(FOLDED)] + [("p", "n", "Other", "Names.JOBS")], "project string, node string, owner string, expression string")
    got = {(r["project"], r["node"]): r["values"] for r in literals.fold(asked, constants, depth=4).collect()}
    assert got == {("", str(n)): want for n, (_, want) in enumerate(FOLDED) if want}


def test_fold_own_type_first(spark):
    constants = spark.createDataFrame([("", "A", "X", '"a"'), ("", "B", "X", '"b"')], "project string, owner string, name string, expression string")
    asked = spark.createDataFrame([("", o, o, "X") for o in "ABC"], "project string, node string, owner string, expression string")
    assert {(r["node"], *r["values"]) for r in literals.fold(asked, constants).collect()} == {("A", "a"), ("B", "b")}


def test_choice_of_configurations(spark):
    got = rules(
        spark,
        by_path=[(1, 'http.securityMatcher("/public/**"); r.permitAll();'), (2, 'http.securityMatcher(f.matcher(Routes.ROOT + "/**")); r.anyRequest().authenticated();'), (3, 'r.hasRole("ADMIN");')],
        order=[(5, 'http.securityMatcher("/internal/**", "/other"); r.permitAll();'), (5, 'http.securityMatcher("/internal/jobs"); r.httpBasic();'), (4, 'http.securityMatcher("/**"); r.formLogin();')],
        length=[(5, 'http.securityMatcher("/internal/**", "/other"); r.permitAll();'), (5, 'http.securityMatcher("/internal/jobs"); r.httpBasic();'), (6, 'http.securityMatcher("/**"); r.formLogin();')],
        disagree=[(1, 'http.securityMatcher("/internal/**"); r.permitAll();'), (1, 'http.securityMatcher("/internal/**"); r.authenticated();'), (0, "http.securityMatcher(dynamic()); r.x509();")],
        # Rules that agree are no disagreement; a pattern with an inner * is unknown.
        inner=[(1, 'http.securityMatcher("/internal/**"); r.permitAll();'), (1, 'http.securityMatcher("/internal/**", "/a/*/b"); r.permitAll();')],
        # Without an order a configuration is last.
        last=[(None, 'http.securityMatcher("/internal/**"); r.permitAll();'), (9, 'http.securityMatcher("/**"); r.x509();')],
    )
    inside, outside = ("/internal/jobs", "/internal/deep/jobs"), ("/public/status", "/other", "/plain")
    every = lambda paths, kind, c="EXTRACTED": {(p, kind, c) for p in paths}
    assert got["by_path"] == every(["/public/status"], "permit_all") | every(inside, "authenticated") | every(["/other", "/plain"], "has_role")
    assert got["order"] == every(inside + outside, "form_login")
    assert got["length"] == every(["/internal/jobs"], "http_basic") | every(["/internal/deep/jobs", "/other"], "permit_all") | every(["/public/status", "/plain"], "form_login")
    assert got["disagree"] == every(inside, "permit_all", "PARTIAL") | every(inside, "authenticated", "PARTIAL") | every(outside, "x509", "PARTIAL")
    assert got["inner"] == every(inside, "permit_all") | every(inside, "permit_all", "PARTIAL")
    assert got["last"] == every(inside + outside, "x509")


def test_declared_rules(spark):
    rows = security.endpoint_security(records(spark, ("C.java", CONTROLLER), ("Api.java", SCHEMES))).collect()
    got = {(r["path"], r["kind"], r["category"], r["source"], r["auth_line"], r["conflicting"]) for r in rows}
    own = lambda p, c: {(p, "pre_authorize", "role", "class_annotation", 3, c), (p, "bearer", "bearer", "openapi_security_scheme", 1, c)}
    jobs = own("/internal/jobs", True) | {("/internal/jobs", "permit_all", "public", "method_annotation", 8, True)}
    deep = {("/internal/deep/jobs", "pre_authorize", "authenticated", "method_annotation", 11, True), ("/internal/deep/jobs", "permit_all", "public", "openapi_security_override", 12, True)}
    assert got == own("/public/status", False) | own("/other", False) | jobs | deep | {("/plain", None, "unknown", None, None, False)}


def test_only_security_configurations(spark):
    chain = "class X {\n  SecurityFilterChain c(HttpSecurity http) { r.permitAll(); return null; }\n}\n"
    df = records(spark, ("src/test/java/T.java", IMPORTS + chain), ("src/main/java/NoImport.java", chain), ("src/main/java/Y.java", "class Y { void c() { r.permitAll(); } }"), ("src/main/java/Z.java", IMPORTS + chain))
    assert [(r["path"], r["patterns"], r["exact"]) for r in security.scopes(df).collect()] == [("src/main/java/Z.java", [], True)]


def test_empty_and_projects(spark):
    empty = records(spark, ("E.java", ""), ("N.java", None))
    assert security.endpoint_security(empty).count() == security.scopes(empty).count() == 0
    two = records(spark, ("a/C.java", CONTROLLER), ("a/src/main/java/Config.java", config((1, "r.permitAll();"))[1]), ("b/C.java", CONTROLLER)).withColumn("project", F.substring("path", 1, 1))
    got = {r["project"] for r in security.endpoint_security(two).filter("source = 'security_config_call'").collect()}
    assert got == {"a"}


def test_no_pairs(spark):
    many = spark.range(20000).select(F.lit("p").alias("project"), F.concat(F.lit("/s/x/"), F.col("id").cast("string")).alias("path"))
    scope = spark.range(300).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scope"), F.lit("p").alias("project"), F.lit("C.java").alias("path"), F.col("id").cast("int").alias("line"), F.col("id").cast("int").alias("order"), F.array(F.lit("/s/**"), F.concat(F.lit("/s/x/"), F.col("id").cast("string"))).alias("patterns"), F.lit(True).alias("exact"))
    scope = scope.withColumn("rules", F.array(F.struct(F.lit("permit_all").alias("kind"), F.lit("").alias("expression"), F.col("line"))))
    got = security.choose(many, scope)
    assert got.count() == 20000 and got.filter("scope <> 's0'").count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
