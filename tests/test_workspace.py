"""Projects, descriptors and commands of a workspace."""

from pyspark.sql import functions as F

from lodestone.sources import workspace

FILES = [
    ("pom.xml", "<project/>"),
    ("services/users/pom.xml", '<project xmlns="http://m/4"><parent><groupId>shop</groupId></parent><artifactId>users</artifactId><dependencies><dependency><groupId>shop</groupId><artifactId>core</artifactId></dependency><dependency><groupId>org</groupId><artifactId>lib</artifactId></dependency></dependencies></project>'),
    ("services/users/src/inner/package.json", "{}"),
    ("libs/core/pom.xml", "<project><groupId>shop</groupId><artifactId>core</artifactId></project>"),
    ("frontend/web/package.json", '{"name": "web", "scripts": {"build": "x", "test": "vitest"}, "dependencies": {"ui": "1"}, "devDependencies": {"vitest": "2"}}'),
    ("frontend/web/node_modules/x/package.json", '{"name": "x"}'),
    ("frontend/ui/package.json", '{"name": "ui"}'),
    ("frontend/ui/jest.config.js", ""),
    ("tools/gen/gen.csproj", ""),
    ("php/composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}}'),
    (".hidden/p/go.mod", "module x"),
]


def test_workspace(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    got = {tuple(r[c] for c in ("path", "kind", "build_system", "test_runner", "service")) for r in workspace.projects(files).collect()}
    assert got == {
        ("services/users", "backend", "maven", "", "users"), ("libs/core", "backend", "maven", "", "core"), ("frontend/web", "frontend", "node", "vitest", ""),
        ("frontend/ui", "frontend", "node", "jest", ""), ("tools/gen", "project", "", "", ""), ("php", "project", "", "", ""),
    }
    symbols = {(r["path"], r["name"], r["kind"]) for r in workspace.manifest_symbols(files).collect()}
    assert symbols == {("frontend/web/package.json", "build", "script"), ("frontend/web/package.json", "test", "script"), ("php/composer.json", "App", "autoload")}
    edges = {(r["from"], r["to"], r["internal"]) for r in workspace.package_graph(workspace.packages(files)).collect()}
    assert edges == {("web", "ui", True), ("web", "vitest", False), ("shop:users", "shop:core", True), ("shop:users", "org:lib", False)}


def test_commands(spark):
    rows = spark.createDataFrame([("maven", "T.java", "T", "m"), ("gradle", "a/T.java", "", ""), ("jest", "x.test.js", "", ""), ("", "y", "", "")], "r string, f string, c string, m string")
    got = [r["x"] for r in rows.select(workspace.verification_command(*(F.col(k) for k in "rfcm")).alias("x")).collect()]
    assert got == ["mvn -Dtest=T#m test", "./gradlew test --tests T", "npx jest x.test.js", ""]
