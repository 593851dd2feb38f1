"""Java and script scanners, and the indexes over them."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clients, flows, java, match
from lodestone.sources import files

JAVA = [
    (
        "src/main/java/shop/UserController.java",
        """package shop;

import shop.UserService;
import java.util.List;
import static shop.Keys.BASE;

// class Commented {}
@RestController
@RequestMapping("/users")
@RequiredArgsConstructor
public class UserController {
    private final UserService service;
    private String note = "void fake(int x) {";

    @GetMapping({"/{id}", "/by-id/{id}"})
    public UserDto get(@PathVariable("id") Long id) {
        return service.find(id);
    }

    @RequestMapping(value = "/all", method = {RequestMethod.POST, RequestMethod.PUT})
    public List<UserDto> all() {
        helper();
        return service.list();
    }

    private void helper() {
        if (note.isEmpty()) { return; }
    }
}
""",
    ),
    ("src/main/java/shop/UserService.java", "package shop;\n@Service\nclass UserService {\n  private UserRepository repo;\n  UserDto find(Long id) { return repo.findById(id); }\n  List<UserDto> list() { return null; }\n}\n"),
    ("src/main/java/shop/UserRepository.java", "package shop;\n@Repository\npublic interface UserRepository extends JpaRepository<User, Long> {\n}\n"),
    ("src/main/java/shop/User.java", 'package shop;\n@Entity\n@Table(name = "users")\npublic class User { private Long id; }\n'),
    ("src/main/java/shop/UserDto.java", "package shop;\npublic record UserDto() { @NotNull private static String name; }\n"),
    ("src/main/java/shop/Config.java", 'package shop;\n@Configuration\nclass Config {\n  public static final String BASE = "/base";\n  @Bean("clock")\n  Clock makeClock() { return null; }\n}\n'),
    ("src/test/java/shop/UserServiceTest.java", "package shop;\nclass UserServiceTest {\n  private UserService service;\n  @Test\n  void findsUser() { service.find(1L); }\n}\n"),
]
SCRIPT = [
    (
        "apps/web/src/api.ts",
        """import axios from 'axios'
const http = axios.create({ baseURL: '/x' })
// fetch('/commented')
export async function loadUser(id: string) {
  const r = await fetch(`/users/${user.id}?full=1&a=2`, { method: 'GET', headers: { Authorization: 'Bearer ' + t } })
  return r.data
}
export const save = (u) => http.post('/users/all', u, { withCredentials: true })
other.get('/ignored')
function strange() { return fetch(`/items/${f(x)}/y`) }
""",
    ),
    ("vendor/lib.js", "fetch('/vendored')\n"),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = spark.createDataFrame(JAVA, "path string, content string")
    return java.java_records(rows.withColumn("language", files.language(F.col("path")))).cache()


def names(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_java_records(records):
    assert names(records.filter("record = 'type'"), "name", "type") == {("UserController", "class"), ("UserService", "class"), ("UserRepository", "interface"), ("User", "class"), ("UserDto", "record"), ("Config", "class"), ("UserServiceTest", "class")}
    assert names(records.filter("record = 'method'"), "owner", "name", "type") == {
        ("UserController", "get", "UserDto"), ("UserController", "all", "List<UserDto>"), ("UserController", "helper", "void"), ("UserService", "find", "UserDto"),
        ("UserService", "list", "List<UserDto>"), ("Config", "makeClock", "Clock"), ("UserServiceTest", "findsUser", "void"),
    }
    assert ("UserController", "service", "UserService", True) in names(records.filter("record = 'field'"), "owner", "name", "type", "final")
    assert names(records.filter("record = 'method' and name = 'all'"), "line", "end_line") == {(21, 24)}


def test_annotation_index(records):
    assert names(java.components(records), "name", "kind") == {("UserController", "rest_controller"), ("UserService", "service"), ("UserRepository", "repository"), ("Config", "configuration")}
    assert names(java.endpoints(records), "http_method", "path", "method") == {("GET", "/users/{id}", "get"), ("GET", "/users/by-id/{id}", "get"), ("POST", "/users/all", "all"), ("PUT", "/users/all", "all")}
    assert names(java.repositories(records), "name", "entity", "id_type") == {("UserRepository", "User", "Long")}
    assert names(java.entities(records), "name", "table") == {("User", "users")}
    assert names(java.beans(records), "name", "type", "config") == {("clock", "Clock", "Config")}
    assert names(java.constants(records), "owner", "name", "value") == {("Config", "BASE", "/base")}
    assert ("UserDto", "name", "String", True) in names(java.dtos(records), "dto", "field", "type", "required")
    assert names(java.dependencies(records), "from", "to", "injection") == {("UserController", "UserService", "constructor"), ("UserService", "UserRepository", "field"), ("UserServiceTest", "UserService", "field")}
    assert ("src/main/java/shop/UserController.java", "src/main/java/shop/UserService.java", "imports_internal") in names(java.imports(records), "from", "to", "type")
    assert names(java.service_dependencies(records, {"UserRepository": "ms-db"}), "service") == {("ms-db",)}


def test_java_calls_and_flows(records):
    edges = java.call_edges(records)
    assert names(edges, "from_owner", "from_name", "to_owner", "to_name", "confidence_score") == {
        ("UserController", "get", "UserService", "find", 1.0), ("UserController", "all", "UserService", "list", 1.0), ("UserController", "all", "UserController", "helper", 1.0),
        ("UserService", "find", "UserRepository", "findById", 0.85), ("UserServiceTest", "findsUser", "UserService", "find", 1.0),
    }
    assert names(java.test_map(records), "test_method", "target_method") == {("findsUser", "find")}
    starts = java.endpoints(records).select(F.concat_ws(" ", "http_method", "path").alias("route_id"), flows.method_key(F.col("file"), F.col("controller"), F.col("method")).alias("key"))
    steps = flows.endpoint_flows(starts, edges).filter("route_id = 'GET /users/{id}'").orderBy("pos")
    assert [(r["owner"], r["name"]) for r in steps.collect()] == [("UserService", "find"), ("UserRepository", "findById")]
    path = flows.persistence_path(steps.select(F.col("route_id").alias("flow_id"), "pos", "owner", F.col("name").alias("method")), java.repositories(records), java.entities(records))
    assert names(path, "repository", "method", "entity", "table") == {("UserRepository", "findById", "User", "users")}


def test_script_clients_match_endpoints(spark, records):
    sources = spark.createDataFrame(SCRIPT, "path string, content string")
    found = clients.contracts(sources.withColumn("language", files.language(F.col("path"))))
    assert names(found, "http_method", "path", "caller", "auth", "unsafe_dynamic", "line") == {("GET", "/users/{id}", "loadUser", "bearer", False, 5), ("POST", "/users/all", "save", "session", False, 8), ("GET", "/items/{dynamic}/y", "strange", "", True, 10)}
    assert names(found.filter("line = 5"), "query", "app", "service_candidate") == {("a=2&full=1", "web", "ms-user")}
    routes = java.endpoints(records).select(F.concat_ws(" ", "http_method", "path").alias("route_id"), "http_method", "path", F.lit("ms-user").alias("service_candidate"))
    matched = match.contract_matches(found.withColumn("internal", F.lit(False)), routes)
    assert names(matched, "path", "issue", "route_id") == {("/users/{id}", "matched", "GET /users/{id}"), ("/users/all", "matched", "POST /users/all"), ("/items/{dynamic}/y", "unsafe_dynamic", None)}
