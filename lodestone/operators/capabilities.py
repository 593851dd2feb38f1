"""What a line shows that its project can do: routes, clients, persistence, messaging, data flow, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exploded, lines
from .graph import sized

# Language, capability, kind, framework, words of the line, words of the lower-cased line.
_ROUTE, _CLIENT, _STORE, _MESSAGE, _RPC, _TEST = "http_route", "http_client", "persistence", "message_consumer_or_producer", "rpc_service", "test"
_BOUNDARY = "request_response_boundary"
RULES = (
    ("java", "routes", _ROUTE, "Spring MVC/WebFlux", ("@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@RequestMapping"), ()),
    ("java", "api_clients", _CLIENT, "Spring/Java HTTP", ("RestTemplate", "WebClient", "FeignClient", "HttpClient"), ()),
    ("java", "persistence", _STORE, "Spring Data", ("JpaRepository", "CrudRepository", "@Entity", "JdbcTemplate"), ()),
    ("java", "messaging", _MESSAGE, "Spring Messaging", ("@KafkaListener", "KafkaTemplate", "RabbitTemplate", "@RabbitListener"), ()),
    ("java", "messaging", _RPC, "gRPC", ("@GrpcService", "StreamObserver"), ()),
    ("java", "data_flow", "validation_boundary", "Jakarta Validation", ("@Valid", "@Validated"), ()),
    ("java", "tests", _TEST, "JUnit/Spring Test", ("@Test", "MockMvc", "WebTestClient"), ()),
    ("script", "routes", _ROUTE, "Express/Fastify", (), ("app.get(", "app.post(", "router.get(", "router.post(")),
    ("script", "routes", _ROUTE, "NestJS", ("@Controller(", "@Get(", "@Post("), ()),
    ("script", "routes", _ROUTE, "Next.js", (), ("nexthandler", "nextrequest", "getserversideprops")),
    ("script", "api_clients", _CLIENT, "Web/Node HTTP", (), ("fetch(", "axios.", "httpclient.")),
    ("script", "persistence", _STORE, "Node persistence", (), ("prisma.", "typeorm", "sequelize", "mongoose", "db.query(")),
    ("script", "messaging", _MESSAGE, "Node messaging", (), ("producer.send(", "consumer.subscribe(", "kafka.", "amqplib")),
    ("script", "messaging", _RPC, "gRPC", (), ("grpc.", "@grpc/grpc-js")),
    ("script", "data_flow", _BOUNDARY, "Node HTTP", (), ("req.body", "res.json(")),
    ("script", "tests", _TEST, "Jest/Vitest/Node Test/RTL", (), ("test(", "it(", "describe(", "render(")),
    ("go", "routes", _ROUTE, "Go HTTP/router", ("http.HandleFunc(", ".HandleFunc(", ".GET(", ".POST(", ".PUT(", ".DELETE("), ()),
    ("go", "api_clients", _CLIENT, "Go net/http", ("http.Get(", "http.Post(", "http.NewRequest(", "client.Do("), ()),
    ("go", "persistence", _STORE, "Go SQL/GORM", ("sql.Open(", "db.Query(", "db.Exec("), ("gorm.",)),
    ("go", "messaging", _MESSAGE, "Go Kafka/AMQP", ("WriteMessages(",), ("kafka.newreader(", "kafka.newwriter(", "amqp.dial(")),
    ("go", "messaging", _RPC, "gRPC", ("RegisterService(",), ("grpc.newserver(",)),
    ("go", "data_flow", _BOUNDARY, "Go HTTP", ("json.NewDecoder(", "json.NewEncoder(", ".Bind("), ()),
    ("go", "tests", _TEST, "Go test/httptest", ("func Test", "httptest.New"), ()),
    ("php", "routes", _ROUTE, "Laravel/Symfony", ("Route::", "#[Route(", "@Route("), ()),
    ("php", "api_clients", _CLIENT, "PHP HTTP client", ("Http::", "GuzzleHttp", "new Client("), ()),
    ("php", "persistence", _STORE, "Eloquent/Doctrine/PDO", ("extends Model", "EntityManager", "new PDO("), ("doctrine",)),
    ("php", "messaging", _MESSAGE, "PHP queue/messaging", ("Queue::", "dispatch(", "AMQP", "MessageBusInterface"), ()),
    ("php", "messaging", _RPC, "gRPC", ("BaseStub",), ("grpc\\client",)),
    ("php", "data_flow", _BOUNDARY, "PHP HTTP", ("->validate(", "Request $", "JsonResponse(", "response()->json("), ()),
    ("php", "tests", _TEST, "PHPUnit/Pest", ("extends TestCase",), ()),
    ("rust", "api_clients", _CLIENT, "Rust reqwest", (), ("reqwest::", "reqwest.", "client.get(", "client.post(")),
    ("rust", "persistence", _STORE, "Rust SQLx/Diesel/SeaORM", (), ("sqlx::", "diesel::", "sea_orm::", ".execute(")),
    ("rust", "messaging", _MESSAGE, "Rust Kafka/AMQP", (), ("rdkafka::", "futureproducer", "lapin::")),
    ("rust", "messaging", _RPC, "tonic gRPC", (), ("tonic::", "server::builder")),
    ("rust", "data_flow", _BOUNDARY, "Rust web", ("Json<", "web::Json", "HttpResponse::"), ()),
    ("rust", "tests", _TEST, "Rust test/tokio test", ("#[test]", "#[tokio::test]"), ()),
    ("python", "routes", _ROUTE, "FastAPI/Flask/Django", ("path(", "re_path("), ()),
    ("python", "api_clients", _CLIENT, "Python requests/httpx/aiohttp", (), ("requests.get(", "requests.post(", "httpx.", "aiohttp.")),
    ("python", "persistence", _STORE, "SQLAlchemy/Django ORM/DB-API", (), ("sqlalchemy", "django.db", "models.model", "psycopg", ".execute(")),
    ("python", "messaging", _MESSAGE, "Python Kafka/Celery/AMQP", (), ("kafka", "celery", "pika.")),
    ("python", "messaging", _RPC, "Python gRPC", (), ("grpc.", "_pb2_grpc")),
    ("python", "data_flow", _BOUNDARY, "Python web/validation", ("BaseModel", "JSONResponse("), ("request.json", "jsonify(")),
    ("python", "tests", _TEST, "pytest/unittest", ("unittest.TestCase",), ("pytest",)),
)
# Rules by pattern on the trimmed line.
PATTERNS = (
    ("rust", "routes", _ROUTE, "Axum/Actix/Rocket", r"^#\[(get|post|put|delete|patch)\(\s*\"[^\"]+\"\s*\)\]|\.route\(\s*\"[^\"]+\"\s*,\s*(get|post|put|delete|patch)\(\s*[A-Za-z_]\w*\s*\)\s*\)"),
    ("python", "routes", _ROUTE, "FastAPI/Flask/Django", r"^@[A-Za-z_]\w*\.(get|post|put|delete|patch|options|head|route)\s*\(\s*[\"'][^\"']+[\"']"),
    ("python", "tests", _TEST, "pytest/unittest", "^def test_"),
    ("php", "tests", _TEST, "PHPUnit/Pest", r"^(test|it)\("),
)


def capability_facts(sources: DataFrame) -> DataFrame:
    """(path, language, line_no, capability, kind, framework), once for each line and rule."""
    family = F.when(F.col("language").isin("javascript", "typescript"), "script").otherwise(F.col("language"))
    rows = lines(sources, "content", "path", "language").withColumn("family", family).withColumn("line", F.trim("line")).withColumn("low", F.lower("line"))
    found = []
    for language, capability, kind, framework, words, low in RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains("line", F.lit(w))
        for w in low:
            hit = hit | F.contains("low", F.lit(w))
        found.append((language, capability, kind, framework, hit))
    found += [(language, capability, kind, framework, F.rlike("line", F.lit(p))) for language, capability, kind, framework, p in PATTERNS]
    each = F.array(*(F.when((F.col("family") == language) & hit, F.struct(F.lit(c).alias("capability"), F.lit(k).alias("kind"), F.lit(f).alias("framework"))) for language, c, k, f, hit in found))
    return exploded(rows, "x", F.array_distinct(F.filter(each, lambda x: x.isNotNull()))).select("path", "language", "line_no", "x.*")


def weak_flows(flows: DataFrame, steps: DataFrame, limit: int = 10) -> DataFrame:
    """(route_id, confidence, reason) of flows without steps, or by their first step that isn't EXTRACTED or RESOLVED."""
    bad = ~F.coalesce("confidence", F.lit("")).isin("", "EXTRACTED", "RESOLVED")
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.concat(F.lit("flow contains inferred step "), F.col("name")))
    first = steps.groupBy("route_id").agg(F.count("*").alias("n"), F.min_by(F.struct("confidence", reason.alias("reason")), F.when(bad, F.col("pos"))).alias("x"))
    out = flows.select("route_id").distinct().join(sized(first), "route_id", "left")
    empty = F.col("n").isNull()
    weak = out.select("route_id", F.when(empty, "WEAK_MATCH").otherwise(F.col("x.confidence")).alias("confidence"), F.when(empty, "flow has no resolved handler or call steps").otherwise(F.col("x.reason")).alias("reason"))
    return weak.filter("confidence is not null").orderBy("route_id").limit(limit)
