"""Capability facts and weak flows."""

from lodestone.operators import capabilities


def test_capability_facts(spark):
    body = [("a.java", "java", '@GetMapping("/x")\n@Valid Foo f;\nint x;'), ("b.ts", "typescript", "const r = await fetch('/x')\nKAFKA.Producer()"), ("c.py", "python", "@app.get('/x')\ndef test_x():\n  import kafka"), ("d.md", "markdown", "fetch(")]
    rows = spark.createDataFrame(body, "path string, language string, content string")
    got = {(r["path"], r["line_no"], r["capability"], r["framework"]) for r in capabilities.capability_facts(rows).collect()}
    assert got == {
        ("a.java", 1, "routes", "Spring MVC/WebFlux"), ("a.java", 2, "data_flow", "Jakarta Validation"), ("b.ts", 1, "api_clients", "Web/Node HTTP"), ("b.ts", 2, "messaging", "Node messaging"),
        ("c.py", 1, "routes", "FastAPI/Flask/Django"), ("c.py", 2, "tests", "pytest/unittest"), ("c.py", 3, "messaging", "Python Kafka/Celery/AMQP"),
    }


def test_weak_flows(spark):
    flows = spark.createDataFrame([("a",), ("b",), ("c",)], "route_id string")
    steps = spark.createDataFrame([("a", 1, "f", "EXTRACTED", ""), ("b", 1, "f", "RESOLVED", ""), ("b", 2, "g", "INFERRED", ""), ("b", 3, "h", "WEAK", "late")], "route_id string, pos int, name string, confidence string, reason string")
    got = {(r["route_id"], r["confidence"], r["reason"]) for r in capabilities.weak_flows(flows, steps).collect()}
    assert got == {("b", "INFERRED", "flow contains inferred step g"), ("c", "WEAK_MATCH", "flow has no resolved handler or call steps")}
