"""Symbols, imports, functions, routes and calls from source lines: one pattern table per kind.

A rule applies to the lines of its languages.  Each line meets only the rules of its language, by a
CASE over literal patterns, so extraction is one pass without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import exploded, lines
from .graph import sized
from .sequence import enclosing


@dataclass(frozen=True)
class Rule:
    languages: tuple[str, ...]
    pattern: str
    name: int
    kind: str | int  # a label, or the group that holds it
    order: int = 0


_ID = "[A-Za-z_][A-Za-z0-9_]*"
_JS = "[A-Za-z_$][A-Za-z0-9_$]*"
_SCRIPT = ("javascript", "typescript")

# Declaration patterns by language.
SYMBOLS = (
    Rule(_SCRIPT, rf"^\s*(?:export\s+)?class\s+({_JS})", 1, "class"),
    Rule(_SCRIPT, rf"^\s*(?:export\s+)?function\s+({_JS})\s*\(", 1, "function"),
    Rule(("go",), rf"^\s*package\s+({_ID})\s*$", 1, "package"),
    Rule(("go",), rf"^\s*func\s+(?:\([^)]*\)\s*)?({_ID})\s*\(", 1, "function"),
    Rule(("go",), rf"^\s*type\s+({_ID})\s+(?:struct|interface|{_ID})", 1, "type"),
    Rule(("python",), rf"^\s*class\s+({_ID})", 1, "class"),
    Rule(("python",), rf"^\s*def\s+({_ID})\s*\(", 1, "function"),
    Rule(("php",), r"^\s*namespace\s+([^;]+);", 1, "namespace"),
    Rule(("php",), rf"^\s*(?:abstract\s+|final\s+)?(class|interface|trait)\s+({_ID})", 2, 1),
    Rule(("php",), rf"^\s*(?:public\s+|protected\s+|private\s+|static\s+|final\s+|abstract\s+)*function\s+({_ID})\s*\(", 1, "function"),
    Rule(("shell",), r"^\s*(?:function\s+)?([A-Za-z_][A-Za-z0-9_-]*)\s*(?:\(\))?\s*\{", 1, "function"),
    Rule(("rust",), rf"^\s*(?:pub\s+)?(?:async\s+)?(fn|struct|enum|trait|impl)\s+({_ID})", 2, 1),
    Rule(("kotlin", "scala"), rf"^\s*(?:(?:public|private|protected|internal|open|data|sealed|abstract|final)\s+)*(class|object|interface|enum|fun|trait)\s+({_ID})", 2, 1),
    Rule(("swift",), rf"^\s*(?:(?:public|private|internal|open|final)\s+)*(class|struct|enum|protocol|func)\s+({_ID})", 2, 1),
    Rule(("ruby",), r"^\s*(class|module|def)\s+([A-Za-z_][A-Za-z0-9_!?=]*)", 2, 1),
    Rule(("c", "cpp"), rf"^\s*(?:template\s*<[^>]+>\s*)?(class|struct|enum)\s+({_ID})", 2, 1),
    Rule(("c", "cpp"), rf"^\s*(?:template\s*<[^>]+>\s*)?(?:[A-Za-z_][A-Za-z0-9_:<>,*&\s]+\s+)+({_ID})\s*\([^;]*\)\s*(?:\{{|$)", 1, "function"),
    Rule(("csharp",), rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async)\s+)*(class|struct|interface|enum|record)\s+({_ID})", 2, 1),
    Rule(("java",), rf"^\s*(?:(?:public|protected|private|abstract|final|sealed|static)\s+)*(class|interface|enum|record)\s+({_ID})\b", 2, 1),
    Rule(("markdown",), r"^#{1,6}\s+(.+?)\s*$", 1, "heading"),
)
# Import patterns by language.
IMPORTS = (
    Rule(_SCRIPT, r"""^\s*import\s+(?:.+?\s+from\s+)?["']([^"']+)["']""", 1, "imports"),
    Rule(("go",), r"""^\s*import\s+(?:[._A-Za-z0-9]+\s+)?"([^"]+)\"""", 1, "imports"),
    Rule(("python",), r"^\s*import\s+([A-Za-z_][A-Za-z0-9_.]*)", 1, "imports"),
    Rule(("python",), r"^\s*from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import\s+", 1, "imports"),
    Rule(("php",), r"^\s*use\s+([^;]+);", 1, "imports"),
    Rule(("php",), r"""\b(?:require|require_once|include|include_once)\b.*['"]([^'"]+\.php)['"]""", 1, "includes"),
    Rule(("shell",), r"^\s*(?:source|\.)\s+(.+?)(?:\s|$)", 1, "sources"),
    Rule(("rust",), r"^\s*use\s+([^;]+);", 1, "imports"),
    Rule(("kotlin", "scala"), r"^\s*import\s+([A-Za-z0-9_.*]+)", 1, "imports"),
    Rule(("java",), r"^\s*import\s+(?:static\s+)?([^;]+);", 1, "imports"),
    Rule(("swift",), r"^\s*import\s+([A-Za-z0-9_]+)", 1, "imports"),
    Rule(("ruby",), r"""^\s*require(?:_relative)?\s+["']([^"']+)["']""", 1, "imports"),
    Rule(("c", "cpp"), r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]""", 1, "imports"),
    Rule(("csharp",), r"^\s*using\s+([A-Za-z0-9_.]+)\s*;", 1, "imports"),
)
# Route patterns; groups of method, path and handler (0: none).
ROUTES = (
    (("go",), "net/http", rf"""\b(?:http\.)?HandleFunc\s*\(\s*["']([^"']+)["']\s*,\s*({_ID})""", 0, 1, 2),
    (("go",), "router", rf"""\.\s*(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s*\(\s*["']([^"']+)["']\s*,\s*({_ID})""", 1, 2, 3),
    (("php",), "laravel", rf"""Route::(get|post|put|delete|patch|options|any)\s*\(\s*['"]([^'"]+)['"]\s*,\s*\[?\s*{_ID}::class\s*,\s*['"]([^'"]+)['"]""", 1, 2, 3),
    (_SCRIPT, "react-router", rf"""<Route\b[^>]*\bpath=["']([^"']+)["'][^>]*\belement=\{{\s*<({_JS})""", 0, 1, 2),
    (("rust",), "axum", rf"""\.route\(\s*"([^"]+)"\s*,\s*(get|post|put|delete|patch)\(\s*({_ID})\s*\)\s*\)""", 2, 1, 3),
)
KIND_NAMES = {"fn": "function", "fun": "function", "func": "function", "def": "function", "trait": "interface", "protocol": "interface"}
# Names that are no calls worth keeping.
LOW_VALUE_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "func", "def", "class", "new", "print", "println", "len", "append", "make", "super", "require", "import")


def _apply(rows: DataFrame, rules: tuple[Rule, ...], outer: bool = False) -> DataFrame:
    """rows (…, language, line) exploded to (…, name, kind), in the order of the rules.

    The pattern is tried only on lines of the rule's languages; what doesn't match gives an empty name.
    outer: a line without a name stays, with nulls.
    """
    found, tried = [], {}
    for k, r in enumerate(rules):
        line = F.col("line")
        for language in r.languages:
            tried.setdefault(language, []).append(f"(?:{r.pattern})")
        name = F.trim(F.regexp_extract(line, r.pattern, r.name))
        label = F.lit(r.kind) if isinstance(r.kind, str) else F.lower(F.regexp_extract(line, r.pattern, r.kind))
        for a, b in KIND_NAMES.items() if not isinstance(r.kind, str) else ():
            label = F.when(label == a, F.lit(b)).otherwise(label)
        hit = F.struct(F.lit(k).alias("rule"), name.alias("name"), label.alias("kind"))
        found.append(F.when(F.col("language").isin(*r.languages), hit))
    # Most lines fit no rule of their language, which one pattern tells.
    some = F.lit(False)
    for language, patterns in tried.items():
        some = F.when(F.col("language") == language, F.rlike(line, F.lit("|".join(patterns)))).otherwise(some)
    hits = F.when(some, F.filter(F.array(*found), lambda h: h.isNotNull() & (h["name"] != "")))
    out = rows.withColumn("hit", F.explode_outer(hits)) if outer else exploded(rows.filter(some), "hit", hits)
    return out.select(*[c for c in rows.columns if c != "line"], "hit.name", "hit.kind")


def symbols(sources: DataFrame) -> DataFrame:
    """(path, language, line_no, name, kind) of sources (path, language, content).

    Python methods and PHP methods are indented; test_ names and Go Test functions are tests.
    """
    return _symbols(lines(sources, "content", "path", "language")).select("path", "language", "line_no", "name", "kind")


def _symbols(rows: DataFrame, outer: bool = False) -> DataFrame:
    """rows (path, language, line_no, line, …) with name and kind of the line's symbols."""
    out = _apply(rows.withColumn("indented", F.col("line").rlike(r"^\s+")), SYMBOLS, outer)
    kind = (
        F.when((F.col("kind") == "function") & F.col("language").isin("python", "php") & F.col("name").rlike("^test_?"), "test")
        .when((F.col("kind") == "function") & (F.col("language") == "go") & F.col("name").rlike("^Test[A-Za-z0-9_]*$"), "test")
        .when((F.col("kind") == "function") & F.col("language").isin("python", "php") & F.col("indented"), "method")
        .otherwise(F.col("kind"))
    )
    return out.withColumn("kind", kind).drop("indented")


def relations(sources: DataFrame) -> DataFrame:
    """(path, language, line_no, target, type), with Go import blocks by a running count of their brackets."""
    rows = lines(sources, "content", "path", "language")
    single = _apply(rows, IMPORTS).select("path", "language", "line_no", F.col("name").alias("target"), F.col("kind").alias("type"))
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    go = rows.filter("language = 'go'")
    opened = F.sum(F.col("line").rlike(r"^\s*import\s*\(").cast("int")).over(w)
    # A block ends at the first closing bracket after it opened: brackets are numbered within blocks.
    inner = go.withColumn("block", opened).filter("block > 0")
    wb = W.partitionBy("path", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    inner = inner.withColumn("closed", F.sum(F.col("line").rlike(r"^\s*\)").cast("int")).over(wb)).filter("closed = 0")
    target = F.regexp_extract("line", r'^\s*(?:[._A-Za-z0-9]+\s+)?"([^"]+)"', 1)
    block = inner.select("path", "language", "line_no", target.alias("target"), F.lit("imports").alias("type")).filter("target <> ''")
    return single.unionByName(block)


def routes(sources: DataFrame) -> DataFrame:
    """(path, language, line_no, framework, http_method, route, handler)."""
    rows = lines(sources, "content", "path", "language")
    found = []
    for languages, framework, pattern, method, route, handler in ROUTES:
        get = lambda g: F.regexp_extract("line", pattern, g) if g else F.lit("")
        hit = F.struct(F.lit(framework).alias("framework"), F.upper(get(method)).alias("http_method"), get(route).alias("route"), get(handler).alias("handler"))
        found.append(F.when(F.col("language").isin(*languages), hit))
    hits = F.filter(F.array(*found), lambda h: h.isNotNull() & (h["route"] != ""))
    line_routes = exploded(rows, "h", hits).select("path", "language", "line_no", "h.*")
    return line_routes.unionByName(decorated_routes(rows)).unionByName(script_routes(rows))


def decorated_routes(rows: DataFrame) -> DataFrame:
    """Python and Rust attributes: the handler is the next function of the file."""
    python = r"""^\s*@[A-Za-z_][A-Za-z0-9_]*\.(get|post|put|delete|patch|options|head|route)\s*\(\s*["']([^"']+)["']"""
    rust = r"""^\s*#\[(get|post|put|delete|patch)\(\s*"([^"]+)"\s*\)\]"""
    pick = lambda g: F.when(F.col("language") == "python", F.regexp_extract("line", python, g)).otherwise(F.regexp_extract("line", rust, g))
    own = rows.filter("language in ('python', 'rust')")
    header = F.regexp_extract("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:def|fn)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(1, W.unboundedFollowing)
    named = own.withColumn("verb", pick(1)).withColumn("route", pick(2)).withColumn("fn", F.when(header != "", header))
    named = named.withColumn("handler", F.coalesce(F.first("fn", ignorenulls=True).over(w), F.lit("")))
    framework = F.when(F.col("language") == "python", "decorator").otherwise("attribute")
    method = F.when(F.col("verb") == "route", "").otherwise(F.upper("verb"))
    return named.filter("route <> ''").select("path", "language", "line_no", framework.alias("framework"), method.alias("http_method"), "route", "handler")


def script_routes(rows: DataFrame) -> DataFrame:
    """Express and Fastify: a receiver counts only if it was made by an imported factory."""
    own = rows.filter(F.col("language").isin(*_SCRIPT))
    factory = F.coalesce(
        F.nullif(F.regexp_extract("line", rf"""^\s*import\s+({_JS})\s+from\s+["'](?:express|fastify)["']""", 1), F.lit("")),
        F.nullif(F.regexp_extract("line", rf"""^\s*(?:const|let|var)\s+({_JS})\s*=\s*require\s*\(\s*["'](?:express|fastify)["']\s*\)""", 1), F.lit("")),
    )
    made = rf"^\s*(?:const|let|var)\s+({_JS})\s*=\s*({_JS})(?:\s*\.\s*Router)?\s*\("
    factories = own.select("path", factory.alias("factory")).filter("factory is not null").distinct()
    receivers = own.select("path", F.regexp_extract("line", made, 1).alias("receiver"), F.regexp_extract("line", made, 2).alias("factory")).filter("receiver <> ''")
    receivers = receivers.join(sized(factories), ["path", "factory"], "left_semi").select("path", "receiver").distinct()
    call = rf"""\b({_JS})\s*\.\s*(get|post|put|delete|patch|options|head)\s*\(\s*["']([^"']+)["']\s*,\s*({_JS})"""
    calls = own.select("path", "language", "line_no", *(F.regexp_extract("line", call, k + 1).alias(n) for k, n in enumerate(("receiver", "verb", "route", "handler")))).filter("route <> ''")
    return calls.join(sized(receivers), ["path", "receiver"], "left_semi").select("path", "language", "line_no", F.lit("script-server").alias("framework"), F.upper("verb").alias("http_method"), "route", "handler")


def calls(sources: DataFrame, low_value: tuple[str, ...] = LOW_VALUE_CALLS) -> DataFrame:
    """(path, language, line_no, receiver, name): member and bare calls of a line, once each, low-value names gone."""
    rows = lines(sources, "content", "path", "language")
    pattern = rf"(?:({_JS})\s*(?:\.|->|::)\s*)?\b({_JS})\s*\("
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("receiver"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("name"))
    found = exploded(rows.filter(F.contains("line", F.lit("("))), "c", F.array_distinct(pairs)).select("path", "language", "line_no", "c.receiver", "c.name")
    return found.filter(~F.col("name").isin(*low_value))


ENDS = "path string, name string, kind string, line_no int, end_line int, owner string"


def functions_with_ends(sources: DataFrame) -> DataFrame:
    """(path, name, kind, line_no, end_line, owner): braces by running depth, Python by indentation.

    The owner is the Python class that a deeper function follows, or the PHP class whose braces hold it.
    The lines of a file are read once in order, with a stack of the functions that are still open.
    """
    rows = lines(sources, "content", "path", "language")
    opens, closes = F.length("line") - F.length(F.replace(F.col("line"), F.lit("{"))), F.length("line") - F.length(F.replace(F.col("line"), F.lit("}")))
    indent = F.length("line") - F.length(F.ltrim("line"))
    solid = (F.trim("line") != "") & ~F.trim("line").startswith("#")
    rows = rows.select("path", "language", "line_no", "line", opens.alias("o"), closes.alias("c"), F.when(solid, indent).alias("indent"))
    # A line is read once, for its brackets and for what it declares; other symbols leave a line without a name.
    head = F.col("kind").isin("function", "method", "test") | ((F.col("kind") == "class") & F.col("language").isin("python", "php"))
    rows = _symbols(rows, outer=True).withColumns({"python": F.col("language") == "python", "name": F.when(head, F.col("name")), "kind": F.when(head, F.col("kind"))}).drop("language")
    rows = rows.repartition("path").sortWithinPartitions("path", "line_no", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, line, last, depth, stack, found = None, 0, None, 0, [], []
        owner, base = "", 0  # of Python: the class's indent; of others: the depth before the class

        def ended() -> None:
            found.extend((path, *head, last, own) for _, *head, own in stack)
            stack.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 6
            found.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["path", "name", "kind", "line_no", "end_line", "owner"])

        for batch in batches:
            for p, n, python, o, c, indent, name, kind in zip(*(x.to_pylist() for x in batch.columns)):
                if p != path:
                    ended()
                    path, line, last, depth, owner = p, 0, None, 0, ""
                if n != line:
                    line, before = n, depth
                    depth += o - c
                    if indent is not None or depth >= 0:
                        last = n
                    # A function ends where the depth is back, or before the first line that is not deeper.
                    level = indent if python else depth
                    while stack and level is not None and stack[-1][0] >= level:
                        _, *head, own = stack.pop()
                        found.append((path, *head, n - 1 if python else n, own))
                    if owner and not python and c > 0 and depth <= base:
                        owner = ""
                if kind == "class":
                    owner, base = name, indent if python else before
                elif name is not None:
                    own = owner if owner and (not python or indent > base) else ""
                    if not python and o > 0 and depth <= before:
                        found.append((path, name, kind, n, n, own))
                    else:
                        stack.append((indent if python else before, name, kind, n, own))
            yield out()
        ended()
        yield out()

    return rows.select("path", "line_no", "python", "o", "c", "indent", "name", "kind").mapInArrow(run, ENDS)


def effect_ranges(sources: DataFrame) -> DataFrame:
    """(path, low, high): lines after a useEffect call's own, up to the one that closes its brackets."""
    rows = lines(sources.filter(F.col("language").isin(*_SCRIPT)), "content", "path")
    line = F.regexp_replace("line", "//.*$", "")
    count = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark)))
    rows = rows.select("path", "line_no", count("(").alias("o"), count(")").alias("c"), F.col("line").contains("useEffect").alias("begins"))
    rows = rows.repartition("path").sortWithinPartitions("path", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last, open_, found = None, 0, [], []
        for batch in batches:
            for p, n, o, c, begins in zip(*(x.to_pylist() for x in batch.columns)):
                if p != path:
                    found += [(path, low + 1, last) for low, _ in open_]
                    path, open_ = p, []
                open_ = [(low, depth + o - c) for low, depth in open_] + ([(n, o - c)] if begins else [])
                found += [(path, low + 1, n) for low, depth in open_ if depth <= 0]
                open_ = [x for x in open_ if x[1] > 0]
                last = n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["path", "low", "high"])
            found = []
        found = [(path, low + 1, last) for low, _ in open_]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["path", "low", "high"])

    return rows.mapInArrow(run, "path string, low int, high int").filter("low <= high")


# Fixed value: a local function bound to an event in JSX.
HANDLER = r"\bon[A-Z][A-Za-z0-9_$]*=\{\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\}"


def call_usage(sources: DataFrame, functions: DataFrame, points: DataFrame) -> DataFrame:
    """(file, point_id, usage) of script calls (file, point_id, line) inside a bound event handler or an effect.

    functions: file, name, line, end_line.  A handler's own head and last line are outside it; where
    both hold, the handler decides.  Other calls have no row.
    """
    rows = lines(sources.filter(F.col("language").isin(*_SCRIPT)), "content", "path")
    bound = rows.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("line", F.lit(HANDLER), F.lit(1))).alias("name")).distinct()
    inner = functions.join(sized(bound), ["file", "name"], "left_semi").select("file", (F.col("line") + 1).alias("low"), (F.col("end_line") - 1).alias("high"), F.lit("event_handler").alias("usage"))
    effects = effect_ranges(sources).select(F.col("path").alias("file"), "low", "high", F.lit("effect").alias("usage"))
    held = lambda ranges: enclosing(points, ranges, "file", "line", "low", "high", "usage")
    return held(inner).unionByName(held(effects)).groupBy("file", "point_id").agg(F.max("usage").alias("usage"))
