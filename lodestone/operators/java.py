"""Java sources as tables, and the annotation index over them.

The scanner needs brackets, so it runs per file in Arrow batches; its rows are tagged records, and all
that follows (components, endpoints, fields, calls to methods) are joins and expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import stable_id
from .graph import sized
from .masking import arguments, closing, code_only, without_comments
from .sequence import first_per_key

RECORD = "path string, record string, ordinal int, package string, owner string, name string, line int, end_line int, type string, supertypes string, receiver string, value string, arguments array<string>, final boolean, annotations array<struct<name:string,args:string,line:int>>"
_WORDS = r"(?:public|protected|private|abstract|final|sealed|static|synchronized|default|native|transient|volatile|strictfp)"
_TYPE = re.compile(rf"((?:{_WORDS}\s+)*)\b(class|interface|enum|record)\s+([A-Za-z_]\w*)\s*([^{{;]*)\{{")
_MEMBER = re.compile(rf"(?<=[;{{}}\n)])\s*((?:{_WORDS}\s+)*)(?:<[^<>]*>\s*)?([A-Za-z_][\w.$]*(?:\s*<[\w\s<>,.?&\[\]$]*>)?(?:\s*\[\s*\])*)\s+([A-Za-z_]\w*)\s*([=;(])")
_ANNOTATION = re.compile(r"@(?!interface\b)([A-Za-z_][\w.]*)\s*(\()?")
_CALL = re.compile(r"(?:\b(new)\s+)?(?:\b([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\.\s*)?\b([A-Za-z_]\w*)\s*\(")
# Words that open brackets without a call.
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "synchronized", "try", "super", "this", "assert", "throw"}
_NO_TYPE = {"return", "new", "throw", "else", "case", "package", "import", "assert", "goto", "instanceof"}


def scan_source(path: str, text: str) -> list[dict]:
    """Records of one file: type, method, field, call, import."""
    clear, code = without_comments(text), code_only(text)
    line_of = lambda at: text.count("\n", 0, at) + 1
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", clear, re.M)
    package = package[1] if package else ""
    out: list[dict] = []

    def add(record, at, **more):
        base = {"path": path, "record": record, "ordinal": len(out), "package": package, "owner": "", "name": "", "line": line_of(at), "end_line": 0, "type": "", "supertypes": "", "receiver": "", "value": "", "arguments": [], "final": False, "annotations": []}
        out.append(base | more)

    for m in re.finditer(r"^\s*import\s+(static\s+)?([^;]+);", clear, re.M):
        add("import", m.start(2), name=m[2].strip(), type="static" if m[1] else "")
    # Annotations, with where each ends: one belongs to the declaration that follows it.
    marks = []
    for m in _ANNOTATION.finditer(code):
        end = closing(code, m.end() - 1) if m[2] else m.end()
        marks.append((m.start(), end, m[1].split(".")[-1], clear[m.end() : end - 1].strip() if m[2] else ""))
    hidden = list(code)
    for a, b, _, _ in marks:
        for k in range(a, b):
            if hidden[k] != "\n":
                hidden[k] = " "
    bare = "".join(hidden)

    def annotated(at: int) -> list[dict]:
        start = max(bare.rfind(c, 0, at) for c in ";{}") + 1
        return [{"name": n, "args": v, "line": line_of(a)} for a, _, n, v in marks if start <= a < at]

    types = []
    for m in _TYPE.finditer(bare):
        end = closing(bare, m.end() - 1)
        types.append((m.start(), m.end() - 1, end, m[3]))
        tail = re.sub(r"\s+", " ", m[4])
        above = re.search(r"\bextends\s+(.+?)(?:\bimplements\b|$)", tail)
        below = re.search(r"\bimplements\s+(.+)$", tail)
        supertypes = ";".join(x.strip() for x in ((above[1] if above else ""), (below[1] if below else "")) if x)
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        add("type", at, name=m[3], type=m[2], end_line=line_of(end - 1), supertypes=supertypes, annotations=annotated(at))

    def owner(at: int) -> str:
        inner = [t for t in types if t[1] < at < t[2]]
        return max(inner)[3] if inner else ""

    methods = []
    at = 0
    while m := _MEMBER.search(bare, at):
        at = m.end() - 1
        kind = m[2].split("<")[0].strip()
        name_at = m.start(3)
        inside = any(a < name_at < b for a, b, _ in methods)
        if kind in _NO_TYPE or m[3] in _NO_CALL or not owner(name_at) or inside:
            at = m.end()
            continue
        declared = re.sub(r"\s+", "", m[2])
        if m[4] == "(":
            after = closing(bare, m.end() - 1)
            tail = re.match(r"\s*(?:throws\s+[\w.,\s]+)?([{;])", bare[after:])
            if not tail:
                at = m.end()
                continue
            body = after + tail.end() - 1
            end = closing(bare, body) if tail[1] == "{" else body + 1
            methods.append((body, end, m[3]))
            add("method", name_at, owner=owner(name_at), name=m[3], type=declared, end_line=line_of(end - 1), value=", ".join(parameters := arguments(clear, bare, m.end() - 1)), arguments=parameters, annotations=annotated(m.start(2)))
            at = body
        else:
            stop = bare.find(";", m.end() - 1)
            stop = len(bare) if stop < 0 else stop
            value = clear[m.end() : stop].strip() if m[4] == "=" else ""
            add("field", name_at, owner=owner(name_at), name=m[3], type=re.sub(r"<.*", "", declared), value=value, final="final" in m[1].split(), annotations=annotated(m.start(2)))
            at = max(stop, m.end())
    for body, end, name in methods:
        for m in _CALL.finditer(bare, body, end):
            if m[3] in _NO_CALL or m[1]:
                continue
            args = arguments(clear, bare, m.end() - 1)
            add("call", m.start(3), owner=owner(m.start(3)), name=m[3], type=name, receiver=re.sub(r"\s+", "", m[2] or ""), value=args[0] if args else "", arguments=args)
    return out


def java_records(sources: DataFrame) -> DataFrame:
    """Tagged records of all Java files of (path, language, content); a file is read whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"]) for r in scan_source(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return sources.filter("language = 'java'").select("path", "content").mapInPandas(run, RECORD)


def has(name: str) -> Column:
    return F.exists("annotations", lambda a: a["name"] == name)


def args_of(*names: str) -> Column:
    """The arguments of the first annotation of one of the names."""
    return F.coalesce(F.get(F.filter("annotations", lambda a: a["name"].isin(*names)), F.lit(0))["args"], F.lit(""))


# Annotations to component kinds, in order of precedence, and to HTTP methods.
COMPONENTS = (("RestController", "rest_controller"), ("Controller", "controller"), ("Service", "service"), ("Repository", "repository"), ("Configuration", "configuration"), ("Component", "component"))
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": ""}


def component_kind() -> Column:
    kind = F.lit("")
    for name, label in reversed(COMPONENTS):
        kind = F.when(has(name), label).otherwise(kind)
    return kind


def components(records: DataFrame) -> DataFrame:
    return records.filter("record = 'type'").select("name", component_kind().alias("kind"), F.col("path").alias("file"), "line", "package").filter("kind <> ''")


def entities(records: DataFrame) -> DataFrame:
    table = F.regexp_extract(args_of("Table"), r'name\s*=\s*"([^"]*)"', 1)
    return records.filter(F.col("record") == "type").filter(has("Entity")).select("name", F.col("path").alias("file"), "line", table.alias("table"))


def repositories(records: DataFrame) -> DataFrame:
    """Repositories with the first type argument of what they extend."""
    entity = F.regexp_extract("supertypes", r"<\s*([A-Za-z_]\w*)", 1)
    id_type = F.regexp_extract("supertypes", r"<[^,<>]*,\s*([A-Za-z_]\w*)", 1)
    return records.filter("record = 'type'").filter(component_kind() == "repository").select("name", F.col("path").alias("file"), "line", entity.alias("entity"), id_type.alias("id_type"))


def beans(records: DataFrame) -> DataFrame:
    named = F.regexp_extract(args_of("Bean"), '"([^"]+)"', 1)
    return records.filter("record = 'method'").filter(has("Bean")).select(F.when(named != "", named).otherwise(F.col("name")).alias("name"), "type", F.col("owner").alias("config"), F.col("path").alias("file"), "line")


def constants(records: DataFrame) -> DataFrame:
    """(owner, name, value) of string constants."""
    value = F.regexp_extract("value", r'^"([^"]*)"$', 1)
    return records.filter("record = 'field' and final").select("owner", "name", value.alias("value")).filter("value <> ''")


def _path_values(args: Column) -> Column:
    """String literals of a mapping: those of value or path if named, else the first position."""
    named = F.regexp_extract(args, r"(?:value|path)\s*=\s*(\{(?:\s*\"[^\"]*\"\s*,?)*\s*\}|\"[^\"]*\")", 1)
    bare = F.when(args.rlike(r"^\s*[\"{]"), F.regexp_extract(args, r"^\s*(\{(?:\s*\"[^\"]*\"\s*,?)*\s*\}|\"[^\"]*\")", 1)).otherwise("")
    return F.regexp_extract_all(F.when(named != "", named).otherwise(bare), F.lit('"([^"]*)"'), F.lit(1))


def endpoints(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(http_method, path, controller, method, file, line, return_type): methods x paths of REST controllers.

    keys: further columns, as a project, within which a path names one file.
    """
    names = list(MAPPINGS)
    types = records.filter("record = 'type'").filter(has("RestController")).select(*keys, "path", F.col("name").alias("owner"), F.coalesce(F.get(_path_values(args_of("RequestMapping")), F.lit(0)), F.lit("")).alias("base"))
    own = records.filter("record = 'method'").filter(F.exists("annotations", lambda a: a["name"].isin(*names)))
    mapping = F.get(F.filter("annotations", lambda a: a["name"].isin(*names)), F.lit(0))
    declared = F.regexp_extract_all(mapping["args"], F.lit(r"RequestMethod\.([A-Z]+)"), F.lit(1))
    by_name = F.create_map(*(F.lit(x) for kv in MAPPINGS.items() for x in kv))[mapping["name"]]
    verbs = F.when(by_name != "", F.array(by_name)).when(F.size(declared) > 0, declared).otherwise(F.array(F.lit("GET")))
    found = _path_values(mapping["args"])
    each = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    rows = own.select(*keys, "path", "owner", "name", "line", "type", F.explode(verbs).alias("http_method"), each.alias("each")).select("*", F.explode("each").alias("sub"))
    joined = rows.join(sized(types), [*keys, "path", "owner"])
    return joined.select(*keys, "http_method", paths.normalise(F.concat_ws("/", "base", "sub")).alias("path"), F.col("owner").alias("controller"), F.col("name").alias("method"), joined["path"].alias("file"), "line", F.col("type").alias("return_type"))


def dtos(records: DataFrame) -> DataFrame:
    """(dto, field, type, required, file): fields of types that are no component and no entity."""
    types = records.filter("record = 'type'").filter((component_kind() == "") & ~has("Entity")).select("path", F.col("name").alias("owner"))
    required = F.exists("annotations", lambda a: a["name"].isin("NotNull", "NotBlank", "NotEmpty", "NonNull"))
    fields = records.filter("record = 'field'").select("path", "owner", "name", "type", required.alias("required"))
    return fields.join(types, ["path", "owner"], "left_semi").select(F.col("owner").alias("dto"), F.col("name").alias("field"), "type", "required", F.col("path").alias("file"))


def dependencies(records: DataFrame) -> DataFrame:
    """(from, to, field, injection): fields whose type is declared in the project."""
    types = records.filter("record = 'type'").select(F.col("name").alias("type"), F.col("path").alias("to_file"))
    built = records.filter("record = 'type'").filter(has("RequiredArgsConstructor")).select(F.col("name").alias("owner")).distinct().withColumn("_built", F.lit(True))
    fields = records.filter("record = 'field' and owner <> ''").join(sized(first_per_key(types, ["type"], [F.desc("to_file")])), "type").join(sized(built), "owner", "left")
    injection = F.when(F.col("final") & F.coalesce("_built", F.lit(False)), "constructor").otherwise("field")
    return fields.select(F.col("owner").alias("from"), F.col("type").alias("to"), F.col("name").alias("field"), injection.alias("injection"), F.col("path").alias("from_file"), "to_file", "line")


def call_edges(records: DataFrame) -> DataFrame:
    """Calls with their target: a declared method is 1.0, a declared type alone 0.85, else no edge.

    The owner of a call is its receiver's field type, the receiver itself if it starts with a capital,
    the caller's own type for this, or that type if it declares the method.
    """
    methods = first_per_key(records.filter("record = 'method'").select(F.col("owner").alias("to_owner"), F.col("name").alias("to_name"), F.col("path").alias("m_file"), F.col("line").alias("m_line"), "ordinal"), ["to_owner", "to_name"], [F.desc("m_file"), F.desc("ordinal")]).drop("ordinal")
    fields = first_per_key(records.filter("record = 'field'").select("owner", F.col("name").alias("receiver"), F.col("type").alias("field_type"), "path", "ordinal"), ["owner", "receiver"], [F.desc("path"), F.desc("ordinal")]).select("owner", "receiver", "field_type")
    types = first_per_key(records.filter("record = 'type'").select(F.col("name").alias("to_owner"), F.col("path").alias("t_file"), F.col("line").alias("t_line")), ["to_owner"], [F.desc("t_file"), F.desc("t_line")])
    calls = records.filter("record = 'call'").select("path", "owner", F.col("type").alias("from_name"), F.col("name").alias("to_name"), F.regexp_replace("receiver", r"^this\.", "").alias("receiver"), F.col("line").alias("call_line"))
    own = methods.select(F.col("to_owner").alias("owner"), "to_name", F.lit(True).alias("own"))
    joined = calls.join(sized(fields), ["owner", "receiver"], "left").join(sized(own), ["owner", "to_name"], "left")
    to_owner = (
        F.when(F.col("receiver") == "this", F.col("owner"))
        .when(F.col("field_type").isNotNull(), F.col("field_type"))
        .when(F.col("receiver").rlike("^[A-Z]"), F.col("receiver"))
        .when((F.col("receiver") == "") & F.col("own"), F.col("owner"))
    )
    resolved = joined.withColumn("to_owner", to_owner).filter("to_owner is not null").join(sized(methods), ["to_owner", "to_name"], "left").join(sized(types), "to_owner", "left")
    kept = resolved.filter("m_file is not null or t_file is not null")
    exact = F.col("m_file").isNotNull()
    rows = kept.select(
        stable_id(F.lit("call"), F.col("owner"), F.col("from_name"), F.col("to_owner"), F.col("to_name"), F.col("call_line")).alias("id"),
        F.col("path").alias("from_file"), F.col("owner").alias("from_owner"), "from_name", F.coalesce("m_file", "t_file").alias("to_file"), "to_owner", "to_name", F.coalesce("m_line", "t_line").alias("to_line"), "call_line",
        F.lit("EXTRACTED").alias("confidence"), F.when(exact, 1.0).otherwise(0.85).alias("confidence_score"), F.when(exact, "method declaration matched").otherwise("type declaration matched").alias("reason"),
    )
    return first_per_key(rows, ["from_owner", "from_name", "to_owner", "to_name"], [F.col("from_file"), F.col("call_line"), F.col("id")])


def test_map(records: DataFrame) -> DataFrame:
    """Test methods' calls to declared methods of other files."""
    tests = records.filter("record = 'method'").filter(F.col("path").rlike("src/test/|_test")).filter(F.exists("annotations", lambda a: a["name"].isin("Test", "ParameterizedTest", "RepeatedTest"))).select(F.col("owner").alias("from_owner"), F.col("name").alias("from_name"))
    return call_edges(records).filter("from_file <> to_file").join(tests, ["from_owner", "from_name"], "left_semi").select(F.col("from_file").alias("test_file"), F.col("from_owner").alias("test_class"), F.col("from_name").alias("test_method"), F.col("to_file").alias("target_file"), F.col("to_owner").alias("target_class"), F.col("to_name").alias("target_method"), F.col("call_line").alias("line"))


def imports(records: DataFrame) -> DataFrame:
    """(from, to, type): imports of project types go to their file, all others are external."""
    types = records.filter("record = 'type'").select(F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("target"), F.col("path").alias("file"))
    types = types.groupBy("target").agg(F.min("file").alias("file"))
    own = records.filter("record = 'import'").select(F.col("path").alias("from"), F.col("name").alias("target"), "line")
    found = own.join(sized(types), "target", "left")
    return found.select("from", F.coalesce("file", "target").alias("to"), F.when(F.col("file").isNotNull(), "imports_internal").otherwise("imports_external").alias("type"), "line")


def service_dependencies(records: DataFrame, clients: dict[str, str]) -> DataFrame:
    """(file, service, line): fields of known client types; clients maps type names to services."""
    if not clients:
        return records.limit(0).select(F.col("path").alias("file"), F.lit("").alias("service"), "line")
    names = F.create_map(*(F.lit(x) for kv in clients.items() for x in kv))
    return records.filter("record = 'field'").select(F.col("path").alias("file"), names[F.col("type")].alias("service"), "line").filter("service is not null").distinct()
