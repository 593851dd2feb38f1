"""Declarations, imports, exports and references of JavaScript and TypeScript, as tables over tokens.

A tokenizer gives every token of a file its brackets: the partner, the one around it, and the innermost
scope (a block, a function with its parameters, or a loop head), and the texts of its neighbours.  What follows
is relational: statements are found by a token's neighbours, names are bound to intervals of tokens,
and a reference belongs to the innermost interval of its name that holds it, so a parameter or variable
of an inner scope hides an import.  Imports meet what a module exports by equality of module and name.

Files are read whole; nothing is joined pair by pair inside a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from . import sequence, symbols
from .graph import sized, written

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<t>`(?:\\.|[^`\\])*`)|(?P<w>[A-Za-z_$][\w$]*)|(?P<d>\d[\w.]*)|(?P<p>=>|\.\.\.|.)""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
# Words after which a slash begins a pattern, words before a bracket that is no parameter
# list, and words that begin a statement.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_NO_FUNCTION = frozenset("if for while switch with return typeof await new throw in of case do else yield void delete instanceof import super".split())
_STATEMENT = frozenset("const let var function class export import return if for while switch interface type enum throw try".split())
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "typeof", "await", "new", "throw", "function", "super", "import", "with", "delete", "void", "in", "of", "case", "do", "else", "yield", "instanceof", "constructor", "require")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
LAST = 2**31 - 1
TOKENS = (
    "path string, n int, text string, line int, around int, around_text string, around_closes int, listed boolean, low int, high int, binds boolean, "
    "b1 string, b2 string, b3 string, a1 string, a2 string, a3 string, a4 string, a5 string, from_line int, then_next string, function_next boolean, function_3 boolean, next_brace int, next_string string, next_from int, "
    "next_source string, head int, head_word string, head_line int, head_a1 string, head_source string, ended int"
)


class _File:
    """The tokens of one file; kinds: w word, s string, t template, d number, r pattern, p mark."""

    def __init__(self, source: str):
        self.kind, self.text, self.line = [], [], []
        at, line = 0, 1
        while at < len(source):
            m = _TOKEN.match(source, at)
            if m[0] == "/" and self._pattern_may_start() and (p := _REGEX.match(source, at)):
                self._put("r", "", line)
                at = p.end()
                continue
            if m.lastgroup:
                self._put(m.lastgroup, m[0][1:-1] if m.lastgroup == "s" else "" if m.lastgroup == "t" else m[0], line)
            line += m[0].count("\n")
            at = m.end()
        each = list(zip(self.kind, self.text))
        self.marks, self.words = [x if c == "p" else "" for c, x in each], [x if c == "w" else "" for c, x in each]
        self._brackets()
        self._scopes()

    def _put(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)

    def _pattern_may_start(self) -> bool:
        if not self.kind:
            return True
        kind, text = self.kind[-1], self.text[-1]
        return text in _BEFORE_PATTERN if kind == "w" else kind == "p" and text not in ")]}"

    def _mark(self, k: int) -> str:
        return self.marks[k] if 0 <= k < len(self.marks) else ""

    def _word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def _brackets(self) -> None:
        n = len(self.kind)
        self.around, self.partner = [-1] * n, [-1] * n
        stack: list[int] = []
        for k, mark in enumerate(self.marks):
            if mark in _CLOSE:
                while stack and self.text[stack[-1]] != _CLOSE[mark]:
                    stack.pop()
                if stack:
                    self.partner[k] = stack[-1]
                    self.partner[stack.pop()] = k
            self.around[k] = stack[-1] if stack else -1
            if mark in _OPEN:
                stack.append(k)
        for k, mark in enumerate(self.marks):  # brackets that nothing closes reach to the end
            if mark in _OPEN and self.partner[k] < 0:
                self.partner[k] = n

    def _arrow_end(self, arrow: int) -> int:
        """The last token of what an arrow gives."""
        k = arrow + 1
        if self._mark(k) == "{":
            return self.partner[k]
        while k < len(self.kind):
            mark = self._mark(k)
            if mark in (",", ";", ")", "]", "}") or (self._word(k) in _STATEMENT and self.line[k] > self.line[k - 1]):
                break
            k = self.partner[k] + 1 if mark in _OPEN else k + 1
        return k - 1

    def _body_end(self, k: int) -> int:
        """The end of the function whose parameters the bracket at k holds; -1: it holds none."""
        after, before = self.partner[k] + 1, self._word(k - 1)
        named = bool(before and before not in _NO_FUNCTION) or self._mark(k - 1) in ("]", ">", "*")
        if self._mark(after) == "=>":
            return self._arrow_end(after)
        if self._mark(after) == "{":
            return self.partner[after] if named else -1
        if self._mark(after) != ":":
            return -1
        j = after + 1
        if self._mark(j) == "{":  # a return type that is an object
            j = self.partner[j] + 1
        while j < len(self.kind):
            mark = self._mark(j)
            if mark == "=>":
                return self._arrow_end(j)
            if mark == "{":
                return self.partner[j] if named else -1
            if mark in (";", "=", ")", "]", "}") or (self._word(j) in _STATEMENT and self.line[j] > self.line[j - 1]):
                return -1
            j = self.partner[j] + 1 if mark in ("(", "[") else j + 1
        return -1

    def _scopes(self) -> None:
        n = len(self.kind)
        self.low, self.high, self.function, self.binds = [-1] * n, [LAST] * n, [False] * n, [False] * n
        holds: dict[int, tuple[int, int]] = {}
        for k, mark in enumerate(self.marks):
            if mark == "{":
                holds[k] = (k, self.partner[k])
            elif mark == "(":
                end = self._body_end(k)
                self.function[k] = end >= 0
                if end >= 0:
                    holds[k] = (k, end)
                elif self._word(k - 1) == "for" or self._word(k - 2) == "for":
                    last = self.partner[k] + 1
                    holds[k] = (k, self.partner[last] if self._mark(last) == "{" else last)
        scope = {-1: -1}  # of what stands in a bracket, which comes before it
        for k, around in enumerate(self.around):
            if (own := scope[around]) >= 0:
                self.low[k], self.high[k] = holds[own]
            if self.marks[k] in _OPEN:
                scope[k] = k if k in holds else own
        for k, (mark, word) in enumerate(zip(self.marks, self.words)):
            if mark == "(" and self.function[k]:
                self._pattern(k + 1, self.partner[k], holds[k])
            elif word in ("const", "let", "var") and self._mark(k - 1) != ".":
                self._declarators(k + 1, (self.low[k], self.high[k]))
            elif mark == "=>" and self._word(k - 1):
                self._bind(k - 1, (k - 1, self._arrow_end(k)))

    def _bind(self, k: int, scope: tuple[int, int]) -> None:
        self.binds[k] = True
        self.low[k], self.high[k] = scope

    def _pattern(self, k: int, end: int, scope: tuple[int, int], keyed: bool = False) -> None:
        """Binds the names of parameters or of a pattern between k and end."""
        start = True
        while k < min(end, len(self.kind)):
            mark = self._mark(k)
            if start and mark in ("{", "["):
                self._pattern(k + 1, self.partner[k], scope, mark == "{")
                start = False
            elif start and self._word(k) and self._word(k) not in ("public", "private", "protected", "readonly"):
                if keyed and self._mark(k + 1) == ":":
                    k += 2  # key: what it is bound to
                    continue
                self._bind(k, scope)
                start = False
            elif mark == ",":
                start = True
            k = self.partner[k] + 1 if mark in _OPEN else k + 1

    def _declarators(self, k: int, scope: tuple[int, int]) -> None:
        first = k
        while k < len(self.kind):
            mark = self._mark(k)
            if mark in (";", ")", "]", "}") or self._word(k) in ("of", "in") or (k > first and self._word(k) in _STATEMENT and self.line[k] > self.line[k - 1]):
                return
            if k == first or self._mark(k - 1) == ",":
                if mark in ("{", "["):
                    self._pattern(k + 1, self.partner[k], scope, mark == "{")
                elif self._word(k):
                    self._bind(k, scope)
            k = self.partner[k] + 1 if mark in _OPEN else k + 1

    def _after(self, values: dict[int, object]) -> list:
        """For each token the value of the next one that has any."""
        out, last = [None] * len(self.kind), None
        for k in range(len(out) - 1, -1, -1):
            out[k] = last
            last = values.get(k, last)
        return out

    def _since(self, marked: set[int]) -> list[int | None]:
        """For each token the last marked one, itself included."""
        out, last = [], None
        for k in range(len(self.kind)):
            last = k if k in marked else last
            out.append(last)
        return out

    def columns(self, path: str) -> list[list]:
        """The words as TOKENS: with the texts of the tokens before (b1 ..) and after (a1 ..), and what comes next; a string's
        text there is a quote and what it holds."""
        n, text = len(self.kind), self.text
        closes = [self.partner[k] if x in _OPEN else -1 for k, x in enumerate(self.marks)]
        then = [self._mark(c + 1) if c >= 0 else "" for c in closes]
        of = lambda values, none: [values[k] if k >= 0 else none for k in self.around]
        shown = [f'"{x}' if c == "s" else x for c, x in zip(self.kind, text)]
        before = lambda k: [""] * min(k, n) + shown[: max(n - k, 0)]
        after = lambda values, k, none: values[k:] + [none] * min(k, n)
        b1, a1 = before(1), after(shown, 1, "")
        # Where the next bracket on the file's own level ends, the next string, and the next source of a list in braces.
        brace = self._after({k: closes[k] for k, x in enumerate(self.marks) if x == "{" and self.around[k] == -1})
        string = self._after({k: text[k] for k, c in enumerate(self.kind) if c == "s"})
        source = self._after({k: k for k, x in enumerate(text) if x == "from" and b1[k] == "}"})
        # Items of braces belong to the latest import or export before them, if no other statement came between.
        head = self._since({k for k, x in enumerate(self.words) if x in ("import", "export") and b1[k] not in (".", "...")})
        ended = self._since({k for k, x in enumerate(self.marks) if x in (";", "=", "(")})
        at = lambda values, places: [None if k is None else values[k] for k in places]
        every = [
            [path] * n, range(n), text, self.line, self.around, of(self.marks, ""), of(self.partner, -1), of(self.function, False), self.low, self.high, self.binds,
            b1, before(2), before(3), a1, *(after(shown, k, "") for k in range(2, 6)), [None, *self.line[:-1]][:n], after(then, 1, None), after(self.function, 1, None), after(self.function, 3, None), brace, string, source,
            at(a1, source), head, at(text, head), at(self.line, head), at(a1, head), at(string, head), ended,
        ]
        return [list(compress(c, self.words)) for c in every]


def tokens(sources: DataFrame) -> DataFrame:
    """The words of the script files of (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in TOKENS.split(", "))])
        held: list[list] = [[] for _ in schema]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)
            for c in held:
                c.clear()
            return batch

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c, more in zip(held, _File(content or "").columns(path)):
                    c.extend(more)
                if len(held[0]) >= 16384:  # many small files share a batch
                    yield out()
        yield out()

    return sources.filter("language in ('javascript', 'typescript')").select("path", "content").mapInArrow(run, TOKENS)


def module_of(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]*$", "")


def declarations(t: DataFrame) -> DataFrame:
    """(path, module, name, kind, export_name, line, n, stop, qualified_name, id) on the file's own level; t: tokens."""
    fresh = (F.col("b1").isin("", ";", "}", "export", "default", "async", "abstract", "declare")) | (F.col("from_line") < F.col("line"))
    name = F.when(F.col("text") == "const", F.col("a1")).when(F.col("a1") == "*", F.col("a2")).otherwise(F.col("a1"))
    type_like = F.col("text").isin("class", "interface", "enum") | ((F.col("text") == "type") & F.col("a2").isin("=", "<"))
    plain = (F.col("text") == "function") & ((F.col("a2") == "(") | (F.col("a2") == "<") | (F.col("a1") == "*"))
    arrow = F.col("text").isin("const", "let", "var") & (F.col("a2") == "=") & (((F.col("a3") == "(") & F.col("function_3")) | ((F.col("a3") == "async") & ((F.col("a4") == "(") | (F.col("a5") == "=>"))) | (F.col("a4") == "=>"))
    rows = t.filter((F.col("around") == -1) & fresh & (type_like | plain | arrow) & name.rlike(r"^[A-Za-z_$]"))
    shown = F.array("b1", "b2", "b3")
    default = F.array_contains(shown, "default") & F.array_contains(shown, "export") & (F.col("b1").isin("default", "async", "abstract"))
    exported = (F.col("b1") == "export") | (F.col("b1").isin("async", "abstract", "declare") & (F.col("b2") == "export"))
    component = name.rlike("^[A-Z]") & F.col("path").rlike(r"\.[tj]sx$|components/|pages/")
    kind = F.when(type_like, F.col("text")).when(component, "component").otherwise("function")
    rows = rows.select("path", module_of(F.col("path")).alias("module"), name.alias("name"), kind.alias("kind"), F.when(default, "default").when(exported, name).otherwise("").alias("export_name"), "line", "n", F.coalesce(F.when(F.col("text") == "type", F.col("n")), "next_brace", F.col("n")).alias("stop"))
    qualified = F.concat_ws("#", "module", "name")
    return rows.withColumn("qualified_name", qualified).withColumn("id", F.concat(F.lit("symbol:"), stable_id(F.lit("script"), F.col("kind"), qualified, F.col("path"))))


def module_references(t: DataFrame) -> DataFrame:
    """(path, line, type, module, target_export, local_name, export_alias, type_only) of imports and exports; t: tokens."""
    statement = F.col("text").isin("import", "export") & ~F.col("b1").isin(".", "...")
    module, none = module_of(F.col("path")), F.lit("")
    found = []

    def add(where: Column, kind: Column, source: Column, export: Column, local: Column = none, alias: Column = none, only: Column = F.lit(False), line: Column = F.col("line")) -> None:
        found.append(F.when(where, F.struct(line.alias("line"), kind.alias("type"), source.alias("module"), export.alias("target_export"), local.alias("local_name"), alias.alias("export_alias"), only.alias("type_only"))))

    text = F.coalesce("next_string", none)
    named = lambda c: c.rlike(r"^[A-Za-z_$]")
    importing = statement & (F.col("text") == "import")
    static = importing & ~F.col("a1").isin("(", ".")
    add(static & F.startswith("a1", F.lit('"')), F.lit("imports_module"), F.substring("a1", 2, 1 << 20), F.lit("*"))
    known = F.startswith("a2", F.lit('"')) & F.col("a3").isin(")", ",")
    add(importing & (F.col("a1") == "("), F.lit("imports_module"), F.when(known, F.substring("a2", 2, 1 << 20)).otherwise(none), F.when(known, F.lit("*")).otherwise(none))
    only = (F.col("a1") == "type") & ~F.col("a2").isin("from", ",")
    first = F.when(only, F.col("a2")).otherwise(F.col("a1"))
    add(static & named(first), F.when(only, F.lit("imports_type")).otherwise(F.lit("imports_value")), text, F.lit("default"), local=first, only=only)
    add(static & (F.col("a1") == "*") & (F.col("a2") == "as"), F.lit("imports_namespace"), text, F.lit("*"), local=F.col("a3"))
    add(static & named(F.col("a1")) & (F.col("a2") == ",") & (F.col("a3") == "*") & (F.col("a4") == "as"), F.lit("imports_namespace"), text, F.lit("*"), local=F.col("a5"))
    # Items: a name after { or , (or after type there), with what it is called by "as".
    inside = (F.col("around_text") == "{") & F.col("head").isNotNull() & (F.col("around") > F.col("head")) & (F.coalesce("ended", F.lit(-1)) < F.col("head"))
    marked = (F.col("b1") == "type") & F.col("b2").isin("{", ",")
    item = inside & ((F.col("b1").isin("{", ",") & ~((F.col("text") == "type") & named(F.col("a1")) & (F.col("a1") != "as"))) | marked)
    called = F.when(F.col("a1") == "as", F.col("a2")).otherwise(F.col("text"))
    is_type = (F.col("head_a1") == "type") | marked
    add(item & (F.col("head_word") == "import"), F.when(is_type, F.lit("imports_type")).otherwise(F.lit("imports_value")), F.coalesce("head_source", none), F.col("text"), local=called, only=is_type, line=F.col("head_line"))
    # An export list has a source if "from" follows its closing brace.
    again = F.coalesce(F.col("next_from") == F.col("around_closes") + 1, F.lit(False))
    kind = F.when(again & is_type, "reexports_type").when(again, "reexports_value").otherwise("exports_local")
    listing = item & (F.col("head_word") == "export") & (F.col("around") <= F.col("head") + 2)
    add(listing, kind, F.when(again, F.substring("next_source", 2, 1 << 20)).otherwise(module), F.col("text"), alias=called, only=is_type, line=F.col("head_line"))
    exporting = statement & (F.col("text") == "export")
    add(exporting & (F.col("a1") == "*"), F.lit("reexports_all"), text, F.lit("*"), alias=F.when(F.col("a2") == "as", F.col("a3")).otherwise(none))
    bare = (F.col("a1") == "default") & named(F.col("a2")) & ~F.col("a2").isin("class", "function", "async", "abstract", "new", "interface") & ~F.col("a3").isin("(", ".", "=>")
    add(exporting & bare, F.lit("exports_local"), module, F.col("a2"), alias=F.lit("default"))
    # One pass over the words of statements, whatever they begin.
    return t.filter(statement | item).select("path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("path", "x.*")


def bindings(t: DataFrame, declared: DataFrame, references: DataFrame) -> DataFrame:
    """(path, name, low, high, binding, kind): every name with the tokens it holds for.

    kind: import, namespace, local, inner.  On the file's own level a variable is no binding of a usage.
    """
    imported = references.filter("local_name <> '' and type like 'imports%'")
    kind = F.when(F.col("type") == "imports_namespace", "namespace").otherwise("import")
    own = imported.select("path", F.col("local_name").alias("name"), F.lit(-1).alias("low"), F.lit(LAST).alias("high"), kind.alias("kind"), F.concat_ws("\n", "module", "target_export", F.col("type_only").cast("string")).alias("says"))
    top = declared.select("path", "name", F.lit(-1).alias("low"), F.lit(LAST).alias("high"), F.lit("local").alias("kind"), F.col("id").alias("says"))
    inner = t.filter("binds and low >= 0").select("path", F.col("text").alias("name"), "low", "high", F.lit("inner").alias("kind"), F.lit("").alias("says"))
    nested = t.filter(F.col("text").isin("function", "class", "interface", "enum") & (F.col("low") >= 0) & F.col("a1").rlike(r"^[A-Za-z_$]") & (F.col("b1") != "."))
    nested = nested.select("path", F.col("a1").alias("name"), "low", "high", F.lit("inner").alias("kind"), F.lit("").alias("says"))
    every = own.unionByName(top).unionByName(inner).unionByName(nested)
    # One binding for each interval: an import before a declaration.
    return every.groupBy("path", "name", "low", "high").agg(F.min_by(F.struct("kind", "says"), F.struct("kind", "says")).alias("b")).select("path", "name", "low", "high", "b.kind", "b.says")


def usages(t: DataFrame, declared: DataFrame, references: DataFrame) -> DataFrame:
    """(path, line, n, type, name, owner_id, module, target_export, local_id, type_only, reason) of names in use; t: tokens.

    Names are bound to an import, a namespace (by member call) or a declaration of the file; one that
    an inner scope hides, a constructor without an import, and a computed call have a reason and no target.
    """
    name = F.col("text")
    is_name = ~F.col("text").isin(*KEYWORDS)
    is_type = is_name & name.rlike("^[A-Z]") & (F.col("b1") == ":")
    in_variable = F.col("b3").isin("const", "let", "var")
    in_parameter = (F.col("around_text") == "(") & F.col("listed")
    called = (F.col("a1") == "(") & ~F.col("function_next")
    how = (
        F.when(is_type & (in_variable | in_parameter | (F.col("b2") == ")")), "type_reference")
        .when(is_name & (F.col("b1") == "<") & name.rlike("^[A-Z]") & F.col("path").rlike(r"(?i)\.[tj]sx$") & ~F.col("b2").rlike(r"^[\w$]"), "renders_component")
        .when(is_name & (F.col("b1") == "new") & (F.col("a1") == "("), "instantiates")
        .when(is_name & (F.col("b1") != ".") & (F.col("a1") == ".") & F.col("a2").rlike(r"^[A-Za-z_$]") & (F.col("a3") == "("), "member")
        .when(is_name & called & ~F.col("b1").isin(".", "function", "new", "class"), "calls")
        .when(is_name & (F.col("b1") != ".") & (F.col("a1") == "[") & (F.col("then_next") == "("), "computed")
    )
    # Both are read more than once below, and a word in use is one of many tokens.
    seen = written(t.select("path", "n", "line", "text", "a2", how.alias("how")).filter("how is not null")).withColumn("point_id", F.col("n"))
    key = lambda c: F.concat_ws("\n", "path", c)
    bound = written(bindings(t, declared, references)).withColumn("k", key("name")).withColumn("binding", F.concat_ws("\n", "kind", "says"))
    inner = sequence.enclosing(seen.withColumn("k", key("text")), bound, "k", "n", "low", "high", "binding").withColumn("part", F.split("binding", "\n"))
    known = bound.filter("kind <> 'inner'").groupBy("k").agg(F.min("kind").alias("outer"), F.min_by("says", "kind").alias("says"))
    rows = seen.withColumn("k", key("text")).join(sized(inner), ["k", "point_id"], "left").join(sized(known), "k", "left")
    outer, kind = F.col("outer"), F.coalesce(F.col("part")[0], F.lit(""))
    hidden = outer.isNotNull() & (kind == "inner")
    imported = outer == "import"
    fits = (
        (F.col("how").isin("type_reference", "renders_component") & imported)
        | (F.col("how").isin("instantiates", "computed"))
        | ((F.col("how") == "member") & (outer == "namespace"))
        | ((F.col("how") == "calls") & outer.isin("import", "local"))
    )
    rows = rows.filter(fits)
    loose = (F.col("how") == "computed") | ((F.col("how") == "instantiates") & ~F.coalesce(imported, F.lit(False)))
    reason = F.when(F.col("how") == "computed", "computed property call").when(loose, "constructor has no static module binding").when(hidden, "lexically shadowed by an inner scope").otherwise("")
    free = reason == ""
    far = free & outer.isin("import", "namespace")
    kind = F.when(F.col("how") == "calls", F.when(outer == "local", "calls_local").otherwise("calls_export")).when(F.col("how").isin("member", "computed"), "calls_export").otherwise(F.col("how"))
    export = F.when(far & (F.col("how") == "member"), F.col("a2")).when(far, F.col("part")[2]).when(F.col("how") == "computed", "").when(F.col("how") == "member", F.col("a2")).otherwise(F.col("text"))
    out = rows.select(
        "path", "line", "n", kind.alias("type"), F.when(F.col("how") == "member", F.col("a2")).otherwise(F.col("text")).alias("name"), F.when(far, F.col("part")[1]).otherwise("").alias("module"), export.alias("target_export"),
        F.when(free & (outer == "local"), F.col("part")[1]).otherwise("").alias("local_id"), (far & (F.col("part")[3] == "true")).alias("type_only"), reason.alias("reason"), F.col("n").alias("point_id"),
    )
    spans = declared.select("path", F.col("n").alias("low"), F.col("stop").alias("high"), F.col("id").alias("owner_id"))
    owners = sequence.enclosing(out.select("path", F.col("n"), "point_id"), spans, "path", "n", "low", "high", "owner_id")
    return out.join(sized(owners), ["path", "point_id"], "left").drop("point_id").fillna({"owner_id": ""})


def exports(declared: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """What each file exports, as symbols.exported takes it; targets: path, module, target (the file meant)."""
    targets = sized(targets)
    own = declared.filter("export_name <> ''").select(F.col("path").alias("module"), F.col("export_name").alias("name"), F.lit("declared").alias("kind"), F.lit(None).cast("string").alias("source_module"), F.lit(None).cast("string").alias("source_name"), F.col("id").alias("symbol_id"))
    listed = references.filter("type = 'exports_local'").select("path", F.col("target_export").alias("name"), "export_alias")
    # A name that is exported by a list is a declaration of the file, or an import that is passed on.
    local = listed.join(sized(declared.select("path", "name", "id")), ["path", "name"]).select(F.col("path").alias("module"), F.col("export_alias").alias("name"), F.lit("declared").alias("kind"), F.lit(None).cast("string").alias("source_module"), F.lit(None).cast("string").alias("source_name"), F.col("id").alias("symbol_id"))
    imported = references.filter("local_name <> '' and type in ('imports_value', 'imports_type')").select("path", F.col("local_name").alias("name"), "module", "target_export").join(targets, ["path", "module"])
    passed = listed.join(sized(imported), ["path", "name"]).select(F.col("path").alias("module"), F.col("export_alias").alias("name"), F.lit("named").alias("kind"), F.col("target").alias("source_module"), F.col("target_export").alias("source_name"), F.lit(None).cast("string").alias("symbol_id"))
    again = references.filter("type like 'reexports%' and export_alias <> '' and type <> 'reexports_all'").join(targets, ["path", "module"])
    named = again.select(F.col("path").alias("module"), F.col("export_alias").alias("name"), F.lit("named").alias("kind"), F.col("target").alias("source_module"), F.col("target_export").alias("source_name"), F.lit(None).cast("string").alias("symbol_id"))
    stars = references.filter("type = 'reexports_all' and export_alias = ''").join(targets, ["path", "module"])
    star = stars.select(F.col("path").alias("module"), F.lit(None).cast("string").alias("name"), F.lit("star").alias("kind"), F.col("target").alias("source_module"), F.lit(None).cast("string").alias("source_name"), F.lit(None).cast("string").alias("symbol_id"))
    return own.unionByName(local).unionByName(passed).unionByName(named).unionByName(star)


def resolve(used: DataFrame, declared: DataFrame, exported: DataFrame, targets: DataFrame) -> DataFrame:
    """used with symbol_id, candidates, resolution and category: what each usage means.

    A type counts for types only, a class or enumeration for both, anything else for values; a type-only
    import is no value.  Several symbols stay ambiguous, none is unresolved.
    """
    means = lambda kind: F.when(kind.isin("class", "enum"), F.lit(True)).when(kind.isin("interface", "type"), F.col("needs_type")).otherwise(~F.col("needs_type"))
    kinds = declared.select(F.col("id").alias("symbol_id"), F.col("kind").alias("symbol_kind"))
    # What a name means is found once for types and once for values, not for each usage; a local name stands alone, under no file.
    known = exported.select(F.col("module").alias("place"), F.col("name").alias("asked"), "symbol_id").join(sized(kinds), "symbol_id")
    known = known.unionByName(kinds.select(F.lit("").alias("place"), F.col("symbol_id").alias("asked"), "symbol_id", "symbol_kind"))
    known = known.withColumn("needs_type", F.explode(F.array(F.lit(True), F.lit(False)))).filter(means(F.col("symbol_kind")))
    found = known.groupBy("place", "asked", "needs_type").agg(F.count_distinct("symbol_id").alias("candidates"), F.min("symbol_id").alias("one"))
    rows = used.withColumn("usage_id", stable_id(F.lit("usage"), F.col("path"), F.col("n"), F.col("type"), F.col("name"))).withColumn("needs_type", F.col("type") == "type_reference")
    rows = rows.join(sized(targets), ["path", "module"], "left")
    near, far = F.col("local_id") != "", F.col("target").isNotNull() & (F.col("module") != "") & (~F.col("type_only") | F.col("needs_type"))
    # What asks for nothing is spread by its file.
    place = F.when(near, "").when(far, F.col("target")).otherwise(F.col("path"))
    rows = rows.withColumns({"place": place, "asked": F.when(near, F.col("local_id")).when(far, F.col("target_export"))}).drop("target")
    out = rows.join(sized(found), ["place", "asked", "needs_type"], "left").drop("place", "asked", "needs_type").fillna({"candidates": 0})
    resolution = F.when(F.col("candidates") == 0, "UNRESOLVED").when(F.col("candidates") == 1, "EXACT").otherwise("AMBIGUOUS")
    out = out.withColumn("symbol_id", F.when(F.col("candidates") == 1, F.col("one"))).withColumn("resolution", resolution).drop("one")
    return out.withColumn("category", symbols.usage_category(F.col("resolution"), F.lit(False)))


def script_usages(sources: DataFrame, aliases: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(declarations, imports and exports, resolved usages) of the script files of (path, language, content).

    aliases and packages as in symbols.module_targets.
    """
    t = written(tokens(sources))
    declared, references = written(declarations(t)), written(module_references(t))
    wanted = references.filter("module <> '' and type <> 'exports_local'").select("path", "module").distinct()
    asked = wanted.select(F.concat_ws("\n", "path", "module").alias("import_id"), F.col("path").alias("file"), "module")
    found = symbols.module_targets(asked, sources.filter("language in ('javascript', 'typescript')").select("path"), aliases, packages).filter("target is not null")
    targets = found.select(F.split("import_id", "\n")[0].alias("path"), F.split("import_id", "\n")[1].alias("module"), "target")
    targets = written(targets)
    exported = symbols.exported(written(exports(declared, references, targets)))
    return declared, references, resolve(usages(t, declared, references), declared, exported, targets)
