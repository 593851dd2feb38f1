"""Route paths: normal forms, and keys under which compatible paths are equal.

Two route paths are compatible if they have equally many segments, placeholders stand only against
placeholders, and the others agree in any case.  So compatibility is equality of ``canon`` and a
join on it is a hash join.  ``{type}`` is compatible with three literals as well; ``keys`` gives such
paths a key for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def is_placeholder(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}") & (F.length(segment) >= 2)


def canon(parts: Column) -> Column:
    """Segments as one key: placeholders as {}, all else in lower case."""
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(is_placeholder(s), F.lit("{}")).otherwise(F.lower(s))), "/"))


def _is_base(segment: Column, mounts: Sequence[str]) -> Column:
    low = F.lower(segment)
    named = low.isin(*(m.lower() for m in mounts)) if mounts else F.lit(False)
    return low.contains("base_path") | named | low.endswith("service")


def _tail(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _typed(parts: Column) -> Column:
    """The segments, and where the first {type} stands also with each of its literals."""
    at = F.array_position(F.transform(parts, F.lower), "{type}").cast("int")
    literal = lambda w: F.transform(parts, lambda s, i: F.when(i == at - 1, F.lit(w)).otherwise(s))
    return F.when(at > 0, F.array(parts, *(literal(w) for w in params.TYPE_LITERALS))).otherwise(F.array(parts))


def keys(path: Column, mounts: Sequence[str] = ()) -> Column:
    """All keys of a path: itself, and without a base segment before at least one other.

    mounts: first segments under which the caller's services are mounted, besides those that name themselves so.
    """
    parts = segments(path)
    based = (F.size(parts) >= 2) & _is_base(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), mounts)
    variants = F.when(based, F.array(parts, _tail(parts))).otherwise(F.array(parts))
    return F.array_distinct(F.transform(F.flatten(F.transform(variants, _typed)), canon))


def gateway_keys(path: Column, mounts: Sequence[str] = ()) -> Column:
    """Keys of the path without a gateway's first segment; none if there is no such segment."""
    parts = segments(path)
    led = (F.size(parts) >= 2) & F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).isin(*params.GATEWAY_PREFIXES)
    rest = F.concat(F.lit("/"), F.array_join(_tail(parts), "/"))
    return F.when(led, keys(rest, mounts)).otherwise(F.array().cast("array<string>"))


def normalise(raw: Column) -> Column:
    """A raw URL path as a route path: no scheme, host, query or fragment; templates as placeholders;
    single slashes; a leading one and no trailing one."""
    path = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r"\$\{(?:[A-Za-z0-9_$]+\.)*([A-Za-z0-9_$]+)\}", r"{$1}")
    path = F.regexp_replace(path, r"\$\{[^}]*\}", "{dynamic}")
    path = F.regexp_replace(path, r"/:([A-Za-z0-9_]+)", r"/{$1}")
    path = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


def unsafe(raw: Column) -> Column:
    """Whether a template expression is more than a dotted name."""
    return F.regexp_replace(raw, r"\$\{(?:[A-Za-z0-9_$]+\.)*[A-Za-z0-9_$]+\}", "").contains("${")


def query_params(raw: Column) -> Column:
    """name=value pairs of the query, sorted; a pair without = has an empty value."""
    query = F.regexp_extract(raw, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))


def service_candidate(path: Column, table: dict[str, str] | None = None) -> Column:
    """The service of a path's first segment: from the table, else ms- and the segment without one final s."""
    first = F.lower(F.coalesce(F.get(segments(path), F.lit(0)), F.lit("")))
    guess = F.when((first == "") | is_placeholder(first), F.lit("")).otherwise(F.concat(F.lit("ms-"), F.regexp_replace(first, "s$", "")))
    for segment, service in (table or {}).items():
        guess = F.when(first == segment, F.lit(service)).otherwise(guess)
    return guess


def frontend_internal(path: Column, file: Column) -> Column:
    """An /api/ call from application code that is not itself an API route."""
    return path.startswith("/api/") & F.lower(file).rlike("(^|/)(app|pages|src)/") & ~F.lower(file).rlike("(^|/)(app|pages)/api/")


def app_of(file: Column) -> Column:
    parts = F.split(file, "/")
    return F.when((F.get(parts, F.lit(0)) == "apps") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.lit("workspace-root"))


def package_of(file: Column) -> Column:
    parts = F.split(file, "/")
    return F.when(F.get(parts, F.lit(0)).isin("apps", "packages") & (F.size(parts) > 1), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.lit(""))


def low_signal(file: Column) -> Column:
    parts = F.split(F.lower(file), "/")
    folder = F.exists(parts, lambda s: s.isin("vendor", "dist", "generated", "__generated__", "storybook", ".storybook", "archive"))
    return folder | F.lower(file).endswith(".d.ts") | F.lower(file).endswith(".min.js")


def hide_parameter_names(path: Column) -> Column:
    """{name} as {_}, {name:constraint} as {_:constraint}."""
    return F.regexp_replace(F.regexp_replace(path, r"\{[^{}:]+:([^{}]*)\}", r"{_:$1}"), r"\{[^{}:]+\}", "{_}")
