"""Named tasks with a filter, a detail level and pages, over fact tables."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import free_text

DEFAULT_LIMIT, LARGEST_LIMIT = 20, 100


def page(rows: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    """One page in order, each row with its number n.

    Only limit + offset rows of each task reach the numbering.
    """
    first = rows.orderBy(*order).limit(offset + limit)
    return first.withColumn("n", F.row_number().over(W.orderBy(*order))).filter(F.col("n") > offset)


def token(task: str, offset: int) -> str:
    return base64.urlsafe_b64encode(f"{task}:{offset}".encode()).decode().rstrip("=")


def offset_of(task: str, continuation: str) -> int:
    if not continuation:
        return 0
    name, _, at = base64.urlsafe_b64decode(continuation + "=" * (-len(continuation) % 4)).decode().rpartition(":")
    if name != task or not at.isdigit():
        raise ValueError("the continuation token is not of this task")
    return int(at)


class Catalogue:
    """Tasks over tables: each has its table, the columns a query filters, an order and detail levels."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    # Task: (table, filtered columns, order, columns by detail).
    TASKS = {
        "symbol-inventory": ("symbols", ["id", "name", "kind", "file"], ["id"], {"summary": ["id", "name", "kind"]}),
        "symbol-usages": ("usages", ["symbol_id", "category", "file"], ["id"], {"summary": ["id", "symbol_id", "category"]}),
        "symbol-api-consumers": ("usages", ["symbol_id", "project", "file"], ["id"], {"summary": ["id", "symbol_id", "project"]}),
        "coverage": ("capabilities", ["project", "language", "capability"], ["project", "language", "capability"], {}),
        "diagnostics": ("diagnostics", ["id", "code", "explanation"], ["id"], {"summary": ["id", "code"]}),
        "evidence": ("evidence", ["id", "file", "reason"], ["id"], {"summary": ["id", "file"]}),
        "tests": ("test_map", ["test", "target"], ["test", "target"], {}),
        "endpoint-search": ("routes", ["http_method", "path", "handler"], ["file", "line", "http_method", "path"], {"summary": ["http_method", "path"]}),
        "service-context": ("service_edges", ["from_service", "to_service", "endpoints"], ["from_service", "to_service"], {}),
        "workspace-summary": ("projects", ["path", "kind", "service"], ["path"], {"summary": ["path", "kind"]}),
        "workspace-delta": ("diff", ["entity", "key", "change"], ["entity", "key"], {}),
        "endpoint-trace": ("trace_nodes", ["trace_id", "role", "file"], ["trace_id", "pos"], {}),
        "data-flow": ("data_flow", ["flow_id", "stage", "field"], ["flow_id", "pos"], {}),
        "impact-summary": ("impact", ["node", "risk"], ["node"], {}),
        "change-context": ("dossiers", ["id", "route", "risk"], ["id"], {"summary": ["id", "route"]}),
    }

    def run(self, task: str, query: str = "", limit: int = DEFAULT_LIMIT, detail: str = "standard", continuation: str = "") -> tuple[DataFrame, str]:
        """(one page, the token of the next page or an empty string)."""
        if task == "symbol-resolve":
            return self.resolve(query), ""
        if task not in self.TASKS:
            raise ValueError(f"unknown task: {task}")
        if not 1 <= limit <= LARGEST_LIMIT:
            raise ValueError(f"limit must be in 1..{LARGEST_LIMIT}")
        if detail not in ("summary", "standard", "full"):
            raise ValueError(f"unknown detail: {detail}")
        name, columns, order, details = self.TASKS[task]
        offset = offset_of(task, continuation)
        rows = self.tables[name].filter(free_text(query, *columns))
        # One row more shows whether there is another page.
        more = rows.orderBy(*order).limit(offset + limit + 1).count() > offset + limit
        out = page(rows, order, limit, offset)
        keep = details.get(detail)
        return (out.select(*keep) if keep else out), (token(task, offset + limit) if more else "")

    def resolve(self, query: str) -> DataFrame:
        """Symbols whose id or a name equals the query in any case; all of several are AMBIGUOUS."""
        q = F.lower(F.lit(query.strip()))
        found = self.tables["symbols"].filter((F.lower("id") == q) | (F.lower("name") == q) | (F.lower("qualified_name") == q))
        n = F.count("*").over(W.partitionBy())
        return found.withColumn("resolution", F.when(n == 1, "EXACT").otherwise("AMBIGUOUS")).orderBy("id").limit(LARGEST_LIMIT)
