"""python -m lodestone.cli build|query|explain|context|report: a thin front over the tables."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("root")
    build.add_argument("out")
    build.add_argument("--target", default="all")
    query = commands.add_parser("query")
    query.add_argument("out")
    query.add_argument("task")
    query.add_argument("--query", default="")
    query.add_argument("--limit", type=int, default=20)
    query.add_argument("--detail", default="standard")
    query.add_argument("--continuation", default="")
    explain = commands.add_parser("explain")
    explain.add_argument("out")
    explain.add_argument("target")
    context = commands.add_parser("context")
    context.add_argument("out")
    context.add_argument("--query", required=True)
    context.add_argument("--tokens", type=int, default=0)
    report = commands.add_parser("report")
    report.add_argument("out")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .plans import build as builder
    from .plans import context as compiler
    from .plans.tasks import Catalogue
    from .sources import sinks

    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        tables = builder.tables(spark, args.root)
        names = sinks.write(spark, tables, args.out, args.target)
        print(json.dumps({"tables": names, "skipped_files": tables["skipped"].count()}))
        return 0
    tables = sinks.read(spark, args.out)
    if args.command == "query":
        rows, token = Catalogue(tables).run(args.task, args.query, args.limit, args.detail, args.continuation)
        print(json.dumps({"items": [r.asDict(recursive=True) for r in rows.collect()], "continuation": token}, default=str))
    elif args.command == "explain":
        rows = builder.explain(tables, args.target).orderBy("section", "label").limit(201).collect()
        for r in rows[:200]:
            print(f"{r['section']}: {r['label']}")
        if len(rows) > 200:
            print("more rows follow; only the first 200 are shown")
    elif args.command == "context":
        pack = compiler.compile_context(tables["facts"], tables["fact_edges"], args.query, args.tokens)
        print(json.dumps(vars(pack) | {"context_id": pack.context_id}, default=str))
    else:
        print(sinks.markdown(tables["routes"].orderBy("path", "http_method"), "Routes", "- `%s %s` -> %s (%s)", "http_method", "path", "handler", "file"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
