"""HTTP calls of JavaScript and TypeScript sources as contracts.

Scanned per file in batches: fetch calls, and calls on receivers that are an imported HTTP client or
were made by one. Paths, parameters, services and flags are expressions on the scanned text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .masking import arguments, closing, code_only, without_comments

RECORD = "file string, line int, http_method string, raw_path string, caller string, auth string, reason string"
_ID = r"[A-Za-z_$][\w$]*"
_FETCH = re.compile(r"(?<![\w$.])fetch\s*\(")
_CLIENT = re.compile(rf"(?<![\w$.])({_ID}(?:\.{_ID})*)\s*\.\s*(get|post|put|delete|patch|head|options)\s*(?:<[^()<>]*>)?\s*\(")
_FUNCTION = re.compile(rf"(?:\bfunction\s+({_ID})\s*\(|\b(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=]+)?=>|\b(?:async\s+)?({_ID})\s*\([^()]*\)\s*(?::[^{{;]+)?\{{)")
_IMPORT = re.compile(rf"""\bimport\s+({_ID})\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*["'](axios|ky|got|superagent)["']|\b(?:const|let|var)\s+({_ID})\s*=\s*require\s*\(\s*["'](axios|ky|got|superagent)["']\s*\)""")
_PATH = re.compile(r"""^(["'`])((?:https?://[^/"'`]+)?/.*|\$\{.*)\1$""", re.S)
# Marks of credentials in a call's options, in order.
_AUTH = (("bearer", r"\bBearer\b"), ("basic", r"\bBasic\b|\bauth\s*:\s*\{"), ("api_key", r"x-api-key|apikey"), ("session", r"credentials\s*:\s*[\"'](?:include|same-origin)|withCredentials\s*:\s*true"), ("oauth2", r"oauth"))


def scan_clients(file: str, text: str) -> list[tuple]:
    clear, code = without_comments(text), code_only(text)
    functions = []
    for m in _FUNCTION.finditer(code):
        name = m[1] or m[2] or m[3]
        if name in ("if", "for", "while", "switch", "catch", "function", "return"):
            continue
        opening = code.find("{", m.end() - 1)
        arrow = m[2] and (opening < 0 or code[m.end() : opening].strip())
        functions.append((m.start(), code.find("\n", m.end()) % (len(code) + 1) if arrow else closing(code, opening), name))
    clients = {m[1] or m[3] for m in _IMPORT.finditer(clear)}
    while True:
        made = {m[1] for m in re.finditer(rf"\b(?:const|let|var)\s+({_ID})\s*=\s*({_ID})\s*\.\s*(?:create|extend|instance)\s*\(", code) if m[2] in clients}
        if made <= clients:
            break
        clients |= made

    def caller(at: int) -> str:
        inside = [f for f in functions if f[0] <= at < f[1]]
        return max(inside)[2] if inside else ""

    def record(at: int, opening: int, method: str, reason: str):
        args = arguments(clear, code, opening)
        hit = _PATH.match(args[0]) if args else None
        if not hit:
            return None
        options = " ".join(args[1:])
        if reason == "fetch-call" and (m := re.search(r"""\bmethod\s*:\s*["'`](\w+)["'`]""", options)):
            method = m[1].upper()
        auth = next((k for k, p in _AUTH if re.search(p, options, re.I if k in ("api_key", "oauth2") else 0)), "")
        return (file, text.count("\n", 0, at) + 1, method, hit[2], caller(at), auth, reason)

    found = [record(m.start(), m.end() - 1, "GET", "fetch-call") for m in _FETCH.finditer(code)]
    found += [record(m.start(), m.end() - 1, m[2].upper(), "http-client-call") for m in _CLIENT.finditer(code) if m[1] in clients]
    return sorted(r for r in found if r)


def contracts(sources: DataFrame, services: dict[str, str] | None = None) -> DataFrame:
    """(contract_id, file, line, http_method, raw_path, path, query, service_candidate, unsafe_dynamic, internal, caller, auth, app, reason)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"]) for r in scan_clients(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    own = sources.filter("language in ('javascript', 'typescript')").filter(~paths.low_signal(F.col("path"))).select("path", "content").mapInPandas(run, RECORD)
    path = paths.normalise(F.col("raw_path"))
    return own.select(
        F.concat_ws(":", "file", "line", "http_method", "raw_path").alias("contract_id"), "file", "line", "http_method", "raw_path", path.alias("path"), F.array_join(paths.query_params(F.col("raw_path")), "&").alias("query"),
        paths.service_candidate(path, services).alias("service_candidate"), paths.unsafe(F.col("raw_path")).alias("unsafe_dynamic"), paths.frontend_internal(path, F.col("file")).alias("internal"), "caller", "auth", paths.app_of(F.col("file")).alias("app"), "reason",
    )
