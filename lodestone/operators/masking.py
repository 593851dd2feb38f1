"""Comments and string bodies blanked out of a source text, so that offsets and lines stay."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_comments(text: str) -> str:
    return _TOKEN.sub(lambda m: _blank(m[0]) if m[0][:2] in ("//", "/*") else m[0], text)


def code_only(text: str) -> str:
    """Comments blanked, strings too but for their quotes."""
    return _TOKEN.sub(lambda m: _blank(m[0]) if m[0][:2] in ("//", "/*") else m[0][0] + _blank(m[0][1:-1]) + m[0][-1], text)


def closing(code: str, opening: int) -> int:
    """The offset after the bracket that closes the one at opening, or the end."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    depth = 0
    for k in range(opening, len(code)):
        if code[k] in pairs:
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if depth == 0:
                return k + 1
    return len(code)


def arguments(text: str, code: str, opening: int) -> list[str]:
    """Top-level arguments of the call whose bracket opens there, as in text."""
    end = closing(code, opening) - 1
    out, depth, at = [], 0, opening + 1
    for k in range(opening + 1, end):
        c = code[k]
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[at:k].strip())
            at = k + 1
    if text[at:end].strip():
        out.append(text[at:end].strip())
    return out
