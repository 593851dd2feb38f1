"""All queries of the catalogue and their SQL."""

from __future__ import annotations

from . import code, facts, features, routes, traces, usages  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
