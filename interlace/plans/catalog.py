"""All queries of the library by name; importing the operator modules registers them."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = (*(f"interlace.operators.{m}" for m in ("stats", "relational", "windows", "scans", "scoring", "references", "phrases", "vectors", "quality", "validation", "monitoring", "extraction", "pages", "ingest", "roundtrips")), "interlace.streaming.windows", "interlace.streaming.lifecycles")
for name in MODULES:
    importlib.import_module(name)

__all__ = ["QUERIES", "SQL"]
