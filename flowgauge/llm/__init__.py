"""Operators of a training-data pipeline: mixing, scoring, filtering, de-duplication, packing, search, archives, scans.

Nothing outside this folder imports it; `load()` registers its queries.
"""

from __future__ import annotations

import importlib

MODULES = ("mixing", "suffix_tree", "quality", "exact_dedup", "packing", "topk", "warc", "licenses", "near_dedup", "secrets",
           "divergence", "spelling", "line_rules")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"flowgauge.llm.{name}")
