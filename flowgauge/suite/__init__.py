"""The registered queries: one module per part of the inventory."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "rules", "runs", "facts", "deadlines", "state", "graphs", "feeds", "catalog", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"flowgauge.suite.{name}")
