"""Named queries.  Each module registers the queries of one area."""

from __future__ import annotations

import importlib

MODULES = ("urls", "normalize", "pages", "faces", "packages", "coverage", "products", "ops")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
