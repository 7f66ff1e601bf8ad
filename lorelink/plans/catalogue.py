"""All registered queries: name -> (run over Tables, SQL or None)."""

import importlib

_MODULES = ["names", "text", "metrics", "vectors", "linking", "training"]


def catalogue() -> dict:
    merged = {}
    for name in _MODULES:
        merged.update(importlib.import_module(f"lorelink.plans.queries_{name}").QUERIES)
    return merged
