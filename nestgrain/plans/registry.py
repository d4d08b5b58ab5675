"""All registered queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

GROUPS = (
    "agreement_queries", "contract_queries", "pooling_queries", "geometry_queries", "cohort_queries",
    "similarity_queries", "modelling_queries", "source_queries", "keyed_queries",
)


def _load() -> dict:
    found: dict = {}
    for group in GROUPS:
        try:
            module = importlib.import_module(f"{__package__}.{group}")
        except ModuleNotFoundError as error:
            if error.name == f"{__package__}.{group}":
                continue
            raise
        clash = set(found) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found


REGISTERED = _load()
