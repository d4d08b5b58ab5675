"""Registered queries of the corpus operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

GROUPS = ("warc", "minhash", "suffix", "packing", "decontamination", "credentials", "vectors", "languages", "licenses", "quality",
          "collocations", "negatives", "pieces")

QUERIES: dict = {}
for _group in GROUPS:
    QUERIES |= importlib.import_module(f"{__package__}.{_group}_query").QUERIES
