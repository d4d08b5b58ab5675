"""Text helpers: identifiers, cosmetic name normalisation, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_identifier(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalise_source_name(name: Column) -> Column:
    """Upper-case base name with a leading subject number padded to three digits."""
    upper = F.upper(base_name(name))
    number = F.regexp_extract(upper, r"^(\d+)(_.+)$", 1)
    rest = F.regexp_extract(upper, r"^(\d+)(_.+)$", 2)
    return F.when(number != "", F.concat(F.format_string("%03d", number.try_cast("bigint")), rest)).otherwise(upper)


def trailing_index(stem: Column) -> Column:
    """Integer after the last underscore of a file stem (extension ignored)."""
    bare = F.regexp_replace(base_name(stem), r"\.[^.]*$", "")
    return F.element_at(F.split(bare, "_"), -1).try_cast("int")


def padded(value: Column, width: int = 3) -> Column:
    return F.format_string(f"%0{width}d", value.cast("bigint"))


def mapped(value: Column, table: dict) -> Column:
    """Look a value up in a literal map; NULL when absent."""
    entries: list[Column] = []
    for key, item in table.items():
        entries += [F.lit(key), F.lit(item)]
    return F.try_element_at(F.create_map(*entries), value)


def sorted_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with keys in sorted order."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))
