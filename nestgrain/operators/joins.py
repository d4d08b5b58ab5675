"""Joins whose condition is not a plain equality, rewritten as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, largest_group, materialise, rows_per_task, small
from .contracts import require_unique

CROWDED = 1000  # right tuples of one tolerance cell before one more field cuts it


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width + 0.5)


def cells_reached(value: Column, tolerance: float, width: float) -> Column:
    """The one or two cells that hold everything within ``tolerance`` of ``value``."""
    return F.array_distinct(F.array(_cell(value - tolerance, width), _cell(value + tolerance, width)))


def tolerance_join(
    left: DataFrame, right: DataFrame, exact: list[str], near: list[str], left_id: str, right_id: str,
    tolerance: float = 1e-10, bands: int = 2, crowded: int = CROWDED,
) -> DataFrame:
    """Match rows equal on ``exact`` and within ``tolerance`` on every ``near`` field.

    Returns one row per left row: the match count and, when it is unique, the
    match. Equal tuples are collapsed on both sides before the join, so a hot tuple
    costs one row per side instead of all its pairs. Each near field is cut into
    cells a few tolerances wide and joined on cell equality; the left tuple also
    probes a neighbouring cell when it lies within reach of the edge. Edges lie halfway between
    whole numbers of widths, so values of few decimals are mid-cell and probe once. Narrow cells
    keep the candidates close to the true matches however the values cluster. At first
    only the first ``bands`` near fields are cut into cells, as each can double the probes;
    a cell that holds more than ``crowded`` right tuples is cut by one more field, again
    until it is not crowded or no field is left.
    """
    width = max(tolerance * 8, 1e-9)
    lookup = right.groupBy(*exact, *near).agg(F.count(F.lit(1)).alias("__rn"), F.min(right_id).alias("__rid"))
    probes = left.select(*exact, *near).distinct()

    def cut(probed: DataFrame, filed: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
        probed = probed.withColumn(f"__c_{field}", F.explode(cells_reached(F.col(field), tolerance, width)))
        return probed, filed.withColumn(f"__c_{field}", _cell(F.col(field), width))

    def hits(probed: DataFrame, filed: DataFrame, cells: list[str]) -> DataFrame:
        renamed = filed.select(*exact, *cells, "__rn", "__rid", *[F.col(f).alias(f"__r_{f}") for f in near])
        found = probed.join(renamed, exact + cells)
        for field in near:
            found = found.where(F.abs(F.col(field) - F.col(f"__r_{field}")) <= tolerance)
        return found.groupBy(*exact, *near).agg(F.sum("__rn").alias("__n"), F.min("__rid").alias("__best"))

    for field in near[:bands]:
        probes, lookup = cut(probes, lookup, field)
    cells = [f"__c_{field}" for field in near[:bands]]
    parts: list[DataFrame] = []
    for field in near[bands:]:
        lookup = materialise(lookup)  # counted and joined
        if largest_group(lookup, exact + cells) <= crowded:
            break
        sizes = lookup.groupBy(*exact, *cells).agg(F.count(F.lit(1)).alias("__size"))
        full = materialise(sizes.where(F.col("__size") > crowded).drop("__size"))
        full, probes = small(full), materialise(probes)
        parts.append(hits(probes.join(full, exact + cells, "left_anti"), lookup.join(full, exact + cells, "left_anti"), cells))
        probes, lookup = cut(probes.join(full, exact + cells, "left_semi"), lookup.join(full, exact + cells, "left_semi"), field)
        cells = [*cells, f"__c_{field}"]
    parts.append(hits(probes, lookup, cells))
    summed = reduce(lambda a, b: a.unionByName(b), parts)
    summed = summed.groupBy(*exact, *near).agg(F.sum("__n").alias("match_count"), F.min("__best").alias("__best"))
    out = left.join(summed, exact + near, "left")
    return out.select(
        left_id, *exact, *near,
        F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"),
        F.when(F.col("match_count") == 1, F.col("__best")).alias(right_id),
    )


def range_join(
    points: DataFrame, ranges: DataFrame, on: list[str], position: str, start: str, stop: str
) -> DataFrame:
    """Attach each integer position to the half-open ranges [start, stop) that hold it.

    Ranges are filed under the power of two at or above their span, so every range
    covers at most two blocks of its own level whatever the mix of spans. Points
    probe the levels that occur (at most 63), giving a pure equi-join. Ranges too many to
    broadcast are shuffled; there a block that holds more points than a task should
    has them dealt over salts by a hash of the whole point, and its ranges copied to each.
    """
    span = F.col(stop) - F.col(start)
    level = F.greatest(F.ceil(F.log2(span.cast("double"))), F.lit(0)).cast("int")
    filed = ranges.where(span > 0).withColumn("__level", level)
    size = F.expr("shiftleft(1L, __level)")
    filed = filed.withColumn(
        "__block",
        F.explode(F.array_distinct(F.array(F.floor(F.col(start) / size), F.floor((F.col(stop) - 1) / size)))),
    )
    levels = sorted(row[0] for row in filed.select("__level").distinct().collect())
    if not levels:
        levels = [0]
    probe = F.explode(F.array(*[
        F.struct(F.lit(lv).alias("lv"), F.floor(F.col(position) / F.lit(2 ** lv)).alias("blk")) for lv in levels
    ]))
    probed = points.withColumn("__p", probe).withColumn("__level", F.col("__p.lv")).withColumn("__block", F.col("__p.blk")).drop("__p")
    keys = [*on, "__level", "__block"]
    if fits_broadcast(filed):
        joined = probed.join(F.broadcast(filed), keys)
    else:
        probed, filed = salted(probed, filed, keys, points.columns, rows_per_task(points.sparkSession))
        joined = probed.join(filed, [*keys, "__salt"]).drop("__salt")
    return joined.where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(stop))).drop("__level", "__block")


def salted(many: DataFrame, few: DataFrame, keys: list[str], own: list[str], per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__salt``: keys with more than ``per_task`` rows in ``many`` are dealt over several, ``few`` copied to each.

    Rows are dealt by a hash of columns ``own``, so a retried task deals them alike; rows equal in all of them stay together.
    """
    counts = many.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("__salts"))
    hot = small(materialise(counts.where("__salts > 1")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*own), salts).cast("int")).drop("__salts")
    copied = few.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt, copied


def enumerate_range(df: DataFrame, start: str, stop_inclusive: str, name: str) -> DataFrame:
    """One row per integer in [start, stop]; an empty range yields no row (``sequence`` would count down)."""
    whole = F.when(F.col(start) <= F.col(stop_inclusive), F.sequence(F.col(start), F.col(stop_inclusive)))
    return df.withColumn(name, F.explode(whole))


def first_match(df: DataFrame, sources: list[tuple[DataFrame, str]], keys: list[str], columns: list[str]) -> DataFrame:
    """Take ``columns`` from the first source that has the key; ``matched_in`` names it or is 'none'.

    A key that a source holds twice is an error: it would multiply rows.
    """
    out = df
    for position, (source, label) in enumerate(sources):
        require_unique(source, keys, f"source {label}")
        picked = source.select(*keys, *[F.col(c).alias(f"__{position}_{c}") for c in columns], F.lit(label).alias(f"__{position}_hit"))
        out = out.join(small(picked), keys, "left")
    found = F.coalesce(*[F.col(f"__{i}_hit") for i in range(len(sources))], F.lit("none"))

    def pick(column: str) -> Column:
        chosen = F.lit(None)
        for i in reversed(range(len(sources))):
            chosen = F.when(F.col(f"__{i}_hit").isNotNull(), F.col(f"__{i}_{column}")).otherwise(chosen)
        return chosen

    return out.select(*df.columns, *[pick(c).alias(c) for c in columns], found.alias("matched_in"))


def patch_rows(df: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Override listed columns for listed keys, leaving every other row as it is; a key listed twice is an error."""
    require_unique(overrides, keys, "overrides")
    patch = overrides.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(small(patch), keys, "left")
    kept = [F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept)


def common_indices(left: DataFrame, right: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Indices present on both sides per key: how many, and the first, middle and last of them."""
    from .ordered import rank_within

    both = left.select(*keys, index).distinct().join(right.select(*keys, index).distinct(), [*keys, index], "left_semi")
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_common"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    middle = rank_within(both, keys, [index], "__r").join(sizes, keys)
    middle = middle.where(F.col("__r") == F.floor(F.col("n_common") / 2) + 1)
    return middle.select(*keys, "n_common", "first_index", F.col(index).alias("middle_index"), "last_index")
