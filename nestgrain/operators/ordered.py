"""Order-dependent operators that stay distributed when one group is huge.

A plain window puts each group in one task. That is the right plan while the
biggest group fits a task, which is measured first. Beyond that the rows are
range-partitioned on (group, order), ranked or summed per slice, and each slice
that continues a group gets the total of the slices before it. At most one group
continues across each slice border, so that offset table has fewer rows than
there are slices and is safe to broadcast.
"""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import largest_group, materialise, rows_per_task, small

SLICE = "__slice"


def _order_columns(order: list) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order]


def slice_by_range(df: DataFrame, group: list[str], order: list, per_task: int) -> DataFrame:
    """Range-partition on (group, order) and record each row's slice number durably."""
    slices = max(2, math.ceil(df.count() / max(per_task, 1)))
    keys = [F.col(name) for name in group] + _order_columns(order)
    return materialise(df.repartitionByRange(slices, *keys).withColumn(SLICE, F.spark_partition_id()))


def _carry(sliced: DataFrame, group: list[str], amount: Column, name: str) -> DataFrame:
    """Total of ``amount`` in earlier slices of the same group, only where there is one."""
    per_slice = sliced.groupBy(*group, SLICE).agg(amount.alias("__total"))
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.withColumn(name, F.sum("__total").over(before)).where(F.col(name).isNotNull()).drop("__total")


def _add_carry(df: DataFrame, carry: DataFrame, group: list[str], name: str) -> DataFrame:
    right = carry.select(*[F.col(key).alias(f"__c_{key}") for key in [*group, SLICE]], name)
    condition = F.lit(True)
    for key in [*group, SLICE]:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__c_{key}"))
    return df.join(F.broadcast(right), condition, "left").drop(*[f"__c_{key}" for key in [*group, SLICE]])


def rank_within(
    df: DataFrame, group: list[str], order: list, name: str = "rank", largest: int | None = None
) -> DataFrame:
    """1-based gap-free position inside each group. ``order`` must be a total order.

    ``largest`` is a known bound on group size (from a cardinality contract); it
    is measured when not given.
    """
    per_task = rows_per_task(df.sparkSession)
    keyed, keys = (df, group) if group else (df.withColumn("__all", F.lit(0)), ["__all"])
    if (largest if largest is not None else largest_group(df, group)) <= per_task:
        window = Window.partitionBy(*keys).orderBy(*_order_columns(order))
        out = keyed.withColumn(name, F.row_number().over(window).cast("bigint"))
    else:
        sliced = slice_by_range(keyed, keys, order, per_task)
        window = Window.partitionBy(*keys, SLICE).orderBy(*_order_columns(order))
        out = sliced.withColumn(name, F.row_number().over(window).cast("bigint"))
        out = _add_carry(out, _carry(sliced, keys, F.count(F.lit(1)), "__before"), keys, "__before")
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col("__before"), F.lit(0))).drop("__before", SLICE)
    return out if group else out.drop("__all")


def running_sum(
    df: DataFrame, group: list[str], order: list, value: str | list[str], name: str | list[str], largest: int | None = None
) -> DataFrame:
    """Inclusive running total of one or several columns along ``order``, in one pass."""
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    per_task = rows_per_task(df.sparkSession)
    keyed, keys = (df, group) if group else (df.withColumn("__all", F.lit(0)), ["__all"])
    if (largest if largest is not None else largest_group(df, group)) <= per_task:
        frame = Window.partitionBy(*keys).orderBy(*_order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        out = keyed.withColumns({n: F.sum(v).over(frame) for v, n in zip(values, names)})
    else:
        sliced = slice_by_range(keyed, keys, order, per_task)
        frame = Window.partitionBy(*keys, SLICE).orderBy(*_order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        out = sliced.withColumns({n: F.sum(v).over(frame) for v, n in zip(values, names)})
        for v, n in zip(values, names):
            out = _add_carry(out, _carry(sliced, keys, F.sum(v), "__before"), keys, "__before")
            out = out.withColumn(n, F.col(n) + F.coalesce(F.col("__before"), F.lit(0))).drop("__before")
        out = out.drop(SLICE)
    return out if group else out.drop("__all")


def previous_value(
    df: DataFrame, group: list[str], order: list, value: str, name: str, largest: int | None = None
) -> DataFrame:
    """``value`` of the row just before, within the group (NULL at the start)."""
    per_task = rows_per_task(df.sparkSession)
    keyed, keys = (df, group) if group else (df.withColumn("__all", F.lit(0)), ["__all"])
    columns = _order_columns(order)
    if (largest if largest is not None else largest_group(df, group)) <= per_task:
        out = keyed.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*columns)))
    else:
        sliced = slice_by_range(keyed, keys, order, per_task)
        window = Window.partitionBy(*keys, SLICE).orderBy(*columns)
        numbered = sliced.withColumn("__pos", F.row_number().over(window)).withColumn(name, F.lag(value).over(window))
        ends = sliced.groupBy(*keys, SLICE).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*columns)).alias("__end"))
        carry = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy(*keys).orderBy(SLICE)))
        carry = carry.where(F.col("__carry").isNotNull()).drop("__end")
        out = _add_carry(numbered, carry, keys, "__carry")
        first = (F.col("__pos") == 1) & F.col("__carry").isNotNull()
        out = out.withColumn(name, F.when(first, F.col("__carry")["v"]).otherwise(F.col(name))).drop("__pos", "__carry", SLICE)
    return out if group else out.drop("__all")


def beside(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``per_key`` (a row a key); NULL keys meet, and no key means one row for all."""
    if not keys:
        return rows.join(F.broadcast(per_key))
    named = per_key.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in per_key.columns if c not in keys])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def exact_percentiles(
    df: DataFrame, group: list[str], value: str, quantiles: dict[str, float], largest: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, NULLs skipped.

    ``weight`` is a whole number of copies of each row, for pre-aggregated input.

    Spark's ``percentile`` buffers every distinct value of a group in one task, so
    oversized groups are pre-aggregated to (value, count), range-partitioned and
    read off their running counts instead.
    """
    copies = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    present = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"), copies.alias("__w"))
    per_task = rows_per_task(df.sparkSession)
    if (largest if largest is not None else largest_group(present, group)) <= per_task:
        aggs = [F.percentile("__v", F.lit(q), F.col("__w")).alias(name) for name, q in quantiles.items()]
        return present.groupBy(*group).agg(*aggs) if group else present.agg(*aggs)
    keys = group or ["__all"]
    if not group:
        present = present.withColumn("__all", F.lit(0))
    counts = present.groupBy(*keys, "__v").agg(F.sum("__w").alias("__c"))
    cumulative = running_sum(counts, keys, ["__v"], "__c", "__cum")
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    joined = beside(cumulative, small(totals), keys)
    aggs, finals = [], []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("__n") - 1)
        aggs += [
            F.min(F.when(F.col("__cum") > F.floor(position), F.col("__v"))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") > F.ceil(position), F.col("__v"))).alias(f"__hi_{name}"),
        ]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        finals.append((low + (high - low) * (position - F.floor(position))).alias(name))
    out = joined.groupBy(*keys, "__n").agg(*aggs)
    return out.select(*group, *finals)


def evenly_spaced(
    df: DataFrame, group: list[str], order: list, count: int, name: str = "pick", largest: int | None = None
) -> DataFrame:
    """``count`` rows per group at positions rint(k * (n - 1) / (count - 1)), half-even."""
    ranked = rank_within(df, group, order, "__rn", largest)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(small(sizes), group)
    step = (F.col("__n") - 1) / F.lit(float(count - 1))
    slots = F.array(*[F.struct(F.lit(k + 1).alias("k"), (F.rint(step * k) + 1).cast("bigint").alias("at")) for k in range(count)])
    chosen = F.filter(slots, lambda s: s["at"] == F.col("__rn"))
    out = joined.withColumn("__slot", F.explode(chosen))
    return out.withColumn(name, F.col("__slot")["k"]).drop("__slot", "__rn", "__n")


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group as one map-side combined aggregate (no window, no sort)."""
    rest = [name for name in df.columns if name not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*_order_columns(order))).alias("__row"))
    return best.select(*group, *[F.col(f"__row.{name}").alias(name) for name in rest]).select(*df.columns)


def top_within(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. Rank filter pushes a group limit below the shuffle."""
    window = Window.partitionBy(*group).orderBy(*_order_columns(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def best_and_second(df: DataFrame, group: list[str], item: list[str], score: str) -> DataFrame:
    """Best candidate per group with its margin over the runner-up (score descending, item ascending)."""
    top = top_within(df, group, [F.col(score).desc(), *item], 2, "__r")
    first = F.col("__r") == 1
    return top.groupBy(*group).agg(
        *[F.max(F.when(first, F.col(name))).alias(name) for name in item],
        F.max(F.when(first, F.col(score))).alias("best_score"),
        F.max(F.when(~first, F.col(score))).alias("second_score"),
    ).withColumn("score_margin", F.col("best_score") - F.col("second_score"))


