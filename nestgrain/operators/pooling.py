"""Hierarchical pooling of repeated measures up to the modelling unit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.numeric import is_finite
from ..session import dealt, largest_group, materialise, rows_per_task
from .contracts import contract_join, non_finite_rows, numeric_features, require_empty, require_label_blind, wrong_cardinality
from .ordered import beside, exact_percentiles

VECTOR_PARTS = 64  # groups that the tasks' states of a key meet in first
STATE_BYTES = 64 << 20  # states that a task keeps


def two_level_pool(df: DataFrame, unit: list[str], middle: str, features: list[str]) -> DataFrame:
    """sample -> scan -> point: mean of scan means, their SD, and the mean of within-scan SDs.

    All SDs are population SDs. The scan-level aggregate combines map-side, and
    hash partitioning on (unit, middle) lets Spark finish with one smaller shuffle.
    """
    first = df.groupBy(*unit, middle).agg(
        *[F.avg(f).alias(f"__m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"__s_{f}") for f in features],
    )
    return first.groupBy(*unit).agg(
        *[F.avg(f"__m_{f}").alias(f"{f}__mean") for f in features],
        *[F.stddev_pop(f"__m_{f}").alias(f"{f}__between_sd") for f in features],
        *[F.avg(f"__s_{f}").alias(f"{f}__within_sd") for f in features],
        F.count(F.lit(1)).alias("n_scans"),
    )


def pool_features(
    samples: DataFrame, features: DataFrame, sample_key: list[str], unit: list[str], middle: str,
    reserved: list[str], scans_per_unit: int | None = None,
) -> DataFrame:
    """Join a label-blind feature table one-to-one to the sample manifest, require completeness, pool.

    Completeness is counted as the rows pass on their way to the pools, which are stored: the join runs once.
    """
    require_label_blind(features)
    names = numeric_features(features, reserved)
    joined = contract_join(samples, features.select(*sample_key, *names), sample_key, "one_to_one")
    if scans_per_unit is not None:
        scans = joined.select(*unit, middle).distinct()
        require_empty(wrong_cardinality(scans, unit, scans_per_unit), f"units without {scans_per_unit} scans")
    seen = Observation()
    finite = reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in names])
    pooled = materialise(two_level_pool(joined.observe(seen, F.count_if(~finite).alias("spoiled")), unit, middle, names))
    if seen.get["spoiled"]:
        require_empty(non_finite_rows(joined, names), "samples without complete finite features")
    return pooled


def value_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, __column, __v, __n): how often each finite value of each column occurs per key; __v is NULL for all others.

    The one pass over ``df`` that a summary needs. Equal values combine before the shuffle, and the
    result is stored, so that moments and percentiles of all columns read it instead of ``df``.
    """
    values = F.array(*[F.when(is_finite(F.col(c)), F.col(c).cast("double")) for c in columns])
    cells = df.select(*keys, F.posexplode(values).alias("__column", "__v"))
    return materialise(cells.groupBy(*keys, "__column", "__v").agg(F.count(F.lit(1)).alias("__n")))


def count_summaries(counts: DataFrame, group: list[str], marks: dict[str, float], largest: int | None = None) -> DataFrame:
    """Per group and column of ``value_counts``: valid and total counts, mean, population SD, minimum, maximum, zeros and ``marks``.

    Percentiles are exact; a NULL group is a group. ``largest`` bounds the counted values of one
    group and column; it is measured on the stored counts where it is not given. Groups that fit a
    task are dealt into parts whose number follows the counts, and everything is worked out there.
    """
    keys, n, v = [*group, "__column"], F.col("__n"), F.col("__v")
    present = F.when(v.isNotNull(), n)
    if largest is None:
        largest = largest_group(counts, keys)
    summaries = [
        F.coalesce(F.sum(present), F.lit(0)).alias("valid"), F.sum(n).alias("total"), F.try_divide(F.sum(v * n), F.sum(present)).alias("mean"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros")]
    away = v - F.col("__mean")
    sd = F.sqrt(F.try_divide(F.sum(n * away * away), F.sum(present))).alias("sd")
    if largest <= rows_per_task(counts.sparkSession):
        percentiles = [F.percentile("__v", F.lit(q), n).alias(name) for name, q in marks.items()]
        own = Window.partitionBy(*keys)
        centred = dealt(counts, keys).withColumn("__mean", F.try_divide(F.sum(v * n).over(own), F.sum(present).over(own)))
        return centred.groupBy(*keys).agg(*summaries, *percentiles, sd)
    out = counts.groupBy(*keys).agg(*summaries)
    spread = beside(counts, out.select(*keys, F.col("mean").alias("__mean")), keys)
    out = beside(out, spread.groupBy(*keys).agg(sd), keys)
    found = exact_percentiles(counts, keys, "__v", marks, largest, weight="__n")
    named = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *marks)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return out.join(named, same, "left").drop(*[f"__k_{k}" for k in keys])


def masked_summary(df: DataFrame, group: list[str], value: str, prefix: str, largest: int | None = None) -> DataFrame:
    """Counts, valid share, mean, population SD, median, p10 and p90 over finite values; NULL, NaN and infinity are not valid."""
    found = count_summaries(value_counts(df, group, [value]), group, MASKED_MARKS, largest)
    return found.select(*group, *_masked(prefix))


MASKED_MARKS = {"median": 0.5, "p10": 0.1, "p90": 0.9}


def _masked(prefix: str) -> list[Column]:
    fraction = (F.col("valid") / F.col("total")).alias(f"{prefix}_valid_fraction")
    return [F.col("valid").alias(f"{prefix}_valid_count"), F.col("total").alias(f"{prefix}_total_count"), fraction,
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("mean", "sd", *MASKED_MARKS)]]


def distribution_summary(df: DataFrame, group: list[str], value: str, largest: int | None = None) -> DataFrame:
    """Minimum, p05, median, mean, p95, maximum and zero share of finite values, and their share of all."""
    marks = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    found = count_summaries(value_counts(df, group, [value]), group, marks, largest)
    return found.select(
        *group, "minimum", "mean", "maximum", F.try_divide(F.col("zeros"), F.col("valid")).alias("zero_fraction"),
        (F.col("valid") / F.col("total")).alias("finite_fraction"), *marks)


def boundary_points(samples: DataFrame, unit: list[str], middle: str, intervals: list[str], largest: int | None = None) -> DataFrame:
    """Masked summaries per unit for each interval, plus the SD of its scan means; units with NULL keys stay.

    Everything follows from one set of stored counts per scan, for all intervals together.
    """
    counts = value_counts(samples, [*unit, middle], intervals)
    n, v = F.col("__n"), F.col("__v")
    means = counts.groupBy(*unit, middle, "__column").agg(
        F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("m"), F.sum(n).alias("rows"))
    scans = means.groupBy(*unit, "__column").agg(F.stddev_pop("m").alias("between"), F.count(middle).alias("scans"), F.sum("rows").alias("samples"))
    found = beside(count_summaries(counts, unit, MASKED_MARKS, largest), scans, [*unit, "__column"])
    cells = []
    for position, interval in enumerate(intervals):
        own = F.struct(F.col("between").alias(f"{interval}_between_scan_mean_sd"), *_masked(interval))
        cells.append(F.max(F.when(F.col("__column") == position, own)).alias(f"__{position}"))  # one row a unit and interval
    wide = found.groupBy(*unit).agg(F.max("scans").alias("scans"), F.max("samples").alias("samples"), *cells)
    between = [F.col(f"__{k}.{i}_between_scan_mean_sd") for k, i in enumerate(intervals)]
    return wide.select(*unit, "scans", "samples", *between, *[
        F.col(f"__{k}.{c}") for k, i in enumerate(intervals) for c in (
            f"{i}_valid_count", f"{i}_total_count", f"{i}_valid_fraction", *[f"{i}_{x}" for x in ("mean", "sd", *MASKED_MARKS)])])


def interval_thickness(values: Column, scale_um: Column, height: Column) -> tuple[Column, Column]:
    """Gaps between successive boundary rows in micrometres, masked, and the reason for a mask.

    A boundary is usable when present, non-negative and inside the image. A gap is
    kept when both its boundaries are usable and it is not negative.
    """
    def in_image(v: Column) -> Column:
        return F.coalesce(~F.isnan(v) & (v >= 0) & (v < height), F.lit(False))

    def pairs(v: Column) -> Column:
        return F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))

    thickness = F.transform(
        pairs(values), lambda p: F.when(in_image(p["a"]) & in_image(p["b"]) & (p["b"] >= p["a"]), (p["b"] - p["a"]) * scale_um))
    reason = (  # fixed values: the reason texts
        F.when(~F.forall(values, in_image), F.lit("negative_or_missing_boundary_sentinel"))
        .when(F.exists(pairs(values), lambda p: p["b"] < p["a"]), F.lit("locally_crossed_boundary_pair"))
        .otherwise(F.lit(""))
    )
    return thickness, reason


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks] or [np.zeros(0)]).astype(float)
    return flat.reshape(len(column), -1)


def _task_states(keys: int, kinds: list[pa.DataType]):
    """One state a key of this task's vectors; handed on early when the states fill ``STATE_BYTES``."""

    def rows(states: dict) -> pa.RecordBatch:
        part = TaskContext.get().partitionId() % VECTOR_PARTS
        columns = [pa.array([key[k] for key in states], kind) for k, kind in zip(range(keys), kinds)]
        values = list(states.values())
        lists = [pa.array([v[i].tolist() for v in values], pa.list_(pa.float64())) for i in (1, 2)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([part] * len(values), pa.int32()), pa.array([float(v[0]) for v in values]), *lists],
            [*[f"k{k}" for k in range(keys)], "part", "n", "means", "squares"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(keys))
            found: dict[tuple, int] = {}
            ids = zip(*[batch.column(k).to_pylist() for k in range(keys)]) if keys else [()] * len(m)
            own = np.array([found.setdefault(key, len(found)) for key in ids])
            order = np.argsort(own, kind="stable")
            cuts, n = np.searchsorted(own[order], np.arange(len(found))), np.bincount(own)
            means = np.add.reduceat(m[order], cuts, axis=0) / n[:, None]
            squares = np.add.reduceat((m - means[own])[order] ** 2, cuts, axis=0)
            for key, k in found.items():
                states[key] = _merged(states.get(key), (n[k], means[k], squares[k]))
            if len(states) * m.shape[1] * 16 > STATE_BYTES:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    return run


def _merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n = a[0] + b[0]
    away = b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + away * away * (a[0] * b[0] / n)


def _merged_states(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        n, means, squares = table.column("n").to_numpy(), _matrix(table.column("means")), _matrix(table.column("squares"))
        centre = n @ means / n.sum()
        spread = squares.sum(axis=0) + n @ (means - centre) ** 2
        first = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table({**first, "n": pa.array([n.sum()]), "means": pa.array([centre.tolist()]), "squares": pa.array([spread.tolist()])})

    return run


def vector_states(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, means, squares): count, elementwise means and central sums of squares of each key's vectors.

    The state is one row of arrays a key, whatever the dimension. Tasks add up their own vectors
    before anything is shuffled; their states merge in two steps, so that no key meets more rows
    than a share of the tasks. Vectors are as long as one another and whole; a NULL one does not count.
    """
    kept = [df.schema[k] for k in keys]
    state = [T.StructField("n", T.DoubleType()), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("squares", T.ArrayType(T.DoubleType()))]
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("__vector")).where("__vector IS NOT NULL")
    names = [f"k{k}" for k in range(len(keys))]
    plain = [T.StructField(n, f.dataType) for n, f in zip(names, kept)]
    part = T.StructField("part", T.IntegerType())
    kinds = [to_arrow_type(f.dataType) for f in kept]
    own = rows.mapInArrow(_task_states(len(keys), kinds), T.StructType([*plain, part, *state]))
    once = own.groupBy(*names, "part").applyInArrow(_merged_states([*names, "part"]), T.StructType([*plain, part, *state]))
    out = once.groupBy(*names).applyInArrow(_merged_states(names), T.StructType([*plain, *state]))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", "means", "squares")


def _sd(squares: str, n: str = "n") -> Column:
    return F.transform(squares, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / F.col(n)))


def vector_pool(df: DataFrame, unit: list[str], vector: str) -> DataFrame:
    """Elementwise mean and population SD over a unit's vectors, concatenated (2 x dimension)."""
    states = vector_states(df, unit, vector)
    return states.select(*unit, F.col("n").cast("bigint").alias("n_vectors"), F.concat("means", _sd("squares")).alias("representation"))


def three_level_vector_pool(df: DataFrame, unit: list[str], middle: str, vector: str) -> DataFrame:
    """Mean of scan means, their population SD and the mean of within-scan SDs, elementwise, concatenated (3 x dimension)."""
    scans = vector_states(df, [*unit, middle], vector).select(*unit, F.concat("means", _sd("squares")).alias("__both"))
    units = vector_states(scans, unit, "__both")
    half = (F.size("means") / 2).cast("int")
    between = F.slice(_sd("squares"), F.lit(1), half)
    return units.select(*unit, F.concat(F.slice("means", F.lit(1), half), between, F.slice("means", half + 1, half)).alias("representation"))


def wide_by_rank(df: DataFrame, unit: list[str], rank: str, ranks: list[int], columns: list[str], prefix: str = "scan") -> DataFrame:
    """Ranked rows to ``{prefix}_{rank}_{column}`` columns as one aggregate."""
    cells = [
        F.max(F.when(F.col(rank) == r, F.col(c))).alias(f"{prefix}_{r}_{c}") for r in ranks for c in columns
    ]
    return df.groupBy(*unit).agg(*cells)


def consecutive_indices(df: DataFrame, unit: list[str], index: str, count: int = 3) -> DataFrame:
    """Whether a unit's ``count`` indices are distinct and consecutive."""
    spread = df.groupBy(*unit).agg(
        F.min(index).alias("lowest"), F.max(index).alias("highest"),
        F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("n_distinct"),
    )
    ok = (F.col("n") == count) & (F.col("n_distinct") == count) & (F.col("highest") - F.col("lowest") == count - 1)
    return spread.select(*unit, "lowest", "highest", ok.alias("contiguous"))


def reproduces(left: DataFrame, right: DataFrame, keys: list[str], vector: str, tolerance: float = 1e-5) -> DataFrame:
    """Largest absolute element difference between two keyed vector tables, with the verdict."""
    other = right.select(*keys, F.col(vector).alias("__other"))
    gap = F.array_max(F.zip_with(F.col(vector), F.col("__other"), lambda a, b: F.abs(a - b)))
    joined = left.join(other, keys)
    return joined.agg(F.count(F.lit(1)).alias("compared"), F.max(gap).alias("max_abs_difference")).withColumn(
        "within_tolerance", F.col("max_abs_difference") <= tolerance
    )
