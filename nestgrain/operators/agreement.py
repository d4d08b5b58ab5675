"""Error, calibration and agreement metrics, strata, ranking and the cluster bootstrap.

Every metric is a function of a few moments that merge over groups, so overall values,
strata, folds, participants and each bootstrap replicate all come from one
aggregation of the predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, rows_per_task, small
from .ordered import beside, rank_within

METRICS = (
    "mae", "rmse", "bias", "lower_loa", "upper_loa", "calibration_intercept", "calibration_slope", "r_squared",
)
# What is kept of a group: rows, sum of |d|, means, central sums of squares and products, and ranges
# (a constant is where they close). Groups merge without leaving their own scale.
MEANS = ("d", "o", "p")
SQUARES = ("dd", "oo", "pp", "op")
BOUNDS = {"lo_o": F.min, "hi_o": F.max, "lo_p": F.min, "hi_p": F.max}
MOMENTS = ("s_n", "s_abs_d", *[f"m_{k}" for k in MEANS], *[f"c_{k}" for k in SQUARES], *BOUNDS)


def agreement_sums(
    df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted", weight: str | None = None
) -> DataFrame:
    """The (weighted) moments per key. Rows without both values, or with weight <= 0, do not count.

    Squares and products are central per key, so neither small spreads nor a key of another
    magnitude cost digits. Weights need the means first: they are joined back, one row a key.
    """
    both = F.col(observed).isNotNull() & F.col(predicted).isNotNull()
    if weight is not None:
        df = df.where(F.col(weight) > 0)
    kept = df.select(*keys, F.when(both, F.col(observed).cast("double")).alias("o"), F.when(both, F.col(predicted).cast("double")).alias("p"),
                     (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    kept = kept.withColumn("d", F.col("p") - F.col("o"))
    bounds = [how(name[-1]).alias(name) for name, how in BOUNDS.items()]
    if weight is None:
        n = F.count("d").cast("double")
        squares = [(n * (F.covar_pop(k[0], k[1]) if k[0] != k[1] else F.var_pop(k[0]))).alias(f"c_{k}") for k in SQUARES]
        aggs = [n.alias("s_n"), F.sum(F.abs("d")).alias("s_abs_d"), *[F.avg(k).alias(f"m_{k}") for k in MEANS], *squares, *bounds]
        return kept.groupBy(*keys).agg(*aggs)
    kept = kept.where("d IS NOT NULL")
    means = kept.groupBy(*keys).agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(f"m_{k}") for k in MEANS])
    joined = beside(kept, small(materialise(means)), keys)
    part = {k: F.col(k) - F.col(f"m_{k}") for k in MEANS}
    squares = [F.sum(F.col("w") * part[k[0]] * part[k[1]]).alias(f"c_{k}") for k in SQUARES]
    return joined.groupBy(*keys).agg(
        F.sum("w").alias("s_n"), F.sum(F.col("w") * F.abs("d")).alias("s_abs_d"), *[F.first(f"m_{k}").alias(f"m_{k}") for k in MEANS], *squares, *bounds)


def add_up(sums: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Moments of the unions of groups: means first, then central sums around them."""
    means = sums.groupBy(*keys).agg(*[(F.sum(F.col("s_n") * F.col(f"m_{k}")) / F.sum("s_n")).alias(f"__m_{k}") for k in MEANS])
    joined = beside(sums, means, keys)
    away = {k: F.col(f"m_{k}") - F.col(f"__m_{k}") for k in MEANS}
    aggs = [F.sum(name).alias(name) for name in ("s_n", "s_abs_d")]
    aggs += [F.first(f"__m_{k}").alias(f"m_{k}") for k in MEANS]
    aggs += [F.sum(F.col(f"c_{k}") + F.col("s_n") * away[k[0]] * away[k[1]]).alias(f"c_{k}") for k in SQUARES]
    aggs += [how(name).alias(name) for name, how in BOUNDS.items()]
    return joined.groupBy(*keys).agg(*aggs, *(extra or []))


def metrics_from_sums(sums: DataFrame, unweighted_sd: bool = False) -> DataFrame:
    """Replace the moments by the eight metrics (difference = predicted - observed).

    The limits of agreement use a frequency-weight SD with ``max(n - 1, 1)``; with
    ``unweighted_sd`` a single row has no SD and hence no limits. A constant
    predictor has no regression slope, so calibration takes the minimum-norm
    least-squares solution. R squared is NULL when the observations are constant.
    """
    n, bias, mean_o, mean_p = (F.col(c) for c in ("s_n", "m_d", "m_o", "m_p"))
    spread = F.sqrt(F.greatest(F.col("c_dd") / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    if unweighted_sd:
        spread = F.when(n > 1, spread)
    flat = F.col("lo_p") == F.col("hi_p")
    shrink = 1 + mean_p * mean_p
    slope = F.when(flat, mean_p * mean_o / shrink).otherwise(F.try_divide(F.col("c_op"), F.col("c_pp")))
    intercept = F.when(flat, mean_o / shrink).otherwise(mean_o - slope * mean_p)
    squared = F.col("c_dd") + n * bias * bias
    values = {
        "mae": F.try_divide(F.col("s_abs_d"), n), "rmse": F.sqrt(F.try_divide(squared, n)), "bias": bias,
        "lower_loa": bias - 1.96 * spread, "upper_loa": bias + 1.96 * spread,
        "calibration_intercept": intercept, "calibration_slope": slope,
        "r_squared": F.when(F.col("lo_o") < F.col("hi_o"), 1 - F.try_divide(squared, F.col("c_oo"))),
    }
    kept = [c for c in sums.columns if c not in MOMENTS]
    return sums.select(*kept, *[values[name].alias(name) for name in METRICS])


def agreement_metrics(
    df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted",
    weight: str | None = None, unweighted_sd: bool = False,
) -> DataFrame:
    return metrics_from_sums(agreement_sums(df, keys, observed, predicted, weight), unweighted_sd)


def stratum_sums(
    df: DataFrame, keys: list[str], strata: dict[str, Column], observed: str = "observed", predicted: str = "predicted"
) -> DataFrame:
    """Sums per key for overlapping strata; a stratum without rows is absent.

    Rows are aggregated once per membership pattern (at most 2^strata small groups
    per key) and only those aggregates are multiplied out to their strata.
    """
    flags = {name: f"__in_{i}" for i, name in enumerate(strata)}
    marked = df.select("*", *[F.coalesce(strata[name], F.lit(False)).alias(flag) for name, flag in flags.items()])
    cells = agreement_sums(marked, [*keys, *flags.values()], observed, predicted)
    member = F.explode(F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in flags.items()])))
    return add_up(cells.withColumn("stratum", member), [*keys, "stratum"])


def rank_models(metrics: DataFrame, tiebreak: str, metric: str = "mae", name: str = "mae_rank") -> DataFrame:
    """1..n by ascending metric. One row per model, so a single sorted task is fine."""
    return metrics.withColumn(name, F.row_number().over(Window.orderBy(metric, tiebreak)).cast("bigint"))


def best_model_rows(predictions: DataFrame, metrics: DataFrame, model: str, metric: str = "mae") -> DataFrame:
    best = metrics.groupBy().agg(F.min_by(model, F.struct(metric, model)).alias(model))
    return predictions.join(F.broadcast(best), model, "left_semi")


def interval_half_widths(metrics: DataFrame, metric: str = "mae") -> DataFrame:
    low, high = F.col(f"{metric}_ci95_low"), F.col(f"{metric}_ci95_high")
    return metrics.withColumn("half_below", F.col(metric) - low).withColumn("half_above", high - F.col(metric))


# ---- plot data ----------------------------------------------------------------

def bland_altman_points(df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    return df.select(
        *keys, ((F.col(observed) + F.col(predicted)) / 2).alias("mean_value"),
        (F.col(predicted) - F.col(observed)).alias("difference"),
    )


def residual_points(df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    return df.select(*keys, F.col(observed).alias("observed"), (F.col(predicted) - F.col(observed)).alias("residual"))


def histogram(df: DataFrame, unit: list[str], value: str, width: float = 1.0, origin: float = -0.5) -> DataFrame:
    """Counts per bin of ``width`` on one row per unit (the smallest value where copies differ)."""
    once = df.groupBy(*unit).agg(F.min(value).alias("__v"))
    return once.groupBy(F.floor((F.col("__v") - origin) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df: DataFrame, keys: list[str], x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    return df.groupBy(
        *keys, F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


# ---- cluster bootstrap ---------------------------------------------------------

# Odd multipliers below 2**62, the size of the numbers they mix.
DRAW_BITS = 62
DRAW_STEPS = {"replicate": 2290263523571452713, "draw": 1498734592374650029, "first": 3202034522624059733, "second": 2685821657736338717}
CLUSTERS_PER_TASK = 1_000_000  # some 400 bytes each in the task that draws them
DRAWS_AT_ONCE = 1 << 18


def block_seed(keys: list[str]) -> Column:
    """60 bits of md5 over the block's keys as text."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(0))


def drawn_clusters(seed: int, replicates: np.ndarray, clusters: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """(replicates, draws) cluster numbers for draws first..last: a function of its arguments alone, whoever works it out."""
    mask, step = np.uint64((1 << DRAW_BITS) - 1), {k: np.uint64(v) for k, v in DRAW_STEPS.items()}
    draws = np.arange(first, clusters if last is None else last, dtype=np.uint64)
    z = (np.uint64(seed) + replicates.astype(np.uint64)[:, None] * step["replicate"] + draws * step["draw"]) & mask
    for shift, factor in ((31, "first"), (29, "second")):  # in place: a task holds few copies of its draws
        z ^= z >> np.uint64(shift)
        z *= step[factor]
        z &= mask
    z ^= z >> np.uint64(32)
    z %= np.uint64(clusters)
    return z.view(np.int64)


def drawn_times(seed: int, replicates: np.ndarray, clusters: int) -> np.ndarray:
    """(replicates, clusters) how often each cluster is drawn, from at most ``DRAWS_AT_ONCE`` draws of a replicate at a time."""
    times = np.zeros(len(replicates) * clusters, np.int64)
    for first in range(0, clusters, DRAWS_AT_ONCE):
        draws = drawn_clusters(seed, replicates, clusters, first, min(first + DRAWS_AT_ONCE, clusters))
        draws += np.arange(len(replicates))[:, None] * clusters
        times += np.bincount(draws.ravel(), minlength=len(times))
    return times.reshape(len(replicates), clusters)


def _first_drawn(times: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each replicate the first cluster in ``order`` that was drawn: one of the first few, nearly always."""
    found, left = np.empty(len(times), np.int64), np.arange(len(times))
    for low in range(0, len(order), 64):
        some = order[low : low + 64]
        hit = times[np.ix_(left, some)] > 0
        done = hit.any(axis=1)
        found[left[done]] = some[hit[done].argmax(axis=1)]
        left = left[~done]
        if not len(left):
            break
    return found


def _resampled(key_names: list[str], cluster: str, replicates: int, parts: int):
    """Moments of this part's replicates of one block: multiplicities of the clusters times the clusters' sums."""

    def run(table: pa.Table) -> pa.Table:
        n, order = table.num_rows, pc.sort_indices(table.column(cluster))
        value = {c: table.column(c).take(order).to_numpy() for c in MOMENTS}
        part, seed = table.column("__part")[0].as_py(), table.column("__seed")[0].as_py()
        mine = np.arange(1 + part, replicates + 1, parts)
        weight = value["s_n"]
        centre = {k: weight @ value[f"m_{k}"] / weight.sum() for k in MEANS}
        for k in MEANS:
            value[f"m_{k}"] = value[f"m_{k}"] - centre[k]
        sums = np.empty((n, 2 + len(MEANS) + len(SQUARES)))
        sums[:, 0], sums[:, 1] = weight, value["s_abs_d"]
        for i, k in enumerate(MEANS):
            sums[:, 2 + i] = weight * value[f"m_{k}"]
        for i, k in enumerate(SQUARES):
            sums[:, 5 + i] = value.pop(f"c_{k}") + weight * value[f"m_{k[0]}"] * value[f"m_{k[1]}"]
        ends = {c: np.argsort(value[c] if c.startswith("lo") else -value[c], kind="stable") for c in BOUNDS}
        out = {c: [] for c in ("__rep", *MOMENTS)}
        for low in range(0, len(mine), max(1, DRAWS_AT_ONCE // n)):
            some = mine[low : low + max(1, DRAWS_AT_ONCE // n)]
            times = drawn_times(seed, some, n)
            total = times @ sums
            out["__rep"].append(some)
            out["s_n"].append(total[:, 0])
            out["s_abs_d"].append(total[:, 1])
            shift = {k: total[:, 2 + i] / total[:, 0] for i, k in enumerate(MEANS)}
            for k in MEANS:
                out[f"m_{k}"].append(centre[k] + shift[k])
            for i, k in enumerate(SQUARES):
                out[f"c_{k}"].append(total[:, 5 + i] - total[:, 0] * shift[k[0]] * shift[k[1]])
            for name in BOUNDS:  # over the drawn clusters only
                out[name].append(value[name][_first_drawn(times, ends[name])])
        columns = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        keys = {k: table.column(k).take(pa.array(np.zeros(len(columns["__rep"]), np.int64))) for k in key_names}
        return pa.table({**keys, **{c: pa.array(v, pa.int64() if c == "__rep" else pa.float64()) for c, v in columns.items()}})

    return run


def _draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (…, __rep, __seed, __clusters) as one row a draw, with the number of the cluster drawn."""
    for batch in batches:
        at = {c: batch.column(c).to_pylist() for c in ("__rep", "__seed", "__clusters")}
        for row in range(batch.num_rows):
            for first in range(0, at["__clusters"][row], 100_000):
                last = min(first + 100_000, at["__clusters"][row])
                drawn = drawn_clusters(at["__seed"][row], np.array([at["__rep"][row]]), at["__clusters"][row], first, last)[0]
                same = pa.array(np.full(len(drawn), row))
                yield pa.RecordBatch.from_arrays([c.take(same) for c in batch.columns] + [pa.array(drawn)], [*batch.schema.names, "__i"])


def cluster_bootstrap(
    df: DataFrame, block: list[str], cluster: str, replicates: int = 5000, observed: str = "observed",
    predicted: str = "predicted", strata: dict[str, Column] | None = None,
) -> DataFrame:
    """Point metrics with percentile 95 % limits from resampling whole clusters.

    Clusters are reduced to their moments first, so a replicate touches clusters, not rows. A
    block's clusters go to a few tasks that each draw a share of its replicates as multiplicities.
    A block of more clusters than a task may hold is drawn row by row and joined instead; draws
    spread evenly over clusters, so that join has no hot key. Clusters are numbered in order.
    """
    keys = [*block, "stratum"] if strata else list(block)
    per_cluster = (
        stratum_sums(df, [*block, cluster], strata, observed, predicted)
        if strata else agreement_sums(df, [*block, cluster], observed, predicted)
    )
    # reduced to clusters x moments, and read several times below: write it once
    per_cluster = materialise(per_cluster.where("s_n > 0"))
    session = df.sparkSession
    sizes = per_cluster.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.count("n").alias("blocks")).first()
    if (sizes["largest"] or 0) <= min(CLUSTERS_PER_TASK, rows_per_task(session)):
        cores = session.sparkContext.defaultParallelism
        parts = min(replicates, cores, max(1, -(-4 * cores // max(1, sizes["blocks"]))))  # each part gets the block's sums
        dealt = per_cluster.withColumn("__seed", block_seed(keys)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        schema = T.StructType([*[per_cluster.schema[k] for k in keys], T.StructField("__rep", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in MOMENTS]])
        replicated = dealt.groupBy(*keys, "__part").applyInArrow(_resampled(keys, cluster, replicates, parts), schema)
    else:
        indexed = rank_within(per_cluster, keys, [cluster], "__i").withColumn("__i", F.col("__i") - 1)
        sizes = per_cluster.groupBy(*keys).agg(F.count(F.lit(1)).alias("__clusters")).withColumn("__seed", block_seed(keys))
        sizes = sizes.withColumn("__rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint")))).repartition(*keys, "__rep")
        draws = sizes.mapInArrow(_draws, T.StructType([*sizes.schema.fields, T.StructField("__i", T.LongType())]))
        sampled = draws.select(*keys, "__rep", "__i").join(small(indexed.drop(cluster)), [*keys, "__i"])
        replicated = add_up(sampled, [*keys, "__rep"])
    resampled = metrics_from_sums(replicated)
    # percentile over exactly ``replicates`` values per block
    limits = resampled.groupBy(*keys).agg(
        *[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(f"__{m}") for m in METRICS]
    ).select(*keys, *[F.get(f"__{m}", F.lit(i)).alias(f"{m}_ci95_{side}") for m in METRICS for i, side in enumerate(("low", "high"))])
    points = metrics_from_sums(add_up(per_cluster, keys, [F.count(F.lit(1)).alias("n_clusters"), F.sum("s_n").cast("bigint").alias("n_points")]))
    return points.join(limits, keys)


def metric_checks(metrics: DataFrame) -> DataFrame:
    """One row: metrics finite, and limits ordered around the bias."""
    finite = reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(m) for m in METRICS[:5]])
    ordered = (F.col("lower_loa") <= F.col("bias")) & (F.col("bias") <= F.col("upper_loa"))
    return metrics.agg(F.bool_and(finite).alias("finite_metrics"), F.bool_and(ordered).alias("limits_ordered"))
