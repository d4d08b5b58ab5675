"""Leakage-safe nested grouped cross-validation for ridge-type model ladders.

Standardising, median imputing, principal components and ridge are all functions
of a training set's cross-product matrix, so the data are read a fixed number of
times whatever the number of models, candidates and folds:

1. feature sums, which give a common shift and the columns with gaps;
2. one cross-product matrix per (outer fold, inner fold) cell, as rows of blocks of its upper
   triangle: every training set, inner or outer, is a sum of cells, added up block by block;
3. absolute errors of all candidates on all inner folds at once;
4. out-of-fold predictions of the selected candidates.

A training set is solved by the task that its blocks meet in; only coefficients reach the
driver. Features are one array<double> column; NULL elements are missing values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, small, spread
from . import forests as fo
from .contracts import GateError, require_empty, split_groups
from .folds import group_kfold, inner_folds
from .ordered import exact_percentiles

FAN_IN = 256
BLOCK_VALUES = 65536


@dataclass(frozen=True)
class Ladder:
    """One model: which features enter as they are, which through principal components."""

    name: str
    family: str  # "mean", "fixed", "linear" or "ridge"
    plain: tuple[int, ...] = ()
    represented: tuple[int, ...] = ()
    components: tuple[int, ...] = (0,)
    alphas: tuple[float, ...] = (0.0,)
    whiten: bool = True
    constant: float = -1.0

    def candidates(self) -> list[tuple[int, float]]:
        if self.family != "ridge":
            return [(0, 0.0)]
        return [(c, a) for c in self.components for a in self.alphas]


@dataclass
class Moments:
    """Cross products of [1, x, gap indicators, y] around a fixed shift."""

    matrix: np.ndarray
    features: int
    gaps: list[int] = field(default_factory=list)

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix + other.matrix, self.features, self.gaps)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def completed(self, fill: dict[int, float]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Means and centred scatter after filling gaps: (x mean, y mean, Sxx, Sxy), in shifted units."""
        size = self.matrix.shape[0]
        lift = np.zeros((size, self.features + 2))
        lift[0, 0] = lift[-1, -1] = 1.0
        lift[1:self.features + 1, 1:self.features + 1] = np.eye(self.features)
        for position, column in enumerate(self.gaps):
            lift[self.features + 1 + position, 1 + column] = fill[column]
        full = lift.T @ self.matrix @ lift
        mean = full[0] / full[0, 0]
        centred = full - np.outer(full[0], mean)
        return mean[1:-1], float(mean[-1]), centred[1:-1, 1:-1], centred[1:-1, -1]


# ---- passes over the data -----------------------------------------------------------

def _dense(column: pa.Array, features: int) -> np.ndarray:
    """(rows, features) matrix straight from the Arrow buffer, NaN for missing elements."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), features)


def _inner(column: pa.Array, outer_folds: int) -> np.ndarray:
    """(rows, outer folds) inner fold numbers with 0 where a row is held out."""
    return np.nan_to_num(_dense(column, outer_folds)).astype(int)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.float64)


def _sums_batch(keys: dict[str, list], values: list[np.ndarray]) -> pa.RecordBatch:
    """Partial sums of this task: int key columns, the task number and one value array per row."""
    ints = {**keys, "part": [TaskContext.get().partitionId()] * len(values)}
    columns = [pa.array(v, pa.int32()) for v in ints.values()]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], [*ints, "values"])


def _sum_arrays(df: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Elementwise sum of array column ``values``.

    Each task of the input adds one row per key. Unless those tasks are known to be
    few, they are summed in two levels so that no group grows with the task count.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("part", T.IntegerType()), df.schema["values"]])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["values"]]), axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "part": [0], "values": [total]})

    if few:
        return df.select(*schema.fieldNames()).groupBy(*keys).applyInPandas(add, schema).drop("part")
    bucketed = df.withColumn("part", F.pmod("part", F.lit(FAN_IN)).cast("int")).select(*schema.fieldNames())
    once = bucketed.groupBy(*keys, "part").applyInPandas(lambda pdf: add(pdf).assign(part=pdf["part"].iloc[0]), schema)
    return once.groupBy(*keys).applyInPandas(add, schema).drop("part")


def feature_sums(df: DataFrame, x: str, y: str, features: int, few: bool = False) -> tuple[np.ndarray, float, list[int]]:
    """Shift (approximate centre) for features and target, and the columns that have gaps."""
    def run(batches):
        total = np.zeros(2 * features + 2)
        for batch in batches:
            m = _dense(batch.column(0), features)
            total[:features] += np.nansum(m, axis=0)
            total[features:2 * features] += np.isnan(m).sum(axis=0)
            total[-2:] += (_numbers(batch.column(1)).sum(), len(m))
        yield _sums_batch({"key": [0]}, [total])

    partial = df.select(x, y).mapInArrow(run, "key int, part int, values array<double>")
    total = np.asarray(_sum_arrays(partial, ["key"], few).first()["values"])
    rows = total[-1]
    if rows == 0:
        raise GateError("no rows to model")
    seen = np.maximum(rows - total[features:2 * features], 1)
    return total[:features] / seen, total[-2] / rows, np.flatnonzero(total[features:2 * features]).tolist()


def cell_blocks(
    df: DataFrame, x: str, y: str, features: int, outer: list[int], shift: np.ndarray, y_shift: float, gaps: list[int],
    few: bool = False,
) -> DataFrame:
    """(o, i, b, values): the upper triangle of every (outer position, inner fold) cell's cross products, in blocks of rows.

    ``inner`` holds a row's fold for every outer fold. A task multiplies its own rows a cell and a
    block at a time and keeps none of the products. Stored, because several steps read it.
    """
    width = features + len(gaps) + 2
    step = max(1, BLOCK_VALUES // width)  # matrix rows per shuffled record

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        m = _dense(rows.column(0).chunk(0), features) - shift
        holes = np.isnan(m[:, gaps]).astype(float)
        z = np.column_stack([np.ones(len(m)), np.nan_to_num(m), holes, _numbers(rows.column(1).chunk(0)) - y_shift])
        inner = _inner(rows.column(2).chunk(0), len(outer))
        for o in range(len(outer)):
            for i in np.unique(inner[:, o]):
                if i > 0:
                    part = z[inner[:, o] == i]
                    for b, at in enumerate(range(0, width, step)):
                        block = part[:, at:at + step].T @ part[:, at:]
                        yield _sums_batch({"o": [o], "i": [int(i)], "b": [b]}, [block.ravel()])

    partial = df.select(x, y, "inner").mapInArrow(run, "o int, i int, b int, part int, values array<double>")
    return materialise(_sum_arrays(partial, ["o", "i", "b"], few))


def assembled(blocks: list[tuple[int, np.ndarray]], features: int, gaps: list[int]) -> Moments:
    """The whole symmetric matrix from its upper blocks."""
    width = features + len(gaps) + 2
    step = max(1, BLOCK_VALUES // width)
    matrix = np.zeros((width, width))
    for b, values in blocks:
        at = b * step
        block = values.reshape(-1, width - at)
        matrix[at:at + len(block), at:] = block
        matrix[at:, at:at + len(block)] = block.T
    return Moments(matrix, features, gaps)


def fitted_sets(
    cells: DataFrame, folds: dict[int, list[int]], features: int, gaps: list[int], fills: dict, models: list[Ladder],
    shift: np.ndarray, y_shift: float, few: bool,
) -> DataFrame:
    """(o, j, position, candidate, n, values): coefficients of every candidate on every training set, left-out fold j or 0 for none.

    Models with one candidate are fitted on whole training sets only. A row with candidate -1 holds
    the variance ratios of the components of the first represented model of a whole set.
    """
    sets = F.array(*[F.array(*[F.lit(j) for j in (0, *folds[o])]) for o in sorted(folds)])
    left_out = F.filter(F.get(sets, F.col("o")), lambda j: j != F.col("i"))
    dealt = cells.withColumn("j", F.explode(left_out)).withColumnRenamed("i", "part").select("o", "j", "b", "part", "values")
    summed = _sum_arrays(dealt, ["o", "j", "b"], few)  # a cell a row: at most as many as inner folds
    first = next((p for p, m in enumerate(models) if m.represented), None)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        o, j = (k.as_py() for k in key)
        blocks = zip(table.column("b").to_pylist(), table.column("values"))
        moments = assembled([(b, v.values.to_numpy(zero_copy_only=False)) for b, v in blocks], features, gaps)
        fill = {c: v - shift[c] for c, v in fills[(o, j)].items()}
        out = []
        for position, model in enumerate(models):
            if j == 0 or len(model.candidates()) > 1:
                for candidate, row in enumerate(fit_candidates(model, moments, fill, shift, y_shift)):
                    out.append((o, j, position, candidate, moments.n, row.tolist()))
        if j == 0 and first is not None:
            rep = list(models[first].represented)
            _, _, sxx, _ = moments.completed(fill)
            _, ratios = principal_axes(sxx[np.ix_(rep, rep)], moments.n, max(models[first].components), models[first].whiten)
            out.append((o, j, first, -1, moments.n, ratios.tolist()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("o", "j", "position", "candidate", "n", "values"), zip(*out), kinds)})

    return summed.groupBy("o", "j").applyInArrow(solve, "o int, j int, position int, candidate int, n double, values array<double>")


def training_medians(df: DataFrame, x: str, gaps: list[int], outer: list[int], inner: int) -> dict[tuple[int, int, int], float]:
    """Exact median of every gap column in every training set: (outer position, left-out inner fold or 0, column)."""
    if not gaps:
        return {}
    sets = F.flatten(F.array(*[
        _training_sets(o, inner) for o in range(len(outer))
    ]))
    # equal values of rows with equal fold membership are counted before they are multiplied out
    cells = df.select("inner", F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.get(x, F.lit(c)).alias("v")) for c in gaps
    ])).alias("e")).where(F.col("e.v").isNotNull())
    counted = cells.groupBy("inner", F.col("e.c").alias("c"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    long = counted.select(F.explode(sets).alias("s"), "c", "v", "n")
    long = long.select(F.col("s.o").alias("o"), F.col("s.j").alias("j"), "c", "v", "n")
    medians = exact_percentiles(long, ["o", "j", "c"], "v", {"m": 0.5}, weight="n")
    return {(r["o"], r["j"], r["c"]): r["m"] for r in medians.collect()}


def _training_sets(o: int, inner: int):
    """The training sets of outer position ``o`` a row belongs to: 0 (all of it) and every other inner fold."""
    mine = F.get("inner", F.lit(o))
    others = F.filter(F.sequence(F.lit(0), F.lit(inner)), lambda j: mine.isNotNull() & (j != mine))
    return F.transform(others, lambda j: F.named_struct(F.lit("o"), F.lit(o), F.lit("j"), j))


# ---- solving one training set ---------------------------------------------------------

def principal_axes(scatter: np.ndarray, n: float, limit: int, whiten: bool) -> tuple[np.ndarray, np.ndarray]:
    """Axes of the standardised block as a projection from centred raw features, and variance ratios.

    Standardisation uses the population SD, component variances n - 1. The sign of
    each axis makes its largest loading positive.
    """
    sd = np.sqrt(np.diag(scatter) / n)
    sd = np.where(sd > 0, sd, 1.0)
    z = scatter / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(z)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    vectors = vectors * np.where(flip == 0, 1.0, flip)
    keep = int(min(limit, n - 1, scatter.shape[0]))
    variance = values / max(n - 1, 1)
    ratios = variance / max(variance.sum(), np.finfo(float).tiny)
    axes = vectors[:, :keep] / sd[:, None]
    if whiten:
        axes = axes / np.sqrt(np.maximum(variance[:keep], np.finfo(float).tiny))
    return axes, ratios[:keep]


def fit_candidates(model: Ladder, moments: Moments, fill: dict[int, float], shift: np.ndarray, y_shift: float) -> np.ndarray:
    """(candidates, 1 + features) intercepts and coefficients in raw feature units."""
    width = moments.features
    mean, y_mean, sxx, sxy = moments.completed(fill)
    out = np.zeros((len(model.candidates()), 1 + width))
    if model.family == "fixed":
        out[:, 0] = model.constant
        return out
    if model.family == "mean":
        out[:, 0] = y_mean + y_shift
        return out
    n = moments.n
    plain, rep = list(model.plain), list(model.represented)
    base = np.zeros((width, len(plain)))
    sd = np.sqrt(np.diag(sxx)[plain] / n)
    base[plain, range(len(plain))] = 1.0 / np.where(sd > 0, sd, 1.0)
    axes = np.zeros((width, 0))
    if rep:
        block, _ = principal_axes(sxx[np.ix_(rep, rep)], n, max(model.components), model.whiten)
        axes = np.zeros((width, block.shape[1]))
        axes[rep] = block
    for position, (k, alpha) in enumerate(model.candidates()):
        project = np.column_stack([base, axes[:, :k]])
        gram, cross = project.T @ sxx @ project, project.T @ sxy
        if model.family == "linear":
            weights = np.linalg.lstsq(gram, cross, rcond=None)[0]
        else:
            weights = np.linalg.solve(gram + alpha * np.eye(len(cross)), cross)
        beta = project @ weights
        out[position, 1:] = beta
        out[position, 0] = y_mean + y_shift - (mean + shift) @ beta
    return out


def _filled(m: np.ndarray, fill: dict[int, float]) -> np.ndarray:
    for column, value in fill.items():
        missing = np.isnan(m[:, column])
        m[missing, column] = value
    return m


# ---- the nested run ---------------------------------------------------------------------

@dataclass
class NestedResult:
    predictions: DataFrame
    tuning: DataFrame
    configurations: DataFrame
    components: DataFrame


def nested_ladder(
    df: DataFrame, keys: list[str], group: str, outer: str, x: str, y: str, features: int, models: list[Ladder], inner: int = 4
) -> NestedResult:
    """Outer-fold predictions of every model with candidates chosen by grouped inner folds.

    The candidate with the smallest mean inner MAE wins, earlier candidates first.
    """
    spark = df.sparkSession
    require_empty(split_groups(df, group, outer), "group split across outer folds")
    outer_values = sorted(int(r[0]) for r in df.select(outer).distinct().collect())
    assigned = inner_folds(df, group, outer, outer_values, inner).select(group, "inner")
    rows = df.select(*keys, group, outer, F.col(x).alias("__x"), F.col(y).cast("double").alias("__y"))
    rows, tasks = spread(rows.join(small(assigned), group))
    few = tasks <= 256  # partial sums that one task can add up
    shift, y_shift, gaps = feature_sums(rows, "__x", "__y", features, few)
    cells = cell_blocks(rows, "__x", "__y", features, outer_values, shift, y_shift, gaps, few)
    medians = training_medians(rows, "__x", gaps, outer_values, inner)
    inner_of: dict[int, list[int]] = {}
    for row in cells.select("o", "i").distinct().collect():
        inner_of.setdefault(row["o"], []).append(row["i"])
    inner_of = {o: sorted(found) for o, found in sorted(inner_of.items())}
    fills = {(o, j): {c: medians[(o, j, c)] for c in gaps} for o in inner_of for j in (0, *inner_of[o])}
    fitted, sizes = {}, {}
    for row in fitted_sets(cells, inner_of, features, gaps, fills, models, shift, y_shift, few).collect():
        fitted.setdefault((row["o"], row["j"], row["position"]), {})[row["candidate"]] = np.asarray(row["values"])
        sizes[row["o"], row["j"]] = row["n"]

    # every candidate of every tuned model on every inner fold
    tuned = [(p, m) for p, m in enumerate(models) if len(m.candidates()) > 1]
    labels = [(p, c) for p, m in tuned for c in range(len(m.candidates()))]
    scores: dict[tuple[int, int], dict[int, float]] = {}
    if labels:
        weights = {(o, i): np.vstack([fitted[o, i, p][c] for p, c in labels]) for o, folds in inner_of.items() for i in folds}
        raw_fill = {key: fills[key] for key in weights}
        shared = spark.sparkContext.broadcast((weights, raw_fill))

        def errors(batches):
            coefficients, filling = shared.value
            total = {cell: np.zeros(len(labels) + 1) for cell in coefficients}
            for batch in batches:
                m, target = _dense(batch.column(0), features), _numbers(batch.column(1))
                folds = _inner(batch.column(2), len(outer_values))
                for (o, i), table in coefficients.items():
                    mask = folds[:, o] == i
                    if mask.any():
                        part = _filled(m[mask], filling[(o, i)])
                        gap = np.abs(part @ table[:, 1:].T + table[:, 0] - target[mask][:, None])
                        total[(o, i)][:-1] += gap.sum(0)
                        total[(o, i)][-1] += mask.sum()
            yield _sums_batch({"o": [o for o, _ in total], "i": [i for _, i in total]}, list(total.values()))

        partial = rows.select("__x", "__y", "inner").mapInArrow(errors, "o int, i int, part int, values array<double>")
        for row in _sum_arrays(partial, ["o", "i"], few).collect():
            values = np.asarray(row["values"])
            for label, value in zip(labels, values[:-1] / values[-1]):
                scores.setdefault((row["o"], *label), {})[row["i"]] = float(value)

    tuning_rows, configuration_rows, component_rows, final = [], [], [], {}
    for o, fold in enumerate(outer_values):
        picked = []
        for position, model in enumerate(models):
            choice, best = 0, None
            for c, (k, alpha) in enumerate(model.candidates()):
                found = scores.get((o, position, c))
                if found is None:
                    continue
                per_fold = [found[i] for i in sorted(found)]
                mean = float(np.mean(per_fold))
                if best is None or mean < best:
                    choice, best = c, mean
                tuning_rows.append([model.name, position + 1, fold, c, k, alpha, per_fold, mean, float(np.std(per_fold))])
            k, alpha = model.candidates()[choice]
            coefficients = fitted[o, 0, position][choice]
            picked.append(coefficients)
            configuration_rows.append((model.name, position + 1, fold, choice, k, alpha, best, int(sizes[o, 0]), float(coefficients[0])))
            for row in tuning_rows:
                if row[0] == model.name and row[2] == fold and len(row) == 9:
                    row.append(row[3] == choice)
        final[fold] = (np.stack(picked), fills[o, 0])
        ratios = next((fitted[o, 0, p][-1] for p, m in enumerate(models) if m.represented), [])
        component_rows += [(fold, c + 1, float(r), float(t)) for c, (r, t) in enumerate(zip(ratios, np.cumsum(ratios)))]

    chosen = spark.sparkContext.broadcast(final)

    def predict(batches):
        for batch in batches:
            m = _dense(batch.column("__x"), features)
            out = np.empty((len(m), len(models)))
            held = _numbers(batch.column(outer))
            for fold, (table, fill) in chosen.value.items():
                mask = held == fold
                if mask.any():
                    out[mask] = _filled(m[mask], fill) @ table[:, 1:].T + table[:, 0]
            offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(models))
            guesses = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            passed = [name for name in batch.schema.names if name != "__x"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in passed], guesses], [*passed, "__p"])

    kept = [*keys, group, outer, "__y"]
    kept = list(dict.fromkeys(kept))
    schema = T.StructType([rows.schema[name] for name in kept] + [T.StructField("__p", T.ArrayType(T.DoubleType()))])
    wide = rows.select(*kept, "__x").mapInArrow(predict, schema)
    names = F.array(*[F.lit(m.name) for m in models])
    long = wide.select(*kept, F.posexplode("__p").alias("__pos", "prediction"))
    predictions = long.select(
        *[c for c in kept if c != "__y"], F.get(names, F.col("__pos")).alias("model"), (F.col("__pos") + 1).alias("model_position"),
        F.col("__y").alias("observed"), F.col("prediction").alias("predicted"))
    tuning = spark.createDataFrame(
        [tuple(r) for r in tuning_rows],
        "model string, model_position int, outer_fold int, candidate int, components int, alpha double, "
        "inner_mae array<double>, mean_inner_mae double, sd_inner_mae double, selected boolean")
    configurations = spark.createDataFrame(
        configuration_rows,
        "model string, model_position int, outer_fold int, candidate int, components int, alpha double, "
        "mean_inner_mae double, train_rows bigint, intercept double")
    components = spark.createDataFrame(component_rows, "outer_fold int, component int, explained_ratio double, cumulative_ratio double")
    return NestedResult(predictions, tuning, configurations, components)


# ---- forests ------------------------------------------------------------------------------

def gap_columns(df: DataFrame, x: str) -> list[int]:
    """Positions of array ``x`` that are NULL somewhere."""
    found = df.select(F.posexplode(x).alias("c", "v")).where(F.col("v").isNull()).select("c").distinct()
    return sorted(r["c"] for r in found.collect())


@dataclass
class _Stored:
    """Rows with binned features, written once, and what the forests on them share."""

    rows: DataFrame
    features: int
    tried: int
    fills: dict
    mean: float
    folds: dict[int, list[int]]
    few: bool

    def means(self, forests: list[fo.Forest], cuts: tuple, node_rows: int | None) -> DataFrame:
        shape = fo.Shape(self.features, self.tried, cuts, self.fills)
        return fo.held_out_means(self.rows, forests, shape, lambda df, keys: _sum_arrays(df, keys, self.few), node_rows)


def _stored(df: DataFrame, keys: list[str], x: str, y: str, n_outer: int, inner: int, feature_share: str) -> _Stored:
    """``df`` has __outer (position) and __inner (a fold for every outer position) beside its own columns."""
    rows = df.select(*keys, F.xxhash64(*keys).alias("__turn"), F.col("__outer").cast("int").alias("__outer"), F.col("__inner").cast("array<int>").alias("__inner"),
                     F.col(y).cast("double").alias("__y"), F.col(x).cast("array<double>").alias("__x"))
    rows, tasks = spread(rows)
    found = rows.agg(F.max(F.size("__x")).alias("f"), F.avg("__y").alias("m")).first()
    if found["f"] is None:
        raise GateError("no rows to model")
    features = found["f"]
    edges = fo.bin_edges(rows, "__x", features)
    gaps = gap_columns(rows, "__x")
    medians = training_medians(rows.withColumnRenamed("__inner", "inner"), "__x", gaps, list(range(n_outer)), inner)
    sets = rows.select(F.posexplode("__inner").alias("o", "i")).where("i IS NOT NULL").distinct().collect()
    folds = {o: sorted(r["i"] for r in sets if r["o"] == o) for o in range(n_outer)}
    fills = {(o, j): {c: int(np.searchsorted(edges[c], medians[o, j, c])) if (o, j, c) in medians else 0 for c in gaps}
             for o in folds for j in (0, *folds[o])}
    numbered = rows.withColumn("__y", F.col("__y") - F.lit(found["m"])).withColumn("__id", F.monotonically_increasing_id())
    numbered = materialise(fo.binned(numbered, "__x", edges, [*keys, "__id", "__turn", "__outer", "__inner", "__y"]))
    tried = int(features**0.5) if feature_share == "sqrt" else int(float(feature_share) * features)
    return _Stored(numbered, features, min(features, max(1, tried)), fills, found["m"], folds, tasks <= FAN_IN)


def _tuned(stored: _Stored, candidates: list[tuple[int | None, int]], trees: int, seeds: dict[int, int], node_rows: int | None) -> dict[int, list]:
    """outer position -> (candidate, depth, leaf, mean inner MAE, parameters as JSON) with all limits of depth read off one forest."""
    cuts = tuple(dict.fromkeys(depth for depth, _ in candidates))
    leaves = list(dict.fromkeys(leaf for _, leaf in candidates))
    sets = [(o, i, leaf) for o, folds in stored.folds.items() for i in folds for leaf in leaves]
    forests = [fo.Forest(k, o, i, leaf, trees, seeds[o]) for k, (o, i, leaf) in enumerate(sets)]
    means = stored.means(forests, cuts, node_rows).join(stored.rows.select("__id", "__y"), F.col("id") == F.col("__id"))
    errors = means.groupBy("forest").agg(*[F.avg(F.abs(F.col(f"p{c}") - F.col("__y"))).alias(f"e{c}") for c in range(len(cuts))])
    found: dict[tuple, list] = {}
    for row in errors.collect():
        o, _, leaf = sets[row["forest"]]
        for c, cut in enumerate(cuts):
            found.setdefault((o, cut, leaf), []).append(row[f"e{c}"])
    return {o: [(k, depth, leaf, float(np.mean(sorted(found[o, depth, leaf]))),
                 '{"max_depth": %s, "min_samples_leaf": %d}' % ("null" if depth is None else depth, leaf))
                for k, (depth, leaf) in enumerate(candidates)] for o in stored.folds}


def forest_predictions(
    df: DataFrame, keys: list[str], group: str, outer: str, x: str, y: str, trees: int = 250, leaf: int = 8,
    feature_share: str = "0.8", depth: int | None = None, seed: int = 42,
    candidates: list[tuple[int | None, int]] | None = None, tune_trees: int = 500, inner: int = 4, node_rows: int | None = None,
) -> DataFrame:
    """Outer-fold predictions of one random forest; groups never straddle train and test.

    NULL features are filled with the medians of the training folds. With ``candidates`` the
    (depth, leaf) of each outer fold are those with the least mean MAE over its grouped inner
    folds; ties go to the sorted JSON of the parameters. A leaf holds at least ``leaf`` different
    drawn rows. Splits fall between at most 64 quantile bins a feature. ``keys`` identify a row.
    """
    require_empty(split_groups(df, group, outer), "group split across outer folds")
    values = sorted(int(r[0]) for r in df.select(outer).distinct().collect())
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(outer).cast("int")) - 1
    kept = list(dict.fromkeys([*keys, group, outer]))
    assigned = inner_folds(df, group, outer, values, inner).select(group, F.col("inner").alias("__inner"))
    stored = _stored(df.withColumn("__outer", position).join(small(assigned), group), kept, x, y, len(values), inner, feature_share)
    seeds = {o: seed + 100 * v if candidates else seed for o, v in enumerate(values)}
    chosen = {o: (depth, leaf) for o in range(len(values))}
    if candidates:
        tuned = _tuned(stored, candidates, tune_trees, seeds, node_rows)
        chosen = {o: min(rows, key=lambda r: (r[3], r[4]))[1:3] for o, rows in tuned.items()}
    cuts = tuple(dict.fromkeys(d for d, _ in chosen.values()))
    forests = [fo.Forest(o, o, 0, size, trees, seeds[o]) for o, (_, size) in sorted(chosen.items())]
    pick = F.coalesce(*[F.when(F.col("forest") == o, F.col(f"p{cuts.index(d)}")) for o, (d, _) in chosen.items()])
    means = stored.means(forests, cuts, node_rows).select("id", (pick + F.lit(stored.mean)).alias("predicted"))
    return stored.rows.join(means.withColumnRenamed("id", "__id"), "__id").select(*kept, (F.col("__y") + F.lit(stored.mean)).alias("observed"), "predicted")


def tune_forest(
    df: DataFrame, group: str, x: str, y: str, candidates: list[tuple[int | None, int]], trees: int, inner: int = 4, seed: int = 42,
    feature_share: str = "sqrt", keys: list[str] | None = None, node_rows: int | None = None,
) -> DataFrame:
    """Mean grouped inner MAE of each (depth, leaf) candidate; ties go to the sorted JSON of its parameters.

    NULL features are filled with the medians of the inner training folds. Rows that ``keys`` (the
    group, target and features by default) do not tell apart are drawn together.
    """
    splits = min(inner, df.select(group).distinct().count())
    folds = group_kfold(df, group, splits, "__fold").select(group, F.array("__fold").alias("__inner"))
    joined = df.join(small(folds), group).withColumn("__outer", F.lit(-1))
    stored = _stored(joined, keys or [group, y, x], x, y, 1, splits, feature_share)
    found = _tuned(stored, candidates, trees, {0: seed}, node_rows)[0]
    table = df.sparkSession.createDataFrame(found, "candidate int, max_depth int, min_leaf int, mean_inner_mae double, parameters string")
    order = Window.orderBy("mean_inner_mae", "parameters")  # one row a candidate
    return table.withColumn("selected", F.row_number().over(order) == 1)
