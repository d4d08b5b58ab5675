"""Deterministic balanced group folds.

Groups are placed largest first into the lightest fold. Placement depends on a
group's load signature (its counts) and, inside a signature, only on its rank by
id. So the sequential part runs over distinct signatures, not over groups. Inside a
run of equal groups the lightest fold is filled until it meets the next one, then
these two take turns until they meet the third, and so on: at most one segment per
fold, each worked out by division, however long the run or uneven the folds. The
signature table is the only data that reaches the driver, streamed; distinct group
sizes cannot exceed sqrt(2 * rows), signatures of three loads about rows ** (3/4).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import materialise, small
from .contracts import GateError
from .ordered import rank_within, running_sum

SEGMENTS = "array<struct<start:bigint, cycle:array<int>>>"


def _turns_before(level: tuple[int, ...], other: tuple[int, ...], step: tuple[int, ...]) -> int | None:
    """How many of level, level + step, level + 2 * step, ... come before ``other``; None when all do."""
    for at, (mine, theirs, add) in enumerate(zip(level, other, step)):
        if add:
            turns = max(-(-(theirs - mine) // add), 0)
            reached = tuple(m + turns * s for m, s in zip(level, step))
            return turns + (reached[at] == theirs and reached < other)
        if mine != theirs:
            return None if mine < theirs else 0
    return 0


def _place_runs(runs: Iterable[tuple[tuple[int, ...], int]], n_folds: int, count_after_first: bool) -> Iterator[tuple]:
    """(signature, segments) per run of equal groups; a segment is its first position and the folds that take turns.

    A fold's level is (first load, other loads, fold), with the group count second where it counts.
    """
    levels: list[tuple[int, ...]] = []
    for signature, size in runs:
        if min(signature) < 0:
            raise GateError(f"negative load in {signature}")
        step = (signature[0], *([1] if count_after_first else []), *signature[1:], 0)
        if not levels:
            levels = [(0,) * (len(step) - 1) + (fold,) for fold in range(n_folds)]
        waiting, active, segments, done = sorted(levels), [], [], 0
        while done < size:
            active = sorted([*active, waiting.pop(0)])
            left = size - done
            taken = [_turns_before(level, waiting[0], step) for level in active] if waiting else [None] * len(active)
            if None in taken or sum(taken) > left:  # the run ends before the next fold is met
                # folds without a step never fill up: the lightest keeps its turn
                cycle = active if any(step) else active[:1]
                taken = [left // len(cycle) + (at < left % len(cycle)) for at in range(len(cycle))]
                taken += [0] * (len(active) - len(cycle))
            else:
                cycle = active
            if sum(taken):
                segments.append((done, [level[-1] + 1 for level in cycle]))
            done += sum(taken)
            active = [tuple(v + t * s for v, s in zip(level, step)) for level, t in zip(active, taken)]
        levels = active + waiting
        yield signature, segments


def _signatures(groups: DataFrame, columns: list[str]) -> Iterator[Row]:
    """Distinct signatures with their number of groups, largest first, a partition at a time."""
    counted = groups.groupBy(*columns).agg(F.count(F.lit(1)).alias("__m"))
    return counted.orderBy(*[F.col(name).desc() for name in columns]).toLocalIterator()


def _turn(segments: Column, position: Column) -> Column:
    """The fold at a position of a run: the last segment that has begun, and its turn there."""
    segment = F.get(F.filter(segments, lambda s: s["start"] <= position), F.size(F.filter(segments, lambda s: s["start"] <= position)) - 1)
    return F.get(segment["cycle"], F.try_mod(position - segment["start"], F.size(segment["cycle"])).cast("int"))


def balanced_folds(
    groups: DataFrame, group: str, loads: list[str], n_folds: int = 5, count_after_first: bool = True, fold: str = "fold"
) -> DataFrame:
    """Add a 1-based ``fold`` to one row per group.

    Groups go in order (-loads..., id); each goes to the fold with the smallest
    (first load, groups so far, other loads, fold number). With
    ``count_after_first=False`` the group count is left out of that comparison.
    """
    if n_folds < 2:
        raise ValueError("at least two folds are required")
    sizes: list[int] = []

    def runs() -> Iterator[tuple[tuple[int, ...], int]]:
        for row in _signatures(groups, loads):
            sizes.append(row["__m"])
            yield tuple(int(row[name]) for name in loads), row["__m"]

    placed = [(*signature, segments) for signature, segments in _place_runs(runs(), n_folds, count_after_first)]
    if sum(sizes) < n_folds:
        raise GateError("more folds than groups")
    schema = ", ".join([*[f"`{name}` bigint" for name in loads], f"__segments {SEGMENTS}"])
    table = groups.sparkSession.createDataFrame(placed, schema)
    ranked = rank_within(groups, loads, [group], "__rank", max(sizes))
    chosen = _turn(F.col("__segments"), F.col("__rank") - 1)
    return ranked.join(small(table), loads).withColumn(fold, chosen).select(*groups.columns, fold)


def visit_folds(cases: DataFrame, participant: str, timepoint: str, baseline: str, year_one: str, n_folds: int = 5) -> DataFrame:
    """Participant folds balanced on visits, then participants, baseline and year-one visits."""
    counts = cases.groupBy(participant).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col(timepoint) == baseline).alias("baseline_visits"),
        F.count_if(F.col(timepoint) == year_one).alias("year_one_visits"),
    )
    return balanced_folds(counts, participant, ["visits", "baseline_visits", "year_one_visits"], n_folds, True)


def group_kfold(df: DataFrame, group: str, n_splits: int, fold: str = "fold") -> DataFrame:
    """(group, fold): row-count balanced k-fold over groups; ties go to the smaller id."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return balanced_folds(sizes, group, ["n_rows"], n_splits, False, fold).select(group, fold)


def fold_summary(assigned: DataFrame, fold: str, loads: list[str]) -> DataFrame:
    return assigned.groupBy(fold).agg(F.count(F.lit(1)).alias("groups"), *[F.sum(name).alias(name) for name in loads])


def inner_folds(df: DataFrame, group: str, outer: str, folds: list[int], n_splits: int = 4) -> DataFrame:
    """(group, outer, inner array): for each outer fold the group's inner fold, NULL where it is held out.

    All outer folds share one sort: a group's rank among equally sized groups that
    stay in training is a running count, kept per outer fold.
    """
    sizes = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.min(outer).alias(outer)))
    runs = [(row["n_rows"], row[outer], row["__m"]) for row in _signatures(sizes, ["n_rows", outer])]
    totals: dict[int, int] = {}
    for n, _, groups in runs:
        totals[n] = totals.get(n, 0) + groups
    placed: dict[int, dict[int, list]] = {}
    for held in folds:
        kept: dict[int, int] = {}
        for n, own, groups in runs:
            if own != held:
                kept[n] = kept.get(n, 0) + groups
        splits = min(n_splits, sum(kept.values()))
        for (n,), segments in _place_runs((((n,), m) for n, m in kept.items()), splits, False):
            placed.setdefault(n, {})[held] = segments
    rows = [(n, [found.get(h, []) for h in folds]) for n, found in placed.items()]
    table = df.sparkSession.createDataFrame(rows, f"n_rows bigint, __segments array<{SEGMENTS}>")
    stays = [f"__stay{h}" for h in folds]
    marked = sizes.withColumns({s: (F.col(outer) != h).cast("int") for s, h in zip(stays, folds)})
    ranks = [f"__rank{h}" for h in folds]
    ranked = running_sum(marked, ["n_rows"], [group], stays, ranks, max(totals.values(), default=0))
    joined = ranked.join(small(table), "n_rows", "left")

    def fold_of(i: int, held: int) -> Column:
        return F.when(F.col(outer) != held, _turn(F.get("__segments", F.lit(i)), F.col(f"__rank{held}") - 1))

    return joined.select(group, outer, F.array(*[fold_of(i, h) for i, h in enumerate(folds)]).alias("inner"))


def leave_fold_out_mean(df: DataFrame, fold: str, value: str) -> DataFrame:
    """Training mean for each held-out fold from per-fold sums: (S - S_k) / (N - N_k)."""
    per_fold = df.groupBy(fold).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    # one row per fold by now, so an unpartitioned window is a handful of rows
    every = Window.partitionBy(F.lit(0))
    rest: Column = F.try_divide(
        F.sum("__s").over(every) - F.col("__s"), F.sum("__n").over(every) - F.col("__n")
    )
    return per_fold.select(fold, rest.alias("training_mean"))
