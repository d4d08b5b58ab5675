"""Data-quality gates and key-contract joins. Gates are aggregates; failing closes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from ..session import dealt, parts_for, small

OUTCOME_TERMS = ("sensitivity", "outcome", "prediction", "residual")


class GateError(RuntimeError):
    """A declared data contract does not hold."""


# ---- plan-time checks (no job) ------------------------------------------------

def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise GateError(f"{what} lacks required columns: {missing}")
    return df


def require_label_blind(df: DataFrame, terms: Iterable[str] = OUTCOME_TERMS) -> DataFrame:
    """Feature tables may not even carry an outcome-like column."""
    found = sorted(name for name in df.columns if any(term in name.lower() for term in terms))
    if found:
        raise GateError(f"outcome-like columns in a label-blind table: {found}")
    return df


def require_same_schema(frames: list[DataFrame]) -> None:
    shapes = {tuple(sorted((f.name, f.dataType.simpleString()) for f in df.schema)) for df in frames}
    if len(shapes) != 1:
        raise GateError("blocks to be stacked differ in columns or types")


def numeric_features(df: DataFrame, reserved: Iterable[str]) -> list[str]:
    """Numeric columns that are not identity columns (schema only, no job)."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    kept = [name for name, kind in df.dtypes if name not in set(reserved) and kind.startswith(kinds)]
    if not kept:
        raise GateError("no numeric feature columns")
    return kept


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefix)]


# ---- violation tables ---------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def wrong_cardinality(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != expected)


def wrong_member_set(df: DataFrame, keys: list[str], member: str, expected: list[int]) -> DataFrame:
    """Groups whose members are not exactly ``expected`` once each, without collecting any group."""
    hits = [F.count_if(F.col(member) == value).alias(f"__m{i}") for i, value in enumerate(expected)]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *hits)
    complete = reduce(lambda a, b: a & b, [F.col(f"__m{i}") == 1 for i in range(len(expected))])
    return counted.where(~(complete & (F.col("n_rows") == len(expected)))).select(*keys, "n_rows")


def split_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that appear in more than one fold (min <> max needs no distinct shuffle)."""
    spread = df.groupBy(group).agg(F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold"))
    return spread.where(F.col("first_fold") != F.col("last_fold"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.select(*keys).distinct().join(parent.select(*keys), keys, "left_anti")


def key_set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, tagged with the side; one shuffle of the union."""
    sides = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    seen = sides.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    only = F.when(F.col("__r") == 0, "left_only").when(F.col("__l") == 0, "right_only")
    return seen.withColumn("side", only).where(F.col("side").isNotNull()).drop("__l", "__r")


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Signed surplus per value: positive when the left has more copies. Pre-aggregated per side."""
    sides = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).unionByName(
        right.groupBy(*keys).agg((-F.count(F.lit(1))).alias("__n"))
    )
    return sides.groupBy(*keys).agg(F.sum("__n").alias("surplus")).where(F.col("surplus") != 0)


def reconcile(declared: DataFrame, actual: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows where a declared summary differs from the recomputed one (null-safe, either side missing)."""
    left = declared.select(*keys, *[F.col(m).alias(f"declared_{m}") for m in measures], F.lit(True).alias("__d"))
    right = actual.select(*keys, *[F.col(m).alias(f"actual_{m}") for m in measures], F.lit(True).alias("__a"))
    both = left.join(right, keys, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"declared_{m}").eqNullSafe(F.col(f"actual_{m}")) for m in measures])
    return both.where(~(same & F.col("__d").eqNullSafe(F.col("__a")))).drop("__d", "__a")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column, in one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "null_rows")


def non_finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in columns]))


def border_audit(borders: DataFrame, index: str, start: str, stop: str) -> DataFrame:
    """Half-open borders: zero start, positive spans, each stop equal to the next start. The result's names are fixed values."""
    nxt = borders.select((F.col(index) - 1).alias("__i"), F.col(start).alias("__next"))
    paired = borders.join(nxt, borders[index] == nxt["__i"], "left")
    return paired.agg(
        F.count(F.lit(1)).alias("volume_count"),
        (F.min_by(start, index) == 0).alias("starts_at_zero"),
        F.bool_and(F.col(stop) > F.col(start)).alias("strictly_positive_spans"),
        F.bool_and(F.coalesce(F.col("__next") == F.col(stop), F.lit(True))).alias("contiguous"),
        F.max_by(stop, index).alias("final_exclusive"),
    )


# ---- gates --------------------------------------------------------------------

def check_row(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One-row table of boolean aggregates that fails closed: NULL counts as failed, also on an empty input."""
    return df.agg(*[F.coalesce(column, F.lit(False)).alias(name) for name, column in checks.items()])


def artefact_checks(
    artefact: DataFrame, recomputed: DataFrame, keys: list[str], measures: list[str], rules: dict[str, Column]
) -> DataFrame:
    """One row that re-validates a stored table against its sources, read once each.

    Keys unique, the same keys on both sides, measures equal (null-safe) and each row rule
    true everywhere. Like every gate it fails closed: NULL, and an empty table, do not pass.
    """
    stored = artefact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.min(m).alias(f"__stored_{m}") for m in measures],
        *[F.bool_and(F.coalesce(rule, F.lit(False))).alias(f"__rule_{name}") for name, rule in rules.items()])
    fresh = recomputed.select(*keys, F.lit(True).alias("__fresh"), *[F.col(m).alias(f"__fresh_{m}") for m in measures])
    both = stored.join(fresh, keys, "full_outer")
    equal = [F.col(f"__stored_{m}").eqNullSafe(F.col(f"__fresh_{m}")) for m in measures]
    return check_row(both, {
        "unique_keys": F.bool_and(F.col("__rows") == 1),
        "same_keys": F.bool_and(F.col("__rows").isNotNull() & F.col("__fresh").isNotNull()),
        "same_measures": F.bool_and(reduce(lambda a, b: a & b, equal, F.lit(True))),
        **{name: F.bool_and(F.col(f"__rule_{name}")) for name in rules},
    })


def require_checks(checks: dict[str, bool] | DataFrame, stage: str) -> dict[str, bool]:
    values = checks.first().asDict() if isinstance(checks, DataFrame) else dict(checks)
    failed = [name for name, passed in values.items() if not passed]
    if failed:
        raise GateError(f"{stage} failed: {failed}")
    return {name: bool(passed) for name, passed in values.items()}


def require_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise with a few examples; reads no further than those."""
    examples = violations.take(show)
    if examples:
        raise GateError(f"{what}: {[row.asDict() for row in examples]}")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    require_empty(duplicate_keys(df, keys), f"{what} has duplicate keys {keys}")
    return df


def require_rows(df: DataFrame, expected: int, what: str = "table") -> DataFrame:
    found = df.count()
    if found != expected:
        raise GateError(f"{what} has {found} rows, expected {expected}")
    return df


def require_single_row(df: DataFrame, per: list[str] | None = None, what: str = "table") -> DataFrame:
    """Exactly one row overall, or one per source."""
    if per:
        require_empty(wrong_cardinality(df, per, 1), f"{what} must hold one row per {per}")
    elif len(df.take(2)) != 1:
        raise GateError(f"{what} must hold exactly one row")
    return df


def require_domain(df: DataFrame, column: str, expected: Iterable, what: str = "table") -> DataFrame:
    """The distinct values are exactly the (small, literal) expected set."""
    wanted = list(expected)
    unknown = df.where(~F.col(column).isin(*wanted) | F.col(column).isNull()).select(column)
    require_empty(unknown, f"{what}.{column} outside {wanted}")
    seen = df.agg(*[F.bool_or(F.col(column) == value).alias(f"__v{i}") for i, value in enumerate(wanted)]).first()
    absent = [value for i, value in enumerate(wanted) if not seen[i]]
    if absent:
        raise GateError(f"{what}.{column} never takes {absent}")
    return df


# ---- joins under a declared contract -------------------------------------------

def key_proof(left: DataFrame, right: DataFrame, keys: list[str]) -> dict[str, int]:
    """Most rows of one key on each side, and distinct keys without a partner, from the keys of both.

    A key with a NULL never finds a partner, as in the join itself. Sides already dealt on their keys are not shuffled again.
    """
    seen = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r")), keys, "full_outer")
    met = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    row = seen.agg(
        F.max("__l").alias("left_most"), F.max("__r").alias("right_most"),
        F.count_if(F.col("__l").isNotNull() & ~met).alias("left_alone"), F.count_if(F.col("__r").isNotNull() & ~met).alias("right_alone")).first()
    return {name: row[name] or 0 for name in ("left_most", "right_most", "left_alone", "right_alone")}


def contract_join(
    left: DataFrame, right: DataFrame, keys: list[str], contract: str = "one_to_one", complete: bool = False
) -> DataFrame:
    """Left join that proves its key contract first, so it can neither fan out nor drop rows.

    ``one_to_one`` checks both sides, ``many_to_one`` the right only. ``complete``
    additionally fails when a left row finds no partner. The proof is one job over the keys
    alone; how the join runs is left to Spark. Only a broken contract is looked at again, for examples.
    """
    if contract not in ("one_to_one", "many_to_one"):
        raise ValueError(contract)
    proof = key_proof(left, right, keys)
    if contract == "one_to_one" and proof["left_most"] > 1:
        require_unique(left, keys, "left side")
    if proof["right_most"] > 1:
        require_unique(right, keys, "right side")
    if complete and proof["left_alone"]:
        require_empty(left.select(*keys).join(right.select(*keys), keys, "left_anti"), "left rows without a partner")
    return left.join(right, keys, "left")


def overlay(base: DataFrame, decisions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Replace ``columns`` by the decision table's, after both key sets are proven equal and unique."""
    proof = key_proof(base, decisions, keys)
    if proof["right_most"] > 1:
        require_unique(decisions, keys, "decisions")
    if proof["left_most"] > 1:
        require_unique(base, keys, "base")
    if proof["left_alone"] or proof["right_alone"]:
        require_empty(key_set_difference(base, decisions, keys), "decision keys differ from base keys")
    return base.drop(*columns).join(decisions.select(*keys, *columns), keys, "left")


def stack(frames: list[DataFrame]) -> DataFrame:
    require_same_schema(frames)
    return reduce(lambda a, b: a.unionByName(b), frames)


def exclude(df: DataFrame, ledger: DataFrame, key: str, decision: str | None = "decision") -> DataFrame:
    """Remove ledgered keys; with a decision column only its ``exclude`` rows count."""
    if decision and decision in ledger.columns:
        ledger = ledger.where(F.lower(F.col(decision).cast("string")) == "exclude")
    return df.join(small(ledger.select(key).distinct()), key, "left_anti")


def _batch_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct rows, so that a frequent key is a row a batch and not all its rows."""
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


def keep_mapped(df: DataFrame, mapping: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a mapping, distinct keys without one).

    Distinct keys are found in parts of bounded size, after each batch has dropped its own repeats; a mapping
    too large to broadcast is joined in those parts.
    """
    mapped, asked = mapping.select(*keys), df.select(*keys)
    parts = parts_for(df.sparkSession, df.count() + mapping.count())
    known = small(dealt(mapped.mapInArrow(_batch_distinct, mapped.schema), keys, parts).distinct())
    asked = dealt(asked.mapInArrow(_batch_distinct, asked.schema), keys, parts).distinct()
    return df.join(known, keys, "left_semi"), asked.join(known, keys, "left_anti")
