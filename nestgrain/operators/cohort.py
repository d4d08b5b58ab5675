"""Cohort construction: manifest reconciliation, admission, freezing, exceptions, review."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_identifier
from ..session import materialise, small
from .contracts import key_set_difference, require_empty, require_unique
from .ordered import first_per_group, rank_within


# ---- rule cascades ---------------------------------------------------------------

def first_reason(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds; a rule that evaluates to NULL does not hold."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def reconcile_manifest(
    manifest: DataFrame, visits: dict[str, tuple[str, str]], functional_only: str,
    duplicates: DataFrame | None = None, key: list[str] | None = None,
) -> DataFrame:
    """Disposition, exclusion reason and case id for every exam row.

    ``visits`` maps a time point to (paired visit name, column prefix); the prefixed
    columns are status, path, n_scans and n_coordinates. Rows at ``functional_only``
    stay for functional analysis only; rows listed in ``duplicates`` are a technical
    cross-visit copy.
    """
    key = key or ["study_id", "eye", "timepoint"]
    df = manifest
    if duplicates is not None:
        df = df.join(small(duplicates.select(*key).distinct().withColumn("is_duplicate", F.lit(True))), key, "left")
    else:
        df = df.withColumn("is_duplicate", F.lit(False))

    def by_visit(column: str) -> Column:
        out = F.lit(None).cast("string")
        for timepoint, (_, prefix) in visits.items():
            out = F.when(F.col("timepoint") == timepoint, F.col(f"{prefix}_{column}")).otherwise(out)
        return out

    name = F.lit(None).cast("string")
    for timepoint, (visit, _) in visits.items():
        name = F.when(F.col("timepoint") == timepoint, F.lit(visit)).otherwise(name)
    df = df.withColumns({
        "visit": name, "scan_status": by_visit("status"), "scan_path": by_visit("path"),
        "n_scans": by_visit("n_scans"), "n_coordinates": by_visit("n_coordinates"),
    })
    unequal = ~F.col("n_scans").eqNullSafe(F.col("n_coordinates"))
    unusable = (F.coalesce(F.col("scan_status"), F.lit("")) != "ready") | ~present(F.coalesce(F.col("scan_path"), F.lit("")))
    reason = first_reason([
        (F.col("timepoint") == functional_only, "no_scan_at_this_visit"),
        (F.col("is_duplicate"), "duplicate_of_other_visit"),
        (F.col("visit").isNull(), "timepoint_outside_design"),
        ((F.col("image_status") != "paired") | ~present(F.coalesce(F.col("image_path"), F.lit(""))), "image_pair_incomplete"),
        (unusable & present(F.col("n_scans")) & present(F.col("n_coordinates")) & unequal, "scan_count_mismatch"),
        (unusable, "no_usable_scan"),
        (unequal, "scan_count_mismatch"),
    ])
    df = df.withColumn("exclusion_reason", reason).withColumn("included", F.col("exclusion_reason").isNull())
    disposition = first_reason([
        (F.col("timepoint") == functional_only, "functional_only"),
        (F.col("is_duplicate"), "cross_visit_only"),
        (F.col("included"), "primary_candidate"),
    ], "excluded")
    identifier = F.when(F.col("included"), case_identifier(F.col("study_id"), F.col("eye"), F.col("timepoint"), F.col("visit")))
    return df.withColumn("disposition", disposition).withColumn("case_id", identifier).drop("is_duplicate")


def admit(candidates: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, rejected rows with the first reason that applies)."""
    marked = candidates.withColumn("reason", first_reason(rules))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def freeze_cohort(
    audits: DataFrame, decisions: DataFrame, key: str, accepted: str, excluded: str, status: str = "completed",
) -> tuple[DataFrame, DataFrame]:
    """(accepted keys, exclusion ledger). Any undecided review row fails closed."""
    require_unique(decisions, [key], "decisions")
    undecided = decisions.where(~F.coalesce(F.col("decision").isin(accepted, excluded), F.lit(False)))
    require_empty(undecided.select(key), "review decisions unresolved")
    completed = audits.where(F.col("processing_status") == status)
    removed = decisions.where(F.col("decision") == excluded)
    ledger = completed.join(small(removed), key)
    return completed.join(small(removed.select(key)), key, "left_anti").select(key), ledger


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    require_empty(key_set_difference(left, right, keys), what)


# ---- exceptions and review --------------------------------------------------------

def exceptions(df: DataFrame, keys: list[str], rules: list[tuple[Column, str, str, Column, str]]) -> DataFrame:
    """One row per violated rule: (condition, issue, severity, observed value, threshold text)."""
    items = [
        F.when(condition, F.struct(
            F.lit(issue).alias("issue"), F.lit(severity).alias("severity"),
            observed.cast("string").alias("observed"), F.lit(threshold).alias("threshold"),
        ))
        for condition, issue, severity, observed, threshold in rules
    ]
    found = df.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("__x"))
    return found.select(*keys, "__x.issue", "__x.severity", "__x.observed", "__x.threshold")


def review_queue(audits: DataFrame, found: DataFrame, key: str, strata: list[str], sample: int = 12) -> DataFrame:
    """Flagged cases with their issue list, plus the first unflagged case of each stratum up to ``sample``.

    Issue names form a fixed short vocabulary, so the collected set is bounded.
    """
    issues = found.groupBy(key).agg(F.concat_ws("|", F.array_sort(F.collect_set("issue"))).alias("issues"))
    flagged = audits.join(issues, key).select(*audits.columns, F.lit("flagged").alias("review_reason"), "issues")
    quiet = audits.where(F.col("processing_status") == "completed").join(issues.select(key), key, "left_anti")
    first = first_per_group(quiet, strata, [key]).orderBy(key).limit(sample)
    return flagged.unionByName(first.select(*audits.columns, F.lit("unflagged_sample").alias("review_reason"), F.lit("").alias("issues")))


def review_scans(volumes: DataFrame, scans: DataFrame, group: str, narrow: Column, score: str, index: str, count: int, target: int = 24) -> DataFrame:
    """Volumes worth a look and, in each, the scan nearest to index ``target``.

    Narrow volumes come first, then the three lowest and two highest scores, then
    volumes evenly spaced in ``group`` order. The first reason that lists a volume
    counts, and the first ``count`` volumes are kept. Ties go to the smaller key.
    """
    ranked = materialise(rank_within(volumes, [], [group], "__at"))
    total = ranked.count()
    spaced = [(int(at), k) for k, at in enumerate(np.linspace(0, max(total - 1, 0), count, dtype=int))]
    places = ranked.sparkSession.createDataFrame(spaced, "__pos bigint, __k bigint")

    def listed(df: DataFrame, step: int, order: Column) -> DataFrame:
        return df.select(*volumes.columns, F.struct(F.lit(step).alias("step"), order.cast("double").alias("at")).alias("__p"))

    # scores ascend within each block; equal scores keep group order
    low = ranked.orderBy(score, group).limit(3)
    high = ranked.orderBy(F.col(score).desc(), F.col(group).desc()).limit(2)
    even = ranked.join(F.broadcast(places), F.col("__at") - 1 == F.col("__pos"))
    candidates = (
        listed(ranked.where(narrow), 0, F.col("__at")).unionByName(listed(low, 1, F.col(score)))
        .unionByName(listed(high, 2, F.col(score))).unionByName(listed(even, 3, F.col("__k"))))
    once = candidates.groupBy(*volumes.columns).agg(F.min("__p").alias("__p"))
    kept = once.orderBy("__p", group).limit(count)
    nearest = scans.join(F.broadcast(kept.select(group)), group, "left_semi").groupBy(group).agg(
        F.min_by(F.col(index), F.struct(F.abs(F.col(index) - target), F.col(index))).alias(index))
    return kept.drop("__p").join(nearest, group)


# ---- expected sources ---------------------------------------------------------------

def source_audit(cases: DataFrame, key: str, templates: dict[str, Column], listing: DataFrame, path: str = "path") -> DataFrame:
    """One row per expected source of a case with whether the listing holds it."""
    expected = cases.select(key, F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), template.alias("path")) for role, template in templates.items()
    ])).alias("__e")).select(key, "__e.role", F.col("__e.path").alias("path"))
    known = listing.select(F.col(path).alias("path")).distinct().withColumn("exists", F.lit(True))
    return expected.join(known, "path", "left").select(key, "role", "path", F.coalesce("exists", F.lit(False)).alias("exists"))


# ---- point identity -----------------------------------------------------------------

def signature_groups(labels: DataFrame, point: str, case: str, value: str) -> DataFrame:
    """Points whose (case -> value) maps are identical, with the smallest such point.

    Maps are compared through two independent 64-bit sums over their entries rather
    than by collecting them, so a point with any number of cases costs one row. Each
    candidate group is then verified entry by entry against its representative; a
    point that fails that check stands alone.
    """
    entry = F.struct(F.col(case), F.col(value))
    prints = labels.groupBy(point).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(F.xxhash64(entry).cast("decimal(38,0)")).alias("__a"),
        F.sum(F.xxhash64(F.lit("salt"), entry).cast("decimal(38,0)")).alias("__b"),
    )
    heads = prints.groupBy("__n", "__a", "__b").agg(F.min(point).alias("representative"), F.count(F.lit(1)).alias("__size"))
    matched = prints.join(heads, ["__n", "__a", "__b"]).select(point, "representative", "__size", "__n")
    # only groups of two or more need proof
    shared = matched.where(F.col("__size") > 1)
    mine = labels.join(shared, point).select(F.col(point).alias("__p"), "representative", "__n", F.col(case).alias("__c"), F.col(value).alias("__v"))
    theirs = labels.join(heads.where(F.col("__size") > 1).select(F.col("representative").alias(point)), point, "left_semi").select(
        F.col(point).alias("representative"), F.col(case).alias("__c"), F.col(value).alias("__w"))
    agree = mine.join(theirs, ["representative", "__c"]).where(F.col("__v").eqNullSafe(F.col("__w")))
    proven = agree.groupBy("__p", "representative", "__n").agg(F.count(F.lit(1)).alias("__same")).where(F.col("__same") == F.col("__n"))
    settled = matched.join(proven.select(F.col("__p").alias(point), F.lit(True).alias("__ok")), point, "left")
    final = settled.select(point, F.when(F.col("__ok"), F.col("representative")).otherwise(F.col(point)).alias("representative"))
    sizes = final.groupBy("representative").agg(F.count(F.lit(1)).alias("group_size"))
    return final.join(sizes, "representative").select(point, "representative", "group_size")


def residual_value(observed: DataFrame, labels: DataFrame, case: str, value: str) -> DataFrame:
    """Per case, the one label left over after removing the observed multiset, when exactly one is."""
    sides = labels.groupBy(case, value).agg(F.count(F.lit(1)).alias("__n")).unionByName(
        observed.groupBy(case, value).agg((-F.count(F.lit(1))).alias("__n")))
    left = sides.groupBy(case, value).agg(F.sum("__n").alias("__n"))
    per = left.groupBy(case).agg(
        F.sum(F.greatest("__n", F.lit(0))).alias("remaining"), F.sum(F.greatest(-F.col("__n"), F.lit(0))).alias("excess"),
        F.max(F.when(F.col("__n") > 0, F.col(value))).alias("__v"))
    ok = (F.col("remaining") == 1) & (F.col("excess") == 0)
    return per.select(case, "remaining", "excess", F.when(ok, F.col("__v")).alias("centre_value"), ok.alias("recovered"))
