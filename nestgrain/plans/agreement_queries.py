"""Registered queries: metrics, strata, ranking, bootstrap and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import stable
from ..operators import agreement as ag
from .common import (
    PREDICTIONS_SQL, metric_sql, metrics_select, predictions, rounded, sql_stable, sums_sql, table, whole,
)

M = list(ag.METRICS)
REPLICATES = 5000


def visit_strata():
    return {
        "open_visit": F.col("visit") == "O", "final_visit": F.col("visit") == "F",
        "floor": F.col("floor_flag"), "above_floor": ~F.col("floor_flag"),
    }


VISIT_STRATA_SQL = {
    "open_visit": "visit = 'O'", "final_visit": "visit = 'F'", "floor": "floor_flag", "above_floor": "NOT floor_flag",
}


def value_strata():
    o = F.col("observed")
    return {
        "floor": F.col("floor_flag"), "above_floor": ~F.col("floor_flag"),
        "below_20000": (o > -1) & (o < 20000), "from_20000_to_60000": (o >= 20000) & (o < 60000), "from_60000": o >= 60000,
    }


VALUE_STRATA_SQL = {
    "floor": "floor_flag", "above_floor": "NOT floor_flag", "below_20000": "observed > -1 AND observed < 20000",
    "from_20000_to_60000": "observed >= 20000 AND observed < 60000", "from_60000": "observed >= 60000",
}


def _strata_sql(strata: dict[str, str], unweighted_sd: bool) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS stratum, p.* FROM predictions p WHERE {cond}" for name, cond in strata.items()
    )
    body = metrics_select("model, stratum", sums_sql("s", "model, stratum"), M, 4, unweighted_sd)
    return f"WITH {PREDICTIONS_SQL}, s AS ({union}) {body}"


def metric_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    ranked = ag.rank_models(ag.agreement_metrics(p, ["model"]), "model")
    return rounded(ranked, ["mae_rank", "model"], M)


METRIC_SUMMARY_SQL = f"""WITH {PREDICTIONS_SQL},
raw AS (SELECT row_number() OVER (ORDER BY s_a / s_n, model) AS mae_rank, * FROM ({sums_sql('predictions', 'model')}))
{metrics_select('mae_rank, model', 'SELECT * FROM raw', M)}"""


def metric_low_spread(spark, sf_dir):
    """Values that vary by a few units around a million: calibration and R squared must not lose them."""
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_quantity") * 2 + F.col("l_discount") + 1e6).alias("observed"), (F.col("l_quantity") + 1e6).alias("predicted"))
    return rounded(ag.agreement_metrics(p, ["model"]), ["model"], M[5:], 3)


METRIC_LOW_SPREAD_SQL = f"""WITH p AS (
  SELECT l_returnflag AS model, l_quantity * 2 + l_discount AS o, l_quantity AS p FROM lineitem)
SELECT model, {sql_stable('1e6 + regr_intercept(o, p) - regr_slope(o, p) * 1e6', 3)} AS calibration_intercept,
  {sql_stable('regr_slope(o, p)', 3)} AS calibration_slope,
  {sql_stable('1 - sum((p - o) * (p - o)) / (var_pop(o) * count(*))', 3)} AS r_squared FROM p GROUP BY model"""


def metric_mixed_scale(spark, sf_dir):
    """One signal around 0, a million and a billion: no group may cost another its digits."""
    level = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1e6).otherwise(1e9)
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("visit"),
        (level + F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("observed"), (level + F.col("l_quantity")).alias("predicted"))
    strata = ag.stratum_sums(p, ["model"], {"all": F.lit(True), "open": F.col("visit") == "O"})
    names = ["mae", "rmse", "bias", "lower_loa", "calibration_slope", "r_squared"]
    return rounded(ag.metrics_from_sums(strata), ["model", "stratum"], names, 3)


METRIC_MIXED_SCALE_SQL = f"""WITH l AS (
  SELECT l_returnflag AS model, l_linestatus AS visit, l_quantity * 2 + l_linenumber AS o, l_quantity AS p FROM lineitem),
s AS (SELECT 'all' AS stratum, * FROM l UNION ALL SELECT 'open', * FROM l WHERE visit = 'O')
SELECT model, stratum, {sql_stable('avg(abs(p - o))', 3)} AS mae, {sql_stable('sqrt(avg((p - o) * (p - o)))', 3)} AS rmse, {sql_stable('avg(p - o)', 3)} AS bias,
  {sql_stable('avg(p - o) - 1.96 * stddev_samp(p - o)', 3)} AS lower_loa, {sql_stable('regr_slope(o, p)', 3)} AS calibration_slope,
  {sql_stable('1 - sum((p - o) * (p - o)) / (var_pop(o) * count(*))', 3)} AS r_squared FROM s GROUP BY model, stratum"""


def metric_strata(spark, sf_dir):
    sums = ag.stratum_sums(predictions(spark, sf_dir), ["model"], visit_strata())
    return rounded(ag.metrics_from_sums(sums), ["model", "stratum"], M)


def sensitivity_strata(spark, sf_dir):
    sums = ag.stratum_sums(predictions(spark, sf_dir), ["model"], value_strata())
    return rounded(ag.metrics_from_sums(sums, unweighted_sd=True), ["model", "stratum"], M)


def participant_errors(spark, sf_dir):
    metrics = ag.agreement_metrics(predictions(spark, sf_dir), ["model", "participant"], unweighted_sd=True)
    return rounded(metrics, ["model", "participant"], M[:5])


def fold_errors(spark, sf_dir):
    metrics = ag.agreement_metrics(predictions(spark, sf_dir), ["model", "fold"], unweighted_sd=True)
    return rounded(metrics, ["model", "fold"], M[:5])


def weighted_metrics(spark, sf_dir):
    weighted = predictions(spark, sf_dir).withColumn("w", (F.col("point") - 1).cast("double"))
    return rounded(ag.agreement_metrics(weighted, ["model"], weight="w"), ["model"], M)


def calibration_degenerate(spark, sf_dir):
    flat = predictions(spark, sf_dir).withColumn("predicted", F.lit(-1.0))
    return rounded(ag.agreement_metrics(flat, ["model"]), ["model"], M)


def metric_checks(spark, sf_dir):
    return ag.metric_checks(ag.agreement_metrics(predictions(spark, sf_dir), ["model"]))


_VALUES = metric_sql()
METRIC_CHECKS_SQL = f"""WITH {PREDICTIONS_SQL}, m AS (
SELECT {', '.join(f'{_VALUES[n]} AS {n}' for n in M)} FROM ({sums_sql('predictions', 'model')}))
SELECT bool_and(mae IS NOT NULL AND rmse IS NOT NULL AND bias IS NOT NULL AND lower_loa IS NOT NULL AND upper_loa IS NOT NULL
  AND NOT isnan(mae) AND NOT isnan(rmse) AND NOT isnan(bias) AND NOT isnan(lower_loa) AND NOT isnan(upper_loa)) AS finite_metrics,
  bool_and(lower_loa <= bias AND bias <= upper_loa) AS limits_ordered FROM m"""


def _with_limits(spark, sf_dir, strata=None):
    return ag.cluster_bootstrap(predictions(spark, sf_dir), ["model"], "participant", REPLICATES, strata=strata)


_LIMITS = [f"{m}_ci95_{side}" for m in M for side in ("low", "high")]


def bootstrap_ci(spark, sf_dir):
    out = _with_limits(spark, sf_dir)
    return rounded(out, ["model", "n_clusters", "n_points"], [*M, *_LIMITS])


def bootstrap_strata_ci(spark, sf_dir):
    out = _with_limits(spark, sf_dir, visit_strata())
    return rounded(out, ["model", "stratum", "n_clusters", "n_points"], [*M, *_LIMITS])


def ci_half_widths(spark, sf_dir):
    out = ag.interval_half_widths(_with_limits(spark, sf_dir))
    return rounded(out, ["model"], ["mae", "half_below", "half_above"])


def _bootstrap_sql(keys: list[str], source: str, final: str) -> str:
    """Same draws, sums and percentile limits in SQL; ``final`` reads CTEs points and limits."""
    plain = ", ".join(keys)
    label = " || '|' || ".join(keys)
    values = metric_sql()
    select_metrics = ", ".join(f"{values[m]} AS {m}" for m in M)
    sums = ", ".join(f"sum({s}) AS {s}" for s in ("s_n", "s_a", "s_d", "s_dd", "s_o", "s_oo", "s_p", "s_pp", "s_op"))
    sums += ", min(lo_o) AS lo_o, max(hi_o) AS hi_o, min(lo_p) AS lo_p, max(hi_p) AS hi_p"
    mask, step = (1 << ag.DRAW_BITS) - 1, ag.DRAW_STEPS
    limits = ", ".join(
        f"quantile_cont({m}, {q}) AS {m}_ci95_{side}" for m in M for side, q in (("low", 0.025), ("high", 0.975))
    )
    return f"""WITH {PREDICTIONS_SQL}, src AS ({source}),
clusters AS (SELECT *, row_number() OVER (PARTITION BY {plain} ORDER BY participant) - 1 AS i
  FROM ({sums_sql('src', plain + ', participant')})),
sizes AS (SELECT {plain}, count(*) AS p FROM clusters GROUP BY ALL),
mixed AS (SELECT {plain}, p, rep, (('0x' || substr(md5({label}), 1, 15))::HUGEINT + rep * {step['replicate']}::HUGEINT + k * {step['draw']}::HUGEINT) & {mask}::HUGEINT AS z
  FROM (SELECT *, unnest(range(0, p)) AS k FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS rep FROM sizes))),
once AS (SELECT * REPLACE ((xor(z, z >> 31) * {step['first']}::HUGEINT) & {mask}::HUGEINT AS z) FROM mixed),
twice AS (SELECT * REPLACE ((xor(z, z >> 29) * {step['second']}::HUGEINT) & {mask}::HUGEINT AS z) FROM once),
draws AS (SELECT {plain}, rep, CAST(xor(z, z >> 32) % p AS BIGINT) AS i FROM twice),
reps AS (SELECT {plain}, rep, {sums} FROM draws JOIN clusters USING ({plain}, i) GROUP BY {plain}, rep),
limits AS (SELECT {plain}, {limits} FROM (SELECT {plain}, rep, {select_metrics} FROM reps) GROUP BY {plain}),
points AS (SELECT {plain}, count(*) AS n_clusters, CAST(sum(s_n) AS BIGINT) AS n_points, {sums} FROM clusters GROUP BY {plain})
{final}"""


def _bootstrap_final(keys: list[str]) -> str:
    values, plain = metric_sql(), ", ".join(keys)
    points = ", ".join(f"{sql_stable(values[m])} AS {m}" for m in M)
    limits = ", ".join(f"{sql_stable(name)} AS {name}" for name in _LIMITS)
    return f"SELECT {plain}, n_clusters, n_points, {points}, {limits} FROM points JOIN limits USING ({plain})"


_STRATA_SOURCE = " UNION ALL ".join(
    f"SELECT '{name}' AS stratum, p.* FROM predictions p WHERE {cond}" for name, cond in VISIT_STRATA_SQL.items()
)
_MAE = metric_sql()["mae"]
_HALF = f"""SELECT model, {sql_stable(_MAE)} AS mae, {sql_stable(f'{_MAE} - mae_ci95_low')} AS half_below,
{sql_stable(f'mae_ci95_high - {_MAE}')} AS half_above FROM points JOIN limits USING (model)"""


def out_of_range_flags(spark, sf_dir):
    p = predictions(spark, sf_dir)
    flagged = p.select(
        "model", (F.col("predicted") < 3000).alias("below_low"), (F.col("predicted") > 70000).alias("above_high")
    )
    return flagged.groupBy("model", "below_low", "above_high").agg(F.count(F.lit(1)).alias("n"))


def hexbin_counts(spark, sf_dir):
    return ag.grid_counts(predictions(spark, sf_dir), ["model"], "observed", "predicted", 5000.0, 5000.0)


def bland_altman_points(spark, sf_dir):
    points = ag.bland_altman_points(predictions(spark, sf_dir), ["model", "case_id", "point"])
    return rounded(points, ["model", "case_id", "point"], ["mean_value", "difference"])


def residual_points(spark, sf_dir):
    points = ag.residual_points(predictions(spark, sf_dir), ["model", "case_id", "point"])
    return rounded(points, ["model", "case_id", "point"], ["observed", "residual"])


def value_histogram(spark, sf_dir):
    return ag.histogram(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 1.0, -0.5)


def best_model_rows(spark, sf_dir):
    p = predictions(spark, sf_dir)
    best = ag.best_model_rows(p, ag.agreement_metrics(p, ["model"]), "model")
    return rounded(best, ["model", "case_id", "point"], ["observed", "predicted"])


def models_first_seen(spark, sf_dir):
    seen = ag.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")
    return seen.select("event_type", whole(F.col("first_position")).alias("first_position"))


def group_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    grouped = e.groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return grouped.select("l_suppkey", stable(F.col("r"), 6).alias("r"))


def circular_phase(spark, sf_dir):
    from ..functions.numeric import circular_phase as phase

    p = table(spark, sf_dir, "lineitem").withColumn("theta", F.col("l_quantity") * F.col("l_linenumber") * 0.01)
    return p.groupBy("l_suppkey").agg(stable(phase(F.col("theta")), 6).alias("phase"))


QUERIES = {
    "metric_mixed_scale": (metric_mixed_scale, METRIC_MIXED_SCALE_SQL),
    "metric_low_spread": (metric_low_spread, METRIC_LOW_SPREAD_SQL),
    "metric_summary": (metric_summary, METRIC_SUMMARY_SQL),
    "metric_strata": (metric_strata, _strata_sql(VISIT_STRATA_SQL, False)),
    "sensitivity_strata": (sensitivity_strata, _strata_sql(VALUE_STRATA_SQL, True)),
    "participant_errors": (
        participant_errors,
        f"WITH {PREDICTIONS_SQL} {metrics_select('model, participant', sums_sql('predictions', 'model, participant'), M[:5], 4, True)}",
    ),
    "fold_errors": (
        fold_errors,
        f"WITH {PREDICTIONS_SQL} {metrics_select('model, fold', sums_sql('predictions', 'model, fold'), M[:5], 4, True)}",
    ),
    "weighted_metrics": (
        weighted_metrics,
        f"WITH {PREDICTIONS_SQL} {metrics_select('model', sums_sql('predictions', 'model', '(point - 1)::DOUBLE', 'point > 1'), M)}",
    ),
    "calibration_degenerate": (
        calibration_degenerate,
        f"WITH {PREDICTIONS_SQL}, flat AS (SELECT * REPLACE (-1.0::DOUBLE AS predicted) FROM predictions) "
        + metrics_select("model", sums_sql("flat", "model"), M),
    ),
    "metric_checks": (metric_checks, METRIC_CHECKS_SQL),
    "bootstrap_ci": (bootstrap_ci, _bootstrap_sql(["model"], "SELECT * FROM predictions", _bootstrap_final(["model"]))),
    "bootstrap_strata_ci": (
        bootstrap_strata_ci, _bootstrap_sql(["model", "stratum"], _STRATA_SOURCE, _bootstrap_final(["model", "stratum"]))),
    "ci_half_widths": (ci_half_widths, _bootstrap_sql(["model"], "SELECT * FROM predictions", _HALF)),
    "out_of_range_flags": (out_of_range_flags, f"""WITH {PREDICTIONS_SQL}
        SELECT model, predicted < 3000 AS below_low, predicted > 70000 AS above_high, count(*) AS n FROM predictions GROUP BY ALL"""),
    "hexbin_counts": (hexbin_counts, f"""WITH {PREDICTIONS_SQL}
        SELECT model, floor(observed / 5000)::BIGINT AS x_bin, floor(predicted / 5000)::BIGINT AS y_bin, count(*) AS n
        FROM predictions GROUP BY ALL"""),
    "bland_altman_points": (bland_altman_points, f"""WITH {PREDICTIONS_SQL}
        SELECT model, case_id, point, {sql_stable('(observed + predicted) / 2')} AS mean_value,
               {sql_stable('predicted - observed')} AS difference FROM predictions"""),
    "residual_points": (residual_points, f"""WITH {PREDICTIONS_SQL}
        SELECT model, case_id, point, {sql_stable('observed')} AS observed, {sql_stable('predicted - observed')} AS residual
        FROM predictions"""),
    "value_histogram": (value_histogram, """
        SELECT floor(v + 0.5)::BIGINT AS bin, count(*) AS n
        FROM (SELECT min(value) AS v FROM events GROUP BY user_id, event_type) GROUP BY 1"""),
    "best_model_rows": (best_model_rows, f"""WITH {PREDICTIONS_SQL},
        best AS (SELECT model FROM predictions GROUP BY model ORDER BY avg(abs(predicted - observed)), model LIMIT 1)
        SELECT model, case_id, point, {sql_stable('observed')} AS observed, {sql_stable('predicted')} AS predicted
        FROM predictions SEMI JOIN best USING (model)"""),
    "models_first_seen": (models_first_seen, "SELECT event_type, min(event_id) AS first_position FROM events GROUP BY 1"),
    "group_correlation": (group_correlation, f"""
        SELECT l_suppkey, {sql_stable('corr(l_quantity, l_extendedprice)', 6)} AS r FROM lineitem GROUP BY 1"""),
    "circular_phase": (circular_phase, f"""
        SELECT l_suppkey, {sql_stable('atan2(avg(sin(12 * t)), avg(cos(12 * t))) / 12', 6)} AS phase
        FROM (SELECT l_suppkey, l_quantity * l_linenumber * 0.01 AS t FROM lineitem) GROUP BY 1"""),
}
