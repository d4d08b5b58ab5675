"""End-to-end studies: the synthetic demonstration and the grouped ladder analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import contracts as ct
from ..operators import folds as fo
from ..operators import modelling as mo
from ..sources.sinks import write_csv
from ..sources.synthetic import CohortConfig, synthetic_cohort
from .stage import StageStore, fingerprint

# The demonstration's feature sets and models.
LOCATION = ["eccentricity", "angle_sin", "angle_cos"]
STRUCTURE = ["retinal_thickness", "reflectivity", "roughness"]
DEMO_ALPHA = 10.0


def demo_predictions(cohort: DataFrame, n_splits: int = 5, trees: int = 250) -> DataFrame:
    """Out-of-fold predictions of the two ridge models and the forest, participants kept whole."""
    folds = fo.group_kfold(cohort, "participant_id", n_splits)
    names = LOCATION + STRUCTURE
    rows = ct.contract_join(cohort, folds, ["participant_id"], "many_to_one", complete=True).withColumn("x", F.array(*names))
    keys = ["participant_id", "visit", "eye", "point"]
    ridge = [
        mo.Ladder("Location ridge", "ridge", tuple(range(3)), alphas=(DEMO_ALPHA,)),
        mo.Ladder("Structure + location ridge", "ridge", tuple(range(6)), alphas=(DEMO_ALPHA,)),
    ]
    linear = mo.nested_ladder(rows, keys, "participant_id", "fold", "x", "sensitivity_db", len(names), ridge).predictions
    forest = mo.forest_predictions(rows, keys, "participant_id", "fold", "x", "sensitivity_db", trees=trees)
    forest = forest.withColumn("model", F.lit("Structure + location forest"))
    columns = [*keys, "fold", "model", "observed", "predicted"]
    return linear.select(*columns).unionByName(forest.select(*columns))


def demo_metrics(predictions: DataFrame) -> DataFrame:
    metrics = ag.agreement_metrics(predictions, ["model"], unweighted_sd=True)
    return metrics.select("model", "mae", "rmse", "bias", "lower_loa", "upper_loa", "r_squared").orderBy("mae")


def run_demo(spark: SparkSession, output: str, config: CohortConfig = CohortConfig(), trees: int = 250) -> DataFrame:
    predictions = demo_predictions(synthetic_cohort(spark, config), trees=trees)
    metrics = demo_metrics(predictions)
    write_csv(metrics, f"{output}/model_comparison", digits=4, single_file=True, replace=True)
    return metrics


def modelling_table(features: DataFrame, outcome: DataFrame, location: DataFrame, folds: DataFrame, identity: list[str], point: list[str], participant: str) -> DataFrame:
    """Label-blind features, outcome, location and folds under their key contracts."""
    ct.require_label_blind(features)
    table = ct.contract_join(features, outcome, identity, "one_to_one", complete=True)
    table = ct.contract_join(table, location, point, "one_to_one", complete=True)
    table = ct.contract_join(table, folds, [participant], "many_to_one", complete=True)
    ct.require_empty(ct.split_groups(table, participant, "fold"), "participant in two folds")
    return table


def prediction_gate(df: DataFrame, models: int, key: list[str]) -> dict[str, bool]:
    """Every model has one finite prediction per point."""
    points = df.select(*key).distinct().count()
    per = df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("predicted").isNotNull() & ~F.isnan("predicted")).alias("finite"))
    rows = per.collect()  # one row per model
    return {
        "model_count": len(rows) == models, "one_prediction_per_point": all(r["n"] == points for r in rows) and ct.duplicate_keys(df, ["model", *key]).isEmpty(),
        "finite_predictions": all(r["finite"] for r in rows),
    }


def run_ladder(
    store: StageStore, name: str, table: DataFrame, keys: list[str], participant: str, features: int, models: list[mo.Ladder],
    inputs: dict[str, str], strata: dict[str, Column], replicates: int = 5000,
) -> dict[str, DataFrame]:
    """Predictions, overall and stratum metrics with cluster-bootstrap limits, ranking, and descriptive error tables."""
    mark = fingerprint({"stage": name, "models": [repr(m) for m in models], "features": features, "replicates": replicates}, inputs)
    predictions = store.run(
        f"{name}_predictions", mark,
        lambda: mo.nested_ladder(table, keys, participant, "fold", "x", "y", features, models).predictions,
        lambda df: prediction_gate(df, len(models), keys))
    flagged = predictions.join(table.select(*keys, *[c for c in table.columns if c not in predictions.columns and c not in ("x", "y")]), keys)
    overall = store.run(f"{name}_metrics", mark, lambda: ag.cluster_bootstrap(flagged, ["model", "model_position"], participant, replicates))
    by_stratum = store.run(f"{name}_strata", mark, lambda: ag.cluster_bootstrap(flagged, ["model", "model_position"], participant, replicates, strata=strata))
    return {
        "predictions": predictions, "metrics": overall, "strata": by_stratum,
        "ranking": ag.rank_models(overall, "model_position"),
        "participants": ag.agreement_metrics(flagged, ["model", participant], unweighted_sd=True),
        "folds": ag.agreement_metrics(flagged, ["model", "fold"], unweighted_sd=True),
    }
