import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.operators.contracts import GateError
from nestgrain.operators.modelling import Ladder
from nestgrain.plans import studies
from nestgrain.plans.stage import StageStore
from nestgrain.sources.synthetic import CohortConfig, synthetic_cohort


def test_cohort_is_seeded_and_shaped(spark):
    a = synthetic_cohort(spark, CohortConfig(participants=6)).orderBy("participant_id", "visit", "eye", "point").toPandas()
    b = synthetic_cohort(spark, CohortConfig(participants=6)).repartition(3).orderBy("participant_id", "visit", "eye", "point").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 6 * 2 * 2 * 37 and a.participant_id.iloc[0] == "SYN-001" and set(a.visit) == {"V1", "V2"}
    assert a.sensitivity_db.between(-1, 30).all() and not a.sensitivity_db.between(-0.999, 0.999).any()
    one = a[(a.participant_id == "SYN-001") & (a.visit == "V1") & (a.eye == "L")]
    assert np.allclose(np.sort(one.eccentricity), np.linspace(0.05, 1, 37)) and not one.eccentricity.is_monotonic_increasing
    assert not a.equals(synthetic_cohort(spark, CohortConfig(participants=6, seed=1)).orderBy("participant_id", "visit", "eye", "point").toPandas())


def test_demo(spark, tmp_path):
    cohort = synthetic_cohort(spark, CohortConfig(participants=10))
    predictions = studies.demo_predictions(cohort, trees=5).cache()
    assert predictions.count() == cohort.count() * 3
    assert predictions.groupBy("participant_id").agg(F.countDistinct("fold").alias("n")).where("n <> 1").isEmpty()
    metrics = studies.demo_metrics(predictions).toPandas()
    assert len(metrics) == 3 and (metrics.mae >= 0).all() and (metrics.rmse >= metrics.mae).all() and metrics.mae.is_monotonic_increasing


def test_ladder_study(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 120
    frame = pd.DataFrame({"case_id": np.arange(n) // 4, "point": np.arange(n) % 4, "who": (np.arange(n) // 4) % 11})
    frame["fold"], frame["visit"] = frame.who % 5 + 1, np.where(frame.case_id % 2 == 0, "BL", "Y01")
    frame["y"] = rng.normal(10, 3, n)
    frame["x"] = [list(map(float, r)) for r in rng.normal(size=(n, 3)) + frame.y.to_numpy()[:, None] * 0.2]
    table = spark.createDataFrame(frame)
    models = [Ladder("null", "mean"), Ladder("ridge", "ridge", (0, 1, 2), alphas=(0.1, 10.0))]
    store = StageStore(spark, tmp_path / "run")
    strata = {"baseline": F.col("visit") == "BL", "later": F.col("visit") == "Y01"}
    out = studies.run_ladder(store, "main", table, ["case_id", "point"], "who", 3, models, {"table": "v1"}, strata, replicates=50)
    assert out["ranking"].where("mae_rank = 1").first()["model"] == "ridge"
    assert out["strata"].count() == 4 and out["participants"].count() == 22 and out["folds"].count() == 10
    m = out["metrics"].toPandas()
    assert (m.mae_ci95_low <= m.mae).all() and (m.mae <= m.mae_ci95_high).all()
    again = StageStore(spark, tmp_path / "run")
    studies.run_ladder(again, "main", table, ["case_id", "point"], "who", 3, models, {"table": "v1"}, strata, replicates=50)
    assert {r["action"] for r in again.records} == {"reused"}


def test_modelling_table_contracts(spark):
    ids = [("s1", "c1", 1), ("s1", "c1", 2), ("s2", "c2", 1)]
    features = spark.createDataFrame([(*i, 0.5) for i in ids], "study_id string, case_id string, point int, b double")
    outcome = spark.createDataFrame([(*i, 20.0) for i in ids], "study_id string, case_id string, point int, sensitivity_db double")
    location = spark.createDataFrame([(c, p, 0.1) for _, c, p in ids], "case_id string, point int, ecc double")
    folds = spark.createDataFrame([("s1", 1), ("s2", 2)], "study_id string, fold int")
    identity, point = ["study_id", "case_id", "point"], ["case_id", "point"]
    assert studies.modelling_table(features, outcome, location, folds, identity, point, "study_id").count() == 3
    with pytest.raises(GateError):
        studies.modelling_table(outcome, outcome, location, folds, identity, point, "study_id")
    with pytest.raises(GateError):
        studies.modelling_table(features, outcome.union(outcome), location, folds, identity, point, "study_id")
    with pytest.raises(GateError):
        studies.modelling_table(features, outcome, location, folds.limit(1), identity, point, "study_id")
