import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": np.where(rng.random(600) < 0.5, 0, rng.integers(1, 40, 600)), "id": np.arange(600)})
    frame["x"] = rng.integers(0, 50, 600).astype(float)
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("forced", [False, True])
def test_rank_sum_lag(spark, skewed, forced, request):
    if forced:
        request.getfixturevalue("tiny_tasks")
    frame, df = skewed
    ranked = ordered.rank_within(df, ["g"], ["x", "id"], "r")
    summed = ordered.running_sum(ranked, ["g"], ["x", "id"], "x", "s")
    got = ordered.previous_value(summed, ["g"], ["x", "id"], "x", "p").toPandas().sort_values(["g", "x", "id"])
    want = frame.sort_values(["g", "x", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    grouped = want.groupby("g")
    assert got["r"].tolist() == (grouped.cumcount() + 1).tolist()
    assert got["s"].tolist() == grouped["x"].cumsum().tolist()
    assert got["p"].fillna(-1).tolist() == grouped["x"].shift().fillna(-1).tolist()
    overall = ordered.rank_within(df, [], ["id"], "r").where("r != id + 1").count()
    assert overall == 0


@pytest.mark.parametrize("forced", [False, True])
def test_percentiles_match_numpy(spark, skewed, forced, request):
    if forced:
        request.getfixturevalue("tiny_tasks")
    frame, df = skewed
    holes = df.withColumn("x", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("x")))
    got = ordered.exact_percentiles(holes, ["g"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).toPandas().set_index("g")
    for g, part in frame[frame.id % 7 != 0].groupby("g"):
        assert np.allclose(got.loc[g], np.percentile(part.x, [10, 50, 90]))
    one = ordered.exact_percentiles(df, [], "x", {"m": 0.5}).first()["m"]
    assert one == np.median(frame.x)


def test_evenly_spaced_and_first(spark, skewed):
    frame, df = skewed
    got = ordered.evenly_spaced(df, ["g"], ["id"], 5).toPandas()
    for g, part in frame.groupby("g"):
        at = np.rint(np.linspace(0, len(part) - 1, 5)).astype(int)
        assert got[got.g == g].sort_values("pick").id.tolist() == part.id.iloc[at].tolist()
    first = ordered.first_per_group(df, ["g"], ["x", "id"]).toPandas().set_index("g")
    want = frame.sort_values(["x", "id"]).groupby("g").first()
    assert first.sort_index().id.tolist() == want.id.tolist()
