import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nestgrain.operators import agreement as ag


def direct(o, p, w=None):
    w = np.ones(len(o)) if w is None else w
    n = w.sum()
    d = p - o
    bias = (w @ d) / n
    sd = np.sqrt(max((w @ d**2 - n * bias**2) / max(n - 1, 1), 0))
    root = np.sqrt(w)
    inter, slope = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p]) * root[:, None], o * root, rcond=None)[0]
    sst = w @ (o - (w @ o) / n) ** 2
    return [w @ abs(d) / n, np.sqrt(w @ d**2 / n), bias, bias - 1.96 * sd, bias + 1.96 * sd, inter, slope,
            1 - (w @ d**2) / sst if sst > 1e-12 else None]


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for model in ("a", "b", "const"):
        o = np.round(rng.uniform(-1, 30, 300))
        p = np.full(300, -1.0) if model == "const" else o * 0.8 + rng.normal(3, 2, 300)
        rows.append(pd.DataFrame({"model": model, "who": rng.integers(0, 12, 300), "observed": o, "predicted": p}))
    frame = pd.concat(rows)
    frame["w"] = rng.integers(0, 4, len(frame)).astype(float)
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("weight", [None, "w"])
def test_metrics_equal_direct_formulas(preds, weight):
    frame, df = preds
    got = ag.agreement_metrics(df, ["model"], weight=weight).toPandas().set_index("model")
    for model, part in frame.groupby("model"):
        w = None if weight is None else part.w.to_numpy()
        assert np.allclose(got.loc[model, list(ag.METRICS)].astype(float), direct(part.observed.to_numpy(), part.predicted.to_numpy(), w))


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 2.0, 5.0), ("flat", -1.0, -1.0), ("flat", -1.0, -1.0)], "model string, observed double, predicted double")
    got = ag.agreement_metrics(df, ["model"]).toPandas().set_index("model")
    assert np.isnan(got.loc["flat", "r_squared"])
    assert np.allclose(got.loc["flat", ["calibration_intercept", "calibration_slope"]].astype(float), [-0.5, 0.5])
    assert got.loc["one", "lower_loa"] == got.loc["one", "bias"] == 3.0
    strict = ag.agreement_metrics(df, ["model"], unweighted_sd=True).where("model = 'one'").first()
    assert strict["lower_loa"] is None


def test_published_identities(preds):
    frame, df = preds
    got = ag.agreement_metrics(df, ["model"]).toPandas()
    n = 300
    sd = (got.upper_loa - got.lower_loa) / 3.92
    assert np.allclose(got.rmse**2, got.bias**2 + sd**2 * (n - 1) / n)
    assert (got.rmse >= got.mae).all()
    const = got[got.model == "const"].iloc[0]
    mean = frame[frame.model == "const"].observed.mean()
    assert np.allclose([const.calibration_intercept, const.calibration_slope], [mean / 2, -mean / 2])


def test_overlapping_strata(preds):
    frame, df = preds
    strata = {"low": F.col("observed") < 10, "floor": F.col("observed") == -1, "none": F.col("observed") > 99}
    got = ag.metrics_from_sums(ag.stratum_sums(df, ["model"], strata)).toPandas().set_index(["model", "stratum"])
    assert "none" not in got.index.get_level_values(1)
    part = frame[(frame.model == "a") & (frame.observed < 10)]
    assert np.isclose(got.loc[("a", "low"), "mae"], (part.predicted - part.observed).abs().mean())


def test_bootstrap_equals_direct_replicates(preds):
    import hashlib

    mask = (1 << ag.DRAW_BITS) - 1

    def drawn(model, r, k, n):
        z = (int(hashlib.md5(model.encode()).hexdigest()[:15], 16) + r * ag.DRAW_STEPS["replicate"] + k * ag.DRAW_STEPS["draw"]) & mask
        z = ((z ^ (z >> 31)) * ag.DRAW_STEPS["first"]) & mask
        z = ((z ^ (z >> 29)) * ag.DRAW_STEPS["second"]) & mask
        return (z ^ (z >> 32)) % n

    frame, df = preds
    reps = 60
    got = ag.cluster_bootstrap(df, ["model"], "who", reps).toPandas().set_index("model")
    for model, part in frame.groupby("model"):
        ids = sorted(part.who.unique())
        code = part.who.map({v: i for i, v in enumerate(ids)}).to_numpy()
        rows = []
        for r in range(1, reps + 1):
            draw = [drawn(model, r, k, len(ids)) for k in range(len(ids))]
            w = np.bincount(draw, minlength=len(ids)).astype(float)[code]
            keep = w > 0
            rows.append(direct(part.observed.to_numpy()[keep], part.predicted.to_numpy()[keep], w[keep]))
        rows = np.array(rows, float)
        for j, name in enumerate(ag.METRICS):
            low, high = np.percentile(rows[:, j], [2.5, 97.5])
            assert np.isclose(got.loc[model, f"{name}_ci95_low"], low)
            assert np.isclose(got.loc[model, f"{name}_ci95_high"], high)
    checks = ag.metric_checks(ag.agreement_metrics(df, ["model"])).first()
    assert checks["finite_metrics"] and checks["limits_ordered"]


def test_bootstrap_by_joined_draws(preds, spark):
    """Blocks with more clusters than a task may hold give the same limits."""
    _, df = preds
    strata = {"low": F.col("observed") < 10, "all": F.lit(True)}
    one = ag.cluster_bootstrap(df, ["model"], "who", 40, strata=strata).toPandas().sort_values(["model", "stratum"])
    spark.conf.set("nestgrain.rowsPerTask", "5")
    try:
        two = ag.cluster_bootstrap(df, ["model"], "who", 40, strata=strata).toPandas().sort_values(["model", "stratum"])
    finally:
        spark.conf.unset("nestgrain.rowsPerTask")
    assert len(one) == 6 and one.columns.tolist() == two.columns.tolist()
    assert np.allclose(one.drop(columns=["model", "stratum"]).astype(float), two.drop(columns=["model", "stratum"]).astype(float), equal_nan=True)


def test_draws_are_even():
    seen = np.bincount(ag.drawn_clusters(12345, np.arange(1, 2001), 50).ravel(), minlength=50)
    assert abs(seen / 2000 - 1).max() < 0.12
    assert (ag.drawn_clusters(9, np.array([7]), 1000, 250, 260)[0] == ag.drawn_clusters(9, np.array([7]), 1000)[0][250:260]).all()


def _one_block(n):
    rng = np.random.default_rng(3)
    value = {c: np.floor(rng.uniform(1, 50, n)) if c == "s_n" else rng.normal(100, 10, n) for c in ag.MOMENTS}
    return pa.table({"model": ["a"] * n, "who": rng.permutation(n), **value, "__seed": np.full(n, 77), "__part": np.zeros(n, np.int32)})


def test_a_tasks_draws_are_bounded(monkeypatch):
    """many clusters and replicates are worked off in few draws at a time, and pieces of a replicate give the same."""
    import tracemalloc

    block = _one_block(20_000)
    run = ag._resampled(["model"], "who", 300, 1)
    tracemalloc.start()
    run(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    block = _one_block(500)
    whole = ag._resampled(["model"], "who", 9, 2)(block)
    monkeypatch.setattr(ag, "DRAWS_AT_ONCE", 7)
    pieces = ag._resampled(["model"], "who", 9, 2)(block)
    assert whole.column("__rep").to_pylist() == pieces.column("__rep").to_pylist() == [1, 3, 5, 7, 9]
    for c in ag.MOMENTS:
        assert np.allclose(whole.column(c), pieces.column(c))
    sums = block.sort_by("who")
    for at, rep in enumerate((1, 3, 5, 7, 9)):
        drawn = ag.drawn_clusters(77, np.array([rep]), 500)[0]
        for c, how in (("lo_o", np.min), ("hi_p", np.max)):
            assert pieces.column(c)[at].as_py() == how(sums.column(c).to_numpy()[drawn])
    rare = np.zeros((2, 200), int)
    rare[0, 3], rare[1, 150] = 1, 2
    assert ag._first_drawn(rare, np.arange(200)).tolist() == [3, 150]


def test_groups_of_other_magnitude_and_empty_groups(spark):
    rows = [("a", 1e9 + 2.0 * i + i % 3, 1e9 + i) for i in range(50)] + [("b", 2.0 * i + i % 3, 1.0 * i) for i in range(50)] + [("n", None, 1.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, observed double, predicted double")
    got = {r["model"]: r for r in ag.agreement_metrics(df, ["model"]).collect()}
    weighted = {r["model"]: r for r in ag.agreement_metrics(df.withColumn("w", F.lit(2.0)), ["model"], weight="w").collect()}
    for found in (got, weighted):
        assert np.isclose(found["a"]["calibration_slope"], found["b"]["calibration_slope"], atol=1e-6)
        assert found[None]["bias"] == 1.0
    assert np.isclose(got["a"]["r_squared"], got["b"]["r_squared"], atol=1e-6) and got["n"]["mae"] is None


def test_ranking(preds):
    _, df = preds
    ranked = ag.rank_models(ag.agreement_metrics(df, ["model"]), "model").toPandas().sort_values("mae_rank")
    assert ranked.mae.is_monotonic_increasing and ranked.mae_rank.tolist() == [1, 2, 3]


def test_weighted_means_do_not_shuffle_rows(spark):
    """The means are sent to the rows; the rows of a key do not meet in one task."""
    rows = spark.range(1000).selectExpr("id % 3 AS k", "id * 1.0D AS observed", "id * 1.5D AS predicted", "id % 4 * 1.0D AS w")
    plan = ag.agreement_sums(rows, ["k"], weight="w")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
