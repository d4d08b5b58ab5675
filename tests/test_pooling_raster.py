import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.functions import arrays as ar
from nestgrain.operators import contracts as ct, geometry as ge, pooling as po, raster as ra


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = [(c, p, s, k, float(rng.normal(p, 2))) for c in range(3) for p in range(2) for s in range(3) for k in range(rng.integers(1, 7))]
    frame = pd.DataFrame(rows, columns=["case_id", "point", "scan", "k", "f"])
    return frame, spark.createDataFrame(frame)


def test_two_level_pool(samples):
    frame, df = samples
    got = po.two_level_pool(df, ["case_id", "point"], "scan", ["f"]).toPandas().set_index(["case_id", "point"]).sort_index()
    scans = frame.groupby(["case_id", "point", "scan"]).f
    means, sds = scans.mean(), scans.std(ddof=0)
    level = ["case_id", "point"]
    assert np.allclose(got.f__mean, means.groupby(level=level).mean())
    assert np.allclose(got.f__between_sd, means.groupby(level=level).std(ddof=0))
    assert np.allclose(got.f__within_sd, sds.groupby(level=level).mean())


def test_pool_features_contract(spark, samples):
    frame, df = samples
    key = ["case_id", "point", "scan", "k"]
    manifest, features = df.select(*key), df
    assert po.pool_features(manifest, features, key, ["case_id", "point"], "scan", key, 3).count() == 6
    with pytest.raises(ct.GateError):
        po.pool_features(manifest, features.withColumnRenamed("f", "sensitivity"), key, ["case_id", "point"], "scan", key)
    with pytest.raises(ct.GateError):
        po.pool_features(manifest, features.where("k > 0"), key, ["case_id", "point"], "scan", key)
    with pytest.raises(ct.GateError):
        po.pool_features(manifest, features, key, ["case_id", "point"], "scan", key, 4)


def test_masked_summary_all_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in po.masked_summary(df, ["g"], "x", "x").collect()}
    assert (got["a"]["x_valid_count"], got["a"]["x_total_count"], got["a"]["x_median"], got["a"]["x_p10"]) == (2, 3, 2.5, 1.3)
    assert got["b"]["x_valid_count"] == 0 and got["b"]["x_mean"] is None and got["b"]["x_median"] is None
    points = po.boundary_points(df.withColumn("s", F.lit(1)), ["g"], "s", ["x"]).toPandas().set_index("g")
    assert points.loc["a", "x_between_scan_mean_sd"] == 0 and np.isnan(points.loc["b", "x_between_scan_mean_sd"])


def test_interval_masks(spark):
    rows = [([1.0, 2.0, 2.0, 5.0, 9.0],), ([1.0, -1.0, 3.0, 4.0, 5.0],), ([1.0, 4.0, 3.0, 5.0, 6.0],), ([1.0, None, 3.0, 4.0, 99.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    t, r = po.interval_thickness(F.col("v"), F.lit(10.0), F.lit(50.0))
    got = [tuple(x) for x in df.select(t.alias("t"), r.alias("r")).collect()]
    bad = "negative_or_missing_boundary_sentinel"
    assert got == [([10.0, 0.0, 30.0, 40.0], ""), ([None, None, 10.0, 10.0], bad), ([30.0, None, 20.0, 10.0], "locally_crossed_boundary_pair"), ([None, None, 10.0, None], bad)]


def test_vector_pools(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2, 3, 5, 4))
    rows = [(u, s, [float(x) for x in v[u, s, k]]) for u in range(2) for s in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, "u int, s int, e array<double>")
    got = po.three_level_vector_pool(df, ["u"], "s", "e").orderBy("u").toPandas().representation
    scan = v.mean(2)
    want = np.concatenate([scan.mean(1), scan.std(1), v.std(2).mean(1)], axis=1)
    assert np.allclose(np.vstack(got), want)
    flat = v.reshape(2, 15, 4)
    got = po.vector_pool(df, ["u"], "e").orderBy("u").toPandas().representation
    assert np.allclose(np.vstack(got), np.concatenate([flat.mean(1), flat.std(1)], axis=1))
    row = po.reproduces(df.where("s = 0 and u = 0").limit(1), df.where("s = 0 and u = 0").limit(1), ["u", "s"], "e").first()
    assert row["within_tolerance"] and row["max_abs_difference"] == 0


def test_wide_vectors_and_null_units(spark, monkeypatch):
    """3,072 elements as one state a unit, early hand-on included; a NULL unit is a unit."""
    monkeypatch.setattr(po, "STATE_BYTES", 1)
    v = np.random.default_rng(1).normal(1e6, 1, size=(20, 3072))
    df = spark.createDataFrame([(None if k % 3 == 0 else "b", k, v[k].tolist()) for k in range(20)] + [("b", 99, None)], "u string, k int, e array<double>").repartition(7)
    got = {r["u"]: r for r in po.vector_pool(df, ["u"], "e").collect()}
    for unit, rows in ((None, v[::3]), ("b", v[[k for k in range(20) if k % 3]])):
        assert got[unit]["n_vectors"] == len(rows)
        assert np.allclose(got[unit]["representation"], np.concatenate([rows.mean(0), rows.std(0)]), rtol=1e-9)
    plan = po.vector_pool(df, ["u"], "e")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_summaries_read_their_rows_once(spark, tmp_path):
    """NULL groups keep their percentiles, all columns and marks come from one pass, and large groups give the same."""
    rng = np.random.default_rng(2)
    rows = [(None if k % 4 == 0 else k % 3, k % 7, float(rng.normal()) if k % 5 else None, float(rng.integers(0, 9))) for k in range(400)]
    frame = pd.DataFrame(rows, columns=["u", "s", "x", "z"])
    spark.createDataFrame(rows, "u int, s int, x double, z double").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def looked_at(value):
        seen.add(1)
        return value

    def run():
        df = spark.read.parquet(str(tmp_path / "t")).withColumn("x", looked_at("x"))
        return {r["u"]: r for r in po.boundary_points(df, ["u"], "s", ["x", "z"]).collect()}

    got = run()
    assert seen.value == 400
    spark.conf.set("nestgrain.rowsPerTask", "20")
    try:
        large = run()
    finally:
        spark.conf.unset("nestgrain.rowsPerTask")
    assert seen.value == 800 and set(got) == {None, 0, 1, 2}
    for unit, own in got.items():
        part = frame[frame.u.isna() if unit is None else frame.u == unit]
        assert own["samples"] == len(part) and own["scans"] == 7 and own["x_valid_count"] == part.x.notna().sum()
        assert np.isclose(own["z_between_scan_mean_sd"], part.groupby("s").z.mean().std(ddof=0))
        for c in ("x", "z"):
            want = [part[c].mean(), part[c].std(ddof=0), *np.percentile(part[c].dropna(), [50, 10, 90])]
            for found in (own, large[unit]):
                assert np.allclose([found[f"{c}_{k}"] for k in ("mean", "sd", "median", "p10", "p90")], want)


def test_array_functions(spark):
    x = np.array([3.0, -1.0, 4.0, 1.5, 9.0, 2.0])
    df = spark.createDataFrame([(x.tolist(), [2.0] * 4)], "x array<double>, flat array<double>")
    row = df.select(
        ar.standardise(F.col("x")).alias("z"), ar.standardise(F.col("flat")).alias("zero"), ar.unit(F.col("x")).alias("u"),
        ar.array_percentile(F.col("x"), 0.1).alias("p"), ar.percentile_scale(F.col("x"), 0.1, 0.9).alias("s"), ar.adjacent_gaps(F.col("x")).alias("d"),
        ar.stride_sample(F.col("x"), 3, 2).alias("k"), ar.dot(F.col("x"), F.col("x")).alias("dot")).first()
    assert np.allclose(row["z"], (x - x.mean()) / x.std()) and row["zero"] == [0.0] * 4
    assert np.allclose(row["u"], x / np.linalg.norm(x)) and np.isclose(row["p"], np.percentile(x, 10))
    lo, hi = np.percentile(x, [10, 90])
    assert np.allclose(row["s"], np.clip((x - lo) / max(hi - lo, 1), 0, 1)) and np.allclose(row["d"], np.diff(x))
    assert row["k"] == [3.0, 4.0] and row["dot"] == x @ x


def test_grid_locations(spark):
    fits = spark.createDataFrame([("c", 401.0, 377.5, 141.25, 0.2)], "case_id string, centre_x double, centre_y double, outer_radius double, base_angle double")
    got = ra.grid_locations(fits, ["case_id"]).collect()
    assert len(got) == 37
    for r in got:
        scale = {"inner": 0.2, "middle": 0.6, "outer": 1.0, "centre": 0.0}[r["ring"]]
        angle = 0.2 + r["angle_index"] * math.pi / 6
        assert np.isclose(r["x"], 401 + 141.25 * scale * math.cos(angle)) and np.isclose(r["y"], 377.5 + 141.25 * scale * math.sin(angle))


def test_summaries_take_finite_values_only(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 3.0, math.nan, math.inf, None)], "g string, v double")
    row = po.masked_summary(df, ["g"], "v", "v").first()
    assert (row["v_valid_count"], row["v_total_count"], row["v_mean"], row["v_median"]) == (2, 5, 2.0, 2.0)


def test_crop_columns(spark):
    df = spark.createDataFrame([(2.5, 0.01, 100), (50.4, 0.0001, 100), (50.0, 1.0, 100)], "c double, s double, w int")
    cols = ge.crop_columns(F.col("c"), F.col("s"), F.col("w"), 0.1)
    got = [tuple(r) for r in df.select(*[cols[k].alias(k) for k in ("crop_x0", "crop_x1", "pad_left", "pad_right", "excessive_padding")]).collect()]
    assert got[0] == (-3, 7, 3, 0, True)
    assert got[1][:2] == (-450, 550) and got[1][4]
    assert got[2][1] - got[2][0] == 3


def test_reflected_crop(spark):
    """Against numpy's reflection; unresized it is exact, resized columns are the triangle filter's weighted means."""
    raster = np.arange(24.0).reshape(3, 8) ** 2
    cases = [(-3, 6, 6), (5, 9, 9), (-20, 5, 5), (0, 8, 3), (2, 4, 7), (-2, 12, 4), (30, 3, 3)]
    for x0, width, target in cases:
        df = spark.createDataFrame([(raster.ravel().tolist(), x0, width)], "v array<double>, x0 int, w int")
        got = np.array(df.select(ar.reflected_crop(F.col("v"), 8, F.col("x0"), F.col("w"), target)).first()[0]).reshape(3, target)
        wide = np.pad(raster, ((0, 0), (40, 40)), mode="reflect")[:, 40 + x0 : 40 + x0 + width]
        reach = max(width / target, 1.0)
        want = np.empty((3, target))
        for t in range(target):
            centre = (t + 0.5) * width / target
            k = np.arange(max(0, int(np.floor(centre - reach + 0.5))), min(width, int(np.floor(centre + reach + 0.5))))
            w = np.maximum(1 - np.abs((k - centre + 0.5) / reach), 0)
            want[:, t] = wide[:, k] @ (w / w.sum())
        assert np.allclose(got, want)
        if width == target:
            assert np.allclose(got, wide)
    odd = spark.createDataFrame([([1.0, 2.0, 3.0], 0, 3), ([], 0, 3), (None, 0, 3)], "v array<double>, x0 int, w int")
    assert [r[0] for r in odd.select(ar.reflected_crop(F.col("v"), 8, F.col("x0"), F.col("w"), 3)).collect()] == [None] * 3


def test_pool_features_joins_once(spark):
    """The result is stored with the check made on the way: using it runs no join again, and a spoiled sample is still refused."""
    rows = spark.range(40).selectExpr("id", "id % 2 AS u", "id % 4 AS s", "id * 1.0D AS x")
    pooled = po.pool_features(rows.select("u", "s", "id"), rows, ["u", "s", "id"], ["u"], "s", ["u", "s", "id"])
    assert "Join" not in pooled._jdf.queryExecution().optimizedPlan().toString() and pooled.count() == 2
    spoiled = rows.withColumn("x", F.when(F.col("id") == 7, float("nan")).otherwise(F.col("x")))
    for features in (spoiled, rows.where("id <> 7")):
        with pytest.raises(ct.GateError, match="complete finite"):
            po.pool_features(rows.select("u", "s", "id"), features, ["u", "s", "id"], ["u"], "s", ["u", "s", "id"])
