import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.operators import contracts, geometry as ge, joins as jn, nearest


def brute(points, segments, k):
    out = []
    for p in points.itertuples():
        hits = []
        for s in segments[segments.case == p.case].itertuples():
            d = np.array([s.bx - s.ax, s.by - s.ay])
            t = np.clip(((p.x - s.ax) * d[0] + (p.y - s.ay) * d[1]) / (d @ d), 0, 1)
            hits.append((np.hypot(p.x - s.ax - t * d[0], p.y - s.ay - t * d[1]), s.scan))
        out += [(p.id, r + 1, s, round(v, 9)) for r, (v, s) in enumerate(sorted(hits)[:k])]
    return out


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(5)
    seg = []
    for case, n in ((0, 120), (1, 2), (2, 30)):
        for i in range(n):
            x, y = rng.uniform(0, 100, 2)
            a, length = rng.uniform(0, 2 * np.pi), rng.choice([0.5, 5, 60])
            if case == 2:
                x, y, a, length = 0, i * 3.0, 0, 100
            seg.append((case, i, x, y, x + length * np.cos(a), y + length * np.sin(a)))
    segments = pd.DataFrame(seg, columns=["case", "scan", "ax", "ay", "bx", "by"])
    points = pd.DataFrame({"id": np.arange(150), "case": rng.integers(0, 3, 150), "x": rng.uniform(-40, 140, 150), "y": rng.uniform(-40, 140, 150)})
    points.loc[points.case == 2, "y"] = np.round(points.y[points.case == 2] * 2) / 2
    return points, segments, spark.createDataFrame(points), spark.createDataFrame(segments)


@pytest.mark.parametrize("limit", [512, 20, 0])
def test_nearest_matches_brute_force(scene, limit):
    points, segments, p, s = scene
    got = nearest.nearest_segments(p, s, ["case"], ["id"], ("x", "y"), "scan", ("ax", "ay", "bx", "by"), 3, limit).toPandas()
    rows = sorted((r.id, r.rank, r.scan, round(r.distance, 9)) for r in got.itertuples())
    assert rows == sorted(brute(points, segments, 3))


def test_projection_edges(spark):
    df = spark.createDataFrame([(5.0, 5.0, 0.0, 0.0, 10.0, 0.0), (-2.0, 0.0, 0.0, 0.0, 10.0, 0.0), (1.0, 1.0, 3.0, 3.0, 3.0, 3.0)],
                               "px double, py double, ax double, ay double, bx double, by double")
    hit = ge.project_to_segment(*[F.col(c) for c in df.columns])
    rows = [r[0] for r in df.select(hit.alias("h")).collect()]
    assert rows[0]["t"] == 0.5 and rows[0]["distance"] == 5.0 and not rows[0]["clipped"]
    assert rows[1]["t"] == 0.0 and rows[1]["clipped"] and rows[1]["distance"] == 2.0
    assert rows[2] is None
    with pytest.raises(contracts.GateError):
        ge.require_proper_segments(df, ("ax", "ay", "bx", "by"))


def test_footprints(spark):
    df = spark.createDataFrame([(1, 10.3, 0.02, 100), (2, 0.4, 0.02, 100), (3, 50.5, 0.3, 100), (4, 99.0, 0.02, 100)],
                               "id int, centre double, scale double, width int")
    prints = ge.footprints(df, "centre", "scale", "width", 0.1)
    got = {r["id"]: r for r in prints.collect()}
    assert (got[1]["first_x"], got[1]["last_x"], got[1]["edge_clipped"]) == (8, 12, False)
    assert got[2]["first_x"] == 0 and got[2]["edge_clipped"] and got[4]["edge_clipped"]
    assert got[3]["empty"] and got[3]["sample_count"] == 0
    samples = ge.footprint_samples(prints, "centre", "scale", 0.1)
    assert samples.where("id = 3").isEmpty() and samples.where(~F.col("inside")).isEmpty()
    assert samples.where("id = 1").count() == 5


def test_fits_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for case in range(4):
        m = rng.uniform(0, 500, (12, 2))
        angle, scale = rng.uniform(-0.4, 0.4), rng.uniform(0.8, 1.2)
        r = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        f = m @ r.T + rng.uniform(-20, 20, 2) + rng.normal(0, 2, (12, 2))
        rows += [(case, i, *m[i], *f[i]) for i in range(12)]
    frame = pd.DataFrame(rows, columns=["case", "id", "x", "y", "u", "v"])
    df = spark.createDataFrame(frame)
    sim = ge.similarity_fits(df, ["case"]).toPandas().set_index("case")
    aff = ge.affine_fits(df, ["case"]).toPandas().set_index("case")
    for case, part in frame.groupby("case"):
        m, f = part[["x", "y"]].to_numpy(), part[["u", "v"]].to_numpy()
        x, y = m - m.mean(0), f - f.mean(0)
        u, s, vt = np.linalg.svd(x.T @ y)
        rot = vt.T @ u.T
        a = s.sum() / (x * x).sum() * rot
        assert np.allclose(sim.loc[case, ["a", "b", "c", "d"]].astype(float), a.ravel())
        assert np.allclose(sim.loc[case, ["tx", "ty"]].astype(float), f.mean(0) - a @ m.mean(0))
        coef = np.linalg.lstsq(np.column_stack([m, np.ones(len(m))]), f, rcond=None)[0]
        assert np.allclose(aff.loc[case, ["a", "b", "c", "d"]].astype(float), coef[:2].T.ravel())
    plaus = ge.plausibility(ge.affine_fits(df, ["case"])).toPandas()
    for r in plaus.itertuples():
        sv = np.linalg.svd(np.array([[r.a, r.b], [r.c, r.d]]), compute_uv=False)
        assert np.allclose([r.scale_max, r.scale_min], sv)
    line = spark.createDataFrame([(0, float(i), 2.0 * i, float(i), float(i)) for i in range(5)], "case int, x double, y double, u double, v double")
    assert ge.affine_fits(line, ["case"]).first()["a"] is None


def test_range_join_mixed_spans(spark):
    rng = np.random.default_rng(2)
    spans = np.r_[np.ones(40, int), 1000, rng.integers(1, 60, 30)]
    stop = np.cumsum(spans)
    ranges = pd.DataFrame({"g": np.arange(len(spans)), "start": stop - spans, "stop": stop})
    pos = pd.DataFrame({"pos": np.arange(-5, stop[-1] + 5)})
    got = jn.range_join(spark.createDataFrame(pos), spark.createDataFrame(ranges), [], "pos", "start", "stop").toPandas()
    want = np.searchsorted(stop, np.arange(stop[-1]), side="right")
    assert got.sort_values("pos").g.tolist() == want.tolist()


def test_spacing(spark):
    df = spark.createDataFrame([(0, i, 0.0, y, 10.0, y) for i, y in enumerate([0.0, 1.0, 3.0, 6.0])],
                               "case int, scan int, ax double, ay double, bx double, by double")
    row = ge.scan_spacing(df, ["case"], "scan", ("ax", "ay", "bx", "by")).first()
    assert (row["min_spacing"], row["median_spacing"], row["max_spacing"], row["area_y1"]) == (1.0, 2.0, 3.0, 6.0)


def test_clumps_and_far_points_do_not_crowd_a_cell(spark):
    """One far segment and point beside a dense clump: cells stay small, answers are those of brute force."""
    rng = np.random.default_rng(7)
    n = 4000
    a = rng.uniform(0, 1, (n, 2))
    b = a + rng.normal(0, 0.002, (n, 2))
    a[0], b[0] = (1e6, 1e6), (1e6, 1e6 + 1)
    p = rng.uniform(0, 1, (300, 2))
    p[0] = (1e6, 0)
    segments = spark.createDataFrame([(1, k, *map(float, (*a[k], *b[k]))) for k in range(n)], "c int, s int, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, k, *map(float, p[k])) for k in range(300)], "c int, p int, x double, y double")
    frame = nearest.grid_frame(points, segments, ["c"], ("x", "y"), ("ax", "ay", "bx", "by")).first()
    middle = np.floor(((a + b) / 2 - [frame["__ox"], frame["__oy"]]) / frame["__cell"])
    assert np.unique(middle, axis=0, return_counts=True)[1].max() <= nearest.CELL_SEGMENTS
    got = nearest.nearest_segments(points, segments, ["c"], ["p"], ("x", "y"), "s", ("ax", "ay", "bx", "by"), 3, array_limit=10).toPandas()
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(2) / (d * d).sum(1), 0, 1)
    distance = np.linalg.norm(p[:, None] - (a + t[..., None] * d), axis=2)
    for k, part in got.groupby("p"):
        assert part.sort_values("rank").s.tolist() == np.lexsort((np.arange(n), distance[k]))[:3].tolist()
    assert len(got) == 900


def test_grid_shuffles_no_pairs(spark):
    """Candidates of a point are read from its cell's lists, so no pairs of points and segments are shuffled."""
    n = 1500
    points = spark.range(n).selectExpr("0 AS case_id", "id AS point", "id % 90 + 0.5D AS x", "double(id * 7 % 1500) AS y")
    segments = spark.range(n).selectExpr("0 AS case_id", "id AS scan", "0.0D AS ax", "double(id) AS ay", "90.0D AS bx", "double(id) AS by")
    store, new = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, new, None)
        return [found.apply(k) for k in range(found.size())]

    before = max([s.stageId() for s in stages()], default=-1)
    got = nearest.nearest_segments(points, segments, ["case_id"], ["point"], ("x", "y"), "scan", ("ax", "ay", "bx", "by"), 3, 2).collect()
    assert len(got) == 3 * n and all(r["distance"] < 1e-9 for r in got if r["rank"] == 1)
    records = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > before)
    print("records", records)
    assert records < 60 * n
