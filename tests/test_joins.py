"""Joins on crowded cells and blocks: same matches as brute force, and no key that holds most rows."""

import numpy as np
from pyspark.sql import functions as F

from nestgrain.operators import joins as jn


def test_tolerance_cells_are_cut_further(spark):
    """Nine tenths of the rows agree in the first two near fields; the third and fourth tell them apart."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        a, b = (1.0, 2.0) if k % 10 else (float(rng.integers(0, 5)), float(rng.integers(0, 5)))
        rows.append((k, "e" if k % 2 else "o", a, b, float(rng.integers(0, 40)) / 7, float(rng.integers(0, 3))))
    schema = "id int, eye string, a double, b double, c double, d double"
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame([(i + 1000, e, a + 4e-11, b - 4e-11, c, d + 5e-11) for i, e, a, b, c, d in rows[::2] + rows[:5]], schema)
    found = {}
    for crowded in (3, 20, 10**6):
        got = jn.tolerance_join(left, right.withColumnRenamed("id", "rid"), ["eye"], ["a", "b", "c", "d"], "id", "rid", crowded=crowded)
        found[crowded] = {r["id"]: (r["match_count"], r["rid"]) for r in got.collect()}
    other = right.collect()
    for i, e, *values in rows:
        hits = [r["id"] for r in other if r["eye"] == e and all(abs(x - r[n]) <= 1e-10 for x, n in zip(values, "abcd"))]
        for got in found.values():
            assert got[i] == (len(hits), hits[0] if len(hits) == 1 else None)


def test_range_blocks_with_most_points_are_dealt(spark, monkeypatch):
    spark.conf.set("nestgrain.rowsPerTask", "50")
    monkeypatch.setattr(jn, "fits_broadcast", lambda df: False)
    try:
        points = [(k, "x", 70 if k % 10 else k) for k in range(1000)]
        ranges = [(0, "x", 0, 64), (1, "x", 64, 128), (2, "x", 70, 71), (3, "x", 10, 900), (4, "y", 0, 100), (5, "x", 5, 5)]
        p = spark.createDataFrame(points, "id int, g string, at long")
        r = spark.createDataFrame(ranges, "rid int, g string, lo long, hi long")
        got = sorted((x["id"], x["rid"]) for x in jn.range_join(p, r, ["g"], "at", "lo", "hi").collect())
        assert got == sorted((i, j) for i, g, at in points for j, h, lo, hi in ranges if g == h and lo <= at < hi)
        dealt, copied = jn.salted(p, r.withColumn("at", F.col("lo")).select("at", "rid"), ["at"], p.columns, 50)
        sizes = [x["count"] for x in dealt.groupBy("at", "__salt").count().collect()]
        assert sum(sizes) == 1000 and max(sizes) <= 100
    finally:
        spark.conf.unset("nestgrain.rowsPerTask")


def test_tolerance_join_probes_plain_values_once(spark):
    """Values of few decimals lie mid-cell; with edges on whole numbers of widths each probed two cells."""
    values = [(round(k * 0.37, 2),) for k in range(2000)]
    cells = F.size(jn.cells_reached(F.col("a"), 1e-10, 1e-9))
    assert spark.createDataFrame(values, "a double").where(cells > 1).count() == 0


def test_tolerance_join_at_cell_edges(spark):
    edges = [(k + 0.5) * 1e-9 + e for k in range(-3, 4) for e in (-1.5e-10, -5e-11, 0.0, 5e-11, 1.5e-10)]
    rows = spark.createDataFrame(list(enumerate(edges)), "id long, a double")
    got = jn.tolerance_join(rows, rows.withColumnRenamed("id", "rid"), [], ["a"], "id", "rid").collect()
    want = {i: sum(abs(v - w) <= 1e-10 for w in edges) for i, v in enumerate(edges)}
    assert {r["id"]: r["match_count"] for r in got} == want
