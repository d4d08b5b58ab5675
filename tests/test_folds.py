import time

import numpy as np
import pandas as pd
import pytest

from nestgrain.operators import contracts, folds


def greedy(frame, loads, n, with_count):
    order = frame.sort_values([*loads, "who"], ascending=[False] * len(loads) + [True])
    state = [[0] * (len(loads) + 1) for _ in range(n)]
    out = {}
    for row in order.itertuples():
        values = [getattr(row, name) for name in loads]

        def key(f):
            first, count, *rest = state[f]
            return (first, count, *rest, f) if with_count else (first, *rest, f)

        f = min(range(n), key=key)
        for i, v in enumerate([values[0], 1, *values[1:]]):
            state[f][i] += v
        out[row.who] = f + 1
    return out


@pytest.mark.parametrize("seed,size,n", [(1, 23, 5), (2, 400, 5), (3, 61, 4), (4, 300, 7), (5, 6, 5)])
def test_matches_sequential_greedy(spark, seed, size, n):
    rng = np.random.default_rng(seed)
    base, year = rng.integers(0, 4, size), rng.integers(0, 3, size)
    frame = pd.DataFrame({"who": [f"p{i:04d}" for i in range(size)], "v": base + year + 1, "b": base, "y": year})
    df = spark.createDataFrame(frame)
    got = folds.balanced_folds(df, "who", ["v", "b", "y"], n).toPandas().set_index("who")["fold"].to_dict()
    assert got == greedy(frame, ["v", "b", "y"], n, True)
    got = folds.balanced_folds(df, "who", ["v"], n, False).toPandas().set_index("who")["fold"].to_dict()
    assert got == greedy(frame, ["v"], n, False)


def test_one_hot_signature_in_slices(spark, tiny_tasks):
    frame = pd.DataFrame({"who": [f"p{i:04d}" for i in range(300)], "v": [2] * 290 + [9] * 10})
    got = folds.balanced_folds(spark.createDataFrame(frame), "who", ["v"], 5).toPandas().set_index("who")["fold"].to_dict()
    assert got == greedy(frame, ["v"], 5, True)


def test_one_giant_group_costs_no_more(spark):
    start = time.perf_counter()
    placed = list(folds._place_runs([((10**7,), 1), ((1,), 10**8)], 5, False))
    assert time.perf_counter() - start < 1
    assert all(len(segments) <= 5 for _, segments in placed)
    frame = pd.DataFrame({"who": [f"p{i:04d}" for i in range(400)], "v": [120, 40, 40] + [1] * 397})
    got = folds.balanced_folds(spark.createDataFrame(frame), "who", ["v"], 5, False).toPandas()
    assert got.set_index("who")["fold"].to_dict() == greedy(frame, ["v"], 5, False)


def test_groups_without_load(spark):
    frame = pd.DataFrame({"who": [f"p{i:02d}" for i in range(12)], "v": [3, 1] + [0] * 10})
    for counted in (True, False):
        got = folds.balanced_folds(spark.createDataFrame(frame), "who", ["v"], 3, counted).toPandas()
        assert got.set_index("who")["fold"].to_dict() == greedy(frame, ["v"], 3, counted)


def test_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "who string, v int")
    with pytest.raises(contracts.GateError):
        folds.balanced_folds(df, "who", ["v"], 5)
    with pytest.raises(ValueError):
        folds.balanced_folds(df, "who", ["v"], 1)
    with pytest.raises(contracts.GateError):
        folds.balanced_folds(spark.createDataFrame([("a", -1), ("b", 2)], "who string, v int"), "who", ["v"], 2)


def test_inner_folds_and_leave_out(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"who": np.repeat(np.arange(20), rng.integers(1, 9, 20))})
    frame["outer"] = frame.who % 5 + 1
    frame["y"] = rng.normal(size=len(frame))
    df = spark.createDataFrame(frame)
    inner = folds.inner_folds(df, "who", "outer", [1, 2, 3, 4, 5]).toPandas()
    for row in inner.itertuples():
        assert pd.isna(row.inner[row.outer - 1])
        assert all(1 <= v <= 4 for i, v in enumerate(row.inner) if i != row.outer - 1)
    means = folds.leave_fold_out_mean(df, "outer", "y").toPandas().set_index("outer")["training_mean"]
    for k in range(1, 6):
        assert np.isclose(means[k], frame[frame.outer != k].y.mean())
    assert contracts.split_groups(df, "who", "outer").isEmpty()
