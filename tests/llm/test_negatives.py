"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestgrain.llm import negatives as hn


def brute(rows, every, positives=5, negatives=3):
    kept = [(i, l, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, l, v in sorted(kept, key=lambda r: (r[0], r[1])):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i and len(w) == len(v))
        for s, j, m in [x for x in scored if x[2] == l][:positives]:
            p = -s
            fit = [x for x in scored if x[2] != l and 50 * p <= -100 * x[0] <= 95 * p][:negatives]
            out |= {(i, j, k + 1, x[1], p, -x[0]) for k, x in enumerate(fit)}
    return out


def made(n, seed, dim=6, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centres[i % 8] + spread * rng.normal(size=dim)]) for i in range(n)]
    return rows


ODD = [(1001, None, [1.0] * 6), (1002, 1, None), (1003, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1004, 2, [float("nan")] * 6), (1005, 2, [float("inf")] * 6),
       (None, 1, [1.0] * 6), (1010, 1, []), (1015, 1, []), (1020, 2, []), (1025, 3, [0.0] * 6), (1030, 3, [0.5, 0.5]), (1035, 2, [0.4, 0.5]), (1040, 3, [0.6, 0.4])]


@pytest.fixture
def found(spark):
    def run(rows, every=5):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, code string")
        got = [tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()]
        assert len(got) == len(set(got))
        return set(got)

    return run


def test_equals_brute_force(found):
    rows = made(600, 1) + ODD
    assert found(rows) == brute(rows, 5) and len(brute(rows, 5)) > 500


def test_copies_ties_and_small_tiles(found, monkeypatch):
    """A third of all rows is one vector; scores tie; tiles and blocks are many."""
    monkeypatch.setattr(hn, "LEAST_TILE", 20)
    monkeypatch.setattr(hn, "LARGEST_TILE", 20)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hn, "STEP_CELLS", 50)
    rows = [(i, l, v if i % 3 else [0.5] * 6) for i, l, v in made(300, 2, spread=0.05)]
    assert found(rows) == brute(rows, 5)


def test_a_small_sample_only_shapes_the_tree(found, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE", 9)
    rows = made(200, 3)
    assert found(rows) == brute(rows, 5)


def test_large_components_stay_exact(found):
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(5)]) for i in range(60)]
    assert found(rows) == brute(rows, 5)


def test_few_rows(found):
    assert found([]) == set()
    assert found([(0, 1, [1.0, 0.0])]) == set()
    assert found([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.7, 0.0])]) == brute([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.7, 0.0])], 5)


def test_ranges_rule_out_subtrees():
    """With clustered rows most leaves are out, and none that holds an answer."""
    rng = np.random.default_rng(8)
    centres = 256 * rng.normal(size=(8, 12))
    x = np.rint(np.repeat(centres, 200, axis=0) + 4 * rng.normal(size=(1600, 12))).astype(np.int64)
    square = float((x.astype(float) ** 2).sum(axis=1).max())
    rows = hn.lifted(x, square)
    tree, ranges = hn.build(rows), {}
    leaf = hn.leaf_of(tree, rows, ranges)
    scores = hn.inner(x[::100], x, square)
    least = np.sort(scores, axis=1)[:, -6]
    near, far = hn._annulus(x[::100], least.astype(float), np.full(16, square), square)
    met = hn.leaves_met(tree, ranges, np.column_stack([x[::100].astype(float), np.zeros(16)]), near, far, 1e-6 * square**0.5)
    wanted = {(i, int(leaf[j])) for i in range(16) for j in np.flatnonzero(scores[i] >= least[i])}
    assert wanted <= set(met) and len(met) < 0.4 * 16 * len(set(leaf.tolist()))
