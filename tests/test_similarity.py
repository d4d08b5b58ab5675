import itertools

import numpy as np
import pandas as pd
import pytest

from nestgrain.operators import contracts, similarity as si


def table(spark, vectors, **extra):
    frame = pd.DataFrame({"id": np.arange(len(vectors)), "v": list(vectors), **extra})
    return spark.createDataFrame(frame)


def brute(left, right, k, same):
    score = np.round(left @ right.T, 10) + 0.0
    if same:
        np.fill_diagonal(score, -np.inf)
    return [(q, int(s)) for q in range(len(left)) for s in np.argsort(-score[q], kind="stable")[:k]]


@pytest.mark.parametrize("tile,pivots", [(2048, 64), (17, 6)])
def test_top_k_matches_brute_force(spark, tile, pivots):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 130)] + rng.normal(0, 0.1, (130, 8))
    v[40:80] = v[3]  # a big group of copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = 0
    df = table(spark, v)
    got = si.top_k_similar(df, df, "id", "v", 3, exclude_same=True, tile=tile, pivots=pivots).toPandas()
    got = got.sort_values(["qid", "rank"])
    assert list(zip(got.qid, got.sid)) == brute(v, v, 3, True)


def test_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    b = np.arange(60) % 4
    df = table(spark, v, b=b)
    got = si.top_k_similar(df, df, "id", "v", 2, ["b"], True, tile=8).toPandas().sort_values(["qid", "rank"])
    for q, part in got.groupby("qid"):
        others = [i for i in range(60) if b[i] == b[q] and i != q]
        want = sorted(others, key=lambda i: (-round(float(v[q] @ v[i]), 10), i))[:2]
        assert part.sid.tolist() == want


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(2)
    for rows, columns in ((5, 5), (3, 6), (6, 4)):
        cost = rng.integers(0, 9, (rows, columns)).astype(float)
        i, j = si._solve(cost)
        short, long = min(rows, columns), max(rows, columns)
        table_ = cost if rows <= columns else cost.T
        best = min(sum(table_[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(long), short))
        assert cost[i, j].sum() == best and len(set(j)) == len(j) and len(set(i)) == len(i)
    v = rng.normal(size=(12, 6))
    left = table(spark, v, b=np.arange(12) // 6)
    perm = np.r_[rng.permutation(6), 6 + rng.permutation(6)]
    right = table(spark, v[perm] + rng.normal(0, 0.01, (12, 6)), b=np.arange(12) // 6)
    got = si.assign_vectors(left, right, ["b"], "id", "v").toPandas()
    assert {r.left_id: r.right_id for r in got.itertuples()} == {int(perm[j]): j for j in range(12)}
    with pytest.raises(contracts.GateError):
        si.assign_vectors(left, right, ["b"], "id", "v", limit=3)


def test_omission(spark):
    names = spark.createDataFrame([(i,) for i in range(12)], "idx int")
    pairs = [(g, g if g < 5 else g + 1) for g in (0, 3, 4, 5, 9)]
    ev = spark.createDataFrame(pairs, "grp int, idx int")
    scores = si.omission_scores(ev, names, "grp", "idx").toPandas().set_index("omitted_index").matches
    for o in range(12):
        assert scores[o] == sum(i == (g if g < o else g + 1) for g, i in pairs)
    row = si.infer_omission(ev, names, "grp", "idx").first()
    assert row["unique_complete"] and row["omitted_index"] == 5
    loose = spark.createDataFrame([(0, 0), (9, 10)], "grp int, idx int")
    assert not si.infer_omission(loose, names, "grp", "idx").first()["unique_complete"]


def test_point_numbering(spark):
    rng = np.random.default_rng(3)
    labels = pd.DataFrame([(c, p, int(rng.integers(-1, 30))) for c in range(9) for p in range(6)], columns=["case", "point", "value"])
    perm = rng.permutation(6)
    seen = labels.assign(location=[int(np.flatnonzero(perm == p)[0]) for p in labels.point])
    costs = si.value_mismatches(spark.createDataFrame(seen.assign(eye="R")), spark.createDataFrame(labels.assign(eye="R")), ["eye"], "case", "location", "point", "value")
    got = si.assign_scores(costs, ["eye"], "location", "point", "mismatches", 9.0).toPandas()
    assert {r.location: r.point for r in got.itertuples()} == dict(enumerate(perm)) and got.mismatches.sum() == 0


def test_top_scores_looks_again_only_at_better_ones():
    """Ties, copies, own columns and blocks that do not divide the sizes: as a sort of all scores gives."""
    rng = np.random.default_rng(5)
    q, s = rng.normal(size=(700, 4)), rng.normal(size=(9000, 4))
    s[5000:6500] = s[3]
    s[6500:6600] = 0
    q[0], q[1] = s[3], 0
    start = rng.integers(0, 8990, 700)
    stop = start + rng.integers(0, 9, 700)
    score = np.round(q @ s.T, 10) + 0.0
    for r in range(700):
        score[r, start[r] : stop[r]] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :3]
    row, col, value = si._top_scores(q, s, 3, (start, stop))
    assert (row.reshape(-1, 3) == np.arange(700)[:, None]).all() and (col.reshape(-1, 3) == want).all()
    assert (value.reshape(-1, 3) == np.take_along_axis(score, want, axis=1)).all()
    assert [p.tolist() for p in si._top_scores(q[:1], s[:2], 3, (np.array([0]), np.array([1])))[:2]] == [[0], [1]]
