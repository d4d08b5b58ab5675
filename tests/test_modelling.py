import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.operators import contracts, folds, forests as fo, modelling as mo

FEATURES = 9
LOC, TAB, REP = (0, 1), (0, 1, 2), (3, 4, 5, 6, 7, 8)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(size=(n, FEATURES)) * rng.uniform(0.5, 4, FEATURES) + rng.uniform(-5, 5, FEATURES)
    y = x @ rng.normal(size=FEATURES) + rng.normal(0, 2, n)
    x[rng.random(n) < 0.1, 2] = np.nan
    group = rng.integers(0, 17, n)
    frame = pd.DataFrame({"id": np.arange(n), "who": group, "outer": group % 5 + 1, "y": y})
    rows = [(int(i), int(g), int(o), float(t), [None if np.isnan(v) else float(v) for v in r])
            for i, g, o, t, r in zip(frame.id, frame.who, frame.outer, frame.y, x)]
    return frame, x, spark.createDataFrame(rows, "id int, who int, outer int, y double, x array<double>").repartition(5)


def fit_predict(train, y, test, model, k, alpha):
    med = np.nanmedian(train, axis=0)
    train, test = np.where(np.isnan(train), med, train), np.where(np.isnan(test), med, test)
    mean, sd = train.mean(0), train.std(0)
    zt, zs = (train - mean) / sd, (test - mean) / sd
    a, b = zt[:, list(model.plain)], zs[:, list(model.plain)]
    if model.represented:
        u, s, vt = np.linalg.svd(zt[:, list(model.represented)], full_matrices=False)
        axes = vt[:k].T / (s[:k] / np.sqrt(len(train) - 1) if model.whiten else 1)
        a = np.column_stack([a, zt[:, list(model.represented)] @ axes])
        b = np.column_stack([b, zs[:, list(model.represented)] @ axes])
    centre = a.mean(0)
    g = (a - centre).T @ (a - centre) + alpha * np.eye(a.shape[1])
    w = np.linalg.solve(g, (a - centre).T @ (y - y.mean()))
    return y.mean() + (b - centre) @ w


MODELS = [
    mo.Ladder("null", "mean"), mo.Ladder("floor", "fixed"), mo.Ladder("ols", "linear", TAB),
    mo.Ladder("plain", "ridge", TAB, alphas=(0.1, 1.0, 10.0, 100.0)),
    mo.Ladder("rep", "ridge", (), REP, (2, 4), (0.1, 10.0, 100.0)),
    mo.Ladder("both", "ridge", LOC, REP, (3,), (0.1, 10.0), whiten=False),
]


def test_matches_direct_nested_cv(spark, data):
    frame, x, df = data
    result = mo.nested_ladder(df, ["id"], "who", "outer", "x", "y", FEATURES, MODELS)
    got = result.predictions.toPandas().pivot(index="id", columns="model", values="predicted")
    tuning = result.tuning.toPandas()
    y = frame.y.to_numpy()
    for fold in range(1, 6):
        train = (frame.outer != fold).to_numpy()
        inner = folds.group_kfold(df.where(F.col("outer") != fold), "who", 4).toPandas().set_index("who")["fold"]
        code = frame.who.map(inner).to_numpy()
        for model in MODELS:
            pred = got.loc[~train, model.name].to_numpy()
            if model.family == "mean":
                assert np.allclose(pred, y[train].mean())
            elif model.family == "fixed":
                assert np.allclose(pred, -1)
            elif model.family == "linear":
                assert np.allclose(pred, fit_predict(x[train], y[train], x[~train], model, 0, 0.0))
            else:
                means = []
                for k, alpha in model.candidates():
                    per = []
                    for i in range(1, 5):
                        a, b = train & (code != i), train & (code == i)
                        per.append(np.abs(fit_predict(x[a], y[a], x[b], model, k, alpha) - y[b]).mean())
                    means.append(np.mean(per))
                rows = tuning[(tuning.model == model.name) & (tuning.outer_fold == fold)].sort_values("candidate")
                assert np.allclose(rows.mean_inner_mae, means)
                best = int(np.argmin(means))
                assert rows.selected.tolist() == [c == best for c in range(len(means))]
                assert np.allclose(pred, fit_predict(x[train], y[train], x[~train], model, *model.candidates()[best]))
    assert result.predictions.count() == len(frame) * len(MODELS)
    comp = result.components.toPandas()
    assert (comp.groupby("outer_fold").cumulative_ratio.max() <= 1 + 1e-9).all() and len(comp) == 20
    assert result.configurations.count() == 30


def test_components_match_spark_ml(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    m = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    z = (m - m.mean(0)) / m.std(0)
    df = spark.createDataFrame([(list(map(float, r)),) for r in z], "x array<double>").select(array_to_vector("x").alias("v"))
    ml = PCA(k=3, inputCol="v", outputCol="p").fit(df)
    c = m - m.mean(0)
    _, ratios = mo.principal_axes(c.T @ c, 80, 3, True)
    assert np.allclose(ratios, ml.explainedVariance.toArray())


def test_ridge_matches_spark_ml(spark, data):
    """regParam = alpha * population SD of y / n reproduces the closed form."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    frame, x, df = data
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    y = frame.y.to_numpy()
    rows = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(z, y)], "x array<double>, label double")
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    ml = LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal", regParam=10.0 * y.std() / len(y)).fit(rows)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(ml.coefficients.toArray(), w)


def test_leakage_fails_closed(spark, data):
    _, _, df = data
    leaky = df.withColumn("outer", F.when(F.col("id") == 0, 9).otherwise(F.col("outer")))
    with pytest.raises(contracts.GateError):
        mo.nested_ladder(leaky, ["id"], "who", "outer", "x", "y", FEATURES, MODELS[:1])


def test_forest(spark, data):
    frame, x, df = data
    got = mo.forest_predictions(df, ["id"], "who", "outer", "x", "y", trees=20, leaf=5, depth=6).toPandas()
    assert len(got) == len(frame) and got.predicted.notna().all()
    assert np.allclose(got.sort_values("id").observed, frame.y)
    null = sum(np.abs(frame.y[frame.outer == f] - frame.y[frame.outer != f].mean()).sum() for f in range(1, 6)) / len(frame)
    assert (got.predicted - got.observed).abs().mean() < 0.9 * null
    tuned = mo.tune_forest(df.where("outer <> 1"), "who", "x", "y", [(2, 5), (6, 5)], trees=5, inner=2).toPandas()
    assert tuned.selected.sum() == 1 and tuned.loc[tuned.selected, "mean_inner_mae"].iloc[0] == tuned.mean_inner_mae.min()


def plain_tree(bins, y, w, root, leaf, limit, features, tried):
    """One tree grown node by node with every split tried by itself; returns row -> value."""
    out = np.zeros(len(y))

    def down(rows, name, depth):
        own = rows[w[rows] > 0]
        mean = np.average(y[own], weights=w[own]) if len(own) else 0.0
        best = None
        for slot, f in enumerate(fo.node_features(np.array([name], np.uint64), features, tried)[0]):
            for last in range(fo.BINS - 1):
                left = own[bins[own, f] <= last]
                right = own[bins[own, f] > last]
                if min(len(left), len(right)) < leaf:
                    continue
                gain = sum(np.dot(w[s], y[s]) ** 2 / w[s].sum() for s in (left, right)) - np.dot(w[own], y[own]) ** 2 / w[own].sum()
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, last)
        if best is None or depth >= limit:
            out[rows] = mean
            return
        side = bins[rows, best[1]] > best[2]
        for s in (0, 1):
            down(rows[side == s], int(fo.children(np.array([name], np.uint64), np.array([s]))[0]), depth + 1)

    down(np.arange(len(y)), root, 0)
    return out


def stored_rows(df):
    rows = df.withColumn("__outer", F.col("outer") - 1).join(folds.inner_folds(df, "who", "outer", [1, 2, 3, 4, 5]).select("who", F.col("inner").alias("__inner")), "who")
    return mo._stored(rows, ["id"], "x", "y", 5, 4, "sqrt")


def test_forest_equals_trees_grown_one_by_one(spark, data):
    """Levels grown for all trees at once, and depth limits read off the deep tree, against plain recursion."""
    frame, x, df = data
    stored = stored_rows(df)
    forests = [fo.Forest(0, 1, 0, 5, 3, 7), fo.Forest(1, 0, 2, 9, 2, 8)]
    got = {(r["forest"], r["id"]): (r["p0"], r["p1"]) for r in stored.means(forests, (2, None), fo.NODE_ROWS).collect()}
    rows = sorted(stored.rows.collect(), key=lambda r: (r["__turn"], r["__id"]))
    seen = 0
    for f in forests:
        part = [r for r in rows if (r["__outer"] != f.outer or not f.left_out)]
        held = np.array([r["__outer"] == f.outer if not f.left_out else r["__inner"][f.outer] == f.left_out for r in part])
        bins = np.array([list(r["__bins"]) for r in part])
        bins[:, 2] = np.where(bins[:, 2] == fo.MISSING, stored.fills[f.outer, f.left_out][2], bins[:, 2])
        y = np.array([r["__y"] for r in part])
        roots = fo.tree_roots(f, np.arange(f.trees))
        draws = fo.bag(np.array([r["__turn"] for r in part]).view(np.uint64), roots)
        for c, limit in enumerate((2, np.inf)):
            want = np.mean([plain_tree(bins, y, np.where(held, 0, w).astype(float), int(root), f.leaf, limit, 9, 3) for w, root in zip(draws, roots)], axis=0)
            for k in np.flatnonzero(held):
                assert got[f.number, part[k]["__id"]][c] == pytest.approx(want[k], abs=1e-9)
                seen += 1
    assert seen == 2 * len(got)


def test_forest_levels_across_tasks(spark, data):
    """Nodes above a small bound are split by keyed histograms of all tasks: the same trees."""
    _, _, df = data
    stored = stored_rows(df)
    forests = [fo.Forest(0, 1, 0, 5, 3, 7), fo.Forest(1, 0, 2, 9, 2, 8), fo.Forest(2, 3, 0, 40, 2, 8)]
    alone = {(r["forest"], r["id"]): tuple(r)[2:] for r in stored.means(forests, (0, 2, 4, None), fo.NODE_ROWS).collect()}
    for bound in (30, 100):
        spread = {(r["forest"], r["id"]): tuple(r)[2:] for r in stored.means(forests, (0, 2, 4, None), bound).collect()}
        assert spread.keys() == alone.keys()
        assert all(np.allclose(spread[k], alone[k]) for k in alone)


def test_forest_fills_gaps_and_tunes(spark, data):
    """Gaps are filled by the median bin of the training rows; each outer fold has the depth and leaf its own rows choose."""
    frame, x, df = data
    stored = stored_rows(df)
    edges = fo.bin_edges(df, "x", FEATURES)
    for o in range(5):
        median = np.nanmedian(x[frame.outer != o + 1, 2])
        assert stored.fills[o, 0] == {2: np.searchsorted(edges[2], median)}
    part = df.where("outer <= 2")
    got = mo.forest_predictions(part, ["id"], "who", "outer", "x", "y", trees=3, feature_share="sqrt", candidates=[(2, 5), (None, 9)], tune_trees=2).toPandas()
    assert len(got) == (frame.outer <= 2).sum() and got.predicted.notna().all()


def test_forest_queries_are_whole(spark, sf_dir, monkeypatch):
    """What the two queries ask of the forest, which is replaced here because 500 and 1,000 trees take long."""
    from nestgrain.plans import modelling_queries as mq

    seen = []

    def asked(rows, *names, trees, feature_share, candidates, tune_trees):
        seen.append((rows.selectExpr("max(size(x))").first()[0], trees, feature_share, len(candidates), tune_trees))
        return rows.select("vec_id", "participant", "fold", F.col("y").alias("observed"), F.lit(0.5).alias("predicted"))

    monkeypatch.setattr(mo, "forest_predictions", asked)
    got = mq.secondary_ladder(spark, sf_dir).collect()
    assert sorted(r["model_position"] for r in got) == list(range(1, 10)) and len({r["model"] for r in got}) == 9
    assert mq.forest_ladder(spark, sf_dir).count() == 1
    assert seen == [(5, 1000, "sqrt", 6, 500), (69, 1000, "sqrt", 6, 500)]


def test_two_level_sums_agree(spark, data):
    frame, x, df = data
    inner = folds.inner_folds(df, "who", "outer", [1, 2, 3, 4, 5])
    rows = df.join(inner.select("who", "inner"), "who").repartition(7)
    for few in (True, False):
        shift, y_shift, gaps = mo.feature_sums(rows, "x", "y", FEATURES, few)
        assert np.allclose(shift, np.nanmean(x, axis=0)) and np.isclose(y_shift, frame.y.mean()) and gaps == [2]
        stored = mo.cell_blocks(rows, "x", "y", FEATURES, [1, 2, 3, 4, 5], shift, y_shift, gaps, few)
        cells = {}
        for r in stored.collect():
            cells.setdefault((r["o"], r["i"]), []).append((r["b"], np.asarray(r["values"])))
        cells = {k: mo.assembled(v, FEATURES, gaps) for k, v in cells.items()}
        train = sum(c.n for (o, _), c in cells.items() if o == 0)
        assert train == (frame.outer != 1).sum() and len(cells) == 20
        z = np.column_stack([np.ones(len(x)), np.nan_to_num(x - shift), np.isnan(x[:, 2]), frame.y - y_shift])
        own = (frame.outer != 1).to_numpy()
        assert np.allclose(sum(c.matrix for (o, _), c in cells.items() if o == 0), z[own].T @ z[own])


def test_blocks_of_a_wide_matrix(spark, data, monkeypatch):
    """A matrix in many small blocks gives the same ladder."""
    _, _, df = data
    one = mo.nested_ladder(df, ["id"], "who", "outer", "x", "y", FEATURES, MODELS).predictions.toPandas().sort_values(["model", "id"])
    monkeypatch.setattr(mo, "BLOCK_VALUES", 30)
    many = mo.nested_ladder(df, ["id"], "who", "outer", "x", "y", FEATURES, MODELS).predictions.toPandas().sort_values(["model", "id"])
    assert np.allclose(one.predicted, many.predicted)


def test_reference_width(spark):
    """3,072 features: no matrix reaches the driver, whose results stay far below its limit."""
    features, n = 3072, 60
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, features))
    y = x[:, :5].sum(axis=1)
    rows = [(i, i % 12, i % 12 % 3 + 1, float(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, who int, outer int, y double, x array<double>").repartition(3)
    models = [mo.Ladder("null", "mean"), mo.Ladder("wide", "ridge", tuple(range(features)), alphas=(10.0, 1000.0))]
    shift, y_shift, gaps = mo.feature_sums(df, "x", "y", features, True)
    inner = folds.inner_folds(df, "who", "outer", [1, 2, 3], 2)
    cells = mo.cell_blocks(df.join(inner.select("who", "inner"), "who"), "x", "y", features, [1, 2, 3], shift, y_shift, gaps, True)
    fits = mo.fitted_sets(cells, {0: [1, 2], 1: [1, 2], 2: [1, 2]}, features, [], {(o, j): {} for o in range(3) for j in range(3)}, models, shift, y_shift, True)
    found = {(r["o"], r["j"], r["position"], r["candidate"]): np.asarray(r["values"]) for r in fits.where("o = 0 AND j = 0").collect()}
    train = np.array([i % 12 % 3 + 1 != 1 for i in range(n)])
    z = (x - x[train].mean(0)) / x[train].std(0)
    for c, alpha in enumerate((10.0, 1000.0)):
        gram = z[train] @ z[train].T + alpha * np.eye(train.sum())
        want = y[train].mean() + z @ (z[train].T @ np.linalg.solve(gram, y[train] - y[train].mean()))
        row = found[0, 0, 1, c]
        assert np.allclose(row[0] + x @ row[1:], want)


def test_forest_shuffle_does_not_grow_with_trees(spark, data):
    """A table that fits one task is sent to a fixed number of tasks, however many trees they grow."""
    stored = stored_rows(data[2])
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(trees):
        before = max(s.stageId() for s in list_of(store))
        stored.means([fo.Forest(0, 1, 0, 40, trees, 7), fo.Forest(1, 0, 2, 40, trees, 8)], (2,), fo.NODE_ROWS).write.format("noop").mode("overwrite").save()
        return sum(s.shuffleWriteBytes() for s in list_of(store) if s.stageId() > before)

    def list_of(store):
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [stages.apply(k) for k in range(stages.size())]

    assert shuffled(800) < 2 * shuffled(40)


def test_leaf_sizes_share_nodes(spark, data, monkeypatch):
    """Leaf sizes grown together give each its own trees, and the nodes they have in common are worked on once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12))
    y = x[:, 0] + np.sin(2 * x[:, 1]) + rng.normal(0, 0.5, 3000)
    rows = {"bins": (np.argsort(np.argsort(x, axis=0), axis=0) * fo.BINS // 3000).astype(np.uint8), "y": y - y.mean(), "held": rng.random(3000) < 0.2}
    shape = fo.Shape(12, 4, (2, 5, None), {})
    roots = fo.tree_roots(fo.Forest(0, 0, 0, 5, 4, 9), np.arange(4))
    draws = fo.bag(rng.integers(0, 2**63, (~rows["held"]).sum()).astype(np.uint64), roots)
    seen, chosen = [], fo._chosen
    monkeypatch.setattr(fo, "_chosen", lambda cells, front, tried, leaves: (seen.append(front.count), chosen(cells, front, tried, leaves))[1])

    def nodes(leaves):
        seen.clear()
        sums = fo.grow(rows, leaves, shape, roots, draws, 0)
        assert min(c.min() for c in seen) >= 2 * min(leaves)  # smaller nodes cannot split
        return sums, sum(len(c) for c in seen)

    (both, shared), (few, n_few), (many, n_many) = nodes([5, 15]), nodes([5]), nodes([15])
    assert np.allclose(both, np.concatenate([few, many]), atol=1e-9) and not np.allclose(few, many)
    assert max(n_few, n_many) < shared < 0.9 * (n_few + n_many)
    stored = stored_rows(data[2])
    forests = [fo.Forest(0, 1, 0, 5, 3, 7), fo.Forest(1, 1, 0, 9, 3, 7), fo.Forest(2, 1, 2, 9, 3, 7), fo.Forest(3, 1, 0, 9, 3, 8)]
    got = {(r["forest"], r["id"]): tuple(r)[2:] for r in stored.means(forests, (2, None), fo.NODE_ROWS).collect()}
    for f in forests:
        alone = {(r["forest"], r["id"]): tuple(r)[2:] for r in stored.means([f], (2, None), fo.NODE_ROWS).collect()}
        assert all(np.allclose(got[k], v) for k, v in alone.items()) and len(alone) == sum(k[0] == f.number for k in got)


def test_histograms_in_parts(monkeypatch):
    """A few nodes and features at a time, as large tables need, give the very same trees."""
    rng = np.random.default_rng(4)
    k = rng.integers(0, 37, 2000)
    x = np.column_stack([k, np.sin(k * 0.17), np.cos(k * 0.17), rng.normal(size=2000), rng.normal(size=2000)])
    y = x[:, 1] + x[:, 3] + rng.normal(0, 0.5, 2000)
    bins = np.column_stack([np.searchsorted(np.unique(np.quantile(c, np.arange(1, 64) / 64)), c) for c in x.T]).astype(np.uint8)
    rows = {"bins": bins, "y": y - y.mean(), "held": rng.random(2000) < 0.2}
    shape = fo.Shape(5, 3, (4, 8, None), {})
    roots = fo.tree_roots(fo.Forest(0, 0, 0, 5, 6, 9), np.arange(6))
    draws = fo.bag(rng.integers(0, 2**63, (~rows["held"]).sum()).astype(np.uint64), roots)
    whole = fo.grow(rows, [5, 15], shape, roots, draws, 0)
    parts, best = [], fo._best
    monkeypatch.setattr(fo, "_best", lambda cells, off, *more: (parts.append(len(off)), best(cells, off, *more))[1])
    for fo_cells, fo_columns in ((64, 7), (3000, 3), (1, 1)):
        monkeypatch.setattr(fo, "CELLS", fo_cells)
        monkeypatch.setattr(fo, "COLUMNS", fo_columns)
        parts.clear()
        assert np.array_equal(fo.grow(rows, [5, 15], shape, roots, draws, 0), whole) and len(parts) > 20
