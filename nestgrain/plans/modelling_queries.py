"""Registered queries: leakage-safe ladders, tuning tables, components, forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import stable
from ..operators import agreement as ag
from ..operators import modelling as mo
from .common import metric_sql, rounded, sql_stable, sums_sql, table

LOCATION = (0, 1, 2)
BOUNDARY = (3, 4)
TABULAR = LOCATION + BOUNDARY
IMAGE = tuple(range(5, 69))
FEATURES = 69

# Candidate grids of the two ladders.
PRIMARY_ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
PRIMARY_COMPONENTS = (8, 16, 32, 64, 128)
SECONDARY_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
SECONDARY_COMPONENTS = (64,)

PRIMARY = [
    mo.Ladder("null_training_mean", "mean"),
    mo.Ladder("null_minus_1_reference", "fixed"),
    mo.Ladder("location_ridge", "ridge", LOCATION, alphas=PRIMARY_ALPHAS),
    mo.Ladder("image_ridge", "ridge", (), IMAGE, PRIMARY_COMPONENTS, PRIMARY_ALPHAS),
    mo.Ladder("location_image_ridge", "ridge", LOCATION, IMAGE, PRIMARY_COMPONENTS, PRIMARY_ALPHAS),
]
# The forest of the secondary ladder stands at FOREST_POSITION among these.
SECONDARY = [
    mo.Ladder("null_training_mean", "mean"),
    mo.Ladder("null_minus_1_reference", "fixed"),
    mo.Ladder("location_ridge", "ridge", LOCATION, alphas=SECONDARY_ALPHAS),
    mo.Ladder("boundary_linear", "linear", BOUNDARY),
    mo.Ladder("boundary_ridge", "ridge", BOUNDARY, alphas=SECONDARY_ALPHAS),
    mo.Ladder("location_boundary_ridge", "ridge", TABULAR, alphas=SECONDARY_ALPHAS),
    mo.Ladder("aligned_image_ridge", "ridge", (), IMAGE, SECONDARY_COMPONENTS, SECONDARY_ALPHAS, whiten=False),
    mo.Ladder("location_boundary_image_ridge", "ridge", TABULAR, IMAGE, SECONDARY_COMPONENTS, SECONDARY_ALPHAS, whiten=False),
]
FOREST_NAME, FOREST_POSITION = "location_boundary_random_forest", 7
FOREST_CANDIDATES = [(depth, leaf) for depth in (4, 8, None) for leaf in (5, 15)]
TUNE_TREES, FOREST_TREES = 500, 1000


def _points(spark, sf_dir):
    """Embeddings as modelling points: 3 location and 2 gappy tabular features, then the vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", ar.as_doubles(F.col("embedding")).alias("v"))
    k = F.col("vec_id") % 37
    angle = k * 0.17
    gap = F.when(F.col("vec_id") % 9 == 4, F.lit(None)).otherwise(ar.norm(F.slice("v", 1, 16)))
    x = F.concat(F.array((k + 1) / 37, F.sin(angle), F.cos(angle), gap, ar.mean(F.slice("v", 17, 16))), F.col("v"))
    who = F.col("vec_id") % 22
    return e.select("vec_id", who.alias("participant"), (who % 5 + 1).cast("int").alias("fold"), F.col("label").cast("double").alias("y"), x.alias("x"))


def _run(spark, sf_dir, models):
    return mo.nested_ladder(_points(spark, sf_dir), ["vec_id"], "participant", "fold", "x", "y", FEATURES, models)


def primary_ladder(spark, sf_dir):
    metrics = ag.agreement_metrics(_run(spark, sf_dir, PRIMARY).predictions, ["model", "model_position"])
    return rounded(metrics, ["model", "model_position"], list(ag.METRICS), 5)


def primary_tuning(spark, sf_dir):
    return _run(spark, sf_dir, PRIMARY).tuning.drop("inner_mae")


def component_diagnostics(spark, sf_dir):
    return _run(spark, sf_dir, PRIMARY).components


def component_trace(spark, sf_dir):
    """All components of a standardised training set share out its whole variance."""
    model = mo.Ladder("image_ridge", "ridge", (), IMAGE, (len(IMAGE),), (1.0, 10.0))
    parts = _run(spark, sf_dir, [model]).components
    return parts.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("components"), stable(F.sum("explained_ratio"), 6).alias("total"), stable(F.max("cumulative_ratio"), 6).alias("last"))


def _forest(rows):
    return mo.forest_predictions(
        rows, ["vec_id"], "participant", "fold", "x", "y", trees=FOREST_TREES, feature_share="sqrt",
        candidates=FOREST_CANDIDATES, tune_trees=TUNE_TREES)


def secondary_ladder(spark, sf_dir):
    linear = _run(spark, sf_dir, SECONDARY).predictions
    place = F.col("model_position")
    linear = linear.withColumn("model_position", F.when(place >= FOREST_POSITION, place + 1).otherwise(place))
    forest = _forest(_points(spark, sf_dir).withColumn("x", F.slice("x", 1, len(TABULAR))))
    forest = forest.withColumns({"model": F.lit(FOREST_NAME), "model_position": F.lit(FOREST_POSITION)})
    columns = ["model", "model_position", "participant", "fold", "observed", "predicted"]
    metrics = ag.agreement_metrics(linear.select(*columns).unionByName(forest.select(*columns)), ["model", "model_position"])
    return rounded(metrics, ["model", "model_position"], list(ag.METRICS), 5)


def forest_ladder(spark, sf_dir):
    return ag.agreement_metrics(_forest(_points(spark, sf_dir)), [])


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", (F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"), F.col("l_extendedprice").alias("y"),
        F.array(F.col("l_quantity"), F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("x"))


LINE_MODELS = [
    mo.Ladder("null_training_mean", "mean"), mo.Ladder("null_minus_1_reference", "fixed"),
    mo.Ladder("one_feature_linear", "linear", (0,)), mo.Ladder("one_feature_ridge", "ridge", (0,), alphas=(5000.0,)),
    mo.Ladder("imputed_ridge", "ridge", (1,), alphas=(5000.0,)),
]


def line_ladder(spark, sf_dir):
    """Fixed-parameter models on every line item, with errors per fold (one-feature closed forms exist)."""
    run = mo.nested_ladder(_lines(spark, sf_dir), ["l_orderkey"], "l_suppkey", "fold", "x", "y", 2, LINE_MODELS)
    metrics = ag.agreement_metrics(run.predictions, ["model", "fold"])
    return rounded(metrics, ["model", "fold"], ["mae", "rmse", "bias"], 4)


_VALUES = metric_sql()
LINE_SQL = f"""WITH l AS (SELECT CAST(l_suppkey % 5 + 1 AS INT) AS fold, l_extendedprice AS y, l_quantity AS q, CASE WHEN l_tax > 0 THEN l_tax END AS t FROM lineitem),
f AS (SELECT unnest(range(1, 6))::INT AS k),
md AS (SELECT k, quantile_cont(t, 0.5) AS med FROM l JOIN f ON fold <> k GROUP BY 1),
tr AS (SELECT k, y, q, coalesce(t, med) AS t FROM l JOIN md ON fold <> k),
c AS (SELECT k, avg(y) AS my, avg(q) AS mq, avg(t) AS mt, var_pop(q) AS vq, var_pop(t) AS vt, covar_pop(q, y) AS cq, covar_pop(t, y) AS ct, count(*) AS n FROM tr GROUP BY 1),
p AS (SELECT fold, y AS observed, my, my + cq / vq * (q - mq) AS lin, my + cq / sqrt(vq) * n / (n + 5000) * (q - mq) / sqrt(vq) AS ridge,
  my + ct / sqrt(vt) * n / (n + 5000) * (coalesce(t, med) - mt) / sqrt(vt) AS imp FROM l JOIN c ON fold = c.k JOIN md ON fold = md.k),
u AS (SELECT 'null_training_mean' AS model, fold, observed, my AS predicted FROM p UNION ALL SELECT 'null_minus_1_reference', fold, observed, -1.0 FROM p
  UNION ALL SELECT 'one_feature_linear', fold, observed, lin FROM p UNION ALL SELECT 'one_feature_ridge', fold, observed, ridge FROM p
  UNION ALL SELECT 'imputed_ridge', fold, observed, imp FROM p)
SELECT model, fold, {sql_stable(_VALUES['mae'])} AS mae, {sql_stable(_VALUES['rmse'])} AS rmse, {sql_stable(_VALUES['bias'])} AS bias FROM ({sums_sql('u', 'model, fold')})"""


def standardised_by_fold(spark, sf_dir):
    """Train-fold means and population SDs for each held-out fold, from the folds' own central moments."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"), F.col("l_extendedprice").alias("x"))
    per = l.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.count("x") * F.var_pop("x")).alias("q"))
    # pairs of folds: five times four rows
    other = per.select(F.col("fold").alias("held"))
    pairs = per.join(other, F.col("fold") != F.col("held"))
    means = pairs.groupBy("held").agg(F.sum("n").alias("n_train"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    away = F.col("m") - F.col("mean")
    spread = pairs.join(means, "held").groupBy("held", "n_train", "mean").agg(F.sqrt(F.sum(F.col("q") + F.col("n") * away * away) / F.col("n_train")).alias("sd"))
    out = spread.withColumnRenamed("held", "fold")
    return out.select("fold", "n_train", stable(F.col("mean"), 4).alias("mean"), stable(F.col("sd"), 4).alias("sd"))


QUERIES = {
    "primary_ladder": (primary_ladder, None),
    "primary_tuning": (primary_tuning, None),
    "component_trace": (component_trace, f"""SELECT DISTINCT CAST(vec_id % 22 % 5 + 1 AS INT) AS outer_fold, 64::BIGINT AS components,
        {sql_stable('1.0::DOUBLE', 6)} AS total, {sql_stable('1.0::DOUBLE', 6)} AS last FROM embeddings"""),
    "component_diagnostics": (component_diagnostics, None),
    "secondary_ladder": (secondary_ladder, None),
    "forest_ladder": (forest_ladder, None),
    "line_ladder": (line_ladder, LINE_SQL),
    "standardised_by_fold": (standardised_by_fold, f"""SELECT k AS fold, count(*) AS n_train, {sql_stable('avg(l_extendedprice)')} AS mean, {sql_stable('stddev_pop(l_extendedprice)')} AS sd
        FROM lineitem JOIN (SELECT unnest(range(1, 6))::INT AS k) ON l_suppkey % 5 + 1 <> k GROUP BY 1"""),
}
