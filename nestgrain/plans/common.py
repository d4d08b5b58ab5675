"""Shared pieces of the registered queries: table access and matching SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import stable
from ..operators.agreement import METRICS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    return df.select(*keys, *[stable(F.col(c), digits).alias(c) for c in columns])


def sql_stable(expression: str, digits: int = 4) -> str:
    return f"round(({expression}) + {0.00317 * 10 ** -digits!r}, {digits})"


def whole(column: Column) -> Column:
    return column.cast("bigint")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the role of predictions: model, participant, case, visit, fold, floor flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("participant"),
        F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("visit"),
        F.col("l_linenumber").alias("point"), (F.col("l_discount") == 0).alias("floor_flag"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"),
        F.col("l_extendedprice").alias("observed"), (F.col("l_quantity") * 1500).alias("predicted"),
    )


PREDICTIONS_SQL = """
predictions AS (
  SELECT l_returnflag AS model, l_suppkey AS participant, l_orderkey AS case_id, l_linestatus AS visit,
         l_linenumber AS point, l_discount = 0 AS floor_flag, CAST(l_suppkey % 5 + 1 AS INT) AS fold,
         l_extendedprice AS observed, l_quantity * 1500 AS predicted
  FROM lineitem)"""


def sums_sql(source: str, keys: str, weight: str = "1.0", where: str = "true", extra: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
    SELECT {lead}sum({weight}) AS s_n, sum({weight} * abs(predicted - observed)) AS s_a,
           sum({weight} * (predicted - observed)) AS s_d, sum({weight} * (predicted - observed) * (predicted - observed)) AS s_dd,
           sum({weight} * observed) AS s_o, sum({weight} * observed * observed) AS s_oo,
           sum({weight} * predicted) AS s_p, sum({weight} * predicted * predicted) AS s_pp,
           sum({weight} * observed * predicted) AS s_op, min(observed) AS lo_o, max(observed) AS hi_o,
           min(predicted) AS lo_p, max(predicted) AS hi_p{extra}
    FROM {source} WHERE {where} {group}"""


_SD = "sqrt(greatest((s_dd - s_d * s_d / s_n) / greatest(s_n - 1, 1), 0))"
_FLAT = "lo_p = hi_p"
_SHRINK = "(1 + (s_p / s_n) * (s_p / s_n))"
_SLOPE = "(s_op - s_o * s_p / s_n) / nullif(s_pp - s_p * s_p / s_n, 0)"


def metric_sql(unweighted_sd: bool = False) -> dict[str, str]:
    sd = f"CASE WHEN s_n > 1 THEN {_SD} END" if unweighted_sd else _SD
    return {
        "mae": "s_a / s_n", "rmse": "sqrt(s_dd / s_n)", "bias": "s_d / s_n",
        "lower_loa": f"s_d / s_n - 1.96 * ({sd})", "upper_loa": f"s_d / s_n + 1.96 * ({sd})",
        "calibration_intercept": f"CASE WHEN {_FLAT} THEN (s_o / s_n) / {_SHRINK} ELSE s_o / s_n - ({_SLOPE}) * s_p / s_n END",
        "calibration_slope": f"CASE WHEN {_FLAT} THEN (s_p / s_n) * (s_o / s_n) / {_SHRINK} ELSE {_SLOPE} END",
        "r_squared": "CASE WHEN lo_o < hi_o THEN 1 - s_dd / (s_oo - s_o * s_o / s_n) END",
    }


def metrics_select(keys: str, source: str, names=METRICS, digits: int = 4, unweighted_sd: bool = False) -> str:
    """SELECT keys and rounded metrics FROM a sums subquery."""
    values = metric_sql(unweighted_sd)
    columns = ", ".join(f"{sql_stable(values[n], digits)} AS {n}" for n in names)
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}{columns} FROM ({source})"
