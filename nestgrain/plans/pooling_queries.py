"""Registered queries: hierarchical pooling, summaries, sampling and vector pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import nan_to_null, stable
from ..operators import ordered as od
from ..operators import pooling as po
from ..session import dealt, parts_for
from .common import rounded, sql_stable, table


def _samples(spark, sf_dir):
    """customer (unit) -> order (scan) -> line item (sample); large tables meet in parts whose number follows their rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = parts_for(spark, lines.count())
    if parts > parts_for(spark, 0):
        lines, orders = dealt(lines, ["l_orderkey"], parts), dealt(orders, ["o_orderkey"], parts)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("scan"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


_SAMPLES_SQL = """samples AS (SELECT o_custkey AS unit, o_orderkey AS scan, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_POOLED = [f"{f}__{k}" for f in ("quantity", "price") for k in ("mean", "between_sd", "within_sd")]


def two_level_pool(spark, sf_dir):
    return rounded(po.two_level_pool(_samples(spark, sf_dir), ["unit"], "scan", ["quantity", "price"]), ["unit", "n_scans"], _POOLED)


def _masked(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_suppkey", F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("x"))


_MASK = "CASE WHEN l_discount > 0.02 THEN l_extendedprice END"
_SUMMARY = ["valid_fraction", "mean", "sd", "median", "p10", "p90"]


def masked_summary(spark, sf_dir):
    out = po.masked_summary(_masked(spark, sf_dir), ["l_suppkey"], "x", "x")
    return rounded(out, ["l_suppkey", "x_valid_count", "x_total_count"], [f"x_{s}" for s in _SUMMARY])


def masked_null_group(spark, sf_dir):
    """The summary where some rows have no unit: they are one group, percentiles included."""
    rows = _masked(spark, sf_dir).withColumn("unit", F.when(F.col("l_suppkey") > 3, F.col("l_suppkey")))
    return rounded(po.masked_summary(rows, ["unit"], "x", "x"), ["unit", "x_valid_count", "x_total_count"], [f"x_{s}" for s in _SUMMARY])


def distribution_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.when(F.col("l_tax") < 0.07, F.col("l_discount")).alias("x"))
    out = po.distribution_summary(lines, ["l_returnflag"], "x")
    return rounded(out, ["l_returnflag"], ["minimum", "p05", "median", "mean", "p95", "maximum", "zero_fraction", "finite_fraction"])


def boundary_points(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("gap", F.when(F.col("quantity") > 5, F.col("quantity")))
    out = po.boundary_points(s, ["unit"], "scan", ["gap"])
    return rounded(out, ["unit", "scans", "samples", "gap_valid_count", "gap_total_count"],
                   ["gap_between_scan_mean_sd", *[f"gap_{x}" for x in _SUMMARY]])


def interval_thickness(spark, sf_dir):
    curves = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array((F.col("l_quantity") - 2), F.col("l_quantity") + F.col("l_linenumber") - 3, F.col("l_quantity") * 1.5,
                F.when(F.col("l_tax") > 0, F.col("l_quantity") * 2), F.col("l_quantity") * 2.5 - 10).alias("rows_px"))
    thickness, reason = po.interval_thickness(F.col("rows_px"), F.lit(3.87), F.lit(90.0))
    wide = curves.select(reason.alias("reason"), thickness.alias("t"))
    out = wide.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.get("t", F.lit(i))).alias(f"valid_{i}") for i in range(4)],
        *[stable(F.sum(F.get("t", F.lit(i))), 3).alias(f"total_{i}") for i in range(4)])
    return out


_ROWS = ["l_quantity - 2", "l_quantity + l_linenumber - 3", "l_quantity * 1.5", "CASE WHEN l_tax > 0 THEN l_quantity * 2 END", "l_quantity * 2.5 - 10"]
_OK = [f"coalesce(b{i} >= 0 AND b{i} < 90, false)" for i in range(5)]
_VALID = [f"({_OK[i]} AND {_OK[i + 1]} AND b{i + 1} - b{i} >= 0)" for i in range(4)]
THICKNESS_SQL = f"""WITH b AS (SELECT {', '.join(f'{e} AS b{i}' for i, e in enumerate(_ROWS))} FROM lineitem),
t AS (SELECT CASE WHEN {' AND '.join(_VALID)} THEN '' WHEN NOT ({' AND '.join(_OK)}) THEN 'negative_or_missing_boundary_sentinel'
  ELSE 'locally_crossed_boundary_pair' END AS reason, {', '.join(f'CASE WHEN {v} THEN (b{i + 1} - b{i}) * 3.87 END AS t{i}' for i, v in enumerate(_VALID))} FROM b)
SELECT reason, count(*) AS n, {', '.join(f'count(t{i}) AS valid_{i}' for i in range(4))}, {', '.join(f'{sql_stable(f"sum(t{i})", 3)} AS total_{i}' for i in range(4))}
FROM t GROUP BY 1"""


def wide_by_rank(spark, sf_dir):
    top = od.top_within(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3, "scan_rank")
    return po.wide_by_rank(top, ["o_custkey"], "scan_rank", [1, 2, 3], ["o_orderkey", "o_totalprice"])


def consecutive_indices(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    top = od.top_within(lines, ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey", "l_suppkey"], 3)
    return po.consecutive_indices(top, ["l_orderkey"], "l_linenumber")


def even_subsample(spark, sf_dir):
    picked = od.evenly_spaced(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5)
    return picked.select("user_id", "pick", "event_id")


def running_share(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    summed = od.running_sum(per, [], [F.col("q").desc(), "l_suppkey"], "q", "run")
    return rounded(summed, ["l_suppkey"], ["q", "run"], 2)


def row_index(spark, sf_dir):
    ranked = od.rank_within(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [], ["o_custkey", "o_orderkey"], "idx")
    return ranked.select("o_orderkey", (F.col("idx") - 1).alias("row_index"))


def adjacent_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    lagged = od.previous_value(e, ["user_id"], ["ts", "event_id"], "value", "before")
    return lagged.select("event_id", stable(F.col("value") - F.col("before"), 4).alias("step"))


def exact_percentiles(spark, sf_dir):
    out = od.exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return rounded(out, ["l_returnflag", "l_linestatus"], ["p05", "p50", "p95"])


def first_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return od.first_per_group(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"])


def most_frequent(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("mode"))


def label_map(spark, sf_dir):
    """Nested value map per case; five priorities at most, so each map is bounded."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "o_orderpriority", F.col("n").cast("string"))))
    return counts.groupBy("o_orderstatus").agg(F.concat_ws("|", entries).alias("labels"))


def vector_pool(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", ar.as_doubles(F.col("embedding")).alias("embedding"))
    pooled = po.vector_pool(vectors, ["label"], "embedding")
    return pooled.select("label", "n_vectors", F.posexplode("representation").alias("pos", "v")).select(
        "label", "n_vectors", "pos", stable(F.col("v"), 5).alias("v"))


def three_level_vector_pool(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "label", (F.col("vec_id") % 3).alias("scan"), ar.as_doubles(F.col("embedding")).alias("embedding"))
    pooled = po.three_level_vector_pool(vectors, ["label"], "scan", "embedding")
    return pooled.select("label", F.posexplode("representation").alias("pos", "v")).select("label", "pos", stable(F.col("v"), 5).alias("v"))


def reproduction_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", ar.as_doubles(F.col("embedding")).alias("v"))
    shifted = e.select("vec_id", F.transform("v", lambda x: x + 5e-6).alias("v"))
    out = po.reproduces(e, shifted, ["vec_id"], "v")
    return out.select("compared", stable(F.col("max_abs_difference"), 9).alias("max_abs_difference"), "within_tolerance")


def position_counters(spark, sf_dir):
    """Negative, tiny and total counts per vector position."""
    items = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "v"))
    return items.groupBy("pos").agg(
        F.count_if(F.col("v") < 0).alias("negatives"), F.count_if(F.abs("v") < 0.01).alias("tiny"), F.count(F.lit(1)).alias("n"))


def nan_as_missing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("x"))
    return lines.select("l_returnflag", nan_to_null(F.col("x")).alias("x")).groupBy("l_returnflag").agg(
        F.count("x").alias("n_valid"), stable(F.avg("x"), 6).alias("mean"))


def signature_groups(spark, sf_dir):
    from ..operators.cohort import signature_groups as groups

    labels = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 150).alias("point"), "event_type").agg(
        (F.count(F.lit(1)) / 8).cast("bigint").alias("value"))
    return groups(labels, "point", "event_type", "value")


QUERIES = {
    "two_level_pool": (two_level_pool, f"""WITH {_SAMPLES_SQL},
        s AS (SELECT unit, scan, avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM samples GROUP BY 1, 2)
        SELECT unit, count(*) AS n_scans, {sql_stable('avg(mq)')} AS quantity__mean, {sql_stable('stddev_pop(mq)')} AS quantity__between_sd,
        {sql_stable('avg(sq)')} AS quantity__within_sd, {sql_stable('avg(mp)')} AS price__mean, {sql_stable('stddev_pop(mp)')} AS price__between_sd,
        {sql_stable('avg(sp)')} AS price__within_sd FROM s GROUP BY 1"""),
    "masked_summary": (masked_summary, f"""SELECT l_suppkey, count(x) AS x_valid_count, count(*) AS x_total_count,
        {sql_stable('count(x) / count(*)')} AS x_valid_fraction, {sql_stable('avg(x)')} AS x_mean, {sql_stable('stddev_pop(x)')} AS x_sd,
        {sql_stable('quantile_cont(x, 0.5)')} AS x_median, {sql_stable('quantile_cont(x, 0.1)')} AS x_p10, {sql_stable('quantile_cont(x, 0.9)')} AS x_p90
        FROM (SELECT l_suppkey, {_MASK} AS x FROM lineitem) GROUP BY 1"""),
    "masked_null_group": (masked_null_group, f"""SELECT unit, count(x) AS x_valid_count, count(*) AS x_total_count,
        {sql_stable('count(x) / count(*)')} AS x_valid_fraction, {sql_stable('avg(x)')} AS x_mean, {sql_stable('stddev_pop(x)')} AS x_sd,
        {sql_stable('quantile_cont(x, 0.5)')} AS x_median, {sql_stable('quantile_cont(x, 0.1)')} AS x_p10, {sql_stable('quantile_cont(x, 0.9)')} AS x_p90
        FROM (SELECT CASE WHEN l_suppkey > 3 THEN l_suppkey END AS unit, {_MASK} AS x FROM lineitem) GROUP BY 1"""),
    "distribution_summary": (distribution_summary, f"""SELECT l_returnflag, {sql_stable('min(x)')} AS minimum, {sql_stable('quantile_cont(x, 0.05)')} AS p05,
        {sql_stable('quantile_cont(x, 0.5)')} AS median, {sql_stable('avg(x)')} AS mean, {sql_stable('quantile_cont(x, 0.95)')} AS p95, {sql_stable('max(x)')} AS maximum,
        {sql_stable('count(*) FILTER (x = 0) / count(x)')} AS zero_fraction, {sql_stable('count(x) / count(*)')} AS finite_fraction
        FROM (SELECT l_returnflag, CASE WHEN l_tax < 0.07 THEN l_discount END AS x FROM lineitem) GROUP BY 1"""),
    "boundary_points": (boundary_points, f"""WITH {_SAMPLES_SQL}, g AS (SELECT unit, scan, CASE WHEN quantity > 5 THEN quantity END AS x FROM samples),
        b AS (SELECT unit, stddev_pop(m) AS sd FROM (SELECT unit, scan, avg(x) AS m FROM g GROUP BY 1, 2) GROUP BY 1)
        SELECT unit, count(DISTINCT scan) AS scans, count(*) AS samples, count(x) AS gap_valid_count, count(*) AS gap_total_count,
        {sql_stable('any_value(b.sd)')} AS gap_between_scan_mean_sd, {sql_stable('count(x) / count(*)')} AS gap_valid_fraction, {sql_stable('avg(x)')} AS gap_mean,
        {sql_stable('stddev_pop(x)')} AS gap_sd, {sql_stable('quantile_cont(x, 0.5)')} AS gap_median, {sql_stable('quantile_cont(x, 0.1)')} AS gap_p10,
        {sql_stable('quantile_cont(x, 0.9)')} AS gap_p90 FROM g JOIN b USING (unit) GROUP BY 1"""),
    "interval_thickness": (interval_thickness, THICKNESS_SQL),
    "wide_by_rank": (wide_by_rank, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
        SELECT o_custkey, max(o_orderkey) FILTER (k = 1) AS scan_1_o_orderkey, max(o_totalprice) FILTER (k = 1) AS scan_1_o_totalprice,
        max(o_orderkey) FILTER (k = 2) AS scan_2_o_orderkey, max(o_totalprice) FILTER (k = 2) AS scan_2_o_totalprice,
        max(o_orderkey) FILTER (k = 3) AS scan_3_o_orderkey, max(o_totalprice) FILTER (k = 3) AS scan_3_o_totalprice FROM r WHERE k <= 3 GROUP BY 1"""),
    "consecutive_indices": (consecutive_indices, """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
        SELECT l_orderkey, min(l_linenumber) AS lowest, max(l_linenumber) AS highest,
        count(*) = 3 AND count(DISTINCT l_linenumber) = 3 AND max(l_linenumber) - min(l_linenumber) = 2 AS contiguous FROM r WHERE k <= 3 GROUP BY 1"""),
    "even_subsample": (even_subsample, """
        WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, CAST(k + 1 AS INT) AS pick, event_id FROM r, range(0, 5) t(k) WHERE i = round_even(k * (n - 1) / 4.0::DOUBLE, 0)"""),
    "running_share": (running_share, f"""SELECT l_suppkey, {sql_stable('q', 2)} AS q, {sql_stable('sum(q) OVER (ORDER BY q DESC, l_suppkey)', 2)} AS run
        FROM (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)"""),
    "row_index": (row_index, "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_index FROM orders"),
    "adjacent_difference": (adjacent_difference, f"""SELECT event_id, {sql_stable('value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS step FROM events"""),
    "exact_percentiles": (exact_percentiles, f"""SELECT l_returnflag, l_linestatus, {sql_stable('quantile_cont(l_extendedprice, 0.05)')} AS p05,
        {sql_stable('quantile_cont(l_extendedprice, 0.5)')} AS p50, {sql_stable('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1, 2"""),
    "first_per_group": (first_per_group, """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1"""),
    "most_frequent": (most_frequent, """SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1"""),
    "label_map": (label_map, """SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, '|' ORDER BY o_orderpriority) AS labels
        FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"""),
    "vector_pool": (vector_pool, f"""
        WITH e AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
        p AS (SELECT label, i, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT label, n AS n_vectors, CAST(i AS INT) AS pos, {sql_stable('m', 5)} AS v FROM p
        UNION ALL SELECT label, n, CAST(i + 64 AS INT), {sql_stable('s', 5)} FROM p"""),
    "three_level_vector_pool": (three_level_vector_pool, f"""
        WITH e AS (SELECT label, vec_id % 3 AS scan, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
        s AS (SELECT label, scan, i, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY 1, 2, 3),
        p AS (SELECT label, i, avg(m) AS a, stddev_pop(m) AS b, avg(s) AS c FROM s GROUP BY 1, 2)
        SELECT label, CAST(i AS INT) AS pos, {sql_stable('a', 5)} AS v FROM p UNION ALL SELECT label, CAST(i + 64 AS INT), {sql_stable('b', 5)} FROM p
        UNION ALL SELECT label, CAST(i + 128 AS INT), {sql_stable('c', 5)} FROM p"""),
    "reproduction_check": (reproduction_check, f"""
        WITH e AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT (SELECT count(*) FROM embeddings) AS compared, {sql_stable('max(abs(v - (v + 5e-6)))', 9)} AS max_abs_difference,
        max(abs(v - (v + 5e-6))) <= 1e-5 AS within_tolerance FROM e"""),
    "position_counters": (position_counters, """
        SELECT CAST(i AS INT) AS pos, count(*) FILTER (v < 0) AS negatives, count(*) FILTER (abs(v) < 0.01::DOUBLE) AS tiny, count(*) AS n
        FROM (SELECT unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1"""),
    "nan_as_missing": (nan_as_missing, f"""SELECT l_returnflag, count(*) FILTER (l_tax <> 0) AS n_valid, {sql_stable('avg(l_tax) FILTER (l_tax <> 0)', 6)} AS mean
        FROM lineitem GROUP BY 1"""),
    "signature_groups": (signature_groups, """
        WITH l AS (SELECT user_id % 150 AS point, event_type, CAST(floor(count(*) / 8) AS BIGINT) AS value FROM events GROUP BY 1, 2),
        s AS (SELECT point, string_agg(event_type || '=' || value, '|' ORDER BY event_type) AS sig FROM l GROUP BY 1)
        SELECT point, min(point) OVER (PARTITION BY sig) AS representative, count(*) OVER (PARTITION BY sig) AS group_size FROM s"""),
}
