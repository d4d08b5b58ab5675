"""Registered queries: nearest segments, footprints, spacing, landmark transforms, crops, phase."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import polar, stable
from ..operators import geometry as ge
from ..operators import nearest as ne
from .common import rounded, sql_stable, table

ENDS = ("ax", "ay", "bx", "by")


def _points(spark, sf_dir):
    """Customers as test points of their nation's scan."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("point"),
        (F.col("c_custkey") % 100 + 0.5).alias("x"), F.col("c_acctbal").alias("y"))


def _segments(spark, sf_dir):
    """Suppliers as scan lines of their nation, slightly tilted."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("scan"), (F.col("s_suppkey") % 10).cast("double").alias("ax"),
        F.col("s_acctbal").alias("ay"), F.lit(90.0).alias("bx"), (F.col("s_acctbal") + F.col("s_suppkey") % 7 - 3).alias("by"))


POINTS_SQL = "points AS (SELECT c_nationkey AS case_id, c_custkey AS point, c_custkey % 100 + 0.5::DOUBLE AS x, c_acctbal AS y FROM customer)"
SEGMENTS_SQL = """segments AS (SELECT s_nationkey AS case_id, s_suppkey AS scan, (s_suppkey % 10)::DOUBLE AS ax, s_acctbal AS ay, 90.0::DOUBLE AS bx,
  s_acctbal + s_suppkey % 7 - 3 AS by_ FROM supplier)"""
NEAREST_SQL = f"""WITH {POINTS_SQL}, {SEGMENTS_SQL},
t AS (SELECT p.*, s.scan, ax, ay, bx, by_, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS t_raw
  FROM points p JOIN segments s USING (case_id)),
d AS (SELECT *, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) AS distance
  FROM (SELECT *, least(greatest(t_raw, 0), 1) AS t FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance, scan) AS rank FROM d)
SELECT point, rank, scan, t_raw < 0 OR t_raw > 1 AS clipped, {sql_stable('t', 6)} AS t, {sql_stable('distance', 5)} AS distance FROM r WHERE rank <= 3"""


def _nearest(spark, sf_dir, limit):
    hits = ne.nearest_segments(_points(spark, sf_dir), _segments(spark, sf_dir), ["case_id"], ["point"], ("x", "y"), "scan", ENDS, 3, limit)
    return hits.select("point", "rank", "scan", "clipped", stable(F.col("t"), 6).alias("t"), stable(F.col("distance"), 5).alias("distance"))


def nearest_three(spark, sf_dir):
    return _nearest(spark, sf_dir, ne.ARRAY_SEGMENTS)


def nearest_three_grid(spark, sf_dir):
    """The same through the grid pyramid, the form used for cases with very many segments."""
    return _nearest(spark, sf_dir, 2)


def distance_rules(spark, sf_dir):
    hits = ne.nearest_segments(_points(spark, sf_dir), _segments(spark, sf_dir), ["case_id"], ["point"], ("x", "y"), "scan", ENDS, 3)
    spacing = ge.scan_spacing(_segments(spark, sf_dir), ["case_id"], "scan", ENDS).select("case_id", "median_spacing")
    units = hits.join(spacing, "case_id").withColumn("units", F.col("distance") / F.col("median_spacing"))
    return units.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("rank") == 1) & (F.col("units") > 0.55)).alias("far_nearest"),
        F.count_if((F.col("rank") == 3) & (F.col("units") > 1.55)).alias("far_third"), F.count_if("clipped").alias("clipped"))


DISTANCE_SQL = NEAREST_SQL.split("\nSELECT point, rank")[0].replace("r AS (SELECT *, row_number()", """
mids AS (SELECT case_id, scan, (ax + bx) / 2 AS mx, (ay + by_) / 2 AS my FROM segments),
gaps AS (SELECT case_id, sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) AS gap FROM (SELECT *, lag(mx) OVER w AS px, lag(my) OVER w AS py FROM mids
  WINDOW w AS (PARTITION BY case_id ORDER BY scan))),
sp AS (SELECT case_id, quantile_cont(gap, 0.5) AS median_spacing FROM gaps GROUP BY 1),
r AS (SELECT *, row_number()""") + """
SELECT rank, count(*) AS n, count(*) FILTER (rank = 1 AND distance / median_spacing > 0.55) AS far_nearest,
count(*) FILTER (rank = 3 AND distance / median_spacing > 1.55) AS far_third, count(*) FILTER (t_raw < 0 OR t_raw > 1) AS clipped
FROM r JOIN sp USING (case_id) WHERE rank <= 3 GROUP BY 1"""


def scan_spacing(spark, sf_dir):
    out = ge.scan_spacing(_segments(spark, sf_dir), ["case_id"], "scan", ENDS)
    return rounded(out, ["case_id", "n_scans"], ["min_spacing", "median_spacing", "max_spacing", "area_x0", "area_y0", "area_x1", "area_y1"])


SPACING_SQL = f"""WITH {SEGMENTS_SQL},
gaps AS (SELECT *, sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) AS gap FROM (SELECT *, lag(mx) OVER w AS px, lag(my) OVER w AS py
  FROM (SELECT *, (ax + bx) / 2 AS mx, (ay + by_) / 2 AS my FROM segments) WINDOW w AS (PARTITION BY case_id ORDER BY scan)))
SELECT case_id, count(*) AS n_scans, {sql_stable('min(gap)')} AS min_spacing, {sql_stable('quantile_cont(gap, 0.5)')} AS median_spacing,
{sql_stable('max(gap)')} AS max_spacing, {sql_stable('min(least(ax, bx))')} AS area_x0, {sql_stable('min(least(ay, by_))')} AS area_y0,
{sql_stable('max(greatest(ax, bx))')} AS area_x1, {sql_stable('max(greatest(ay, by_))')} AS area_y1 FROM gaps GROUP BY 1"""


def _prints(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") + 0.37).alias("centre"), (F.col("p_retailprice") / 50000).alias("scale"), F.lit(50).alias("width"))
    return ge.footprints(parts, "centre", "scale", "width", 0.1)


def footprints(spark, sf_dir):
    p = _prints(spark, sf_dir)
    return p.select("p_partkey", "first_x", "last_x", F.col("sample_count").cast("bigint").alias("sample_count"), "edge_clipped", "empty")


def footprint_samples(spark, sf_dir):
    rows = ge.footprint_samples(_prints(spark, sf_dir), "centre", "scale", 0.1)
    return rows.select("p_partkey", "sample_rank", "sample_x", stable(F.col("offset"), 6).alias("offset"), "inside")


FOOTPRINT_SQL = """prints AS (SELECT *, greatest(ceil(c - 0.05 / s - 1e-12), 0)::BIGINT AS first_x, least(floor(c + 0.05 / s + 1e-12), 49)::BIGINT AS last_x,
  c - 0.05 / s < 0 OR c + 0.05 / s > 49 AS edge_clipped FROM (SELECT p_partkey, p_size + 0.37::DOUBLE AS c, p_retailprice / 50000 AS s FROM part))"""


def crop_geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("scale", F.col("p_retailprice") / 100000)
    bounds = ge.crop_columns(F.col("p_size") + 0.5, F.col("scale"), F.lit(50), 0.1)
    keep = ["crop_x0", "crop_x1", "crop_width", "pad_left", "pad_right"]
    return p.select("p_partkey", *[bounds[k].cast("bigint").alias(k) for k in keep],
                    stable(bounds["padded_fraction"], 6).alias("padded_fraction"), bounds["excessive_padding"].alias("excessive_padding"))


CROP_SQL = f"""WITH c AS (SELECT p_partkey, greatest(round_even(0.1 / (p_retailprice / 100000), 0)::BIGINT, 3) AS w, round_even(p_size + 0.5::DOUBLE, 0)::BIGINT AS m FROM part),
x AS (SELECT p_partkey, w, m - w // 2 AS x0, m - w // 2 + w AS x1 FROM c), p AS (SELECT *, greatest(-x0, 0) AS pl, greatest(x1 - 50, 0) AS pr FROM x)
SELECT p_partkey, x0 AS crop_x0, x1 AS crop_x1, w AS crop_width, pl AS pad_left, pr AS pad_right, {sql_stable('(pl + pr) / w', 6)} AS padded_fraction,
(pl + pr) / w > 0.25 AS excessive_padding FROM p"""


CROP_TARGET = 5


def reflected_crop(spark, sf_dir):
    """Every 8 x 8 raster cropped around a moving centre to a width of its own, reflected at the borders, resized to five columns."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scale = (F.col("vec_id") % 5 + 2) / 20.0
    bounds = ge.crop_columns((F.col("vec_id") % 9).cast("double") + 0.3, scale, F.lit(8), 0.8)
    cropped = e.select("vec_id", *[bounds[k].alias(k) for k in ("crop_x0", "crop_width", "padded_fraction", "excessive_padding")], ar.reflected_crop(
        F.col("embedding"), 8, bounds["crop_x0"], bounds["crop_width"], CROP_TARGET).alias("v"))
    return cropped.select("vec_id", "crop_width", stable(F.col("padded_fraction"), 6).alias("padded_fraction"), "excessive_padding", F.posexplode("v").alias("pos", "x")).select(
        "vec_id", "crop_width", "padded_fraction", "excessive_padding", "pos", stable(F.col("x"), 5).alias("x"))


REFLECTED_SQL = f"""WITH g AS (SELECT vec_id, greatest(round_even(0.8 / ((vec_id % 5 + 2) / 20.0::DOUBLE), 0)::BIGINT, 3) AS w, round_even(vec_id % 9 + 0.3::DOUBLE, 0)::BIGINT AS m FROM embeddings),
c AS (SELECT vec_id, w, m - w // 2 AS x0, greatest(w / {CROP_TARGET}.0, 1.0)::DOUBLE AS reach, (greatest(-(m - w // 2), 0) + greatest(m - w // 2 + w - 8, 0)) / w AS share FROM g),
t AS (SELECT *, unnest(range(0, {CROP_TARGET})) AS tx FROM c),
k AS (SELECT *, (tx + 0.5) * w / {CROP_TARGET}.0 AS centre, unnest(range(0, w)) AS k FROM t),
r AS (SELECT *, greatest(1 - abs((k - centre + 0.5) / reach), 0) AS raw FROM k
  WHERE k >= greatest(floor(centre - reach + 0.5), 0) AND k < least(floor(centre + reach + 0.5), w)),
n AS (SELECT *, raw / sum(raw) OVER (PARTITION BY vec_id, tx) AS weight, (x0 + k) - 14 * floor((x0 + k) / 14.0) AS inside FROM r),
v AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)
SELECT vec_id, w AS crop_width, {sql_stable('any_value(share)', 6)} AS padded_fraction, any_value(share) > 0.25 AS excessive_padding,
  CAST(i // 8 * {CROP_TARGET} + tx AS INT) AS pos, {sql_stable('sum(weight * e)', 5)} AS x
FROM n JOIN v USING (vec_id) WHERE i % 8 = CASE WHEN inside < 8 THEN inside ELSE 14 - inside END GROUP BY vec_id, w, i // 8, tx"""


# ---- landmarks ------------------------------------------------------------------------

def _landmarks(spark, sf_dir):
    """Customers as landmarks of their nation: moving (x, y), fixed (u, v) with deterministic noise."""
    c = table(spark, sf_dir, "customer")
    x, y = F.col("c_acctbal") / 20, (F.col("c_custkey") * 37 % 500).cast("double")
    noise = (F.col("c_custkey") * 7919 % 13 - 6) / 3.0
    tilt = F.col("c_nationkey") / 60.0
    return c.select(
        F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("landmark"), x.alias("x"), y.alias("y"),
        (x * (1 - tilt / 2) - y * tilt + 12 + noise).alias("u"), (x * tilt + y * (1 - tilt / 3) - 7 - noise / 2).alias("v"))


LANDMARKS_SQL = """lm AS (SELECT case_id, landmark, x, y, x * (1 - tilt / 2) - y * tilt + 12 + noise AS u, x * tilt + y * (1 - tilt / 3) - 7 - noise / 2 AS v
  FROM (SELECT c_nationkey AS case_id, c_custkey AS landmark, c_acctbal / 20 AS x, (c_custkey * 37 % 500)::DOUBLE AS y,
    (c_custkey * 7919 % 13 - 6) / 3.0::DOUBLE AS noise, c_nationkey / 60.0::DOUBLE AS tilt FROM customer))"""
_COEF = ["a", "b", "c", "d", "tx", "ty"]


def similarity_fit(spark, sf_dir):
    return rounded(ge.similarity_fits(_landmarks(spark, sf_dir), ["case_id"]), ["case_id", "n"], _COEF)


SIMILARITY_SQL = f"""sim AS (SELECT case_id, n, p AS a, -q AS b, q AS c, p AS d, mu - (p * mx - q * my) AS tx, mv - (q * mx + p * my) AS ty FROM (
  SELECT case_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv,
  (covar_pop(x, u) + covar_pop(y, v)) / (var_pop(x) + var_pop(y)) AS p, (covar_pop(x, v) - covar_pop(y, u)) / (var_pop(x) + var_pop(y)) AS q FROM lm GROUP BY 1))"""
AFFINE_SQL = """aff AS (SELECT case_id, n, a, b, c, d, mu - a * mx - b * my AS tx, mv - c * mx - d * my AS ty FROM (
  SELECT *, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b, (xv * yy - yv * xy) / det AS c, (yv * xx - xv * xy) / det AS d FROM (
  SELECT *, xx * yy - xy * xy AS det FROM (SELECT case_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy,
  covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(x, v) AS xv, covar_pop(y, u) AS yu, covar_pop(y, v) AS yv FROM lm GROUP BY 1))))"""
_COEF_SQL = ", ".join(f"{sql_stable(k)} AS {k}" for k in _COEF)


def affine_fit(spark, sf_dir):
    return rounded(ge.affine_fits(_landmarks(spark, sf_dir), ["case_id"]), ["case_id", "n"], _COEF)


def registration_error(spark, sf_dir):
    marks = _landmarks(spark, sf_dir)
    errors = ge.registration_errors(marks, ge.similarity_fits(marks, ["case_id"]).drop("n"), ["case_id"])
    return rounded(ge.error_summary(errors, ["case_id"]), ["case_id", "n_landmarks"], ["mean_error", "median_error", "max_error"])


REGISTRATION_SQL = f"""WITH {LANDMARKS_SQL}, {SIMILARITY_SQL},
e AS (SELECT case_id, sqrt((a * x + b * y + tx - u) * (a * x + b * y + tx - u) + (c * x + d * y + ty - v) * (c * x + d * y + ty - v)) AS error FROM lm JOIN sim USING (case_id))
SELECT case_id, count(*) AS n_landmarks, {sql_stable('avg(error)')} AS mean_error, {sql_stable('quantile_cont(error, 0.5)')} AS median_error,
{sql_stable('max(error)')} AS max_error FROM e GROUP BY 1"""


def landmark_errors(spark, sf_dir):
    marks = _landmarks(spark, sf_dir)
    errors = ge.registration_errors(marks, ge.affine_fits(marks, ["case_id"]).drop("n"), ["case_id"])
    return errors.select("landmark", *[stable(F.col(k), 3).alias(k) for k in ("predicted_u", "predicted_v", "error")])


def transform_plausibility(spark, sf_dir):
    out = ge.plausibility(ge.affine_fits(_landmarks(spark, sf_dir), ["case_id"]))
    return rounded(out, ["case_id", "plausible"], ["determinant", "scale_max", "scale_min", "condition_number"])


PLAUSIBLE_SQL = f"""WITH {LANDMARKS_SQL}, {AFFINE_SQL},
s AS (SELECT case_id, a * d - b * c AS det, (sqrt((a + d) * (a + d) + (c - b) * (c - b)) + sqrt((a - d) * (a - d) + (b + c) * (b + c))) / 2 AS hi,
  abs(sqrt((a + d) * (a + d) + (c - b) * (c - b)) - sqrt((a - d) * (a - d) + (b + c) * (b + c))) / 2 AS lo FROM aff)
SELECT case_id, det > 0 AND lo >= 0.70 AND hi <= 1.35 AND hi / greatest(lo, 1e-12) <= 1.30 AS plausible, {sql_stable('det')} AS determinant,
{sql_stable('hi')} AS scale_max, {sql_stable('lo')} AS scale_min, {sql_stable('hi / greatest(lo, 1e-12)')} AS condition_number FROM s"""


def transform_choice(spark, sf_dir):
    """Recommended transform and landmark rejection per case."""
    marks = _landmarks(spark, sf_dir)
    sim, aff = ge.similarity_fits(marks, ["case_id"]).drop("n"), ge.affine_fits(marks, ["case_id"]).drop("n")
    errors = ge.error_summary(ge.registration_errors(marks, sim, ["case_id"]), ["case_id"])
    other = ge.error_summary(ge.registration_errors(marks, aff, ["case_id"]), ["case_id"])
    joined = errors.select("case_id", "median_error", (-F.col("mean_error")).alias("sim_score")).join(
        other.select("case_id", (-F.col("mean_error")).alias("aff_score")), "case_id").join(
        ge.plausibility(aff).select("case_id", "determinant", "plausible"), "case_id")
    return joined.select(
        "case_id", ge.recommend(F.col("sim_score"), F.col("aff_score"), F.col("plausible")).alias("choice"),
        ge.reject_landmarks(F.col("median_error"), F.col("determinant")).alias("rejected"))


CHOICE_SQL = f"""WITH {LANDMARKS_SQL}, {SIMILARITY_SQL}, {AFFINE_SQL},
e1 AS (SELECT case_id, quantile_cont(e, 0.5) AS med, -avg(e) AS s FROM (SELECT case_id, sqrt((a * x + b * y + tx - u) * (a * x + b * y + tx - u)
  + (c * x + d * y + ty - v) * (c * x + d * y + ty - v)) AS e FROM lm JOIN sim USING (case_id)) GROUP BY 1),
e2 AS (SELECT case_id, -avg(e) AS s FROM (SELECT case_id, sqrt((a * x + b * y + tx - u) * (a * x + b * y + tx - u)
  + (c * x + d * y + ty - v) * (c * x + d * y + ty - v)) AS e FROM lm JOIN aff USING (case_id)) GROUP BY 1),
s AS (SELECT case_id, a * d - b * c AS det, (sqrt((a + d) * (a + d) + (c - b) * (c - b)) + sqrt((a - d) * (a - d) + (b + c) * (b + c))) / 2 AS hi,
  abs(sqrt((a + d) * (a + d) + (c - b) * (c - b)) - sqrt((a - d) * (a - d) + (b + c) * (b + c))) / 2 AS lo FROM aff)
SELECT case_id, CASE WHEN det > 0 AND lo >= 0.70 AND hi <= 1.35 AND hi / greatest(lo, 1e-12) <= 1.30 AND e2.s >= e1.s + 0.01 THEN 'affine' ELSE 'similarity' END AS choice,
med > 50 OR det <= 0 AS rejected FROM s JOIN e1 USING (case_id) JOIN e2 USING (case_id)"""


def polar_encoding(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x, y = F.col("c_acctbal") / 100, F.col("c_custkey") % 61 - 30.0
    ecc, sin, cos = polar(x, y, F.lit(100.0))
    return c.select("c_custkey", ecc, sin, cos).select("c_custkey", *[stable(F.col(k), 6).alias(k) for k in ("eccentricity", "angle_sin", "angle_cos")])


POLAR_SQL = f"""SELECT c_custkey, {sql_stable('r / 100', 6)} AS eccentricity, {sql_stable('CASE WHEN r = 0 THEN 0 ELSE y / r END', 6)} AS angle_sin,
{sql_stable('CASE WHEN r = 0 THEN 1 ELSE x / r END', 6)} AS angle_cos
FROM (SELECT *, sqrt(x * x + y * y) AS r FROM (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 61 - 30.0::DOUBLE AS y FROM customer))"""


def rescaled_points(spark, sf_dir):
    """Points to a 512 grid, through the case transform, and back to the target's native size."""
    marks = _landmarks(spark, sf_dir)
    fits = ge.similarity_fits(marks, ["case_id"]).drop("n")
    mapped = ge.map_on_grid(marks.join(fits, "case_id"), "x", "y", (F.lit(500.0), F.lit(500.0)), (F.lit(768.0), F.lit(512.0)))
    return mapped.select("landmark", stable(F.col("mapped_x"), 4).alias("mapped_x"), stable(F.col("mapped_y"), 4).alias("mapped_y"))


RESCALED_SQL = f"""WITH {LANDMARKS_SQL}, {SIMILARITY_SQL}, g AS (SELECT *, x * 512 / 500 AS gx, y * 512 / 500 AS gy FROM lm JOIN sim USING (case_id))
SELECT landmark, {sql_stable('(a * gx + b * gy + tx) * 768 / 512')} AS mapped_x, {sql_stable('(c * gx + d * gy + ty) * 512 / 512')} AS mapped_y FROM g"""


QUERIES = {
    "nearest_three": (nearest_three, NEAREST_SQL),
    "nearest_three_grid": (nearest_three_grid, NEAREST_SQL),
    "distance_rules": (distance_rules, DISTANCE_SQL),
    "scan_spacing": (scan_spacing, SPACING_SQL),
    "footprints": (footprints, f"""WITH {FOOTPRINT_SQL} SELECT p_partkey, first_x, last_x, greatest(last_x - first_x + 1, 0) AS sample_count, edge_clipped,
        last_x < first_x AS empty FROM prints"""),
    "footprint_samples": (footprint_samples, f"""WITH {FOOTPRINT_SQL}, r AS (SELECT *, unnest(range(first_x, last_x + 1)) AS sample_x FROM prints)
        SELECT p_partkey, sample_x - first_x + 1 AS sample_rank, sample_x, {sql_stable('(sample_x - c) * s', 6)} AS "offset", abs((sample_x - c) * s) <= 0.05 + 1e-10 AS inside FROM r"""),
    "crop_geometry": (crop_geometry, CROP_SQL),
    "reflected_crop": (reflected_crop, REFLECTED_SQL),
    "similarity_fit": (similarity_fit, f"WITH {LANDMARKS_SQL}, {SIMILARITY_SQL} SELECT case_id, n, {_COEF_SQL} FROM sim"),
    "affine_fit": (affine_fit, f"WITH {LANDMARKS_SQL}, {AFFINE_SQL} SELECT case_id, n, {_COEF_SQL} FROM aff"),
    "registration_error": (registration_error, REGISTRATION_SQL),
    "landmark_errors": (landmark_errors, f"""WITH {LANDMARKS_SQL}, {AFFINE_SQL}, p AS (SELECT landmark, u, v, a * x + b * y + tx AS pu, c * x + d * y + ty AS pv FROM lm JOIN aff USING (case_id))
        SELECT landmark, {sql_stable('pu', 3)} AS predicted_u, {sql_stable('pv', 3)} AS predicted_v, {sql_stable('sqrt((pu - u) * (pu - u) + (pv - v) * (pv - v))', 3)} AS error FROM p"""),
    "transform_plausibility": (transform_plausibility, PLAUSIBLE_SQL),
    "transform_choice": (transform_choice, CHOICE_SQL),
    "polar_encoding": (polar_encoding, POLAR_SQL),
    "rescaled_points": (rescaled_points, RESCALED_SQL),
}
