"""Planar geometry: segment projection, footprints, spacing and landmark transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import guarded_ceil, guarded_floor, half_even
from .contracts import require_empty
from .joins import enumerate_range
from .ordered import exact_percentiles, previous_value


def project_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Foot of the perpendicular clamped to the segment, as a struct; NULL for a zero-length segment."""
    dx, dy = bx - ax, by - ay
    raw = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    fx, fy = ax + t * dx, ay + t * dy
    # greatest/least skip NULLs, so a degenerate segment must be ruled out here
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw.alias("t_raw"), t.alias("t"), (~raw.between(0.0, 1.0)).alias("clipped"),
            fx.alias("foot_x"), fy.alias("foot_y"), F.hypot(px - fx, py - fy).alias("distance"),
        ),
    )


def require_proper_segments(segments: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    ax, ay, bx, by = columns
    require_empty(
        segments.where((F.col(ax) == F.col(bx)) & (F.col(ay) == F.col(by))), "zero-length scan segments"
    )
    return segments


def scan_spacing(segments: DataFrame, case: list[str], index: str, columns: tuple[str, str, str, str], largest: int | None = None) -> DataFrame:
    """Distance between successive segment midpoints: minimum, exact median, maximum; and the bounding box."""
    ax, ay, bx, by = (F.col(c) for c in columns)
    mids = segments.withColumn("__mid", F.struct(((ax + bx) / 2).alias("x"), ((ay + by) / 2).alias("y")))
    stepped = previous_value(mids, case, [index], "__mid", "__prev", largest)
    stepped = stepped.withColumn(
        "__gap", F.hypot(F.col("__mid.x") - F.col("__prev.x"), F.col("__mid.y") - F.col("__prev.y"))
    )
    basic = stepped.groupBy(*case).agg(
        F.min("__gap").alias("min_spacing"), F.max("__gap").alias("max_spacing"),
        F.min(F.least(ax, bx)).alias("area_x0"), F.min(F.least(ay, by)).alias("area_y0"),
        F.max(F.greatest(ax, bx)).alias("area_x1"), F.max(F.greatest(ay, by)).alias("area_y1"),
        F.count(F.lit(1)).alias("n_scans"),
    )
    return basic.join(exact_percentiles(stepped, case, "__gap", {"median_spacing": 0.5}, largest), case, "left")


def inside_box(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def inside_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Half-open pixel bounds."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def footprints(df: DataFrame, centre: str, scale: str, width: str, diameter: float) -> DataFrame:
    """Integer columns inside a footprint: bounds, count, clipping. ``scale`` is length per column."""
    radius = F.lit(diameter / 2.0) / F.col(scale)
    out = df.withColumn("left_x", F.col(centre) - radius).withColumn("right_x", F.col(centre) + radius)
    out = out.withColumn("first_x", F.greatest(guarded_ceil(F.col("left_x")), F.lit(0)).cast("bigint"))
    out = out.withColumn("last_x", F.least(guarded_floor(F.col("right_x")), F.col(width) - 1).cast("bigint"))
    out = out.withColumn("sample_count", F.greatest(F.col("last_x") - F.col("first_x") + 1, F.lit(0)))
    edge = (F.col("left_x") < 0) | (F.col("right_x") > F.col(width) - 1)
    return out.withColumn("edge_clipped", edge).withColumn("empty", F.col("sample_count") == 0)


def footprint_samples(prints: DataFrame, centre: str, scale: str, diameter: float) -> DataFrame:
    """One row per column inside each footprint with its rank and signed offset; empty ones yield nothing."""
    rows = enumerate_range(prints, "first_x", "last_x", "sample_x")
    rows = rows.withColumn("sample_rank", F.col("sample_x") - F.col("first_x") + 1)
    rows = rows.withColumn("offset", (F.col("sample_x") - F.col(centre)) * F.col(scale))
    return rows.withColumn("inside", F.abs("offset") <= F.lit(diameter / 2.0 + 1e-10))


def crop_columns(centre: Column, scale: Column, width: Column, crop_length: float, pad_limit: float = 0.25) -> dict[str, Column]:
    """Physical-width crop bounds around a centre: padding left/right and whether it is excessive."""
    source = F.greatest(half_even(F.lit(crop_length) / scale).cast("bigint"), F.lit(3).cast("bigint"))
    x0 = half_even(centre).cast("bigint") - F.floor(source / 2)
    x1 = x0 + source
    left, right = F.greatest(-x0, F.lit(0)), F.greatest(x1 - width, F.lit(0))
    share = (left + right) / source
    return {
        "crop_x0": x0, "crop_x1": x1, "crop_width": source, "pad_left": left, "pad_right": right,
        "padded_fraction": share, "excessive_padding": share > pad_limit,
    }


# ---- landmark transforms --------------------------------------------------------

def _moments(landmarks: DataFrame, case: list[str]) -> DataFrame:
    """Means and centred second moments of moving (x, y) and fixed (u, v) landmarks per case."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in ("x", "y", "u", "v"):
        aggs.append(F.avg(name).alias(f"m_{name}"))
    pairs = ("xx", "xy", "yy", "xu", "xv", "yu", "yv")
    aggs += [F.covar_pop(pair[0], pair[1]).alias(f"c_{pair}") for pair in pairs]
    return landmarks.groupBy(*case).agg(*aggs)


def similarity_fits(landmarks: DataFrame, case: list[str]) -> DataFrame:
    """Least-squares scale + rotation + translation per case, in closed form from moments.

    Columns x, y map to u, v. Reflections are excluded by construction.
    """
    m = _moments(landmarks, case)
    base = F.col("c_xx") + F.col("c_yy")
    p = F.try_divide(F.col("c_xu") + F.col("c_yv"), base)
    q = F.try_divide(F.col("c_xv") - F.col("c_yu"), base)
    return m.select(
        *case, p.alias("a"), (-q).alias("b"), q.alias("c"), p.alias("d"),
        (F.col("m_u") - (p * F.col("m_x") - q * F.col("m_y"))).alias("tx"),
        (F.col("m_v") - (q * F.col("m_x") + p * F.col("m_y"))).alias("ty"), "n",
    )


def affine_fits(landmarks: DataFrame, case: list[str]) -> DataFrame:
    """Least-squares affine map per case; NULL coefficients when the landmarks are collinear."""
    m = _moments(landmarks, case)
    det = F.col("c_xx") * F.col("c_yy") - F.col("c_xy") * F.col("c_xy")
    size = (F.col("c_xx") + F.col("c_yy")) * (F.col("c_xx") + F.col("c_yy"))
    det = F.when(det > 1e-12 * size, det)

    def row(target: str) -> tuple[Column, Column]:
        cx, cy = F.col(f"c_x{target}"), F.col(f"c_y{target}")
        first = (cx * F.col("c_yy") - cy * F.col("c_xy")) / det
        return first, (cy * F.col("c_xx") - cx * F.col("c_xy")) / det

    a, b = row("u")
    c, d = row("v")
    return m.select(
        *case, a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"),
        (F.col("m_u") - a * F.col("m_x") - b * F.col("m_y")).alias("tx"),
        (F.col("m_v") - c * F.col("m_x") - d * F.col("m_y")).alias("ty"), "n",
    )


def apply_transform(x: Column, y: Column) -> tuple[Column, Column]:
    """Map (x, y) by the joined columns a, b, c, d, tx, ty."""
    return (
        F.col("a") * x + F.col("b") * y + F.col("tx"),
        F.col("c") * x + F.col("d") * y + F.col("ty"),
    )


def registration_errors(landmarks: DataFrame, transforms: DataFrame, case: list[str]) -> DataFrame:
    """Per-landmark distance between the mapped and the observed fixed position."""
    joined = landmarks.join(transforms, case)
    u, v = apply_transform(F.col("x"), F.col("y"))
    return joined.select(
        *landmarks.columns, u.alias("predicted_u"), v.alias("predicted_v"),
        F.hypot(u - F.col("u"), v - F.col("v")).alias("error"),
    )


def error_summary(errors: DataFrame, case: list[str], largest: int | None = None) -> DataFrame:
    basic = errors.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_landmarks"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error")
    )
    return basic.join(exact_percentiles(errors, case, "error", {"median_error": 0.5}, largest), case, "left")


def plausibility(transforms: DataFrame) -> DataFrame:
    """Determinant, singular values and condition number of each 2x2 part, with the accept rule."""
    a, b, c, d = (F.col(k) for k in "abcd")
    det = a * d - b * c
    # singular values of a 2x2 matrix from its conformal and anti-conformal parts
    keep = F.hypot(a + d, c - b)
    flip = F.hypot(a - d, b + c)
    high, low = (keep + flip) / 2, F.abs(keep - flip) / 2
    out = transforms.withColumn("determinant", det).withColumn("scale_max", high).withColumn("scale_min", low)
    out = out.withColumn("condition_number", F.col("scale_max") / F.greatest(F.col("scale_min"), F.lit(1e-12)))
    ok = (
        (F.col("determinant") > 0) & (F.col("scale_min") >= 0.70)
        & (F.col("scale_max") <= 1.35) & (F.col("condition_number") <= 1.30)
    )
    return out.withColumn("plausible", F.coalesce(ok, F.lit(False)))


def recommend(similarity_score: Column, affine_score: Column, affine_plausible: Column, margin: float = 0.01) -> Column:
    """Affine only when plausible, finite and better by the margin."""
    better = affine_plausible & affine_score.isNotNull() & ~F.isnan(affine_score) & (affine_score >= similarity_score + margin)
    return F.when(better, "affine").otherwise("similarity")


def reject_landmarks(median_error: Column, determinant: Column, limit: float = 50.0) -> Column:
    return F.coalesce((median_error > limit) | (determinant <= 0), F.lit(True))


def map_on_grid(
    joined: DataFrame, x: str, y: str, moving_size: tuple[Column, Column], fixed_size: tuple[Column, Column], grid: float = 512.0
) -> DataFrame:
    """Scale to a common square grid, apply the joined transform, scale to the target's native size."""
    u, v = apply_transform(F.col(x) * grid / moving_size[0], F.col(y) * grid / moving_size[1])
    return joined.withColumn("mapped_x", u * fixed_size[0] / grid).withColumn("mapped_y", v * fixed_size[1] / grid)
