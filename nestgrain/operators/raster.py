"""Raster rules: palette ranges and the positions of a fitted test grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three rings of the test grid.
RING_SCALES = (0.2, 0.6, 1.0)
MARKERS_PER_RING = 12


def palette_range(red: Column, green: Column, blue: Column) -> tuple[Column, Column]:
    """Lowest and highest label value a marker colour allows."""
    rules = [  # fixed values
        (F.greatest(red, green, blue) <= 12, -1, -1), ((blue >= 40) & (blue > green), 0, 4),
        ((red >= 220) & (green < 50), 5, 9), ((red >= 200) & (green >= 50), 10, 25), ((green >= 180) & (red < 200), 24, 36),
    ]
    low, high = F.lit(-1), F.lit(36)
    for condition, a, b in reversed(rules):
        low, high = F.when(condition, a).otherwise(low), F.when(condition, b).otherwise(high)
    return low, high


def grid_locations(fits: DataFrame, case: list[str]) -> DataFrame:
    """The 37 expected positions of each fitted grid: three rings of twelve and the centre."""
    rings = F.array(*[
        F.struct(F.lit(name).alias("ring"), F.lit(scale).alias("scale"), F.lit(i).alias("angle_index"))
        for name, scale in zip(("inner", "middle", "outer"), RING_SCALES) for i in range(MARKERS_PER_RING)
    ], F.struct(F.lit("centre").alias("ring"), F.lit(0.0).alias("scale"), F.lit(0).alias("angle_index")))
    spots = fits.withColumn("__s", F.explode(rings))
    angle = F.col("base_angle") + F.col("__s.angle_index") * (2 * math.pi / MARKERS_PER_RING)
    radius = F.col("outer_radius") * F.col("__s.scale")
    return spots.select(
        *case, F.col("__s.ring").alias("ring"), F.col("__s.angle_index").alias("angle_index"),
        (F.col("centre_x") + radius * F.cos(angle)).alias("x"), (F.col("centre_y") + radius * F.sin(angle)).alias("y"))
