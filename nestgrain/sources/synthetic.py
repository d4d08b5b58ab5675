"""Synthetic nested cohort with participant, visit and eye effects.

Every draw is a hash of (seed, entity, name), so a row does not depend on
partitioning and the same seed always gives the same cohort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortConfig:
    participants: int = 30
    visits: int = 2
    eyes: tuple[str, ...] = ("L", "R")
    points: int = 37
    seed: int = 42


# The generator's structural coefficients.
THICKNESS = {"base": 105.0, "severity": -30.0, "eccentricity": -14.0, "progression": -3.0, "noise": 5.0}
REFLECTIVITY = {"base": 0.72, "severity": -0.20, "eccentricity": -0.08, "progression": 0.0, "noise": 0.045}
ROUGHNESS = {"base": 2.5, "severity": 3.5, "eccentricity": 1.3, "progression": 0.0, "noise": 0.7}
PARTICIPANT_SD, EYE_SD, NOISE_SD = 2.2, 0.7, 3.0


def uniform(seed: int, name: str, *entity: Column) -> Column:
    """In (0, 1), from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), *entity), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def normal(seed: int, name: str, *entity: Column) -> Column:
    radius = F.sqrt(-2.0 * F.log(uniform(seed, name + "/r", *entity)))
    return radius * F.cos(2 * 3.141592653589793 * uniform(seed, name + "/a", *entity))


def synthetic_cohort(spark: SparkSession, config: CohortConfig = CohortConfig()) -> DataFrame:
    c, s = config, config.seed
    last = c.points - 1
    people = spark.range(c.participants).select((F.col("id") + 1).alias("p"))
    exams = people.withColumn("visit_no", F.explode(F.sequence(F.lit(0), F.lit(c.visits - 1)))).withColumn(
        "eye", F.explode(F.array(*[F.lit(e) for e in c.eyes])))
    p, v, e = F.col("p"), F.col("visit_no"), F.col("eye")
    # a random permutation of the evenly spaced eccentricities, one short array per exam
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.struct(uniform(s, "order", p, v, e, i).alias("u"), i.alias("i"))))
    points = exams.select("*", F.posexplode(shuffled).alias("k", "draw"))
    eccentricity = 0.05 + F.col("draw.i") * (0.95 / max(last, 1))
    angle = -3.141592653589793 + F.col("k") * (2 * 3.141592653589793 / c.points)
    points = points.withColumns({
        "eccentricity": eccentricity, "angle_sin": F.sin(angle), "angle_cos": F.cos(angle), "point": F.col("k") + 1,
        "severity": uniform(s, "severity", p), "progression": v * (0.2 + 1.2 * uniform(s, "progression", p, v)),
    })

    def layer(name: str, w: dict) -> Column:
        return (w["base"] + w["severity"] * F.col("severity") + w["eccentricity"] * F.col("eccentricity")
                + w["progression"] * F.col("progression") + w["noise"] * normal(s, name, p, v, e, F.col("k")))

    points = points.withColumns({
        "retinal_thickness": layer("thickness", THICKNESS), "reflectivity": layer("reflectivity", REFLECTIVITY), "roughness": layer("roughness", ROUGHNESS)})
    latent = (  # fixed values: the coefficients of the response
        8.0 + 0.13 * F.col("retinal_thickness") + 11.0 * F.col("reflectivity") - 0.75 * F.col("roughness") - 5.0 * F.col("eccentricity")
        + PARTICIPANT_SD * normal(s, "participant", p) + EYE_SD * normal(s, "eye", p, v, e) - F.col("progression")
        + NOISE_SD * normal(s, "noise", p, v, e, F.col("k")))
    clipped = F.least(F.greatest(latent, F.lit(-1.0)), F.lit(30.0))
    return points.select(
        F.concat(F.lit("SYN-"), F.format_string("%03d", "p")).alias("participant_id"), F.concat(F.lit("V"), (v + 1).cast("string")).alias("visit"),
        "eye", "point", "eccentricity", "angle_sin", "angle_cos", "retinal_thickness", "reflectivity", "roughness",
        F.when(clipped < 1.0, -1.0).otherwise(clipped).alias("sensitivity_db"))
