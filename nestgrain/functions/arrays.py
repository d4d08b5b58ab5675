"""Array (vector / raster) expressions built from higher-order functions.

A lambda body is evaluated once per element, so anything that does not depend on
the element is bound outside it with ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def population_sd(values: Column) -> Column:
    def spread(centre: Column) -> Column:
        squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - centre) * (v - centre))
        return F.sqrt(F.try_divide(squares, F.size(values)))

    return let(mean(values), spread)


def standardise(values: Column) -> Column:
    """Z-scores with the population SD; a flat input becomes all zeros."""
    def scaled(bound: Column) -> Column:
        return F.transform(
            bound["v"], lambda v: F.when(bound["sd"] > 0, (v - bound["mean"]) / bound["sd"]).otherwise(F.lit(0.0)))

    def with_moments(v: Column) -> Column:
        return let(F.struct(v.alias("v"), mean(v).alias("mean"), population_sd(v).alias("sd")), scaled)

    return let(values, with_moments)


def unit(values: Column) -> Column:
    """Scaled to length one; a zero vector is left as it is."""
    def scaled(bound: Column) -> Column:
        return F.transform(bound["v"], lambda v: F.when(bound["n"] > 0, v / bound["n"]).otherwise(v))

    return let(values, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def stride_sample(flat: Column, width: int, stride: int) -> Column:
    """Every ``stride``-th row and column of a row-major flattened raster."""
    def kept(value: Column, index: Column) -> Column:
        row, col = F.floor(index / F.lit(width)), index % F.lit(width)
        return (row % F.lit(stride) == 0) & (col % F.lit(stride) == 0)

    return F.filter(flat, kept)


def fingerprint(flat: Column, width: int, stride: int) -> Column:
    """Stride-sampled raster as z-scores: the dot product of two, over d, is their correlation."""
    return standardise(stride_sample(as_doubles(flat), width, stride))


def adjacent_gaps(values: Column) -> Column:
    """values[i+1] - values[i]; empty for fewer than two entries."""
    count = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, count), F.slice(values, 1, count), lambda after, before: after - before)


def _at(ordered: Column, q: float) -> Column:
    position = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(position).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.ceil(position).cast("int"))
    return below + (above - below) * (position - low)


def array_percentile(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of one array (a bounded vector, not a column of rows)."""
    return let(F.array_sort(values), lambda ordered: _at(ordered, q))


def percentile_scale(values: Column, low_q: float, high_q: float, floor: float = 1.0) -> Column:
    """Clip-and-scale to [0, 1] between two percentiles; the span is at least ``floor``."""
    def scaled(bound: Column) -> Column:
        span = F.greatest(bound["high"] - bound["low"], F.lit(floor))
        return let(span, lambda s: F.transform(
            bound["v"], lambda v: F.least(F.greatest((v - bound["low"]) / s, F.lit(0.0)), F.lit(1.0))))

    def with_limits(v: Column) -> Column:
        limits = let(F.array_sort(v), lambda o: F.struct(v.alias("v"), _at(o, low_q).alias("low"), _at(o, high_q).alias("high")))
        return let(limits, scaled)

    return let(values, with_limits)


def reflected(index: Column, width: Column) -> Column:
    """A column index mirrored at both borders as often as needed; the border columns are not repeated."""
    period = F.greatest(2 * (width - 1), F.lit(1))
    inside = F.pmod(index, period)
    return F.when(inside < width, inside).otherwise(period - inside)


def _resize_weights(source: Column, target: int) -> Column:
    """For every target column: the first source column it reads and the weights from there on (triangle filter, sum 1)."""
    scale = source / F.lit(float(target))
    reach = F.greatest(scale, F.lit(1.0))

    def of(bound: Column) -> Column:
        def weights(x: Column) -> Column:
            centre = (x + F.lit(0.5)) * bound["scale"]
            first = F.greatest(F.floor(centre - bound["reach"] + 0.5), F.lit(0)).cast("int")
            last = F.least(F.floor(centre + bound["reach"] + 0.5), bound["source"]).cast("int")

            def raw(place: Column) -> Column:
                return F.transform(F.sequence(place["first"], place["last"] - 1), lambda k: F.greatest(
                    1 - F.abs((k - place["centre"] + 0.5) / bound["reach"]), F.lit(0.0)))

            def scaled(place: Column) -> Column:
                return let(raw(place), lambda w: let(total(w), lambda t: F.struct(
                    place["first"].alias("first"), F.transform(w, lambda v: v / t).alias("w"))))

            return let(F.struct(centre.alias("centre"), first.alias("first"), last.alias("last")), scaled)

        return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), weights)

    return let(F.struct(scale.alias("scale"), reach.alias("reach"), source.cast("int").alias("source")), of)


def reflected_crop(flat: Column, width: int, crop_x0: Column, crop_width: Column, target: int) -> Column:
    """Columns crop_x0 .. crop_x0 + crop_width - 1 of a row-major raster, full height, resized to ``target`` columns.

    Columns beyond the borders are reflections. Resizing is linear with a triangle filter that
    widens when it shrinks; values stay real numbers. A raster of another shape gives NULL.
    """
    whole = F.size(flat) % F.lit(width) == 0

    def crop(bound: Column) -> Column:
        def row(r: Column) -> Column:
            def cell(place: Column) -> Column:
                weighted = F.transform(place["w"], lambda w, k: w * F.get(
                    bound["v"], (r * F.lit(width) + reflected(bound["x0"] + place["first"] + k, F.lit(width))).cast("int")))
                return total(weighted)

            return F.transform(bound["weights"], cell)

        return F.flatten(F.transform(F.sequence(F.lit(0), bound["rows"] - 1), row))

    rows = (F.size(flat) / width).cast("int")
    parts = F.struct(as_doubles(flat).alias("v"), crop_x0.cast("int").alias("x0"), rows.alias("rows"), _resize_weights(crop_width, target).alias("weights"))
    return F.when(whole & (F.size(flat) > 0), let(parts, crop))
