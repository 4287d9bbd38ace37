"""Curves through points: piecewise-linear and nearest-neighbour interpolation, projection, curvature.

A curve is an array column of struct(i, x, y), sorted by i; everything stays in one row and in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_segment


def curves(df: DataFrame, by: str, i: str, x: str, y: str) -> DataFrame:
    """(by, curve): the points of each key as a curve."""
    p = F.struct(F.col(i).cast("double").alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return df.groupBy(by).agg(F.array_sort(F.collect_list(p)).alias("curve"))


def _pieces(curve: Column) -> Column:
    n = F.size(curve)
    return F.zip_with(F.slice(curve, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(curve, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def interpolate(curve: Column, q: Column) -> Column:
    """struct(x, y) at an index, on the line between its neighbours, clamped at the ends."""
    first, last = F.get(curve, F.lit(0)), F.element_at(curve, -1)
    hit = F.try_element_at(F.filter(_pieces(curve), lambda p: (p["a"]["i"] <= q) & (q <= p["b"]["i"])), F.lit(1))
    t = (q - hit["a"]["i"]) / F.nullif(hit["b"]["i"] - hit["a"]["i"], F.lit(0.0))
    between = F.struct(*[(hit["a"][c] + F.coalesce(t, F.lit(0.0)) * (hit["b"][c] - hit["a"][c])).alias(c) for c in ("x", "y")])
    end = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.when(q <= first["i"], end(first)).when(q >= last["i"], end(last)).otherwise(between)


def project(curve: Column, x: Column, y: Column) -> Column:
    """struct(distance, x, y): the nearest point of the curve."""
    near = F.transform(_pieces(curve), lambda p: point_segment(x, y, p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    only = F.get(curve, F.lit(0))
    alone = point_segment(x, y, only["x"], only["y"], only["x"], only["y"])
    return F.coalesce(F.array_min(near), alone)


def curvature(curve: Column, q: Column, reach: float) -> Column:
    """1 + the cosine of the angle at an index between the curve `reach` before and behind: 0 where it is straight,
    2 where it turns back; null where a side has no length."""
    c, a, b = interpolate(curve, q), interpolate(curve, q - reach), interpolate(curve, q + reach)
    ux, uy, vx, vy = a["x"] - c["x"], a["y"] - c["y"], b["x"] - c["x"], b["y"] - c["y"]
    return 1 + (ux * vx + uy * vy) / F.nullif(F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)), F.lit(0.0))


def nearest_index(curve: Column, q: Column) -> Column:
    """The point whose index is nearest, the earlier of two."""
    order = F.array_sort(F.transform(curve, lambda p: F.struct(F.abs(p["i"] - q).alias("d"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    best = F.get(order, F.lit(0))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))


def nearest_mean(curve: Column, x: Column, y: Column, k: int = 1) -> Column:
    """struct(distance, i): distance to the nearest point, and the mean index of the k nearest."""
    d = lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))
    order = F.slice(F.array_sort(F.transform(curve, lambda p: F.struct(d(p).alias("d"), p["i"].alias("i")))), 1, k)
    return F.struct(F.get(order, F.lit(0))["d"].alias("distance"), (F.aggregate(order, F.lit(0.0), lambda a, p: a + p["i"]) / F.size(order)).alias("i"))


def sample(points: Column, at: Column) -> Column:
    """y at x on an array of struct(x, y) sorted by x, clamped at the ends."""
    curve = F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("i"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return interpolate(curve, at)["y"]
