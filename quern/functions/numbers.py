"""Numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def three_way(c: Column, threshold: float = 0.8) -> Column:
    return F.when(c >= threshold, 1).when(c <= -threshold, -1).otherwise(0)


def to_byte(c: Column, low: float = -math.pi, high: float = math.pi) -> Column:
    return (clamp((c - low) / (high - low)) * 255).cast("int")


def quantize(c: Column, eps: float = 0.001) -> Column:
    """Cut towards zero to a multiple of eps."""
    return (c / eps).cast("bigint") * F.lit(eps)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two points; y0 where they share their x."""
    return F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0)))


def step(c: Column) -> Column:
    return F.when(c >= 0, 1.0).otherwise(0.0)


def gaussian(x: Column, mean: float, var: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * var)) / math.sqrt(2 * math.pi * var)


def gaussian2d(x: Column, y: Column, sigma: float) -> Column:
    return F.exp(-(x * x + y * y) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def steps(low: Column, high: Column, by: float) -> Column:
    """low, low + by, ... up to high, both ends in."""
    n = F.floor((high - low) / by + 1e-9).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: low + i * F.lit(by))).otherwise(F.array().cast("array<double>"))


def geometric(low: Column, high: Column, n: int) -> Column:
    """n values from low to high with equal ratios."""
    if n < 2:
        return F.array(low)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.pow(high / low, i / F.lit(float(n - 1))))


def _scaled(c: Column, units: dict[str, float]) -> Column:
    n = F.regexp_extract(c, r"^\s*([-+]?[\d,]*\.?\d+)", 1)
    n = F.replace(n, F.lit(","), F.lit("")).try_cast("double")
    u = F.lower(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1))
    out = F.when(u == "", n)
    for name, factor in units.items():
        out = out.when(u == name, n * factor)
    return out


def memory_bytes(c: Column) -> Column:
    """'5 kB' -> 5120.0; units of 1024."""
    units = {p + b: 1024.0**i for i, p in enumerate(("", "k", "m", "g", "t", "p")) for b in ("b", "ib", "") if p + b}
    return _scaled(c, units)


def metres(c: Column) -> Column:
    """'5 km' -> 5000.0."""
    # Lengths of the units in metres.
    units = {"m": 1.0, "meter": 1.0, "meters": 1.0, "km": 1000.0, "kilometers": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048, "feet": 0.3048}
    return _scaled(c, units)


def short_count(c: Column) -> Column:
    """'1.2K', '3M', '1,234' -> whole number."""
    return F.round(_scaled(c, {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12})).cast("bigint")
