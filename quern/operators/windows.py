"""Ordered analytics. Every function takes a window spec, or a partition and an order with a unique tiebreak."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(c: Column, w: WindowSpec, start: float = 0.0) -> Column:
    return F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.lit(start)


def forward_difference(c: Column, w: WindowSpec) -> Column:
    """The next value less this one; 0 at the end."""
    return F.coalesce(F.lead(c).over(w) - c, F.lit(0.0))


def extremum(c: Column, w: WindowSpec) -> Column:
    """'max' or 'min' at strict local extrema, 'end' at both ends, else null."""
    a, b = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(a.isNull() | b.isNull(), "end").when((c > a) & (c > b), "max").when((c < a) & (c < b), "min")


def z_score(c: Column, by: WindowSpec, devs: float = 2.0) -> Column:
    """(x - mean) over `devs` population deviations; 0 where nothing varies."""
    s = F.stddev_pop(c).over(by)
    return F.when(s == 0, 0.0).otherwise((c - F.avg(c).over(by)) / (s * devs))


def min_max(c: Column, by: WindowSpec, low: float = 0.0, high: float = 1.0) -> Column:
    a, b = F.min(c).over(by), F.max(c).over(by)
    return F.when(a == b, F.lit(low)).otherwise((c - a) / F.nullif(b - a, F.lit(0.0)) * (high - low) + low)


def share(c: Column, by: WindowSpec) -> Column:
    return c / F.nullif(F.sum(c).over(by), F.lit(0.0))


def gaussian_kernel(variance: float, width: int | None = None) -> list[float]:
    """Weights that sum to 1, 6 * int(variance + 0.99) + 1 of them unless told."""
    n = width or 6 * int(variance + 0.99) + 1
    raw = [math.exp(-((i - n // 2) ** 2) / (2 * variance)) for i in range(n)]
    return [x / sum(raw) for x in raw]


def smoothed(c: Column, w: WindowSpec, kernel: list[float]) -> Column:
    """Convolution along the window; beyond its ends the first and last value go on."""
    first, last = F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)), F.last(c).over(w.rowsBetween(0, W.unboundedFollowing))
    half = len(kernel) // 2
    out = F.lit(0.0)
    for i, k in enumerate(kernel):
        d = i - half
        v = F.coalesce(F.lead(c, d).over(w), last) if d > 0 else F.coalesce(F.lag(c, -d).over(w), first) if d < 0 else c
        out = out + v * k
    return out


def signal_window(n: int, kind: str = "rect") -> list[float]:
    """rect, tri, hamming, hann or lanczos weights of n points."""
    x = [i / (n - 1) if n > 1 else 0.5 for i in range(n)]
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    shape = {"rect": lambda _: 1.0, "tri": lambda t: 1 - abs(2 * t - 1), "hamming": lambda t: 0.54 - 0.46 * math.cos(2 * math.pi * t), "hann": lambda t: 0.5 - 0.5 * math.cos(2 * math.pi * t), "lanczos": lambda t: sinc(2 * t - 1)}
    return [shape[kind](t) for t in x]


def kernel_weight(distance: Column, reach: float, kind: str = "linear") -> Column:
    """linear, constant, exp or sqrt weight of a distance; 0 from `reach` on."""
    x = F.abs(distance) / reach
    shape = {"linear": 1 - x, "constant": F.lit(1.0), "exp": F.exp(-x), "sqrt": F.sqrt(F.greatest(1 - x, F.lit(0.0)))}
    return F.when(x >= 1, 0.0).otherwise(shape[kind])


def islands(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """(by, island, key, n, first, last): runs of consecutive rows with an equal key."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    marked = df.withColumn("new_", new).withColumn("island", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.first(key).alias(key), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def interpolated(df: DataFrame, by: str, x: str, y: str, grid: DataFrame, at: str) -> DataFrame:
    """(by, at, value): piecewise-linear values at the grid's points, clamped at the ends.

    Grid points and data meet in one union, ordered once per key; each point takes its neighbours by last and first
    non-null values, so no range join is needed.
    """
    both = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(False).alias("q")).union(grid.select(by, F.col(at).cast("double"), F.lit(None).cast("double"), F.lit(True)))
    w = W.partitionBy(by).orderBy("x", "q")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    have = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    got = both.withColumn("a", F.last(have, True).over(back)).withColumn("b", F.first(have, True).over(ahead)).where("q")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    slope = (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    return got.where(a.isNotNull()).select(by, F.col("x").alias(at), F.when((F.col("a").isNull()) | (F.col("b").isNull()) | (a["x"] == b["x"]), a["y"]).otherwise(a["y"] + slope * (F.col("x") - a["x"])).alias("value"))


def resampled(df: DataFrame, by: str, x: str, y: str, start: float, end: float, parts: int, smoothing: float = 1.0) -> DataFrame:
    """(by, t, n, mean): means over windows of +- smoothing steps at parts + 1 regular points.

    A row goes to the few grid points that it is near, by arithmetic on its own position.
    """
    delta = (end - start) / parts
    pos = (F.col(x) - start) / delta
    low, high = F.greatest(F.ceil(pos - smoothing), F.lit(0)), F.least(F.floor(pos + smoothing), F.lit(parts))
    near = df.withColumn("g", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))))
    return near.groupBy(by, (F.lit(start) + F.col("g") * F.lit(delta)).alias("t")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def halving_means(df: DataFrame, by: str, x: str, y: str, now: float, period: float, parts: int = 5) -> DataFrame:
    """(by, mean): the mean over trailing windows of period, period / 2, ... of each window's mean."""
    out = df.groupBy(by).agg(*[F.avg(F.when((F.col(x) > now - period / 2**i) & (F.col(x) <= now), F.col(y))).alias(f"m{i}") for i in range(parts)])
    have = F.array_compact(F.array(*[f"m{i}" for i in range(parts)]))
    return out.select(by, (F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(have), F.lit(0))).alias("mean"))


def time_weighted_mean(x: Column, y: Column, now: Column, factor: float) -> Column:
    """An aggregate: the mean of y weighted by exp(-factor * age)."""
    wt = F.exp(-(now - x) * factor)
    return F.sum(y * wt) / F.sum(wt)


def regular_grid(start: float, end: float, step: float, from_middle: bool = False) -> list[float]:
    n = int((end - start) / step + 1e-9)
    g = [start + i * step for i in range(n + 1)]
    return sorted(g, key=lambda t: (abs(t - (start + end) / 2), t)) if from_middle else g


def best_offset(df: DataFrame, start: str, energy_at: str, levels: list[tuple[float, float]], low: float, high: float) -> float:
    """The shift of `start` times that meets the most positive energy, by coarse-to-fine grids of (step, reach).

    df holds the starts; each level scores its bounded grid in one aggregate, with the energy an SQL expression of t.
    """
    best = (low + high) / 2
    reach = (high - low) / 2
    for step, around in levels:
        grid = regular_grid(best - reach, best + reach, step)
        sums = [F.sum(F.greatest(F.expr(energy_at.replace("{t}", f"({start} + {g!r}D)")), F.lit(0.0))).alias(f"g{i}") for i, g in enumerate(grid)]
        row = df.agg(*sums).first()
        best = max(zip(grid, row), key=lambda p: (p[1] if p[1] is not None else 0.0, -abs(p[0])))[0]
        reach = around
    return best
