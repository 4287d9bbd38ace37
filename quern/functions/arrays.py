"""Arrays and vectors, as higher-order functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO = 0.0


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(ZERO), lambda a, x: a + x.cast("double"))


def chunks(c: Column, n: int, pad: Column | None = None) -> Column:
    """Parts of n items; with `pad` the last one is filled up."""
    count = F.ceil(F.size(c) / n).cast("int")
    parts = F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(c, i * n + 1, F.lit(n)))).otherwise(F.slice(F.array(c), 1, 0))
    if pad is None:
        return parts
    return F.transform(parts, lambda p: F.when(F.size(p) < n, F.concat(p, F.array_repeat(pad, F.lit(n) - F.size(p)))).otherwise(p))


def pairwise(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def l1(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: F.abs(x - y)))


def l2_squared(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(pairwise(a, b, lambda x, y: F.abs(x - y)))


def lp(a: Column, b: Column, p: float) -> Column:
    """The p-distance; p = 0 counts differing components."""
    if p == 0:
        return total(pairwise(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    return F.pow(total(pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def intersection(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, F.least))


def chi_squared(a: Column, b: Column, eps: float = 1e-4) -> Column:
    return total(pairwise(a, b, lambda x, y: (x - y) * (x - y) / (x + y + eps)))


def bhattacharyya(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: F.sqrt(F.greatest(x * y, F.lit(0.0)))))


def dot(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scale_power(a: Column, value: float = 1.0, power: float = 2.0, eps: float = 1e-8) -> Column:
    """Scaled so that the powers sum to value; unchanged if they sum to less than eps."""
    s = F.aggregate(a, F.lit(ZERO), lambda t, x: t + F.pow(F.abs(x.cast("double")), F.lit(power)))
    k = F.when(s < eps, F.lit(1.0)).otherwise(F.pow(F.lit(value) / F.greatest(s, F.lit(eps)), F.lit(1.0 / power)))
    return F.transform(a, lambda x: x.cast("double") * k)


def unit(a: Column) -> Column:
    return scale_power(a)


def scale_total(a: Column, value: float = 1.0) -> Column:
    """Scaled to the given sum; null items if the sum is 0."""
    s = F.nullif(total(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") * value / s)


def grid_dims(n: Column) -> Column:
    """[columns, rows] of a near-square grid for n cells."""
    w = F.ceil(F.sqrt(n)).cast("int")
    return F.array(w, F.ceil(n / w).cast("int"))


def standardized(a: Column, means: Column, devs: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (2 (dev + eps)) per component."""
    centred = F.zip_with(a, means, lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, devs, lambda x, s: x / (2 * (s + eps)))


def pair_features(a: Column, b: Column) -> Column:
    """Absolute differences, squares of differences, products, means and both vectors, one after the other."""
    d = [lambda x, y: F.abs(x - y), lambda x, y: (x - y) * (x - y), lambda x, y: x * y, lambda x, y: (x + y) / 2]
    return F.concat(*[pairwise(a, b, f) for f in d], a.cast("array<double>"), b.cast("array<double>"))


def upper_median(a: Column) -> Column:
    """sorted[n // 2], not interpolated."""
    return F.try_element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)


def round_robin(a: Column, n: int) -> Column:
    """Items of an array of arrays dealt in turn, n at most; spent arrays are passed over."""
    longest = F.array_max(F.transform(a, lambda x: F.size(x)))
    rounds = F.transform(F.sequence(F.lit(0), F.greatest(longest, F.lit(1)) - 1), lambda i: F.transform(F.filter(a, lambda x: F.size(x) > i), lambda x: F.get(x, i)))
    return F.slice(F.flatten(rounds), 1, n)


def strided(a: Column, start: int = 0, step: int = 1, most: int = 50) -> Column:
    """Every step-th item from start, `most` at most."""
    kept = F.filter(a, lambda _, i: (i >= start) & (F.pmod(i - start, F.lit(step)) == 0))
    return F.slice(kept, 1, most)


def power_set(a: Column) -> Column:
    """All subsets of up to 20 items, in the order of their bit masks."""
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(a)).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(a, lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)).cast("bigint"), F.lit(2)) == 1))


def columns_spec(a: Column, spec: str) -> Column:
    """Components by a spec such as 5,0-3 (half open), in its order."""
    parts = []
    for p in spec.split(","):
        low, _, high = p.strip().partition("-")
        z = int(high) if high else int(low) + 1
        parts.append(F.slice(a, int(low) + 1, z - int(low)))
    return F.concat(*parts)


def flat(c: Column, kind: T.DataType) -> Column:
    """A nested array of any depth as one array; the depth comes from the type."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c


def shape(c: Column, kind: T.DataType) -> Column:
    """The sizes of a nested array along its first items."""
    out = []
    while isinstance(kind, T.ArrayType):
        out.append(F.size(c))
        c, kind = F.get(c, F.lit(0)), kind.elementType
    return F.array(*out)
