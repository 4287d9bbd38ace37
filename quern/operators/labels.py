"""Labels read from tags, checks of vectors, comparisons of arrays, cost profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import specialize
from .aggregates import running


def typed_tags(tags: DataFrame) -> DataFrame:
    """tags (id, key, value, type) with the value's own kind, without titles."""
    return tags.where("key <> 'title'").withColumn("v", specialize(F.col("value")))


def label_kinds(tags: DataFrame, impure: float = 0.1) -> DataFrame:
    """(type, key, kind, n): what the values of each key are.

    The most frequent kind of value wins if others make up less than `impure`, else the key is mixed. If ids repeat
    at that rate or more, it is multilabel; numbers are numeric; text whose values are all different is an id; the
    rest is multiclass.
    """
    t = typed_tags(tags)
    kinds = t.groupBy("type", "key", F.when(F.col("v.kind").isin("int", "float"), "number").otherwise(F.col("v.kind")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("value").alias("values"))
    w = W.partitionBy("type", "key")
    top = kinds.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "k"))).where("r = 1")
    repeated = 1 - F.col("ids") / F.col("n") >= impure
    kind = F.when(1 - F.col("n") / F.col("all") >= impure, "mixed").when(repeated, "multilabel").when(F.col("k") == "number", "numeric").when(F.col("values") == F.col("n"), "id").otherwise("multiclass")
    return top.select("type", "key", kind.alias("kind"), F.col("ids").alias("n"))


def by_label(labels: DataFrame) -> DataFrame:
    """(value, ids): the ids of each label."""
    return labels.groupBy("value").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def aligned(keys: DataFrame, labels: DataFrame, default: str = "unknown") -> DataFrame:
    """(id, value): one label per key, the smallest of several, a default where there is none."""
    one = labels.groupBy("id").agg(F.min("value").alias("value"))
    return keys.select("id").join(one, "id", "left").select("id", F.coalesce("value", F.lit(default)).alias("value"))


def binned(labels: DataFrame, bins: int = 20) -> DataFrame:
    """(id, bin): numbers as they are, or in equal bins if there are more distinct ones than bins."""
    s = labels.agg(F.countDistinct("value").alias("d"), F.min("value").alias("a"), F.max("value").alias("b")).first()
    if s["d"] <= bins:
        return labels.select("id", F.col("value").cast("double").alias("bin"))
    width = (s["b"] - s["a"]) / bins
    return labels.select("id", F.least(F.floor((F.col("value") - s["a"]) / width), F.lit(bins - 1)).cast("double").alias("bin"))


def signed_rows(labels: DataFrame, most_values: int = 1000) -> DataFrame:
    """(value, id, y): per label value, 1 for ids that have it and -1 for the others.

    There is a row for each id and value, and every task holds all values: over `most_values` raise an error.
    """
    values, ids = labels.select("value").distinct(), labels.select("id").distinct()
    if values.limit(most_values + 1).count() > most_values:
        raise ValueError(f"signed_rows takes at most {most_values} label values")
    have = labels.select("value", "id").distinct().withColumn("y", F.lit(1))
    return ids.crossJoin(F.broadcast(values)).join(have, ["value", "id"], "left").select("value", "id", F.coalesce("y", F.lit(-1)).alias("y"))


def dimension_check(df: DataFrame, vector: str) -> DataFrame:
    return df.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n"))


def nan_check(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, n): how many components of each vector are no numbers, where any is."""
    n = F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x)))
    return df.select(F.col(ident).alias("id"), n.alias("n")).where("n > 0")


def full_stats(a: Column) -> Column:
    """struct of mean, std, min, max, median, percentiles, signs, kurtosis, skew, geometric mean, entropy of an array."""
    names = ["mean", "std", "min", "max", "median", "p1", "p5", "p25", "p75", "p95", "p99", "kurtosis", "skew", "gmean", "entropy"]
    counts = ["n_neg", "n_zero", "n_pos"]

    @F.pandas_udf(T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], *[T.StructField(n, T.LongType()) for n in counts]]))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            x = np.asarray(v if v is not None else [], float)
            if not len(x):
                rows.append([None] * (len(names) + 3))
                continue
            d, sd = x - x.mean(), x.std()
            p = np.abs(x) / np.abs(x).sum() if np.abs(x).sum() else np.zeros(len(x))
            gmean = float(np.exp(np.log(x).mean())) if (x > 0).all() else None
            rows.append([x.mean(), sd, x.min(), x.max(), np.median(x), *np.percentile(x, [1, 5, 25, 75, 95, 99]), (d**4).mean() / sd**4 - 3 if sd else None, (d**3).mean() / sd**3 if sd else None, gmean, float(-(p[p > 0] * np.log(p[p > 0])).sum()), int((x < 0).sum()), int((x == 0).sum()), int((x > 0).sum())])
        return pd.DataFrame(rows, columns=[*names, *counts])

    return run(a)


def rank_correlations(a: Column, b: Column) -> Column:
    """struct(pearson, spearman, kendall, kl) of two arrays; kl of their absolute values scaled to sum 1."""
    names = ["pearson", "spearman", "kendall", "kl"]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for u, v in zip(x, y):
            p, q = pd.Series(u, dtype=float), pd.Series(v, dtype=float)
            s = np.sign(np.subtract.outer(p.values, p.values)) * np.sign(np.subtract.outer(q.values, q.values))
            tx, ty = (np.sign(np.subtract.outer(z.values, z.values)) != 0 for z in (p, q))
            both = np.sqrt(tx.sum() * ty.sum())
            f, g = (np.abs(z.values) + 1e-12 for z in (p, q))
            rows.append([p.corr(q), p.rank().corr(q.rank()), s.sum() / both if both else None, float((f / f.sum() * np.log(f / f.sum() / (g / g.sum()))).sum())])
        return pd.DataFrame(rows, columns=names)

    return run(a, b)


def map_at(df: DataFrame, score: str, label: str, ident: str) -> DataFrame:
    """One row: average precision of the ranking by score, ties by id, from running counts of rows and positives."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(ident).alias("i"), (F.col(label) == 1).cast("long").alias("y"))
    got = running(rows, "s", {"r": "1", "h": "y"}, "i")
    return got.where("y = 1").agg(F.avg(F.col("h") / F.col("r")).alias("map"))


#: Costs by input size, simplest first.
SHAPES = {"1": lambda n: np.ones_like(n), "log n": lambda n: np.log2(np.maximum(n, 2)), "n": lambda n: n, "n log n": lambda n: n * np.log2(np.maximum(n, 2)), "n^2": lambda n: n**2, "n^3": lambda n: n**3, "2^n": lambda n: 2.0 ** np.minimum(n, 60)}


def complexity(sizes: list[float], times: list[float]) -> str:
    """The shape that fits times by size with the least squared error, one factor each; earlier ones win ties."""
    n, t = np.asarray(sizes, float), np.asarray(times, float)
    errors = {}
    for name, f in SHAPES.items():
        x = f(n)
        errors[name] = float(((t - (x @ t) / (x @ x) * x) ** 2).mean())
    return min(errors, key=lambda k: (round(errors[k], 12), list(SHAPES).index(k)))


def cost_profile(log: DataFrame, block: str, size: str, value: str) -> DataFrame:
    """(block, shape): mean cost per size of each block, then its shape."""
    means = log.groupBy(F.col(block).alias("block"), F.col(size).cast("double").alias("size")).agg(F.avg(value).alias("mean"))
    lists = means.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("size", "mean"))).alias("a"))

    @F.pandas_udf(T.StringType())
    def shape(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: complexity([r["size"] for r in rows], [r["mean"] for r in rows]))

    return lists.select("block", shape("a").alias("shape"))


def ranked_peaks(values: list[float], least: int, factor: float = 0.9) -> list[int]:
    """Places of peaks, those that top the widest neighbourhood first; the width shrinks by the factor down to `least`."""
    x, out, width = np.asarray(values, float), [], max(1.0, len(values) / 2)
    while width >= max(1, least):
        w = int(width)
        for i in range(len(x)):
            if i not in out and x[i] >= x[max(0, i - w) : i + w + 1].max() and (len(x) < 2 or x[i] > x[max(0, i - w) : i + w + 1].min()):
                out.append(i)
        width *= factor
    return out
