"""Histograms, statistics and classifier measures as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, width: float | None = None, weight: Column | None = None, normalize: bool = False) -> DataFrame:
    """(bin, n): counts or weights per value, or per bin of a width named by its lower edge."""
    b = F.floor(value / width) * F.lit(width) if width else value
    out = df.groupBy(b.alias("bin")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    return out.withColumn("n", F.col("n") / F.sum("n").over(W.partitionBy())) if normalize else out


def nearest_centre(value: Column, centres: list[float]) -> Column:
    """The nearest of the centres by the midpoints between them; a midpoint belongs to the upper one."""
    cs = sorted(centres)
    out = F.lit(cs[0])
    for a, b in zip(cs, cs[1:]):
        out = F.when(value >= (a + b) / 2, F.lit(b)).otherwise(out)
    return F.when(value.isNotNull(), out)


def centre_edges(centres: list[float]) -> list[float]:
    return [-1e99, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], 1e99]


def cumulative(hist: DataFrame) -> DataFrame:
    """(bin, n, total): running sums by bin; for histograms, which are small."""
    return hist.withColumn("total", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def aligned(hists: dict[str, DataFrame]) -> DataFrame:
    """(bin, one column per histogram), zeros where one lacks the bin."""
    long = None
    for name, h in hists.items():
        one = h.select("bin", F.lit(name).alias("which"), "n")
        long = one if long is None else long.union(one)
    return long.groupBy("bin").pivot("which", list(hists)).agg(F.sum("n")).na.fill(0)


def folded(hist: DataFrame, into: Column, when: Column) -> DataFrame:
    """Bins that satisfy `when` become one."""
    return hist.groupBy(F.when(when, into).otherwise(F.col("bin")).alias("bin")).agg(F.sum("n").alias("n"))


def scott_width(c: Column) -> Column:
    return F.lit(3.49) * F.stddev_pop(c) * F.pow(F.count(c), F.lit(-1.0 / 3))


def upper_medians(df: DataFrame, by: str, col: str) -> DataFrame:
    """(by, median): sorted[n // 2] of a group's numbers, one of the values and never a mean of two; null without any.

    Equal values are counted first. Counts by range tell which range holds a group's median; only its values are
    ranked, so no task sees a whole group.
    """
    cut = df.groupBy(by, col).agg(F.count(col).alias("n_")).withColumn("range_", F.coalesce(ranges(df, col), F.lit(0)))
    group = W.partitionBy(by)
    before = F.coalesce(F.sum("t_").over(group.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy(by, "range_").agg(F.sum("n_").alias("t_")).withColumn("before_", before).withColumn("all_", F.sum("t_").over(group))
    mid = F.floor(F.col("all_") / 2)
    holds = ((F.col("before_") <= mid) & (mid < F.col("before_") + F.col("t_"))) | (F.col("all_") == 0)
    place = totals.where(holds).select(F.col(by).alias("by_"), F.col("range_").alias("at_"), (mid - F.col("before_")).alias("left_"))
    inside = cut.join(place, F.col(by).eqNullSafe(F.col("by_")) & (F.col("range_") == F.col("at_")))
    passed = F.sum("n_").over(W.partitionBy(by, "range_").orderBy(col))
    return inside.withColumn("passed_", passed).groupBy(by).agg(F.min(F.when(F.col("passed_") > F.col("left_"), F.col(col))).alias("median"))


def entropy(df: DataFrame, weight: str) -> DataFrame:
    """One row: the entropy in nats of weights scaled to sum 1."""
    w = F.col(weight)
    own, total = F.sum(F.when(w > 0, w)), F.sum(w)
    return df.agg((F.log(total) * own / total - F.sum(F.when(w > 0, w * F.log(w))) / total).alias("entropy"))


def moments(c: Column) -> list[Column]:
    """Count, mean, population deviation, skewness, excess kurtosis, extremes of a column."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), F.min(c).alias("low"), F.max(c).alias("high")]


def array_stats(a: Column) -> Column:
    """struct(mean, std, low, high, median, n_neg, n_zero, n_pos) of each row's array."""
    d = F.transform(a, lambda x: x.cast("double"))
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    srt = F.array_sort(d)
    half = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(srt, half)).otherwise((F.get(srt, half - 1) + F.get(srt, half)) / 2)
    count = lambda f: F.size(F.filter(d, f))
    return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), F.array_min(d).alias("low"), F.array_max(d).alias("high"), median.alias("median"), count(lambda x: x < 0).alias("n_neg"), count(lambda x: x == 0).alias("n_zero"), count(lambda x: x > 0).alias("n_pos"))


def compare_arrays(a: Column, b: Column) -> Column:
    """struct(pearson, r2): correlation of two arrays and its square."""
    n = F.size(a)
    sum_ = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    mx, my = sum_(x) / n, sum_(y) / n
    sxy = sum_(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)))
    sxx, syy = sum_(F.transform(x, lambda p: (p - mx) * (p - mx))), sum_(F.transform(y, lambda q: (q - my) * (q - my)))
    r = sxy / F.nullif(F.sqrt(sxx * syy), F.lit(0.0))
    return F.struct(r.alias("pearson"), (r * r).alias("r2"))


# --- classifiers ----------------------------------------------------------------------------------------------------


def error_rates(df: DataFrame, score: Column, label: Column, threshold: float) -> DataFrame:
    """One row: tpr, fpr, tnr, fnr, precision of score >= threshold against 0/1 labels."""
    hit, pos = score >= threshold, label == 1
    n = lambda c: F.sum(c.cast("long"))
    rate = lambda a, b: a / F.nullif(b, F.lit(0))
    return df.agg(
        rate(n(hit & pos), n(pos)).alias("tpr"),
        rate(n(hit & ~pos), n(~pos)).alias("fpr"),
        rate(n(~hit & ~pos), n(~pos)).alias("tnr"),
        rate(n(~hit & pos), n(pos)).alias("fnr"),
        rate(n(hit & pos), n(hit)).alias("precision"),
    )


def ranges(df: DataFrame, col: str, parts: int = 16) -> Column:
    """The number of the range that a numeric column's value lies in, between about equally many rows each.

    The bounds are values held by the driver and not by a sampled shuffle, so every plan and every rerun that uses the
    column cuts at the same places.
    """
    bounds = sorted(set(df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.01)))
    out = F.lit(0)
    for b in bounds:
        out = out + (F.col(col) > b).cast("int")
    return out


def running(df: DataFrame, col: str, sums: dict[str, str], tie: str | None = None) -> DataFrame:
    """df with running sums (name -> expression) in falling order of a numeric column, ties by another.

    Sums run inside ranges; the totals of the few ranges, added up, give each range its start. No task sees all rows.
    """
    cut = df.withColumn("range_", ranges(df, col))
    order = [F.col(col).desc(), *([F.col(tie)] if tie else [])]
    inside = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = cut.groupBy("range_").agg(*[F.sum(F.expr(e)).alias(f"t_{n}") for n, e in sums.items()])
    before = W.orderBy(F.col("range_").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("range_", *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"s_{n}") for n in sums])
    local = cut.select("*", *[F.sum(F.expr(e)).over(inside).alias(f"l_{n}") for n, e in sums.items()])
    return local.join(F.broadcast(starts), "range_").select(*df.columns, *[(F.col(f"l_{n}") + F.col(f"s_{n}")).alias(n) for n in sums])


def roc(df: DataFrame, score: str, label: str, step: float | None = None) -> DataFrame:
    """(threshold, tpr, fpr, precision): rates of score >= threshold at every distinct score, or every `step`.

    Scores are counted first, so the running sums go over distinct thresholds and not over rows.
    """
    s = F.floor(F.col(score) / step) * F.lit(step) if step else F.col(score)
    cells = df.groupBy(s.alias("threshold")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    whole = cells.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    out = running(cells, "threshold", {"tp": "p", "fp": "q"}).join(F.broadcast(whole))
    return out.select("threshold", (F.col("tp") / F.nullif("np", F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif("nq", F.lit(0))).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auc(curve: DataFrame) -> DataFrame:
    """One row: trapezoid area under (fpr, tpr), from the origin."""
    cut = curve.withColumn("range_", ranges(curve, "threshold"))
    w = W.partitionBy("range_").orderBy(F.col("threshold").desc())
    local = cut.select("range_", "fpr", "tpr", F.lag("fpr").over(w).alias("x"), F.lag("tpr").over(w).alias("y"))
    ends = cut.groupBy("range_").agg(F.max(F.struct("fpr", "tpr")).alias("e"))
    above = W.orderBy(F.col("range_").desc())
    starts = ends.select("range_", F.coalesce(F.lag("e").over(above)["fpr"], F.lit(0.0)).alias("x0"), F.coalesce(F.lag("e").over(above)["tpr"], F.lit(0.0)).alias("y0"))
    x, y = F.coalesce("x", "x0"), F.coalesce("y", "y0")
    return local.join(F.broadcast(starts), "range_").select(((F.col("fpr") - x) * (F.col("tpr") + y) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def equal_error(curve: DataFrame) -> DataFrame:
    """One row: threshold and error where the false positive rate is nearest the miss rate."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    return curve.select(gap.alias("gap"), "threshold", ((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer")).orderBy("gap", "threshold").limit(1).select("threshold", "eer")


def ranking_measures(df: DataFrame, score: str, label: str, ident: str, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """One row: precision among the k best scores for each k, ties by id."""
    best = df.orderBy(F.col(score).desc(), ident).limit(max(ks)).withColumn("r", F.row_number().over(W.orderBy(F.col(score).desc(), ident)))
    return best.agg(*[(F.sum(F.when(F.col("r") <= k, F.col(label))) / k).alias(f"p_at_{k}") for k in ks])


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, size, dominant, purity): the most frequent label per cluster, the smallest of equal ones."""
    c = contingency(df, cluster, label)
    return c.groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct(-F.col("n"), F.col("label"))).alias("top"), F.max("n").alias("m")).select("cluster", "size", F.col("top.label").alias("dominant"), (F.col("m") / F.col("size")).alias("purity"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalized mutual information (arithmetic mean) of two labellings."""
    pair = lambda c: c * (c - 1) / 2
    cells = contingency(df, a, b)
    rows, cols = cells.groupBy("cluster").agg(F.sum("n").alias("n")), cells.groupBy("label").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    ent = lambda t, x: t.crossJoin(F.broadcast(total)).agg(F.sum(pair(F.col("n"))).alias(f"s{x}"), (-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(f"h{x}"))
    joint = cells.join(rows.withColumnRenamed("n", "na"), "cluster").join(cols.withColumnRenamed("n", "nb"), "label").crossJoin(F.broadcast(total))
    mi = joint.agg(F.sum(pair(F.col("n"))).alias("s"), F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    one = ent(rows, "a").crossJoin(ent(cols, "b")).crossJoin(mi).crossJoin(total)
    expected = F.col("sa") * F.col("sb") / pair(F.col("total"))
    mean = (F.col("sa") + F.col("sb")) / 2
    return one.select(((F.col("s") - expected) / (mean - expected)).alias("ari"), (F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def pair_conflicts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: pairs of one label that are parted and pairs of two labels that are merged, from cell counts."""
    pair = lambda c: c * (c - 1) / 2
    cells = contingency(df, predicted, label)
    same = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pair(F.col("n"))).alias(k))
    one = cells.agg(F.sum(pair(F.col("n"))).alias("s"), pair(F.sum("n")).alias("all")).crossJoin(same("cluster")).crossJoin(same("label"))
    return one.select((F.col("label") - F.col("s")).alias("parted"), (F.col("cluster") - F.col("s")).alias("merged"), ((F.col("label") + F.col("cluster") - 2 * F.col("s")) / F.col("all")).alias("rate"))
