"""Samples and splits. Randomness is a hash of key and seed, so reruns and recomputed tasks agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coin(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on key and seed alone: 52 bits of the MD5 of both, as any engine has it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def at_most(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(coin(F.col(key), seed), key).limit(k)


def per_group(df: DataFrame, by: str, k: int, key: str, seed: int = 0) -> DataFrame:
    w = W.partitionBy(by).orderBy(coin(F.col(key), seed), key)
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).drop("r_")


def split(df: DataFrame, key: str, shares: list[float], seed: int = 0) -> DataFrame:
    """df with part: rows fall into parts by their coin, in the given shares."""
    total, edge, out = sum(shares), 0.0, F.lit(len(shares) - 1)
    edges = []
    for s in shares[:-1]:
        edge += s / total
        edges.append(edge)
    c = coin(F.col(key), seed)
    for i in reversed(range(len(edges))):
        out = F.when(c < edges[i], i).otherwise(out)
    return df.withColumn("part", out)


def exact_split(df: DataFrame, key: str, shares: list[float], seed: int = 0) -> DataFrame:
    """df with part: exact counts by rank, cut to whole rows; the last part takes the remainder.

    Ranks come from ntile-like cuts of the coin: only rows between two neighbouring coins need comparing, so the
    cut points are found by an exact percentile and not by ranking all rows in one task.
    """
    n, total, edge, out = df.count(), sum(shares), 0.0, F.lit(len(shares) - 1)
    c = coin(F.col(key), seed)
    for i, s in reversed(list(enumerate(shares[:-1]))):
        edge = sum(shares[: i + 1]) / total
        k = int(edge * n + 1e-9)
        at = df.select(c.alias("c")).orderBy("c").offset(max(0, k - 1)).limit(1).first() if k else None
        out = F.when(c <= (at[0] if at else -1.0), i).otherwise(out)
    return df.withColumn("part", out)


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(coin(F.col(key), seed) * k).cast("int"))


def proportional(hist: DataFrame, num: int) -> DataFrame:
    """(bin, take): whole numbers proportional to n that sum to num; the largest remainders round up, ties by bin."""
    share = F.col("n") / F.sum("n").over(W.partitionBy()) * num
    cut = hist.withColumn("share_", share).withColumn("floor_", F.floor("share_"))
    left = F.lit(num) - F.sum("floor_").over(W.partitionBy())
    order = F.row_number().over(W.orderBy((F.col("share_") - F.col("floor_")).desc(), "bin"))
    return cut.select("bin", (F.col("floor_") + (order <= left).cast("long")).alias("take"))


def weighted(df: DataFrame, weight: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement with chances by weight: the largest coin^(1/weight) win."""
    race = -F.log(F.greatest(coin(F.col(key), seed), F.lit(1e-300))) / F.col(weight)
    return df.where(F.col(weight) > 0).orderBy(race, key).limit(k)


def numbered(df: DataFrame, key: str, parts: int = 64) -> tuple[DataFrame, int]:
    """((key, place), n): rows numbered from 0 without gaps, in parts by a hash of the key, so no task ranks them all."""
    placed = df.select(key).withColumn("b_", F.floor(coin(F.col(key), parts) * parts).cast("int"))
    size = {r[0]: r[1] for r in placed.groupBy("b_").count().collect()}
    start, at = {}, 0
    for b in range(parts):
        start[b], at = at, at + size.get(b, 0)
    first = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    ranked = placed.withColumn("place", F.row_number().over(W.partitionBy("b_").orderBy(key)) - 1 + first[F.col("b_")])
    return ranked.select(key, F.col("place").cast("long").alias("place")), at


def with_replacement(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """(draw, key): k draws."""
    ranked, n = numbered(df, key)
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw"), F.floor(coin(F.col("id"), seed) * n).cast("long").alias("place"))
    return draws.join(ranked, "place").select("draw", key)


def labelled_pairs(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """(a, b, same): about n random pairs; every row meets partners at fixed places of a shuffled order."""
    w = W.partitionBy(F.floor(coin(F.col(key), seed + 1) * 64)).orderBy(coin(F.col(key), seed), key)
    b, lb = F.lead(key).over(w), F.lead(label).over(w)
    out = df.select(F.least(F.col(key), b).alias("a"), F.greatest(F.col(key), b).alias("b"), (F.col(label) == lb).alias("same")).where("b IS NOT NULL AND a <> b")
    return out.distinct().orderBy(coin(F.col("a"), seed), "a", "b").limit(n)


def training_set(positive: DataFrame, negative: DataFrame, key: str, most: int, factor: float, seed: int = 0) -> DataFrame:
    """(key, label): positives capped, and negatives up to factor times as many, +1 and -1."""
    pos = at_most(positive.select(key), most, key, seed)
    n = pos.count()
    neg = at_most(negative.select(key).join(pos, key, "left_anti"), int(n * factor), key, seed)
    return pos.withColumn("label", F.lit(1)).union(neg.withColumn("label", F.lit(-1)))
