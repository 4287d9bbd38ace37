"""Joins beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import _cut


def as_of(left: DataFrame, right: DataFrame, on: str, time: str, value: list[str], prefix: str = "r_") -> DataFrame:
    """left with the latest right row at or before its time, per key: one union, one sort per key, no range join."""
    l = left.withColumn("t_", F.col(time)).withColumn("side_", F.lit(1)).withColumn("v_", F.lit(None).cast(_struct(right, time, value)))
    r = right.select(on, F.col(time).alias("t_"), F.lit(0).alias("side_"), F.struct(F.col(time).alias("t"), *value).alias("v_"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(on).orderBy("t_", "side_").rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("v_", F.last("v_", True).over(w)).where("side_ = 1")
    return got.select(*left.columns, F.col("v_.t").alias(prefix + time), *[F.col(f"v_.{v}").alias(prefix + v) for v in value])


def _struct(df: DataFrame, time: str, value: list[str]) -> str:
    return df.select(F.struct(F.col(time).alias("t"), *value).alias("v")).schema["v"].dataType.simpleString()


def in_interval(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Points with every span that holds them: spans are dealt to buckets of `width`, points find theirs by equality."""
    s = spans.withColumn("b_", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("b_", F.floor(F.col(at) / width))
    return p.join(s, "b_").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("b_")


def ancestors(items: DataFrame, key: str, parent: str, most: int = 20) -> DataFrame:
    """(id, ancestor, hops): every item with itself and its ancestors, by doubling paths: log2(depth) joins."""
    reach = items.select(F.col(key).alias("id"), F.col(key).alias("ancestor"), F.lit(0).alias("hops"))
    step = items.where(F.col(parent).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("ancestor"), F.lit(1).alias("hops"))
    span = 1
    while span <= most:
        a, b = reach.alias("a"), step.alias("b")
        more = a.join(b, F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id"), F.col("b.ancestor"), (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        reach = reach.union(more)
        c, d = step.alias("c"), step.alias("d")
        step = c.join(d, F.col("c.ancestor") == F.col("d.id")).select(F.col("c.id"), F.col("d.ancestor"), (F.col("c.hops") + F.col("d.hops")).alias("hops"))
        span *= 2
    return reach


def closest_ancestor(items: DataFrame, key: str, parent: str, fits: Column) -> DataFrame:
    """(id, ancestor): the nearest ancestor at any distance, or the item itself, that fits; key is unique.

    Every round doubles how far up each item has looked. A cycle without a fitting item has none.
    """
    good = F.coalesce(fits, F.lit(False))
    now = _cut(items.select(F.col(key).alias("id"), F.when(good, F.col(key)).alias("ancestor"), F.when(~good, F.col(parent)).alias("up")))
    for _ in range(now.count().bit_length() + 1):
        if now.where("ancestor IS NULL AND up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("id").alias("up"), F.col("ancestor").alias("a_"), F.col("up").alias("u_"))
        now = _cut(now.join(above, "up", "left").select("id", F.coalesce("ancestor", "a_").alias("ancestor"), F.when(F.coalesce("ancestor", "a_").isNull(), F.col("u_")).alias("up")))
    return now.where("ancestor IS NOT NULL").select("id", "ancestor")


def children_of(posts: DataFrame, items: DataFrame, key: str, parent: str, fields: list[str]) -> DataFrame:
    """posts with an array of their children, by key."""
    kids = items.groupBy(F.col(parent).alias(key)).agg(F.sort_array(F.collect_list(F.struct(key, *fields))).alias("children"))
    return posts.join(kids, key, "left").withColumn("children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)))


def scores_map(scores: DataFrame, ident: str = "id") -> DataFrame:
    """(id, scores): a map from type to a map from tag to score."""
    inner = scores.groupBy(ident, "ttype").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "score")))).alias("m"))
    return inner.groupBy(ident).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ttype", F.map_entries("m").alias("e")))).cast("array<struct<ttype:string,e:array<struct<key:string,value:double>>>>")).alias("s")).select(ident, F.transform_values("s", lambda _, e: F.map_from_entries(e)).alias("scores"))


def greedy_matching(pairs: DataFrame, group: str, a: str, b: str, score: str, least: float = 0.0) -> DataFrame:
    """(group, a, b, score): pairs taken by falling score, each a and b of a group once; ties by a, then b.

    A pair that is the best of its a and of its b is taken whatever the others are, so rounds of mutual best pairs
    give what taking one by one would, and no task sees a whole group. A pair that repeats counts by its highest score.
    """
    left = _cut(pairs.where(F.col(score) >= least).groupBy(group, a, b).agg(F.max(score).alias(score)))
    order = (F.col(score).desc(), a, b)
    taken = left.limit(0)
    while not left.isEmpty():
        best = left.withColumn("i_", F.row_number().over(W.partitionBy(group, a).orderBy(*order))).withColumn("j_", F.row_number().over(W.partitionBy(group, b).orderBy(*order)))
        best = _cut(best.where("i_ = 1 AND j_ = 1").drop("i_", "j_"))
        taken = taken.union(best)
        left = _cut(left.join(best.select(group, a), [group, a], "left_anti").join(best.select(group, b), [group, b], "left_anti").select(*best.columns))
    return taken


def unmatched(side: DataFrame, key: str, matched: DataFrame, col: str) -> DataFrame:
    return side.join(matched.select(F.col(col).alias(key)), key, "left_anti")


def propagated(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): sums over incoming edges of the source's score times the edge's weight."""
    return scores.join(edges, scores["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))


#: Places that go to every task at most.
MOST_PLACES = 100_000


def nearest_place(df: DataFrame, lat: str, lon: str, places: DataFrame, name: str) -> DataFrame:
    """df with place and place_m: the nearest of a bounded table (lat, lon, name) by great circle, ties by name."""
    import numpy as np

    from ..functions.geo import RADIUS

    rows = places.select("lat", "lon", F.col(name).cast("string")).orderBy(name).limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"at most {MOST_PLACES} places; cut the table into regions first")
    p, names = np.radians(np.array([[r[0], r[1]] for r in rows], float).reshape(-1, 2)), [r[2] for r in rows]
    schema = df.withColumn("place", F.lit(None).cast("string")).withColumn("place_m", F.lit(None).cast("double")).schema

    def find(it):
        for pdf in it:
            q = np.radians(pdf[[lat, lon]].to_numpy(float))
            place, metres = [None] * len(pdf), [None] * len(pdf)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                ok = np.flatnonzero(np.isfinite(part).all(1))
                if len(ok) and len(p):
                    a = np.sin((part[ok, None, 0] - p[:, 0]) / 2) ** 2 + np.cos(part[ok, None, 0]) * np.cos(p[:, 0]) * np.sin((part[ok, None, 1] - p[:, 1]) / 2) ** 2
                    best = a.argmin(1)
                    for i, b, x in zip(ok, best, a[np.arange(len(ok)), best]):
                        place[at + i], metres[at + i] = names[b], float(2 * RADIUS * np.arcsin(min(1.0, x**0.5)))
            yield pdf.assign(place=place, place_m=metres)

    return df.mapInPandas(find, schema)


def local_times(df: DataFrame, at: str, lat: str, lon: str, cities: DataFrame) -> DataFrame:
    """df with local: epoch seconds `at` as the clock of the nearest city (lat, lon, zone) shows it."""
    got = nearest_place(df, lat, lon, cities, "zone")
    return got.withColumn("local", F.from_utc_timestamp(F.timestamp_seconds(at), F.col("place"))).drop("place_m")
