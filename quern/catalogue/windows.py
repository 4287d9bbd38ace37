"""Ordered analytics over events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times
from ..operators import windows as O
from ..streaming import log
from .base import query, r6, table


def by_user():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def v():
    return F.col("value")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 5, 4) AS s FROM events")
def cumsum(spark, d):
    return table(spark, d, "events").select("event_id", F.round(O.running_sum(v(), by_user(), 5.0), 4).alias("s"))


@query("SELECT event_id, round(coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 0), 6) AS diff FROM events")
def derivatives(spark, d):
    return table(spark, d, "events").select("event_id", r6(O.forward_difference(v(), by_user())).alias("diff"))


@query("""SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN 'end' WHEN value > a AND value > b THEN 'max' WHEN value < a AND value < b THEN 'min' END AS kind
FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def extrema(spark, d):
    return table(spark, d, "events").select("event_id", O.extremum(v(), by_user()).alias("kind"))


@query("SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / (2 * stddev_pop(value) OVER w) END, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore(spark, d):
    return table(spark, d, "events").select("event_id", r6(O.z_score(v(), W.partitionBy("user_id"))).alias("z"))


@query("SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS x FROM events WINDOW w AS (PARTITION BY event_type)")
def linscale(spark, d):
    return table(spark, d, "events").select("event_id", r6(O.min_max(v(), W.partitionBy("event_type"))).alias("x"))


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY event_type), 9) AS p FROM events")
def freqs2probs(spark, d):
    return table(spark, d, "events").select("event_id", F.round(O.share(v(), W.partitionBy("event_type")), 9).alias("p"))


_K = O.gaussian_kernel(1.0, 5)


@query("SELECT event_id, round(" + " + ".join(f"{k!r} * " + ("value" if i == 2 else f"coalesce({'lag' if i < 2 else 'lead'}(value, {abs(i - 2)}) OVER w, {'first' if i < 2 else 'last'}_value(value) OVER f)") for i, k in enumerate(_K)) + """, 6) AS s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def gauss_smooth(spark, d):
    return table(spark, d, "events").select("event_id", r6(O.smoothed(v(), by_user(), _K)).alias("s"))


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM m GROUP BY 1, 2""")
def group_runs(spark, d):
    return O.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "island", "event_type", "n")


@query("""WITH e AS (SELECT event_type, epoch(ts) - min(epoch(ts)) OVER () AS x, value FROM events), g AS (SELECT event_type, unnest(range(21)) AS k, max(x) OVER () AS m FROM (SELECT event_type, max(x) AS x FROM e GROUP BY 1))
SELECT event_type, k, count(*) AS n, round(avg(value), 6) AS mean FROM g JOIN e USING (event_type) WHERE abs(x - k * 86400.0) <= 86400.0 GROUP BY 1, 2""")
def linear_weighting(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("ts")).first()[0]
    x = times.epoch(F.col("ts")) - times.epoch(F.lit(first))
    out = O.resampled(e.withColumn("x", x), "event_type", "x", "value", 0.0, 20 * 86400.0, 20)
    return out.select("event_type", F.round(F.col("t") / 86400).cast("long").alias("k"), "n", r6("mean").alias("mean"))


@query("""WITH e AS (SELECT user_id, epoch(ts) AS x, avg(value) AS y FROM events GROUP BY 1, 2), n AS (SELECT user_id, min(x) AS a, max(x) AS b FROM e GROUP BY 1),
g AS (SELECT user_id, a + (b - a) * k / 4 AS t, k FROM n, range(5) r(k))
SELECT g.user_id, k, round(CASE WHEN hx = lx THEN ly ELSE ly + (hy - ly) * (t - lx) / (hx - lx) END, 4) AS value
FROM (SELECT g.user_id, k, t, max(x) FILTER (x <= t) AS lx, max_by(y, x) FILTER (x <= t) AS ly, min(x) FILTER (x >= t) AS hx, min_by(y, x) FILTER (x >= t) AS hy FROM g JOIN e USING (user_id) GROUP BY 1, 2, 3) g""")
def interp_linear(spark, d):
    e = table(spark, d, "events").groupBy("user_id", times.epoch(F.col("ts")).alias("x")).agg(F.avg("value").alias("y"))
    n = e.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    g = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / 4)
    got = O.interpolated(e, "user_id", "x", "y", g, "t")
    return got.join(g.select("user_id", "t", F.col("k").cast("long").alias("k")), ["user_id", "t"]).distinct().select("user_id", "k", F.round("value", 4).alias("value"))


@query("""SELECT event_type, round(sum(value * exp(-(n - epoch(ts)) * 0.00001)) / sum(exp(-(n - epoch(ts)) * 0.00001)), 4) AS mean FROM events, (SELECT max(epoch(ts)) AS n FROM events) GROUP BY 1""")
def exp_weighting(spark, d):
    e = table(spark, d, "events").withColumn("x", times.epoch(F.col("ts")))
    now = e.agg(F.max("x")).first()[0]
    return e.groupBy("event_type").agg(F.round(O.time_weighted_mean(F.col("x"), v(), F.lit(now), 1e-5), 4).alias("mean"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_type, epoch(ts)::DOUBLE AS t, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_type, t, event_id, r, t AS o, CAST(NULL AS DOUBLE) AS copy_of FROM s WHERE r = 1 UNION ALL
SELECT s.user_id, s.event_type, s.t, s.event_id, s.r, CASE WHEN s.t - f.o <= 86400 THEN f.o ELSE s.t END, CASE WHEN s.t - f.o <= 86400 THEN f.o END
FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.r = f.r + 1)
SELECT event_id, copy_of IS NOT NULL AS is_copy FROM f""")
def recency_dedup(spark, d):
    e = table(spark, d, "events").withColumn("x", times.epoch(F.col("ts")))
    return log.recent_duplicates(e, ["user_id", "event_type"], "x", "event_id", 86400.0).select("event_id", F.col("copy_of").isNotNull().alias("is_copy"))
