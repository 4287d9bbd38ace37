"""Histograms, statistics, classifier measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .base import query, r6, table


@query("SELECT l_returnflag AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist_count(spark, d):
    return A.histogram(table(spark, d, "lineitem"), F.col("l_returnflag"))


@query("SELECT floor(l_extendedprice / 5000.0) * 5000.0 AS bin, round(sum(l_quantity), 4) AS n FROM lineitem GROUP BY 1")
def hist_binned_weighted(spark, d):
    return A.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 5000.0, F.col("l_quantity")).select("bin", F.round("n", 4).alias("n"))


@query("SELECT floor(value / 10.0) * 10.0 AS bin, round(count(*) / sum(count(*)) OVER (), 6) AS n FROM events GROUP BY 1")
def hist_normalized(spark, d):
    return A.histogram(table(spark, d, "events"), F.col("value"), 10.0, normalize=True).select("bin", r6("n").alias("n"))


@query("""SELECT CASE WHEN p_retailprice >= 1350 THEN 1500e0 WHEN p_retailprice >= 1100 THEN 1200e0 ELSE 1000e0 END AS bin, count(*) AS n FROM part GROUP BY 1""")
def hist_centers(spark, d):
    return A.histogram(table(spark, d, "part"), A.nearest_centre(F.col("p_retailprice"), [1000.0, 1200.0, 1500.0]))


@query("SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS total FROM (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY 1)")
def hist_cumulative(spark, d):
    return A.cumulative(A.histogram(table(spark, d, "part"), F.col("p_size")))


@query("""SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS bin, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS bin, count(*) AS n FROM supplier GROUP BY 1) b ON a.bin = b.bin""")
def hist_multi(spark, d):
    return A.aligned({"customers": A.histogram(table(spark, d, "customer"), F.col("c_nationkey")), "suppliers": A.histogram(table(spark, d, "supplier"), F.col("s_nationkey"))})


@query("SELECT CASE WHEN p_size > 30 THEN 99 ELSE p_size END AS bin, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def hist_collapse(spark, d):
    return A.folded(A.histogram(table(spark, d, "part"), F.col("p_size")), F.lit(99), F.col("bin") > 30)


@query("SELECT event_type, round(3.49 * stddev_pop(value) * pow(count(value), -1.0/3), 6) AS width FROM events GROUP BY 1")
def scott_bin(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(A.scott_width(F.col("value"))).alias("width"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(count(value) / 2) AS INT) + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, d):
    return A.upper_medians(table(spark, d, "events"), "event_type", "value")


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var,
round(kurtosis_pop(l_quantity), 6) AS kurtosis, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def moments(spark, d):
    c = F.col("l_quantity")
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*A.moments(c), F.var_samp(c).alias("var"))
    return out.select("l_returnflag", "n", *[r6(x).alias(x) for x in ("mean", "std", "var", "kurtosis")], "low", "high")


@query("SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT n / sum(n) OVER () AS p FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def entropy(spark, d):
    return A.entropy(A.histogram(table(spark, d, "events"), F.col("event_type")), "n").select(r6("entropy").alias("entropy"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counters(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT unnest(json_keys(props)) AS path, count(*) AS n FROM events GROUP BY 1")
def key_path_counts(spark, d):
    from ..functions.semi import key_paths

    return key_paths(table(spark, d, "events"), "props", 1)


@query("""SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS std, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high,
round(list_median(embedding::DOUBLE[]), 6) AS median, CAST(len(list_filter(embedding, lambda x: x < 0)) AS INT) AS n_neg FROM embeddings""")
def array_stats(spark, d):
    s = A.array_stats(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", s.alias("s")).select("vec_id", *[r6(f"s.{x}").alias(x) for x in ("mean", "std", "low", "high", "median")], "s.n_neg")


@query("""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(corr(x, y), 6) AS pearson, round(corr(x, y) * corr(x, y), 6) AS r2 FROM p GROUP BY 1""")
def array_correlation(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = e.join(b, "vec_id").select("vec_id", A.compare_arrays(F.col("embedding"), F.col("other")).alias("s"))
    return s.select("vec_id", r6("s.pearson").alias("pearson"), r6("s.r2").alias("r2"))


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


_S = "s AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"


@query(f"""WITH {_S} SELECT round(sum(CASE WHEN score >= 30000 THEN label END) / sum(label), 6) AS tpr, round(sum(CASE WHEN score >= 30000 THEN 1 - label END) / sum(1 - label), 6) AS fpr,
round(sum(CASE WHEN score < 30000 THEN 1 - label END) / sum(1 - label), 6) AS tnr, round(sum(CASE WHEN score < 30000 THEN label END) / sum(label), 6) AS fnr,
round(sum(CASE WHEN score >= 30000 THEN label END) / count(*) FILTER (score >= 30000), 6) AS precision FROM s""")
def error_rates(spark, d):
    out = A.error_rates(_scored(spark, d), F.col("score"), F.col("label"), 30000)
    return out.select(*[r6(c).alias(c) for c in out.columns])


_ROC = f"""{_S}, c AS (SELECT floor(score / 1000.0) * 1000.0 AS threshold, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1),
r AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c WINDOW w AS (ORDER BY threshold DESC)),
k AS (SELECT threshold, tp / np AS tpr, fp / nq AS fpr, tp / (tp + fp) AS precision FROM r)"""


@query(f"WITH {_ROC} SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM k")
def roc_curve(spark, d):
    return A.roc(_scored(spark, d), "score", "label", 1000.0).select("threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("precision").alias("precision"))


@query(f"""WITH {_ROC}, z AS (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY fpr, tpr), 0) AS x, coalesce(lag(tpr) OVER (ORDER BY fpr, tpr), 0) AS y FROM k) SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM z""")
def roc_auc(spark, d):
    return A.auc(A.roc(_scored(spark, d), "score", "label", 1000.0)).select(r6("auc").alias("auc"))


@query(f"WITH {_ROC} SELECT threshold, round((fpr + 1 - tpr) / 2, 6) AS eer FROM k ORDER BY abs(fpr - (1 - tpr)), threshold LIMIT 1")
def equal_error(spark, d):
    return A.equal_error(A.roc(_scored(spark, d), "score", "label", 1000.0)).select("threshold", r6("eer").alias("eer"))


@query("""WITH b AS (SELECT o_totalprice AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT round(sum(y) FILTER (r <= 10) / 10, 6) AS p_at_10, round(sum(y) FILTER (r <= 50) / 50, 6) AS p_at_50, round(sum(y) FILTER (r <= 100) / 100, 6) AS p_at_100 FROM b""")
def precision_at(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    out = A.ranking_measures(o, "o_totalprice", "y", "o_orderkey")
    return out.select(*[r6(c).alias(c) for c in out.columns])


_C = "c AS (SELECT o_orderpriority AS cluster, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY cluster) AS s FROM c)
SELECT cluster, CAST(s AS BIGINT) AS size, label AS dominant, round(n / s, 6) AS purity FROM r WHERE k = 1""")
def cluster_purity(spark, d):
    return A.purity(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select("cluster", "size", "dominant", r6("purity").alias("purity"))


@query(f"""WITH {_C}, a AS (SELECT sum(n) AS n FROM c GROUP BY cluster), b AS (SELECT sum(n) AS n FROM c GROUP BY label), t AS (SELECT sum(n)::DOUBLE AS n FROM c),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, (SELECT n * (n - 1) / 2 FROM t) AS st,
(SELECT -sum(a.n / t.n * ln(a.n / t.n)) FROM a, t) AS ha, (SELECT -sum(b.n / t.n * ln(b.n / t.n)) FROM b, t) AS hb,
(SELECT sum(c.n / t.n * ln(c.n * t.n / (p.n * q.n))) FROM c, t, (SELECT cluster, sum(n) AS n FROM c GROUP BY 1) p, (SELECT label, sum(n) AS n FROM c GROUP BY 1) q WHERE p.cluster = c.cluster AND q.label = c.label) AS mi)
SELECT round((s - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM x""")
def ari_nmi(spark, d):
    return A.agreement(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(r6("ari").alias("ari"), r6("nmi").alias("nmi"))


@query(f"""WITH {_C}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY cluster)) AS sa,
(SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY label)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT CAST(sb - s AS DOUBLE) AS parted, CAST(sa - s AS DOUBLE) AS merged, round((sa + sb - 2 * s) / t, 6) AS rate FROM x""")
def pair_conflicts(spark, d):
    return A.pair_conflicts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.col("parted").cast("double").alias("parted"), F.col("merged").cast("double").alias("merged"), r6("rate").alias("rate"))
