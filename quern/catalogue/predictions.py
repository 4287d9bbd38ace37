"""Predictions: nearest neighbours, tasks, encodings, weights, similarity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predict as P
from .base import query, r6, table
from .vectors import _D

_N = f"SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_D})) JOIN embeddings ON vec_id = id WHERE rank <= 10"


@query(f"""WITH n AS ({_N}), v AS (SELECT query, label, count(*) AS n FROM n GROUP BY 1, 2)
SELECT query AS id, arg_min(label, (-n, label)) AS vote, round(sum(label * n) / sum(n), 6) AS mean FROM v GROUP BY 1""")
def knn_predictions(spark, d):
    e = table(spark, d, "embeddings")
    return P.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "label", 10).select("id", "vote", r6("mean").alias("mean"))


@query("""WITH g AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS g FROM orders)
SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT y, avg(CASE WHEN y = g THEN 1e0 ELSE 0e0 END) AS r FROM g GROUP BY y)""")
def balanced_accuracy(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("g"))
    return P.balanced_accuracy(o, "y", "g").select(r6("balanced_accuracy").alias("balanced_accuracy"))


@query("""WITH c AS (SELECT c_custkey AS id, c_acctbal / 5000 AS v FROM customer), m AS (SELECT min(v) AS m FROM c), t AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 1e0 ELSE -1e0 END AS v FROM labels)
SELECT 'acct-regression-orig' AS task, 'regression' AS type, id, round(v, 6) AS y FROM c UNION ALL SELECT 'acct-regression-log', 'regression', id, round(ln(1 + v - m + 1), 6) FROM c, m UNION ALL SELECT 'acct-regression-exp', 'regression', id, round(exp(v - m + 1) - 1, 6) FROM c, m
UNION ALL SELECT 'toxic-binary', 'classification', id, v FROM t WHERE (SELECT count(*) FROM t WHERE v > 0) >= 10 UNION ALL SELECT 'label-multiclass-orig', 'classification', vec_id, CAST(label AS DOUBLE) FROM embeddings""")
def prediction_tasks(spark, d):
    acct = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 5000).alias("value"))
    toxic = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 1.0).otherwise(-1.0).alias("value"))
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("value"))
    out = P.tasks(acct, "acct", "numeric").union(P.tasks(toxic, "toxic", "class")).union(P.tasks(label, "label", "class"))
    return out.select("task", "type", "id", r6("y").alias("y"))


@query("""SELECT vec_id AS id, round(pow(s, 0.2), 6) AS score, round(1 - pow(s, 0.2), 6) AS lacks FROM (SELECT vec_id, CASE WHEN s >= 0 THEN s END AS s FROM
(SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (i % 7) / 10.0 + 0.1)::DOUBLE[]) AS s FROM embeddings))""")
def similarity_filter(spark, d):
    e, q = table(spark, d, "embeddings"), [(i % 7) / 10 + 0.1 for i in range(64)]
    a, b = P.similarity_scores(e, "vec_id", "embedding", q), P.similarity_scores(e, "vec_id", "embedding", q, True)
    return a.join(b.select("id", F.col("score").alias("lacks")), "id").select("id", r6("score").alias("score"), r6("lacks").alias("lacks"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN [1.0, 0.5] WHEN 'O' THEN [0.0, 2.0] END::DOUBLE[] AS v FROM orders""")
def target_encoding(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.target_encoded(F.col("o_orderstatus"), {"F": [1, 0.5], "O": [0, 2]}).alias("v"))


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (i % 3))), 5) AS total FROM embeddings")
def weighted_dimensions(spark, d):
    v = P.weighted(F.col("embedding").cast("array<double>"), [i % 3 for i in range(64)])
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id % 2 = 0 THEN -1e0 ELSE round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), 5) END AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def filled_distances(spark, d):
    e = table(spark, d, "embeddings")
    ids = e.select(F.col("vec_id").alias("b"))
    pairs = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(ids, "b", "left_semi")
    known = pairs.where("a % 2 = 0").select("a", "b", F.lit(-1.0).alias("d"))
    return P.filled_distances(known, pairs, e, "vec_id", "embedding").select("a", "b", F.round("d", 5).alias("d"))
