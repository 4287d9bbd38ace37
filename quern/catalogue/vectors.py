"""Vectors: distances, neighbours, embeddings, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml
from ..operators import vectors as V
from .base import query, r6, table

_D = "SELECT q.vec_id AS query, c.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0"
_COS = "SELECT q.vec_id AS query, c.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0"


def _nn(spark, d, k, metric="l2"):
    e = table(spark, d, "embeddings")
    return V.neighbours(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", k, metric)


@query(f"SELECT query, CAST(rank AS INT) AS rank, id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_D})) WHERE rank <= 10")
def knn_l2(spark, d):
    return _nn(spark, d, 10).select("query", "rank", "id", r6("d").alias("d"))


@query(f"SELECT query, CAST(rank AS INT) AS rank, id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_COS})) WHERE rank <= 10")
def knn_cosine(spark, d):
    return _nn(spark, d, 10, "cosine").select("query", "rank", "id", r6("d").alias("d"))


@query(f"SELECT id, round(max(1 - d), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_COS})) WHERE rank <= 30 GROUP BY id")
def knn_max_over_queries(spark, d):
    return V.best_over_queries(_nn(spark, d, 30, "cosine")).select("id", r6("score").alias("score"))


@query(f"SELECT id, round(sum(1 - d), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_COS})) WHERE rank <= 30 GROUP BY id")
def knn_sum_over_queries(spark, d):
    return V.summed_over_queries(_nn(spark, d, 30, "cosine")).select("id", r6("score").alias("score"))


@query("""WITH q AS (SELECT list_transform(range(64), lambda i: (i % 5) / 10.0) AS q)
SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS d FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(embedding, q), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), id LIMIT 20""")
def near_l1(spark, d):
    return V.near(table(spark, d, "embeddings"), "vec_id", "embedding", [(i % 5) / 10 for i in range(64)], 20, "l1").select("id", r6("d").alias("d"))


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_D})), c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_COS})),
a AS (SELECT query, list(id) AS a FROM l WHERE rank <= 10 GROUP BY 1), b AS (SELECT query, list(id) AS b, FROM c WHERE rank <= 10 GROUP BY 1), h AS (SELECT c.query, min(c.rank) AS f FROM c JOIN l USING (query, id) WHERE c.rank <= 10 AND l.rank <= 10 GROUP BY 1)
SELECT query, round(len(list_intersect(a, b)) / 10, 6) AS recall, round(coalesce(1.0 / f, 0), 6) AS mrr, round(len(list_intersect(a, b)) / (20 - len(list_intersect(a, b))), 6) AS jaccard FROM a JOIN b USING (query) LEFT JOIN h USING (query)""")
def neighbor_recall(spark, d):
    out = V.neighbour_agreement(_nn(spark, d, 10), _nn(spark, d, 10, "cosine"), 10)
    return out.select("query", *[r6(c).alias(c) for c in ("recall", "mrr", "jaccard")])


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM ({_D.replace(' WHERE q.vec_id % 100 = 0', '')}))
SELECT e.vec_id AS id, round(CASE WHEN e.label >= 5 THEN 5 + coalesce(s, 0) ELSE e.label END, 6) AS score FROM embeddings e LEFT JOIN (SELECT query, sum(exp(-d)) / 5 AS s FROM l WHERE rank <= 5 GROUP BY 1) ON query = vec_id""")
def rescore_nn(spark, d):
    e = table(spark, d, "embeddings")
    s = e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score"))
    return V.density_rescored(s, V.neighbours(e, e, "vec_id", "embedding", 5), 5.0, 5).select("id", r6("score").alias("score"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS t FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS d FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""")
def jaccard_labels(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("t"))
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("t").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("t").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", r6(V.label_distance(F.col("x"), F.col("y"), "multi")).alias("d"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a, round(embedding[1]::DOUBLE, 6) AS b, len(embedding) * 2 AS n FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0")
def concat_stores(spark, d):
    e = table(spark, d, "embeddings")
    return V.concatenated([e.where("vec_id % 3 = 0"), e.where("vec_id % 2 = 0")], "vec_id", "embedding").select("vec_id", r6(F.get("embedding", 0).cast("double")).alias("a"), r6(F.get("embedding", 64).cast("double")).alias("b"), F.size("embedding").cast("long").alias("n"))


_P = """one AS (SELECT DISTINCT l_orderkey AS g, p_brand AS i FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM one x JOIN one y ON x.g = y.g AND x.i <> y.i GROUP BY 1, 2)"""


@query(f"WITH {_P} SELECT a, b, n FROM c")
def tag_cooccurrence(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return V.co_occurrence(li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("g"), F.col("p_brand").alias("i")), "g", "i")


@query(f"""WITH {_P}, v AS (SELECT a, b, ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b))) AS v FROM c) SELECT a, b, round(v, 6) AS ppmi FROM v WHERE v > 0""")
def ppmi(spark, d):
    return V.ppmi(tag_cooccurrence(spark, d)).select("a", "b", r6("ppmi").alias("ppmi"))


@query()
def ppmi_embeddings(spark, d):
    return V.ppmi_embeddings(V.ppmi(tag_cooccurrence(spark, d))).select("item", F.size("v").alias("n"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(4), lambda i: CASE label WHEN i THEN 1e0 ELSE 0e0 END)), 6) AS hot, CAST(CASE WHEN label < 4 THEN label ELSE -1 END AS DOUBLE) AS number FROM embeddings""")
def category_features(spark, d):
    c = F.col("label").cast("string")
    values = ["0", "1", "2", "3"]
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(V.encoded(c, values), F.lit(0.0), lambda a, x: a + x).alias("hot"), F.get(V.encoded(c, values, "int"), 0).alias("number"))


@query()
def standardized_vectors(spark, d):
    return V.standardized(table(spark, d, "embeddings"), "embedding", 64).select("vec_id", F.round(F.get("embedding", 0), 6).alias("x0"))


@query()
def kmeans(spark, d):
    return ml.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query()
def logreg_cv(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return ml.cross_validated(e, "vec_id", "embedding", "y", 3, "logistic").select("id", "fold", "label", F.round("score", 4).alias("score"))


@query()
def ridge_r2(spark, d):
    return ml.regressed(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query()
def pca_project(spark, d):
    return ml.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 3)[0]


@query()
def fourier_features(spark, d):
    return ml.fourier_features(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 64, 8, 0.1)
