"""Clusterings beyond k-means, their quality, and classifiers made of several."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ml

#: Rows that a clustering on the driver's matrix takes at most.
MOST_ROWS = 5000


def _matrix(df: DataFrame, ident: str, vector: str) -> tuple[list, np.ndarray]:
    rows = df.select(ident, F.col(vector).cast("array<double>")).orderBy(ident).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"this clustering takes at most {MOST_ROWS} rows; use kmeans or bisecting for more")
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def _table(df: DataFrame, ident: str, ids: list, labels: list[int]) -> DataFrame:
    kind = df.schema[ident].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(zip(ids, map(int, labels))), f"id {kind}, cluster int")


def _distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(s[:, None] - 2 * x @ x.T + s, 0))


def bisecting(df: DataFrame, ident: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster): hierarchical k-means from the top, for any number of rows."""
    d = ml.dense(df, vector)
    return BisectingKMeans(k=k, seed=seed).fit(d).transform(d).select(F.col(ident).alias("id"), F.col("prediction").alias("cluster"))


def agglomerative(df: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(id, cluster): average linkage from the bottom, of a bounded number of rows."""
    ids, x = _matrix(df, ident, vector)
    d = _distances(x)
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(len(x)), list(range(len(x))), np.arange(len(x))
    while len(alive) > max(1, k):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
        alive.remove(b)
    return _table(df, ident, ids, pd.factorize(label)[0].tolist())


def density(df: DataFrame, ident: str, vector: str, reach: float, least: int) -> DataFrame:
    """(id, cluster): rows with `least` neighbours within `reach` and what they reach; noise is -1."""
    ids, x = _matrix(df, ident, vector)
    near = _distances(x) <= reach if len(x) else np.zeros((0, 0), bool)
    core = near.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            for q in np.flatnonzero(near[todo.pop()] & (label < 0)):
                label[q] = n
                if core[q]:
                    todo.append(int(q))
        n += 1
    return _table(df, ident, ids, label.tolist())


def affinity(df: DataFrame, ident: str, vector: str, damping: float = 0.7, rounds: int = 200) -> DataFrame:
    """(id, cluster): affinity propagation with the median similarity as preference."""
    ids, x = _matrix(df, ident, vector)
    n = len(x)
    if n < 2:
        return _table(df, ident, ids, [0] * n)
    s = -(_distances(x) ** 2)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]))
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        m = a + s
        top = m.argmax(1)
        best = m[np.arange(n), top]
        m[np.arange(n), top] = -np.inf
        second = m.max(1)
        new = s - best[:, None]
        new[np.arange(n), top] = s[np.arange(n), top] - second
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(0) - p
        diag = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, diag)
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero((r + a).diagonal() > 0)
    heads = heads if len(heads) else np.array([int((r + a).diagonal().argmax())])
    label = s[:, heads].argmax(1)
    label[heads] = np.arange(len(heads))
    return _table(df, ident, ids, label.tolist())


def silhouette(df: DataFrame, vector: str, cluster: str) -> float:
    """The mean silhouette by squared distance, in one pass of sums per cluster."""
    d = ml.dense(df, vector).withColumn("prediction", F.col(cluster).cast("double"))
    return ClusteringEvaluator(metricName="silhouette").evaluate(d)


def davies_bouldin(df: DataFrame, vector: str, cluster: str, dims: int) -> float:
    """The mean over clusters of the worst ratio of spreads to the distance of centres; less is better."""
    x = lambda i: F.get(F.col(vector), i).cast("double")
    centre = df.groupBy(cluster).agg(F.array(*[F.avg(x(i)) for i in range(dims)]).alias("centre_"))
    off = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("centre_"), lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))
    rows = df.join(F.broadcast(centre), cluster).groupBy(cluster).agg(F.avg(off).alias("s"), F.first("centre_").alias("centre")).collect()
    c, s = np.array([r["centre"] for r in rows]), np.array([r["s"] for r in rows])
    if len(rows) < 2:
        return 0.0
    d = _distances(c)
    ratio = (s[:, None] + s) / np.where(d == 0, np.inf, d)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(1).mean())


def guided(df: DataFrame, ident: str, vector: str, label: str, k: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """(id, cluster, score): k-means whose labelled clusters with conflicts are split until labels agree or rounds end;
    score 1 / (1 + distance to the centre)."""
    for extra in range(rounds):
        model = KMeans(k=k + extra, seed=seed + extra, maxIter=30).fit(ml.dense(df, vector))
        got = model.transform(ml.dense(df, vector)).withColumnRenamed("prediction", "cluster")
        mixed = got.where(F.col(label).isNotNull()).groupBy("cluster").agg(F.countDistinct(label).alias("n")).where("n > 1")
        if mixed.isEmpty():
            break
    centres = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centre_ array<double>")
    off = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("centre_"), lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))
    return got.join(F.broadcast(centres), "cluster").select(F.col(ident).alias("id"), "cluster", (1 / (1 + off)).alias("score"))


def mixture_scores(train: DataFrame, todo: DataFrame, ident: str, vector: str, label: str, parts: int) -> DataFrame:
    """(id, score): the highest score of linear classifiers, one per cluster of positives against all negatives."""
    pos, neg = train.where(F.col(label) == 1), train.where(F.col(label) != 1)
    groups = pos.join(ml.kmeans(pos, ident, vector, parts).withColumnRenamed("id", ident), ident)
    out = None
    for i in range(parts):
        one = ml.fit_and_score(groups.where(F.col("cluster") == i).drop("cluster").unionByName(neg), todo, ident, vector, label)
        out = one if out is None else out.union(one)
    return out.groupBy("id").agg(F.max("score").alias("score"))


def named(clusters: DataFrame, tags: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, n, tags): the k most frequent tags of each cluster."""
    from pyspark.sql import Window as W

    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    c = clusters.join(tags, "id").groupBy("cluster", "tag").agg(F.count("*").alias("m"))
    top = c.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.col("m").desc(), "tag"))).where(F.col("r") <= k)
    names = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("tags"))
    return size.join(names, "cluster", "left")
