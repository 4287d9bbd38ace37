"""Clustering, classifiers, decompositions and feature pipelines on pyspark.ml, with what it lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import coin, folds


def dense(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, ident: str, vector: str, k: int | None = None, seed: int = 1) -> DataFrame:
    """(id, cluster): k-means, sqrt(n) clusters unless told; clusters are numbered by falling size, then least id."""
    n = k or max(1, int(df.count() ** 0.5))
    model = KMeans(k=n, seed=seed, maxIter=30).fit(dense(df, vector))
    got = model.transform(dense(df, vector)).select(F.col(ident).alias("id"), F.col("prediction").alias("c"))
    size = got.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    order = {r["c"]: i for i, r in enumerate(sorted(size.collect(), key=lambda r: (-r["n"], r["least"])))}
    number = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return got.select("id", number[F.col("c")].alias("cluster"))


def classifier(method: str = "linear", weight: str | None = "weight", **kw):
    """linear: support vectors; logistic; both weigh rows by the column `weight`."""
    make = {"linear": LinearSVC, "logistic": LogisticRegression}[method]
    model = make(featuresCol="features", labelCol="label", **kw)
    return model.setWeightCol(weight) if weight else model


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: rows of each class weigh the same in sum."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    w = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (len(counts) * n))])
    return df.withColumn("weight", w[F.col(label)])


def fit_and_score(train: DataFrame, todo: DataFrame, ident: str, vector: str, label: str, method: str = "linear") -> DataFrame:
    """(id, score): the margin (linear) or probability (logistic) of class 1."""
    fit = balanced(dense(train.withColumn("label", F.col(label).cast("double")), vector))
    model = classifier(method).fit(fit)
    raw = "rawPrediction" if method == "linear" else "probability"
    got = model.transform(dense(todo, vector))
    return got.select(F.col(ident).alias("id"), F.get(vector_to_array(raw), 1).alias("score"))


def cross_validated(df: DataFrame, ident: str, vector: str, label: str, k: int = 4, method: str = "linear") -> DataFrame:
    """(id, fold, label, score): every row scored by a model that never saw its fold."""
    parts = folds(df, ident, k)
    out = None
    for i in range(k):
        test = parts.where(F.col("fold") == i)
        s = fit_and_score(parts.where(F.col("fold") != i), test, ident, vector, label, method)
        one = test.select(F.col(ident).alias("id"), "fold", F.col(label).alias("label")).join(s, "id")
        out = one if out is None else out.union(one)
    return out


def grid_search(df: DataFrame, ident: str, vector: str, label: str, methods: list[str], k: int = 3) -> DataFrame:
    """(method, accuracy) by cross-validation, best first."""
    out = None
    for m in methods:
        cut = 0.0 if m == "linear" else 0.5
        one = cross_validated(df, ident, vector, label, k, m).agg(F.avg(((F.col("score") > cut) == (F.col("label") == 1)).cast("double")).alias("accuracy")).select(F.lit(m).alias("method"), "accuracy")
        out = one if out is None else out.union(one)
    return out.orderBy(F.col("accuracy").desc(), "method")


def regressed(df: DataFrame, ident: str, vector: str, target: str, k: int = 4, ridge: float = 1.0) -> DataFrame:
    """One row: r2 of ridge regression over k folds."""
    parts = folds(dense(df.withColumn("label", F.col(target).cast("double")), vector), ident, k)
    out = None
    for i in range(k):
        model = LinearRegression(regParam=ridge, elasticNetParam=0.0).fit(parts.where(F.col("fold") != i))
        one = model.transform(parts.where(F.col("fold") == i)).select("label", "prediction")
        out = one if out is None else out.union(one)
    mean = out.agg(F.avg("label")).first()[0]
    return out.agg((1 - F.sum(F.pow(F.col("label") - F.col("prediction"), F.lit(2))) / F.sum(F.pow(F.col("label") - F.lit(mean), F.lit(2)))).alias("r2"))


def pca(df: DataFrame, ident: str, vector: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """((id, v), components): rows projected on the k largest components of the centred data."""
    d = dense(df, vector)
    model = PCA(k=k, inputCol="features", outputCol="p").fit(d)
    mean = np.array(df.agg(F.array(*[F.avg(F.get(F.col(vector), i).cast("double")) for i in range(model.pc.numRows)])).first()[0])
    shift = mean @ model.pc.toArray()
    own = F.zip_with(vector_to_array("p"), F.array(*[F.lit(float(x)) for x in shift]), lambda a, b: a - b)
    return model.transform(d).select(F.col(ident).alias("id"), own.alias("v")), model.pc.toArray()


def pca_inverse(df: DataFrame, vector: str, components: np.ndarray, mean: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def back(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_numpy()) @ components.T + mean)) if len(s) else s

    return df.withColumn(vector, back(vector))


def normalized(df: DataFrame, vector: str, p: float = 2.0) -> DataFrame:
    """Rows scaled to p-norm 1 (p = inf: largest component 1)."""
    got = Normalizer(inputCol="features", outputCol="n_", p=p).transform(dense(df, vector))
    return got.withColumn(vector, vector_to_array("n_")).drop("features", "n_")


def random_projection(df: DataFrame, vector: str, dims: int, out: int, seed: int = 0) -> DataFrame:
    """Gaussian random projection to `out` dimensions; the matrix follows from the seed."""
    m = np.random.default_rng(seed).normal(size=(dims, out)) / np.sqrt(out)
    return _matmul(df, vector, m, lambda x: x)


def fourier_features(df: DataFrame, vector: str, dims: int, out: int, gamma: float, seed: int = 0) -> DataFrame:
    """Random Fourier features of the Gaussian kernel exp(-gamma d^2)."""
    rng = np.random.default_rng(seed)
    m, b = rng.normal(scale=np.sqrt(2 * gamma), size=(dims, out)), rng.uniform(0, 2 * np.pi, out)
    return _matmul(df, vector, m, lambda x: np.sqrt(2 / out) * np.cos(x + b))


def _matmul(df: DataFrame, vector: str, m: np.ndarray, f) -> DataFrame:
    @F.pandas_udf("array<double>")
    def times(s: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(s.to_numpy()) @ m))) if len(s) else s

    return df.withColumn(vector, times(vector))


def quantile_normal(df: DataFrame, col: str, parts: int = 1000) -> DataFrame:
    """A column mapped to a normal distribution through `parts` quantiles, interpolated between them."""
    from statistics import NormalDist

    qs = [i / parts for i in range(parts + 1)]
    edges = np.array(df.approxQuantile(col, qs, 0.001))

    @F.pandas_udf("double")
    def mapped(s: pd.Series) -> pd.Series:
        share = np.clip(np.interp(s, edges, qs), 1e-6, 1 - 1e-6)
        return pd.Series([NormalDist().inv_cdf(x) for x in share])

    return df.withColumn(col, mapped(col))


def incremental_scatter(df: DataFrame, vector: str, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) from one pass: each task hands on sums of a fixed size."""

    def part(it):
        n, s, m = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(part, "n long, s array<double>, m array<double>")
    got = rows.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(dims)]).alias("s"), F.array(*[F.sum(F.get("m", i)) for i in range(dims * dims)]).alias("m")).first()
    n = got["n"] or 0
    mean = np.array(got["s"]) / max(n, 1)
    return mean, np.array(got["m"]).reshape(dims, dims) / max(n, 1) - np.outer(mean, mean), n


def ransac(points: np.ndarray, fit, error, size: int, threshold: float, rounds: int = 200, seed: int = 0) -> tuple[object, np.ndarray]:
    """(model, inliers) of the hypothesis from `size` points that most points agree with; refitted on them."""
    rng = np.random.default_rng(seed)
    best, most = None, np.zeros(len(points), bool)
    for _ in range(rounds):
        model = fit(points[rng.choice(len(points), size, replace=False)])
        if model is None:
            continue
        inside = error(model, points) < threshold
        if inside.sum() > most.sum():
            best, most = model, inside
    return (fit(points[most]) if most.sum() >= size else best), most


def rounds_needed(size: int, inliers: float, confidence: float = 0.95, deviations: float = 2) -> int:
    """Rounds until a clean sample is likely, plus some standard deviations of the waiting time."""
    good = min(max(inliers**size, 1e-12), 1 - 1e-12)
    return int(np.ceil(np.log(1 - confidence) / np.log(1 - good) + deviations * np.sqrt(1 - good) / good))


def affine(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 least-squares affine map."""
    x = np.c_[src, np.ones(len(src))]
    return np.vstack([np.linalg.lstsq(x, dst, rcond=None)[0].T, [0, 0, 1]])


def similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 least-squares map of rotation, scale and shift."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, -y, 1, 0], [y, x, 0, 1]]
        rhs += [u, v]
    a, b, tx, ty = np.linalg.lstsq(np.array(rows, float), np.array(rhs, float), rcond=None)[0]
    return np.array([[a, -b, tx], [b, a, ty], [0, 0, 1]])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 projective map of four or more points, by the smallest singular vector."""
    rows = []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def negatives_without(tags: DataFrame, ident: str, tag: str, wanted: str, factor: int = 10, seed: int = 0) -> DataFrame:
    """(id, label): items with a tag, and up to factor times as many that share no tag with any of them."""
    pos = tags.where(F.col(tag) == wanted).select(F.col(ident).alias("id")).distinct()
    near = tags.join(pos.withColumnRenamed("id", ident), ident).select(tag).distinct()
    touched = tags.join(near, tag).select(F.col(ident).alias("id")).distinct()
    neg = tags.select(F.col(ident).alias("id")).distinct().join(touched, "id", "left_anti")
    n = pos.count() * factor
    return pos.withColumn("label", F.lit(1)).union(neg.orderBy(coin(F.col("id"), seed), "id").limit(n).withColumn("label", F.lit(0)))
