"""Classifiers and regressors by name, nearest-neighbour predictions, prediction tasks, weights of dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ml
from . import vectors as V


def weighted(vector: Column, weights: list[float]) -> Column:
    """The vector with each dimension times its weight."""
    return F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)


def importance(model) -> list[float]:
    """Weights of the dimensions from a fitted linear model: the mean size of its coefficients over the classes."""
    rows = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else np.atleast_2d(model.coefficients.toArray())
    return np.abs(rows).mean(axis=0).tolist()


def mapped(df: DataFrame, vector: str, method: str, dims: int, gamma: float, features: int) -> DataFrame:
    """df as a linear model of the method takes it: for "rbf" by random features of the Gaussian kernel."""
    return ml.fourier_features(df, vector, dims, features, gamma) if method == "rbf" else df


def classified(train: DataFrame, todo: DataFrame, ident: str, vector: str, label: str, method: str, dims: int, k: int = 10, gamma: float = 1.0, features: int = 512) -> DataFrame:
    """(id, score) of class 1, rows of each class weighing the same in sum: "rbf" (random features, then support vectors),
    "linear" and "sgd" (support vectors by gradient steps), "logistic", or "knn" (the share among the k nearest)."""
    if method == "knn":
        return nearest(train.withColumn(label, (F.col(label) == 1).cast("double")), todo, ident, vector, label, k).select("id", F.col("mean").alias("score"))
    a, b = (mapped(t, vector, method, dims, gamma, features) for t in (train, todo))
    return ml.fit_and_score(a, b, ident, vector, label, "logistic" if method == "logistic" else "linear")


def predicted(train: DataFrame, todo: DataFrame, ident: str, vector: str, target: str, method: str, dims: int, k: int = 10, gamma: float = 1.0, features: int = 512) -> DataFrame:
    """(id, prediction): "ridge", "linear" and "sgd" (squared and Huber loss), "rbf" (random features) or "knn" (mean of
    the k nearest)."""
    if method == "knn":
        return nearest(train, todo, ident, vector, target, k).select("id", F.col("mean").alias("prediction"))
    a, b = (ml.dense(mapped(t, vector, method, dims, gamma, features), vector) for t in (train.withColumn("label", F.col(target).cast("double")), todo))
    robust = method in ("linear", "sgd")
    model = LinearRegression(regParam=1e-4 if robust else 1e-2, loss="huber" if robust else "squaredError").fit(a)
    return model.transform(b).select(F.col(ident).alias("id"), "prediction")


def nearest(train: DataFrame, todo: DataFrame, ident: str, vector: str, label: str, k: int) -> DataFrame:
    """(id, vote, mean): the commonest label (the smallest of equally common ones) and the mean of the k nearest rows of
    train, a row's own id left out."""
    near = V.neighbours(train, todo, ident, vector, k).join(train.select(F.col(ident).alias("id"), F.col(label).alias("y")), "id")
    votes = near.groupBy("query", "y").agg(F.count("*").alias("n"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "y")).alias("m"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("mean"))
    return best.select(F.col("query").alias("id"), F.col("m.y").alias("vote"), "mean")


def balanced_accuracy(df: DataFrame, label: str, guess: str) -> DataFrame:
    """One row: the mean over the classes of the share that is guessed right."""
    each = df.groupBy(label).agg(F.avg((F.col(label) == F.col(guess)).cast("double")).alias("recall"))
    return each.agg(F.avg("recall").alias("balanced_accuracy"))


def tasks(values: DataFrame, name: str, kind: str, least_positive: int = 10) -> DataFrame:
    """(task, type, id, y) from (id, value): numeric labels as they are, by logarithm and by exponential of their height
    over the smallest; labels of 1 and -1 as a binary task from `least_positive` positives on; others as classes. A task
    with a value that is not finite is left out."""
    v = F.col("value").cast("double")
    if kind == "numeric":
        low = values.agg(F.min(v).alias("low_"))
        up = v - F.col("low_") + 1
        rows = values.crossJoin(F.broadcast(low)).select("id", F.explode(F.create_map(F.lit(f"{name}-regression-orig"), v, F.lit(f"{name}-regression-log"), F.log1p(up), F.lit(f"{name}-regression-exp"), F.expm1(up))).alias("task", "y"))
        rows = rows.withColumn("type", F.lit("regression"))
    else:
        seen = values.agg(F.count_if(v > 0).alias("pos_"), F.max(~v.isin(1, -1)).alias("other_"), F.count_distinct(v).alias("n_"))
        binary = ~F.col("other_") & (F.col("n_") == 2)
        rows = values.crossJoin(F.broadcast(seen)).where(~binary | (F.col("pos_") >= least_positive))
        rows = rows.select(F.when(binary, f"{name}-binary").otherwise(f"{name}-multiclass-orig").alias("task"), F.lit("classification").alias("type"), "id", v.alias("y"))
    bad = rows.where(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).select("task").distinct()
    return rows.join(F.broadcast(bad), "task", "left_anti").select("task", "type", "id", "y")


def similarity_scores(df: DataFrame, ident: str, vector: str, query: list[float], negate: bool = False) -> DataFrame:
    """(id, score): the fifth root of the cosine similarity to a query, or what it lacks to 1; null below 0."""
    s = 1 - V.distances(df, vector, query, "cosine")
    root = F.when(s >= 0, F.pow(s, F.lit(0.2)))
    return df.select(F.col(ident).alias("id"), (1 - root if negate else root).alias("score"))


def target_encoded(c: Column, targets: dict[str, list[float]]) -> Column:
    """A category as the vector that stands for it; null for an unknown one."""
    known = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
    return F.try_element_at(known, c)


def filled_distances(known: DataFrame, pairs: DataFrame, rows: DataFrame, ident: str, vector: str, metric: str = "l2") -> DataFrame:
    """(a, b, d): the known distances, and those of the pairs (a < b) that are missing, computed."""
    x, y = rows.select(F.col(ident).alias("a"), F.col(vector).alias("x_")), rows.select(F.col(ident).alias("b"), F.col(vector).alias("y_"))
    new = pairs.join(known, ["a", "b"], "left_anti").join(x, "a").join(y, "b")
    return known.select("a", "b", "d").union(new.select("a", "b", V.METRICS[metric](F.col("x_"), F.col("y_")).alias("d")))


def eigenpairs(m: np.ndarray, keep: float = -1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, largest first, and their vectors as columns: all, the first `keep`, or for a
    share below 1 as many as hold it of the sum."""
    values, vecs = np.linalg.eigh(m)
    values, vecs = values[::-1], vecs[:, ::-1]
    n = len(values) if keep < 0 else int(keep) if keep >= 1 else int(np.searchsorted(np.cumsum(values) / values.sum(), keep) + 1)
    return values[:n], vecs[:, :n]
