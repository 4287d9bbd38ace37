"""Vector search, distances, neighbours, co-occurrence embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A

METRICS = {"l1": A.l1, "l2": A.l2, "l2_squared": A.l2_squared, "chisq": A.chi_squared, "intersection": A.intersection, "bhattacharyya": A.bhattacharyya, "cosine": lambda a, b: 1 - A.cosine(a, b), "dot": lambda a, b: 1 - A.dot(a, b)}


def distances(df: DataFrame, vector: str, query: list[float], metric: str = "l2") -> Column:
    return METRICS[metric](F.col(vector), F.array(*[F.lit(float(x)) for x in query]))


def near(df: DataFrame, ident: str, vector: str, query: list[float], k: int, metric: str = "l2", radius: float | None = None) -> DataFrame:
    """(id, d): the k rows nearest to one vector, within a radius if told; ties by id."""
    out = df.select(F.col(ident).alias("id"), distances(df, vector, query, metric).alias("d"))
    if radius is not None:
        out = out.where(F.col("d") <= radius)
    return out.orderBy("d", "id").limit(k)


#: Queries that go to every task at once.
BLOCK = 10_000


def _block(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric in ("l2", "l2_squared"):
        d = np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0)
        return np.sqrt(d) if metric == "l2" else d
    dots = q @ x.T
    if metric == "dot":
        return 1 - dots
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return 1 - dots / np.where(norm == 0, np.nan, norm)
    return np.stack([np.abs(x - v).sum(1) for v in q])


def neighbours(df: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, metric: str = "l2", own: bool = False) -> DataFrame:
    """(query, rank, id, d): the k nearest rows of each query, exactly; ties by id.

    Queries go through in blocks of a bounded size: a block goes to every task, which keeps k rows a query from its
    own rows. Blocks are cut by seeking in the order of the ids, which must be unique.
    """
    slim = df.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = slim.schema["id"].dataType.simpleString()
    todo = queries.select(F.col(ident).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    tops, last = df.sparkSession.createDataFrame([], f"query {kind}, id {kind}, d double"), None
    while True:
        rows = (todo if last is None else todo.where(F.col("q") > F.lit(last))).orderBy("q").limit(BLOCK).collect()
        if rows:
            tops = tops.union(slim.mapInPandas(_scan(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), k, metric, own), tops.schema))
            last = rows[-1][0]
        if len(rows) < BLOCK:
            break
    w = W.partitionBy("query").orderBy("d", "id")
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "d")


def _scan(ids: np.ndarray, q: np.ndarray, k: int, metric: str, own: bool):
    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                d = _block(metric, q, np.stack(part["v"].to_numpy()))
                keep = min(k + (not own), len(part))
                cut = np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep]
                i, j = np.nonzero((d <= cut) | np.isnan(cut))
                got = pd.DataFrame({"query": ids[i], "id": part["id"].to_numpy()[j], "d": d[i, j]})
                if not own:
                    got = got[got["query"] != got["id"]]
                got = got if best is None else pd.concat([best, got])
                best = got.sort_values(["query", "d", "id"]).groupby("query").head(k)
        if best is not None:
            yield best

    return scan


def best_over_queries(nn: DataFrame) -> DataFrame:
    """(id, score): the highest 1 - d of each row over all queries."""
    return nn.groupBy("id").agg(F.max(1 - F.col("d")).alias("score"))


def summed_over_queries(nn: DataFrame) -> DataFrame:
    return nn.groupBy("id").agg(F.sum(1 - F.col("d")).alias("score"))


def density_rescored(scores: DataFrame, nn: DataFrame, least: float, k: int) -> DataFrame:
    """(id, score): scores from `least` on become least + the mean of exp(-d) to their k nearest positives."""
    dense = nn.where(F.col("rank") <= k).groupBy(F.col("query").alias("id")).agg((F.sum(F.exp(-F.col("d"))) / k).alias("density"))
    return scores.join(dense, "id", "left").select("id", F.when(F.col("score") >= least, F.lit(least) + F.coalesce("density", F.lit(0.0))).otherwise(F.col("score")).alias("score"))


def neighbour_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, jaccard) at k of neighbour lists b against a."""
    x, y = (t.where(F.col("rank") <= k) for t in (a, b))
    la, lb = x.groupBy("query").agg(F.collect_set("id").alias("a")), y.groupBy("query").agg(F.collect_set("id").alias("b"))
    hit = y.join(x.select("query", "id"), ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"))
    both = la.join(lb, "query").join(hit, "query", "left")
    n = F.size(F.array_intersect("a", "b"))
    return both.select("query", (n / F.size("a")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), (n / F.size(F.array_union("a", "b"))).alias("jaccard"))


def label_distance(a: Column, b: Column, kind: str) -> Column:
    """numeric: |a - b|; class: 0 or 1; multi: Jaccard distance of arrays, 1 for two empty ones."""
    if kind == "numeric":
        return F.abs(a - b)
    if kind == "class":
        return F.when(a == b, 0.0).otherwise(1.0)
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0)))


def concatenated(stores: list[DataFrame], key: str, vector: str) -> DataFrame:
    """(key, vector): the vectors of keys that every store has, one after the other."""
    out = stores[0].select(key, F.col(vector).alias("v0"))
    for i, s in enumerate(stores[1:], 1):
        out = out.join(s.select(key, F.col(vector).alias(f"v{i}")), key)
    return out.select(key, F.concat(*[F.col(f"v{i}") for i in range(len(stores))]).alias(vector))


def long_form(df: DataFrame, ident: str, vector: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.posexplode(vector).alias("dim", "x"))


def column_stats(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """One row: arrays of means and population deviations per dimension, without a row per component."""
    x = lambda i: F.get(F.col(vector), i).cast("double")
    return df.agg(F.array(*[F.avg(x(i)) for i in range(dims)]).alias("means"), F.array(*[F.stddev_pop(x(i)) for i in range(dims)]).alias("devs"))


def standardized(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """df with unit rows, then columns of mean 0 and population deviation 1."""
    unit = df.withColumn(vector, A.unit(F.col(vector)))
    s = column_stats(unit, vector, dims).first()
    means, devs = F.array(*map(F.lit, s["means"])), F.array(*[F.lit(x or 1.0) for x in s["devs"]])
    centred = F.zip_with(F.col(vector), means, lambda a, m: a - m)
    return unit.withColumn(vector, F.zip_with(centred, devs, lambda a, d: a / d))


def co_occurrence(lists: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): in how many groups two different items occur together; both orders."""
    one = lists.select(group, item).distinct()
    x, y = one.select(group, F.col(item).alias("a")), one.select(group, F.col(item).alias("b"))
    return x.join(y, group).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame, shift: float = 0.0) -> DataFrame:
    """(a, b, ppmi): positive pointwise mutual information of co-occurrence counts, less a shift."""
    row = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    col = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    total = pairs.agg(F.sum("n").alias("total"))
    joint = pairs.join(row, "a").join(col, "b").crossJoin(F.broadcast(total))
    v = F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))) - shift
    return joint.select("a", "b", F.greatest(v, F.lit(0.0)).alias("ppmi")).where("ppmi > 0")


def ppmi_embeddings(matrix: DataFrame, share: float = 0.9, most_items: int = 4000) -> DataFrame:
    """(item, v): unit rows of a singular value decomposition that keeps `share` of the variance.

    The dense matrix must fit the driver, so a vocabulary of over `most_items` raises an error; none is dropped.
    """
    items = [r[0] for r in matrix.groupBy("a").agg(F.sum("ppmi").alias("s")).limit(most_items + 1).collect()]
    if len(items) > most_items:
        raise ValueError(f"ppmi_embeddings takes at most {most_items} items")
    at = {x: i for i, x in enumerate(sorted(items))}
    m = np.zeros((len(at), len(at)))
    for r in matrix.where(F.col("a").isin(items) & F.col("b").isin(items)).collect():
        m[at[r["a"]], at[r["b"]]] = r["ppmi"]
    u, s, _ = np.linalg.svd(m)
    keep = int(np.searchsorted(np.cumsum(s**2) / max((s**2).sum(), 1e-300), share)) + 1
    v = u[:, :keep] * s[:keep]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return matrix.sparkSession.createDataFrame([(k, v[i].tolist()) for k, i in at.items()], "item string, v array<double>")


def encoded(c: Column, values: list[str], how: str = "onehot") -> Column:
    """A category as a vector: onehot, int, binary digits or hash buckets."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1, F.lit(-1))
    if how == "onehot":
        return F.array(*[F.when(c == v, 1.0).otherwise(0.0) for v in values])
    if how == "int":
        return F.array(place.cast("double"))
    if how == "binary":
        bits = max(1, (len(values) - 1).bit_length())
        return F.array(*[F.shiftright(place, i).bitwiseAND(1).cast("double") for i in range(bits)])
    return F.array((F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)).cast("double"))
