"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, lean, written
from .forest import Forest, candidates, kept, meet, numbered, plant, ranked
from .vectors import by_dimension, matrix, valid


def levels(dim: int) -> list[np.ndarray]:
    """Segment bounds from coarse to fine: 1, 2, 4, ... segments, down to segments of about two components."""
    out, n = [], 1
    while n <= max(1, dim // 2):
        out.append(np.unique(np.linspace(0, dim, n + 1).astype(int)))
        n *= 2
    return out


def statistics(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, root-length-weighted means and deviations of the segments.

    With the statistics a and b of two vectors, |a - b| never exceeds their distance (the means leave nothing out and
    the deviations obey Cauchy-Schwarz) and |a| is the vector's norm, so the product of a and b is no less than that
    of the vectors.
    """
    n = np.diff(bounds)
    mean = np.add.reduceat(x, bounds[:-1], axis=1) / n
    square = np.add.reduceat(x * x, bounds[:-1], axis=1) / n
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([n, n]))


def finest(x: np.ndarray) -> np.ndarray:
    return statistics(x, levels(x.shape[1])[-1]) if x.shape[1] else np.zeros((len(x), 1))


def least(floor: np.ndarray) -> np.ndarray:
    """The floors, less what rounding may take from a bound."""
    return floor - 1e-6 * (1 + np.abs(floor))


def balls(placed: DataFrame, forest: Forest, sample: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each length and level, centres and radii of the leaves' statistics: the mean of the sample rows in a leaf,
    and the distance of the leaf's farthest row from it, found in one pass over all rows."""
    centres: dict[int, list[np.ndarray]] = {}
    for dim in forest.base:
        n = forest.trees[dim].leaves if dim in forest.trees else 1
        x = sample[dim][1] if dim in sample else np.zeros((0, dim))
        leaf = forest.assign(x) - forest.base[dim] if len(x) else np.zeros(0, np.int64)
        count = np.maximum(np.bincount(leaf, minlength=n), 1)[:, None]
        centres[dim] = []
        for b in levels(dim) if dim else []:
            sums = np.zeros((n, 2 * len(b) - 2))
            np.add.at(sums, leaf, statistics(x, b)) if len(x) else None
            centres[dim].append(sums / count)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {d: np.full((len(c[0]), len(c)), -1.0) for d, c in centres.items() if c}
        for b in batches:
            for part, x in by_dimension(b, "v"):
                if (d := x.shape[1]) in most:
                    leaf = part.column(0).to_numpy() - forest.base[d]
                    for k, bounds in enumerate(levels(d)):
                        np.maximum.at(most[d][:, k], leaf, np.sqrt(((statistics(x, bounds) - centres[d][k][leaf]) ** 2).sum(axis=1)))
        for d, r in most.items():
            leaf, k = np.nonzero(r >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), d)), pa.array(leaf), pa.array(k), pa.array(r[leaf, k])], ["dim", "leaf", "level", "r"])

    out = {d: [(c, np.full(len(c), -np.inf)) for c in cs] for d, cs in centres.items()}
    for d, leaf, k, r in placed.mapInArrow(lean(far), "dim long, leaf long, level long, r double").groupBy("dim", "leaf", "level").agg(F.max("r")).collect():
        out[d][k][1][leaf] = r
    return out


def visited(q: np.ndarray, floor: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which leaves may hold a row whose product with the query reaches its floor, coarse to fine: over a ball of
    statistics the product is at most that with the centre, and the query's norm times the radius."""
    alive = np.ones((len(q), len(own[0][0]) if own else 1), bool)
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    for b, (c, r) in zip(levels(q.shape[1]), own):
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        bound = statistics(q[some], b) @ c.T + norm[some] * np.maximum(r, 0)
        alive[some] &= (bound >= least(floor[some])[:, None]) & (r >= 0)
    return alive


def block_topk(q: np.ndarray, floor: np.ndarray, rows_of: list[np.ndarray], x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): what forest.kept() takes of the highest inner products of each query with its rows.

    Each level of statistics drops the rows whose bound is under the floor, a score that k rows are known to reach
    whichever id is left out; survivors are scored exactly in integers.
    """
    big = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    plain = float(big) ** 2 * max(x.shape[1], 1) < 2**52
    stats = [(statistics(q, b), statistics(x, b)) for b in levels(x.shape[1])] if x.shape[1] and plain else []
    unique = len(np.unique(ids)) == len(ids)
    whole = None if plain else (q.astype(np.int64), x.astype(np.int64))
    out: list[tuple[np.ndarray, ...]] = []

    def score(i: int, rows: np.ndarray) -> np.ndarray:
        return (x[rows] @ q[i]).astype(np.int64) if plain else (whole[1][rows] * whole[0][i]).sum(axis=1)

    for i, rows in enumerate(rows_of):
        low = floor[i]
        if len(rows) > 8 * k and stats and unique:
            a, b = stats[min(3, len(stats) - 1)]
            seeds = rows[np.argpartition(-(b[rows] @ a[i]), 2 * k)[: 2 * k]]
            low = max(low, np.sort(score(i, seeds))[-k - 1])
        for a, b in stats:
            if len(rows) <= 2 * k:
                break
            rows = rows[b[rows] @ a[i] >= least(low)]
        got = score(i, rows)
        at = kept(np.zeros(len(rows), np.int64), ids[rows], -got, k)
        out.append((np.full(len(at), i), rows[at], got[at]))
    return tuple(np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out) if out else ((), (), ())))


def search(df: DataFrame, is_query, k: int = 5, scale: int = 256, ident: str = "vec_id", vector: str = "embedding", sample_rows: int = 20_000, most_sample: int = 200_000, floor_rows: int = 20_000, rows_per_block: int = 16384, queries_per_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * x), own id excluded.

    `is_query` selects the queries by the column `id`. Rows lie in the leaves of a k-means tree over their finest
    statistics (forest.plant() states the bounds of its sample). A query's floor is its (k + 1)-th best score among at
    most `floor_rows` sample rows, sent to all tasks; it visits the leaves whose ball of statistics can reach that, and
    in a block each level of statistics drops further rows. Only vectors of a query's own length are its candidates.
    Null and non-finite vectors and null ids take no part. Repeated rows are candidates of their own, at most k to a
    list; equal query vectors are searched once; lists of one id merge. Scores are exact while components stay under
    2^31; beyond that they wrap as long, and every leaf is visited. An empty table gives no rows.
    """
    own = valid(df, ident, vector, zero=True).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = written(candidates(own, k), "candidates")
    queries = numbered(own.where(is_query))
    big, dim = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    prune = big is not None and float(big) ** 2 * max(dim, 1) < 2**52
    forest, placed, sample = plant(rows, rows_per_block, sample_rows, most_sample, finest)
    discard(rows)
    own_balls = balls(placed, forest, sample) if prune else {}
    total = sum(len(i) for i, _ in sample.values())
    known = {}
    for d, (ids, x) in sample.items():
        first = np.sort(np.unique(ids, return_index=True)[1])[: max(1, floor_rows * len(ids) // max(total, 1))]
        known[d] = x[first]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for part, q in by_dimension(whole.slice(at, 256), "v"):
                    d = q.shape[1]
                    floor, alive = np.full(len(q), -np.inf), np.ones((len(q), forest.trees[d].leaves if d in forest.trees else 1), bool)
                    if prune and len(known.get(d, ())) > k:
                        floor = np.sort(np.partition(q @ known[d].T, -k - 1, axis=1)[:, -k - 1 :], axis=1)[:, 0]
                        alive = visited(q, floor, own_balls[d])
                    leaves = [(forest.base[d] + np.flatnonzero(a)).tolist() for a in alive]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int64())), pa.array(floor)], ["q1", "q2", "v", "leaves", "floor"])

    routed = queries.select("q1", "q2", "v").dropDuplicates(["q1", "q2"]).mapInArrow(lean(route), "q1 long, q2 long, v array<double>, leaves array<long>, floor double")

    def pair(x: pa.Table, q: pa.Table) -> pa.Table:
        leaf = x["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, ids = leaf[order], x["id"].to_numpy()[order]
        rows_of = []
        for leaves in q["leaves"]:
            want = np.sort(np.asarray(leaves.as_py()))
            a, z = np.searchsorted(leaf, want), np.searchsorted(leaf, want, side="right")
            rows_of.append(np.concatenate([np.arange(i, j) for i, j in zip(a, z)]))
        i, j, s = block_topk(matrix(q["v"]), q["floor"].to_numpy(), rows_of, matrix(x["v"])[order], ids, k)
        return pa.table({"q1": q["q1"].to_numpy()[i], "q2": q["q2"].to_numpy()[i], "id": ids[j], "score": -s})

    lists = meet(forest, placed, routed, pair, rows_per_block, queries_per_block, "long")
    return ranked(lists, queries.select("id", "q1", "q2").distinct(), k, [placed]).withColumn("score", -F.col("score"))
