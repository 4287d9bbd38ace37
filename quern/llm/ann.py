"""Approximate nearest neighbours: hierarchical k-means trees, searched best bin first."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, lean, written
from .forest import Forest, candidates, kept, meet, numbered, plant, ranked
from .vectors import by_dimension, matrix, valid

log = logging.getLogger(__name__)


def near(q: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row): pairs among which are the `most` rows nearest to each query, with all ties. The products that
    choose them are rounded, so what lies within their error of the last is taken too."""
    norm, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
    if len(x) <= most:
        return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    at, rows = [], []
    step = max(1, (4 << 20) // len(x))
    for a in range(0, len(q), step):
        d = norm - 2 * (q[a : a + step] @ x.T)
        last = np.partition(d, most - 1, axis=1)[:, most - 1]
        i, j = np.nonzero(d <= (last + 1e-10 * (norm.max() + own[a : a + step]))[:, None])
        at.append(i + a)
        rows.append(j)
    return np.concatenate(at), np.concatenate(rows)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b, place by place, in double precision."""
    return np.concatenate([np.sqrt(((a[k : k + 65536] - b[k : k + 65536]) ** 2).sum(axis=1)) for k in range(0, max(len(a), 1), 65536)])


def exact(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): what kept() takes of all pairs of the queries and rows."""
    unique = len(np.unique(ids)) == len(ids)
    out = []
    step = max(1, len(q) if unique else (2 << 20) // len(x))
    for a in range(0, len(q), step):
        i, j = near(q[a : a + step], x, k + 1 if unique else len(x))
        d = distances(q[i + a], x[j])
        at = kept(i, ids[j], d, k)
        out.append((i[at] + a, j[at], d[at]))
    return tuple(np.concatenate(z) for z in zip(*out))


def calibrate(placed: DataFrame, forest: Forest, sample: dict[int, tuple[np.ndarray, np.ndarray]], probes: int, k: int, recall: float) -> dict[int, tuple[int, float]]:
    """(leaf visits, recall at them) of each length that has a tree: the fewest at which its probes find `recall` of
    their exact k nearest among all rows, and 95 of 100 probes nine tenths of theirs (a hot cluster, whose own rows
    need few visits, would hide the others in the mean).

    The exact lists come from one pass of brute force for the probes, a fixed number; each task hands on k rows a
    probe. The visits are widened until both aims are reached.
    """
    some = {d: (ids[: min(probes, max(1, len(ids) // 10))], x[: min(probes, max(1, len(ids) // 10))]) for d, (ids, x) in sample.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, x in by_dimension(b, "v"):
                if (dim := x.shape[1]) not in some:
                    continue
                own_ids, q = some[dim]
                leaf, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                i, j = near(q, x, k + 1)
                i, j = (z[ids[j] != own_ids[i]] for z in (i, j))
                found = [i, ids[j], distances(q[i], x[j]), leaf[j]]
                if dim in best:
                    found = [np.concatenate(z) for z in zip(best[dim], found)]
                at = kept(found[0], found[1], found[2], k)
                best[dim] = [z[at] for z in found]
        for dim, (i, ids, d, leaf) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim)), pa.array(i), pa.array(ids), pa.array(d), pa.array(leaf)], ["dim", "probe", "id", "d", "leaf"])

    found = placed.mapInArrow(lean(brute), "dim long, probe long, id long, d double, leaf long")
    w = W.partitionBy("dim", "probe").orderBy("d", "id")
    need: dict[int, dict[int, list[int]]] = {}
    for dim, i, leaf in found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("dim", "probe", "leaf").collect():
        need.setdefault(dim, {}).setdefault(i, []).append(leaf)
    out = {d: (1, 1.0) for d in some}
    for dim, lists in need.items():
        tree, base = forest.trees[dim], forest.base[dim]
        places = []
        for i, leaves in lists.items():
            place = {base + n: p + 1 for p, n in enumerate(tree.order(forest.space(some[dim][1][i][None])[0], tree.leaves))}
            places.append(sorted(place[n] for n in leaves))
        every = np.sort(np.concatenate([np.array(v) for v in places]))
        of_mean = every[int(np.ceil(recall * len(every))) - 1]
        of_each = np.sort([v[int(np.ceil(0.9 * len(v))) - 1] for v in places])
        visits = int(max(of_mean, of_each[int(np.ceil(0.95 * len(of_each))) - 1]))
        out[dim] = visits, float((every <= visits).mean())
        log.info("%d components: %d of %d leaves a query, recall %.3f", dim, visits, tree.leaves, out[dim][1])
    return out


def search(df: DataFrame, is_query, k: int = 10, ident: str = "vec_id", vector: str = "embedding", sample_rows: int = 20_000, most_sample: int = 200_000, probes: int = 200, recall: float = 0.97, rows_per_block: int = 16384, queries_per_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest rows by Euclidean distance, own id excluded.

    Candidates of a query are the vectors of its own length. Each length with more rows than fit a block has a tree of
    its own, fitted on rows drawn by a hash (forest.plant() states the bounds); every row is assigned to a leaf. A
    query visits leaves best bin first, as many as `probes` drawn rows that the tree was not fitted on need to reach
    `recall` against brute force over all rows (calibrate(), which logs both). Lengths of fewer rows are searched
    exactly. Null, zero and non-finite vectors and null ids take no part. Repeated rows are candidates of their own,
    at most k to a list; equal query vectors are searched once; lists of one id merge. An empty table gives no rows.
    """
    own = valid(df, ident, vector, zero=False)
    rows = written(candidates(own, k), "candidates")
    queries = numbered(own.where(is_query))
    forest, placed, sample = plant(rows, rows_per_block, sample_rows, most_sample, lambda x: x, probes)
    discard(rows)
    visits = {d: v for d, (v, _) in calibrate(placed, forest, sample, probes, k, recall).items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in by_dimension(b, "v"):
                leaves = [forest.order(q, visits.get(len(q), 1)) for q in x]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int64())), pa.array(np.zeros(len(x)))], ["q1", "q2", "v", "leaves", "floor"])

    routed = queries.select("q1", "q2", "v").dropDuplicates(["q1", "q2"]).mapInArrow(lean(route), "q1 long, q2 long, v array<double>, leaves array<long>, floor double")

    def pair(x: pa.Table, q: pa.Table) -> pa.Table:
        leaf = x["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, m, ids, qm = leaf[order], matrix(x["v"])[order], x["id"].to_numpy()[order], matrix(q["v"])
        lists = q["leaves"].combine_chunks()
        visit, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(qm)), np.diff(lists.offsets.to_numpy()))
        found: list[tuple[np.ndarray, ...]] = []
        for n in np.unique(visit):
            a, z = np.searchsorted(leaf, n), np.searchsorted(leaf, n, side="right")
            some = who[visit == n]
            if z > a:
                i, j, d = exact(qm[some], m[a:z], ids[a:z], k)
                found.append((some[i], ids[a:z][j], d))
        i, got, d = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at = kept(i, got, d, k)
        return pa.table({"q1": q["q1"].to_numpy()[i[at]], "q2": q["q2"].to_numpy()[i[at]], "id": got[at], "score": d[at]})

    return ranked(meet(forest, placed, routed, pair, rows_per_block, queries_per_block), queries.select("id", "q1", "q2").distinct(), k, [placed])
