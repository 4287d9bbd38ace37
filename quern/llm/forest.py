"""What the vector searches share: k-means trees over a sample, rows placed in leaves, leaves in blocks, and queries
that meet the blocks they visit.

There is a tree for each vector length with more rows than fit a block; shorter lists of rows are one leaf. A leaf lies
in one block, or in several if it is large, and a block's rows are sent once per `queries_per_block` queries that visit
it, so what is shuffled follows the visits and not all pairs of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, lean, written
from .vectors import by_dimension, matrix


@dataclass
class Tree:
    """centres[n], spread[n] (mean squared distance of its sample rows to the centre) and children[n] of node n; leaf[n]
    is a leaf's number in tree order, -1 for inner nodes."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child, level by level."""
        out = np.full(len(x), -1, np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[n]:
                out[rows] = self.leaf[n]
                continue
            kids = np.array(self.children[n])
            near = nearest(x[rows], self.centres[kids])
            todo += [(int(kid), rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of best-bin-first traversal: always the open node whose rows promise to be nearest.

        The squared distance to a node's rows has the mean d^2 + spread and a deviation of about 2 d sqrt(spread / dim);
        the near rows of a node lie about two deviations under its mean. The distance to the centre alone would put
        wide nodes, whose centres are nearer to everything than their rows are, before tight ones.
        """
        heap, out, dim = [(0.0, 0)], [], max(1, len(q))
        while heap and len(out) < most:
            _, n = heapq.heappop(heap)
            if kids := self.children[n]:
                d = ((self.centres[kids] - q) ** 2).sum(axis=1)
                d = d + self.spread[kids] - 4 * np.sqrt(d * self.spread[kids] / dim)
                for kid, x in zip(kids, d):
                    heapq.heappush(heap, (float(x), kid))
            else:
                out.append(int(self.leaf[n]))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norm = (centres * centres).sum(axis=1)
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = np.argmin(norm - 2 * (x[a : a + 8192] @ centres.T), axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; empty clusters vanish."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums[n > 0] / n[n > 0][:, None]
    return centres


def build(sample: np.ndarray, branching: int = 16, leaf_rows: int = 64, seed: int = 5) -> Tree:
    """Splits the sample by k-means until a node holds at most `leaf_rows` sample rows or only equal ones."""
    rng = np.random.default_rng(seed)
    wide = lambda x, c: float(((x - c) ** 2).sum(axis=1).mean())
    centres, children = [sample.mean(axis=0)], [[]]
    spread = [wide(sample, centres[0])]
    todo = [(0, sample)]
    while todo:
        n, x = todo.pop()
        if len(x) <= leaf_rows or (x == x[0]).all():
            continue
        c = kmeans(x, min(branching, max(2, len(x) // leaf_rows)), rng)
        near = nearest(x, c)
        if len(c) < 2 or len(np.unique(near)) < 2:
            continue
        for i in range(len(c)):
            own = x[near == i]
            centres.append(c[i])
            spread.append(wide(own, c[i]) if len(own) else 0.0)
            children.append([])
            children[n].append(len(centres) - 1)
            todo.append((len(centres) - 1, own))
    leaf, count, stack = np.full(len(centres), -1, np.int64), 0, [0]
    while stack:
        n = stack.pop()
        if children[n]:
            stack += children[n][::-1]
        else:
            leaf[n] = count
            count += 1
    return Tree(np.array(centres), np.array(spread), children, leaf, count)


def candidates(own: DataFrame, k: int) -> DataFrame:
    """The rows of own (id, v) that any list of k neighbours could need: of equal vectors those of the k + 1 smallest
    ids, and k rows of an id. A vector that a third of all rows hold is cut down before it is shuffled."""
    rows = own.withColumn("h", F.xxhash64("v"))
    rows = rows.withColumn("r", F.dense_rank().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("h", "v", "id").orderBy("id"))).where(F.col("r") <= k)
    return rows.select("id", "v")


@dataclass
class Forest:
    """A tree and its first leaf number for each vector length; lengths without a tree are one leaf. sample and ids:
    the drawn rows of each length that has a tree, those that the tree was not fitted on first."""

    trees: dict[int, Tree]
    base: dict[int, int]
    leaves: int
    space: Callable[[np.ndarray], np.ndarray]
    counts: np.ndarray
    dims: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        tree = self.trees.get(dim)
        return self.base[dim] + (tree.assign(self.space(x)) if tree else np.zeros(len(x), np.int64))

    def order(self, q: np.ndarray, most: int) -> list[int]:
        tree = self.trees.get(len(q))
        return [self.base[len(q)] + n for n in tree.order(self.space(q[None])[0], most)] if tree else [self.base[len(q)]]

    def layout(self, rows_per_block: int) -> tuple[np.ndarray, np.ndarray]:
        """(first block, number of blocks) of each leaf; leaves next to each other share a block, lengths never do."""
        first, parts, block, room, dim = np.zeros(self.leaves, np.int64), np.ones(self.leaves, np.int64), -1, 0, -1
        for leaf, n in enumerate(self.counts.tolist()):
            most = capacity(int(self.dims[leaf]), rows_per_block)
            if n > room or self.dims[leaf] != dim:
                block, room, dim = block + 1, most, self.dims[leaf]
            first[leaf] = block
            if n > most:
                parts[leaf] = -(-n // most)
                block, room = block + int(parts[leaf]) - 1, 0
            else:
                room -= n
        return first, parts


def capacity(dim: int, rows_per_block: int) -> int:
    """Rows of a block: no more than 64 MB of doubles."""
    return max(64, min(rows_per_block, (64 << 20) // (8 * max(dim, 1))))


def plant(rows: DataFrame, rows_per_block: int, sample_rows: int, most_sample: int, space: Callable[[np.ndarray], np.ndarray], probes: int = 0) -> tuple[Forest, DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The forest, the rows in their leaves as a written table (leaf, id, v), and (ids, sample) of each length with a
    tree, of which the first `probes` (a tenth of the sample at most) took no part in building it.

    The sample, drawn by a hash of id and vector, is a fiftieth of the rows, but at least `sample_rows` and at most
    `most_sample` of all lengths together: leaves hold about as many rows each until the latter bound is reached.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}
    total = sum(sizes.values())
    large = [d for d, n in sizes.items() if n > capacity(d, rows_per_block)]
    share = min(most_sample, max(sample_rows, total // 50))
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if large:
        drawn = rows.where(F.size("v").isin(large) & (F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(total)) < share)).orderBy(F.xxhash64("id", F.lit(4)), "id").toArrow()
        lengths = np.array([len(v) for v in drawn["v"]], np.int64)
        for d in large:
            part = drawn.filter(pa.array(lengths == d))
            if part.num_rows:
                sample[d] = part["id"].to_numpy(), matrix(part["v"])
    trees, base, leaves, dims = {}, {}, 0, []
    for d in sorted(sizes):
        if d in sample:
            x = sample[d][1]
            trees[d] = build(space(x[min(probes, len(x) // 10) :]))
        base[d], n = leaves, trees[d].leaves if d in trees else 1
        leaves += n
        dims += [d] * n
    forest = Forest(trees, base, leaves, space, np.zeros(leaves, np.int64), np.array(dims, np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in by_dimension(b, "v"):
                yield pa.RecordBatch.from_arrays([pa.array(forest.assign(x)), *part.columns], ["leaf", "id", "v"])

    placed = written(rows.select("id", "v").mapInArrow(lean(place), "leaf long, id long, v array<double>"), "placed")
    for leaf, n in placed.groupBy("leaf").count().collect():
        forest.counts[leaf] = n
    return forest, placed, sample


def numbered(queries: DataFrame) -> DataFrame:
    """queries (id, v) with a 128-bit number of the vector, q1 and q2."""
    return queries.select("id", "v", F.xxhash64("v").alias("q1"), F.xxhash64(F.lit(1), "v").alias("q2"))


def meet(forest: Forest, placed: DataFrame, routed: DataFrame, pair: Callable[[pa.Table, pa.Table], pa.Table], rows_per_block: int, queries_per_block: int, score: str = "double") -> DataFrame:
    """(q1, q2, id, score): pair(rows, queries) of every block and every share of the queries that visit it.

    routed: (q1, q2, v, leaves, floor) of each distinct query. A query goes to all blocks of the leaves it visits; rows
    of blocks that none visits are not sent.
    """
    first, parts = forest.layout(rows_per_block)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            for i, leaves in enumerate(b.column(3)):
                to: dict[int, list[int]] = {}
                for leaf in leaves.as_py():
                    if forest.counts[leaf]:
                        for p in range(parts[leaf]):
                            to.setdefault(int(first[leaf]) + p, []).append(leaf)
                out += [(i, block, own) for block, own in to.items()]
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int64()), *[b.column(k).take(rows) for k in (0, 1, 2)], pa.array([o[2] for o in out], pa.list_(pa.int64())), b.column(4).take(rows)], ["block", "q1", "q2", "v", "leaves", "floor"])

    sent = written(routed.mapInArrow(lean(to_blocks), "block long, q1 long, q2 long, v array<double>, leaves array<long>, floor double"), "routed")
    shares = np.zeros(int((first + parts).max(initial=0)), np.int64)
    for block, n in sent.groupBy("block").count().collect():
        shares[block] = -(-n // queries_per_block)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            leaf = b.column(0).to_numpy()
            at = first[leaf] + (row + np.arange(len(leaf))) % parts[leaf]
            row += len(leaf)
            for s in range(shares[at].max(initial=0)):
                own = np.flatnonzero(shares[at] > s)
                yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(np.full(len(own), s)), *[c.take(pa.array(own)) for c in b.columns]], ["block", "share", "leaf", "id", "v"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = shares[b.column(0).to_numpy()]
            s = (b.column(1).to_numpy().view(np.uint64) >> np.uint64(33)).astype(np.int64) % np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[1:]], ["block", "share", "q1", "q2", "v", "leaves", "floor"])

    none = pa.array([], pa.int64())
    empty = pa.table({"q1": none, "q2": none, "id": none, "score": none.cast(pa.float64() if score == "double" else pa.int64())})

    def both(x: pa.Table, q: pa.Table) -> pa.Table:
        return pair(x, q) if x.num_rows and q.num_rows else empty

    left = placed.mapInArrow(lean(spread), "block long, share long, leaf long, id long, v array<double>")
    right = sent.mapInArrow(lean(shared), "block long, share long, q1 long, q2 long, v array<double>, leaves array<long>, floor double")
    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(both, f"q1 long, q2 long, id long, score {score}")


def kept(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's lowest scores, ties to smaller ids, in order: enough that k stay whichever id is left out.
    Of an id k rows count; without repeated ids these are k + 1 rows, else 2 k."""
    order = np.lexsort((ids, score, query))
    q, i = query[order], ids[order]
    by_id = np.lexsort((np.arange(len(q)), i, q))
    copy = np.empty(len(q), np.int64)
    copy[by_id] = _ranks((np.diff(q[by_id], prepend=-1) != 0) | (np.diff(i[by_id], prepend=-1) != 0) | (np.arange(len(q)) == 0))
    order = order[copy < k]
    rank = _ranks(np.diff(query[order], prepend=-1) != 0)
    return order[rank < (2 * k if copy.any() else k + 1)]


def _ranks(new: np.ndarray) -> np.ndarray:
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def ranked(lists: DataFrame, queries: DataFrame, k: int, used: list[DataFrame]) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k lowest scores with its own id left out, from the lists of its
    vector. The lists are cut and written first; then the used tables can go, and a vector that many queries share
    meets them in a join that adaptive execution can split."""
    vector = W.partitionBy("q1", "q2")
    short = lists.withColumn("copy", F.row_number().over(W.partitionBy("q1", "q2", "id").orderBy("score"))).where(F.col("copy") <= k)
    short = short.withColumn("r", F.row_number().over(vector.orderBy("score", "id"))).where(F.col("r") <= 2 * k)
    short = written(short.select("q1", "q2", F.col("id").alias("vec_id"), "score"), "lists")
    for done in used:
        discard(done)
    both = queries.select(F.col("id").alias("query_id"), "q1", "q2").join(short, ["q1", "q2"]).where("query_id <> vec_id")
    own = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return own.select("query_id", "rank", "vec_id", "score")
