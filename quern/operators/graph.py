"""Graphs as edge tables (src, dst, w). Loops are bounded and cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import coin, numbered


def _cut(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst").distinct()


def shortest_paths(edges: DataFrame, source, most: int = 10_000) -> DataFrame:
    """(id, d, prev): distances from one node and the node before on a shortest path (the smallest of equal ones).

    Frontier relaxation: a round joins only the nodes that got nearer with their edges, until none does.
    """
    e = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    known = spark.createDataFrame([(source, 0.0, None)], f"id {kind.simpleString()}, d double, prev {kind.simpleString()}")
    front = known
    for _ in range(most):
        step = front.join(e, front["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), F.col("src").alias("prev"))).alias("m"))
        step = step.select("id", F.col("m.d").alias("d"), F.col("m.prev").alias("prev"))
        front = _cut(step.join(known.select("id", F.col("d").alias("old")), "id", "left").where("old IS NULL OR d < old").drop("old"))
        if front.isEmpty():
            return known
        known = _cut(known.join(front.select("id"), "id", "left_anti").union(front))
    raise RuntimeError(f"paths not settled after {most} rounds")


def all_pairs(edges: DataFrame, most: int = 12) -> DataFrame:
    """(src, dst, d): shortest distances between all connected pairs, by doubling path lengths."""
    d = _cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("d")))
    mark = None
    for _ in range(most):
        a, b = d.alias("a"), d.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select("a.src", "b.dst", (F.col("a.d") + F.col("b.d")).alias("d"))
        d = _cut(d.union(longer).groupBy("src", "dst").agg(F.min("d").alias("d")))
        now = d.agg(F.count("*"), F.sum("d")).first()
        if now == mark:
            return d
        mark = now
    raise RuntimeError(f"distances not settled after {most} rounds")


def breadth_first(edges: DataFrame, source, target=None, most: int = 10_000) -> DataFrame:
    """(id, hops): fewest edges from the source, up to the round that reaches the target; an error after `most` rounds."""
    kind = edges.schema["src"].dataType.simpleString()
    seen = edges.sparkSession.createDataFrame([(source, 0)], f"id {kind}, hops int")
    for i in range(1, most + 1):
        front = seen.where(F.col("hops") == i - 1)
        new = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = _cut(new.select("id", F.lit(i).alias("hops")))
        if new.isEmpty():
            return seen
        seen = _cut(seen.union(new))
        if target is not None and not new.where(F.col("id") == F.lit(target)).isEmpty():
            return seen
    raise RuntimeError(f"the search has not ended after {most} rounds")


def route(edges: DataFrame, source, target, most: int = 10_000) -> tuple[list, float]:
    """(nodes, length) of a shortest path among the edges that breadth-first search explores; ([], inf) if none."""
    area = breadth_first(edges, source, target, most)
    near = edges.join(area.select(F.col("id").alias("src")), "src", "left_semi")
    rows = {r["id"]: (r["d"], r["prev"]) for r in shortest_paths(near, source, most).collect()} if not area.where(F.col("id") == F.lit(target)).isEmpty() else {}
    if target not in rows:
        return [], float("inf")
    path = [target]
    while path[-1] != source:
        path.append(rows[path[-1]][1])
    return path[::-1], rows[target][0]


def flow(scores: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(id, score): scores carried through edge layers in turn, summed per node."""
    for e in layers:
        scores = scores.join(e, scores["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))
    return scores


def combined(flows: list[tuple[float, DataFrame]], op: str = "add") -> DataFrame:
    """(id, score): weighted sums (or products over nodes of every flow) of flows, no less than 0."""
    out = None
    for factor, f in flows:
        one = f.select("id", (F.col("score") * factor).alias("score"))
        out = one if out is None else out.union(one)
    agg = F.sum("score") if op == "add" else F.when(F.count("*") == len(flows), F.product("score"))
    return out.groupBy("id").agg(F.greatest(agg, F.lit(0.0)).alias("score")).where("score IS NOT NULL")


def outliers(scores: DataFrame, layer: str) -> DataFrame:
    """(layer, outlier): 1 - second / first score of each layer, largest first."""
    w = W.partitionBy(layer).orderBy(F.col("score").desc(), "id")
    top = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    out = top.groupBy(layer).agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("b"))
    return out.select(layer, (1 - F.coalesce("b", F.lit(0.0)) / F.nullif("a", F.lit(0.0))).alias("outlier")).orderBy(F.col("outlier").desc(), layer)


def walks(edges: DataFrame, length: int, per_node: int = 1, seed: int = 0) -> DataFrame:
    """(walk, step, node): random walks from every node; the next edge follows from walk, step and seed."""
    near = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("next"))
    at = edges.select(F.col("src").alias("node")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select(F.concat_ws(":", "node", "k").alias("walk"), "node")
    out = at.withColumn("step", F.lit(0))
    for i in range(1, length):
        pick = F.get("next", F.floor(coin(F.concat_ws("#", "walk", F.lit(i)), seed) * F.size("next")).cast("int"))
        at = at.join(near, at["node"] == near["src"]).select("walk", pick.alias("node"))
        out = out.union(at.withColumn("step", F.lit(i)))
    return out.select("walk", "step", "node")


def context_pairs(w: DataFrame, window: int) -> DataFrame:
    """(anchor, context): nodes within `window` steps of each other on a walk."""
    a, b = w.alias("a"), w.alias("b")
    near = (F.col("a.walk") == F.col("b.walk")) & (F.col("a.step") != F.col("b.step")) & (F.abs(F.col("a.step") - F.col("b.step")) <= window)
    return a.join(b, near).select(F.col("a.node").alias("anchor"), F.col("b.node").alias("context")).where("anchor <> context")


def negative_pairs(edges: DataFrame, per_node: int, seed: int = 0) -> DataFrame:
    """(anchor, other): nodes that no edge joins, drawn by the coin of node and try; misses are dropped."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    ranked, n = numbered(nodes, "node")
    tries = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select(F.col("node").alias("anchor"), F.floor(coin(F.concat_ws("#", "node", "k"), seed) * n).cast("long").alias("place"))
    drawn = tries.join(ranked, "place").select("anchor", F.col("node").alias("other")).where("anchor <> other").distinct()
    return drawn.join(edges.select(F.col("src").alias("anchor"), F.col("dst").alias("other")), ["anchor", "other"], "left_anti")


def capped_edges(edges: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` out-edges of each node, drawn by the coin of the edge."""
    w = W.partitionBy("src").orderBy(coin(F.concat_ws("#", "src", "dst"), seed), "dst")
    return edges.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= most).drop("r_")
