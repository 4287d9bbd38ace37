"""Connected components of an edge table, without collecting links or components to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, written


def components(edges: DataFrame, few: int = 5_000_000, most_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, component): component is the smallest node reachable.

    Alternates large-star and small-star steps: each node's smallest neighbour is an aggregate that combines before
    the shuffle. From `few` links on it is written, so that the join by which the edges take it has plain shuffles on
    both sides and adaptive execution can split a hub's links over tasks; fewer links fit into any one task, and the
    result is the same. Every round is written to the shared folder. Self-links, repeats and nulls add nothing; an empty table gives no rows. Stops when every link leads from a node of one link
    to one that only links lead to; the number of rounds grows with the logarithm of the longest path.
    """
    apart = F.col("u") != F.col("v")
    two = edges.where(apart).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(two, "edges")
    for _ in range(most_rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
        at = ends.groupBy("e.n").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        links, open_ = at.agg(F.sum("ups"), F.count_if(F.expr("ups > 1 OR ups = 1 AND low = 0"))).first()
        if not open_:
            break
        step = written if links >= few else lambda df, name: df
        both = now.union(now.select("v", "u"))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = step(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(apart).distinct(), "large")
        lowest = step(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        star = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(star.where(apart).distinct(), "edges")
        for done in (now, least, large, lowest):
            discard(done)
        now = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(labels.union(labels.select(F.col("component").alias("node"), "component").distinct()), "components")
    discard(now)
    return out
