"""Graphs made of nations that trade with each other, and batch maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..streaming import log
from .base import query, r6, table
from .sets import _c

_E = """e AS (SELECT c_nationkey AS src, s_nationkey AS dst, 1000.0 / count(*) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING (c_nationkey * 7 + s_nationkey * 11) % 5 = 0)"""


def _edges(spark, d):
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    e = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((1000.0 / F.count("*")).alias("w"))
    return e.where((F.col("src") * 7 + F.col("dst") * 11) % 5 == 0)


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT 0 AS id, 0.0::DOUBLE AS d, 0 AS h UNION SELECT e.dst, min(p.d + e.w), p.h + 1 FROM p JOIN e ON e.src = p.id WHERE p.h < 8 GROUP BY 1, 3)
SELECT id, round(min(d), 6) AS d FROM p GROUP BY id""")
def dijkstra(spark, d):
    return G.shortest_paths(_edges(spark, d), 0).select("id", r6("d").alias("d"))


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT src, dst, w AS d, 1 AS h FROM e UNION SELECT p.src, e.dst, min(p.d + e.w), p.h + 1 FROM p JOIN e ON e.src = p.dst WHERE p.h < 8 AND p.src <> e.dst GROUP BY 1, 2, 4)
SELECT src, dst, round(min(d), 6) AS d FROM p GROUP BY 1, 2""")
def floyd_warshall(spark, d):
    return G.all_pairs(_edges(spark, d)).select("src", "dst", r6("d").alias("d"))


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT 0 AS id, 0 AS h UNION SELECT e.dst, p.h + 1 FROM p JOIN e ON e.src = p.id WHERE p.h < 8) SELECT id, min(h) AS hops FROM p GROUP BY 1""")
def bfs_route(spark, d):
    return G.breadth_first(_edges(spark, d), 0)


@query(f"""WITH {_E}, a AS (SELECT dst AS id, sum((src + 1) * w) AS s FROM e GROUP BY 1) SELECT e.dst AS id, round(sum(a.s * e.w), 3) AS score FROM a JOIN e ON e.src = a.id GROUP BY 1""")
def layered_flow(spark, d):
    e = _edges(spark, d)
    seeds = e.select(F.col("src").alias("id")).distinct().withColumn("score", (F.col("id") + 1).cast("double"))
    return G.flow(seeds, [e, e]).select("id", F.round("score", 3).alias("score"))


@query(f"""WITH {_E}, t AS (SELECT src, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) SELECT src, round(1 - coalesce(max(w) FILTER (r = 2), 0) / max(w) FILTER (r = 1), 6) AS outlier FROM t WHERE r <= 2 GROUP BY 1""")
def flow_outliers(spark, d):
    e = _edges(spark, d).select("src", F.col("dst").alias("id"), F.col("w").alias("score"))
    return G.outliers(e, "src").select("src", r6("outlier").alias("outlier"))


@query()
def random_walks(spark, d):
    return G.walks(_edges(spark, d), 5, 2)


@query()
def walk_pairs(spark, d):
    return G.context_pairs(G.walks(_edges(spark, d), 4), 2)


@query()
def negative_pairs(spark, d):
    return G.negative_pairs(_edges(spark, d), 3)


@query(f"WITH {_E} SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {_c("src || '#' || dst")}, dst) AS r FROM e) WHERE r <= 3")
def capped_edges(spark, d):
    return G.capped_edges(_edges(spark, d), 3).select("src", "dst")


@query("SELECT item_id, CAST(len(text) AS VARCHAR) AS result FROM benchmark")
def batch_map(spark, d):
    return log.batch_map(table(spark, d, "benchmark"), "text", lambda xs: [len(x) for x in xs], 16).select("item_id", "result")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id / 2 AS BIGINT) || '' END AS result, item_id % 2 = 1 AS failed FROM benchmark")
def staged_map(spark, d):
    def half(x: int) -> int:
        if x % 2:
            raise ValueError("odd")
        return x // 2

    return log.staged(table(spark, d, "benchmark"), "item_id", [half, str]).select("item_id", "result", F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, d):
    return log.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")
