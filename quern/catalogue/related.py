"""Searches over related tables, joins, and requests over items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..plans.catalog import Catalog
from ..plans.items import Collection
from ..plans.search import search
from .base import query, r6, table


def _orders(spark, d) -> Catalog:
    return Catalog(table(spark, d, "orders"), "o_orderkey", {"line": (table(spark, d, "lineitem"), ["l_orderkey"])})


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 45 AND l_returnflag = 'R'")
def join_aliased(spark, d):
    return search(_orders(spark, d), "(o_orderstatus = F, line.l_quantity > 45, line.l_returnflag = R)", None)


@query("""SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey
WHERE a.l_quantity > 48 AND b.l_quantity < 3""")
def join_numbered(spark, d):
    return search(_orders(spark, d), "(line.1.l_quantity > 48, line.2.l_quantity < 3)", None)


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 400000 OR l_quantity > 49")
def join_hoisted(spark, d):
    return search(_orders(spark, d), "(o_totalprice > 400000 | line.l_quantity > 49)", None)


@query("SELECT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY max(l_extendedprice) DESC, 1 LIMIT 25")
def join_ordered(spark, d):
    return search(_orders(spark, d), '(line.l_returnflag = R, $order = "-line.l_extendedprice", $limit = 25)', None)


def _tree(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    a = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit("region").alias("otype"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("ts"))
    b = n.select((F.col("n_nationkey") + 100).cast("long"), F.lit("nation"), F.col("n_name"), F.col("n_regionkey").cast("long"), F.lit(1.0))
    e = c.select(F.col("c_custkey") + 1000, F.lit("customer"), F.col("c_name"), (F.col("c_nationkey") + 100).cast("long"), F.col("c_acctbal"))
    return a.union(b).union(e)


def _items(spark, d):
    t = _tree(spark, d)
    none = F.lit(None).cast("string")
    return t.select("id", F.lit("tpch").alias("source"), F.lit("table").alias("stype"), "otype", F.concat(F.lit("x://"), "id").alias("url"), "name", "parent", "ts", *[F.lit(None).cast("double").alias(c) for c in ("added_ts", "explored_ts", "seen_ts", "embed_ts")], none.alias("md"))


def _scores(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    a = c.select((F.col("c_custkey") + 1000).alias("id"), F.lit("acct").alias("ttype"), F.col("c_mktsegment").alias("tag"), (F.col("c_acctbal") / 10000).alias("score"), F.lit(0.0).alias("ts"))
    b = o.groupBy((F.col("o_custkey") + 1000).alias("id"), F.lit("like").alias("ttype"), F.col("o_orderpriority").alias("tag")).agg((F.sum("o_totalprice") / 1e6).alias("score"), F.lit(0.0).alias("ts"))
    return a.union(b)


def _rels(spark, d):
    return table(spark, d, "orders").select(F.lit(1).cast("long").alias("src"), (F.col("o_custkey") + 1000).alias("tgt"), F.lower("o_orderstatus").alias("rtype"), F.unix_timestamp("o_orderdate").alias("ts"))


def _collection(spark, d) -> Collection:
    return Collection(_items(spark, d), _scores(spark, d), _rels(spark, d))


_ITEMS = """items AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'region' AS otype, r_name AS name, CAST(NULL AS BIGINT) AS parent, 0.0::DOUBLE AS ts FROM region UNION ALL
  SELECT n_nationkey + 100, 'nation', n_name, n_regionkey, 1.0 FROM nation UNION ALL
  SELECT c_custkey + 1000, 'customer', c_name, c_nationkey + 100, c_acctbal FROM customer
), scores AS (
  SELECT c_custkey + 1000 AS id, 'acct' AS ttype, c_mktsegment AS tag, c_acctbal / 10000 AS score FROM customer UNION ALL
  SELECT o_custkey + 1000, 'like', o_orderpriority, sum(o_totalprice) / 1e6 FROM orders GROUP BY 1, 2, 3
), rels AS (SELECT 1 AS src, o_custkey + 1000 AS tgt, lower(o_orderstatus) AS rtype FROM orders)"""


@query("SELECT CAST(n_nationkey AS BIGINT) + 100 AS id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def join_nested(spark, d):
    t = _tree(spark, d)
    rel = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("tgt"))
    return search(Catalog(t, "id", {"rel": (rel, ["src"])}), "rel.tgt.name = ASIA", None)


@query(f"WITH {_ITEMS} SELECT DISTINCT i.id FROM items i JOIN scores s ON s.id = i.id WHERE s.tag = 'BUILDING' AND s.score > 0.5")
def alias_score_condition(spark, d):
    cat = Catalog(_items(spark, d), "id", {"score": (_scores(spark, d), ["id"])}, aliases={"building": {"type": "score_condition", "tag_field": "BUILDING"}})
    return search(cat, "building > 0.5", None)


@query(f"""WITH {_ITEMS} SELECT DISTINCT i.id FROM items i JOIN scores s ON s.id = i.id JOIN scores t ON t.id = i.id
WHERE s.tag = '1-URGENT' AND s.score > 0.3 AND t.tag = '5-LOW' AND t.score < 0.2""")
def alias_multi_score(spark, d):
    spec = {"type": "multi_score_condition", "conditions": [{"tag_field": "1-URGENT", "op": ">", "value": 0.3}, {"tag_field": "5-LOW", "op": "<", "value": 0.2}]}
    return search(Catalog(_items(spark, d), "id", {"score": (_scores(spark, d), ["id"])}, aliases={"urgent": spec}), "urgent = true", None)


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE otype = 'customer' AND id IN (SELECT tgt FROM rels WHERE rtype = 'f') AND ts > 1000 ORDER BY ts DESC, id DESC LIMIT 50")
def request_related(spark, d):
    return _collection(spark, d).request(otype="customer", has_rel="f", ts=">1000", order="-ts", limit=50).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE otype = 'customer' AND id NOT IN (SELECT tgt FROM rels WHERE rtype = 'p')")
def request_unrelated(spark, d):
    return _collection(spark, d).request(otype="customer", no_rel="p").select("id")


@query(f"WITH {_ITEMS} SELECT i.id FROM items i JOIN items p ON p.id = i.parent WHERE i.parent = 2 OR p.parent = 2")
def request_ancestor(spark, d):
    return _collection(spark, d).request(ancestor=2).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE id IN (SELECT id FROM scores WHERE tag IN ('BUILDING', '1-URGENT') AND score > 0.6) AND id >= 1001")
def request_tags(spark, d):
    return _collection(spark, d).request(tags=["BUILDING", "1-URGENT"], min_score=0.6).where("id >= 1001").select("id")


@query(f"""WITH {_ITEMS}, g AS (SELECT id, CASE WHEN tag IN ('1-URGENT', '2-HIGH') THEN 0 WHEN tag IN ('BUILDING', 'MACHINERY') THEN 1 END AS g, max(score) AS m FROM scores WHERE score > 0 GROUP BY 1, 2)
SELECT id, round(sum(m), 6) AS score FROM g WHERE g IS NOT NULL GROUP BY id HAVING count(*) = 2 ORDER BY sum(m) DESC, id LIMIT 30""")
def semantic_groups(spark, d):
    return _collection(spark, d).by_tag_groups([["1-URGENT", "2-HIGH"], ["BUILDING", "MACHINERY"]], 30).select("id", r6("score").alias("score"))


@query(f"WITH {_ITEMS} SELECT tag, count(*) AS n FROM scores WHERE score > 0.5 AND id IN (SELECT id FROM items WHERE otype = 'customer') GROUP BY tag")
def top_tags(spark, d):
    c = _collection(spark, d)
    return c.top_tags(c.items.where("otype = 'customer'"))


@query("""WITH RECURSIVE t AS (SELECT c_custkey + 1000 AS id, c_nationkey + 100 AS up FROM customer)
SELECT t.id, CAST(r_regionkey AS BIGINT) AS ancestor FROM t JOIN nation ON n_nationkey + 100 = up JOIN region ON r_regionkey = n_regionkey""")
def closest_ancestor(spark, d):
    t = _tree(spark, d)
    return joins.closest_ancestor(t, "id", "parent", F.col("otype") == "region").where("id >= 1000")


@query("""SELECT n_nationkey + 100 AS user_id, count(c_custkey) AS n, max(c_acctbal) AS last_ts FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def user_stats(spark, d):
    items = _items(spark, d).withColumn("otype", F.when(F.col("otype") == "nation", "user").otherwise(F.col("otype"))).withColumn("id", F.col("id").cast("long"))
    c = Collection(items, _scores(spark, d), _rels(spark, d))
    return c.user_stats().select(F.col("user").alias("user_id"), "n", "last_ts")


@query("""SELECT e.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS r_event_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts
WHERE e.event_type = 'view' GROUP BY 1""")
def asof_latest(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return joins.as_of(views, buys, "user_id", "ts", ["event_id"]).select("event_id", "r_event_id")


@query("""WITH s AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS m, min(epoch(o_orderdate)) AS a, max(epoch(o_orderdate)) AS b FROM orders GROUP BY 1, 2)
SELECT o_orderkey AS k, p, m FROM orders JOIN s ON epoch(o_orderdate) >= a AND epoch(o_orderdate) <= b""")
def range_interval(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.unix_timestamp("o_orderdate"))
    s = o.groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return joins.in_interval(o.select(F.col("o_orderkey").alias("k"), "t"), "t", s, "a", "b", 30 * 86400.0).select("k", "p", "m")


@query("""SELECT o_custkey AS id, round(sum(o_totalprice * l_discount), 4) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def propagated_scores(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    scores = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    edges = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("l_discount").alias("w"))
    return joins.propagated(scores, edges).select("id", F.round("score", 4).alias("score"))


@query()
def greedy_matching(spark, d):
    """Parts and return flags of each order, matched by price."""
    return joins.greedy_matching(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("b"), F.col("l_extendedprice").alias("score")), "g", "a", "b", "score")
