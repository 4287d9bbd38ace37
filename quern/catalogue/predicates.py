"""The search language over one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.search import matching, search, search_rows
from .base import query, table


def _orders(spark, d, q):
    return matching(table(spark, d, "orders"), q).select("o_orderkey")


def _simple(name: str, text: str, where: str):
    def f(spark, d):
        return _orders(spark, d, text)

    f.__name__ = name
    query(f"SELECT o_orderkey FROM orders WHERE {where}")(f)


_simple("pred_eq", 'o_orderstatus = "F"', "o_orderstatus = 'F'")
_simple("pred_neq", 'o_orderstatus != "F"', "o_orderstatus <> 'F'")
_simple("pred_gt_gte", "(o_totalprice > 150000, o_custkey >= 100)", "o_totalprice > 150000 AND o_custkey >= 100")
_simple("pred_lt_lte", "o_totalprice < 90000.5 & o_custkey <= 900", "o_totalprice < 90000.5 AND o_custkey <= 900")
_simple("pred_like_smartcase", 'o_orderpriority ~ "high"', "regexp_matches(o_orderpriority, '(?i)high')")
_simple("pred_like_cased", 'o_orderpriority ~ "^[0-9]-H"', "regexp_matches(o_orderpriority, '^[0-9]-H')")
_simple("pred_not_like", 'o_orderpriority !~ "low"', "NOT regexp_matches(o_orderpriority, '(?i)low')")
_simple("pred_in", 'o_orderstatus : ["F", "P"]', "o_orderstatus IN ('F', 'P')")
_simple("pred_not_in", "o_orderstatus !: [F, P]", "o_orderstatus NOT IN ('F', 'P')")
_simple("pred_exists", "(o_orderpriority ?, o_comment !?)", "true")
_simple("pred_null", "(o_orderpriority ?+, !(o_orderpriority !?+))", "o_orderpriority IS NOT NULL")
_simple("pred_nested_and_or", '((o_orderstatus = "F", o_totalprice > 100000) | (o_orderstatus = "O" & !(o_custkey < 500)))', "(o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'O' AND NOT o_custkey < 500)")
_simple("pred_json_form", '["&", {"o_orderstatus:": ["F", "O"], "o_totalprice>=": 50000}, ["!", ["o_custkey", ">", 700]]]', "o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000 AND NOT o_custkey > 700")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND event_type = 'click'")
def pred_json_path(spark, d):
    return matching(table(spark, d, "events"), "(props.k >= 50, event_type = click)").select("event_id")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') OR contains(p_name, 'a')")
def pred_has(spark, d):
    df = table(spark, d, "part").withColumn("words", F.split("p_type", " "))
    return matching(df, "(words @ STEEL | p_name @ a)").select("p_partkey")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL OR NOT v > 50")
def pred_not_two_valued(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return matching(df, "!(v > 50)").select("event_id")


@query("SELECT event_id, event_id % 7 = 0 AS missing FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0")
def pred_missing_or_null(spark, d):
    e = table(spark, d, "events")
    df = e.withColumn("v", F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 5 != 0), F.col("value"))).withColumn("has", F.create_map(F.lit("v"), F.col("event_id") % 7 != 0))
    return matching(df, "(v !? | v !?+)", presence="has").select("event_id", (F.col("event_id") % 7 == 0).alias("missing"))


@query("""SELECT o_orderkey AS id, round(1e0 + 0.1e0 * (CAST(o_orderstatus = 'F' AS INT) + greatest(CAST(o_totalprice > 100000 AS INT), CAST(o_custkey < 100 AS INT))), 6) AS score
FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_custkey < 100) ORDER BY score DESC, id LIMIT 500""")
def search_reranked(spark, d):
    out = search_rows(table(spark, d, "orders"), "(o_orderstatus = F, (o_totalprice > 100000 | o_custkey < 100))", "o_orderkey", 500, rerank=True)
    return out.select("id", F.round("score", 6).alias("score"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 40 OFFSET 10")
def magic_order_limit_offset(spark, d):
    return search(Catalog(table(spark, d, "events"), "event_id"), '(event_type = view, $order = "-value", $limit = 40, $offset = 10)', None)


@query("SELECT event_id AS id FROM events WHERE value > 20 ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE), event_id LIMIT 60")
def magic_order_json(spark, d):
    return search(Catalog(table(spark, d, "events"), "event_id", json_columns={"main": {"props"}}), '(value > 20, $order = "props.k", $limit = 60)', None)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND NOT o_orderstatus ILIKE '%f%'")
def sql_like(spark, d):
    return search(Catalog(table(spark, d, "orders"), "o_orderkey"), "(o_orderpriority ~ urgent, o_orderstatus !~ f)", None)


@query("SELECT event_id AS id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE NOT v > 50")
def sql_three_valued(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return search(Catalog(df, "event_id"), "!(v > 50)", None)
