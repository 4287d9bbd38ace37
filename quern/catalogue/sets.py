"""Differences, duplicates, upserts, folds, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, setops
from .base import query, table


def _listings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    key = F.format_string("f%06d", F.col("doc_id"))
    old = docs.where("doc_id % 3 <> 0").select(key.alias("key"), "hash")
    new = docs.where("doc_id % 4 <> 0").select(F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("moved/"), key)).otherwise(key).alias("key"), "hash")
    return old, new


_L = """d AS (SELECT doc_id, sha256(text) AS h, printf('f%06d', doc_id) AS k FROM documents), o AS (SELECT k, h FROM d WHERE doc_id % 3 <> 0),
n AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' || k ELSE k END AS k, h FROM d WHERE doc_id % 4 <> 0),
add_ AS (SELECT k, h, row_number() OVER (PARTITION BY h ORDER BY k) AS i FROM n WHERE (k, h) NOT IN (SELECT (k, h) FROM o)),
del_ AS (SELECT k, h, row_number() OVER (PARTITION BY h ORDER BY k) AS i FROM o WHERE (k, h) NOT IN (SELECT (k, h) FROM n)),
mv AS (SELECT del_.k AS a, add_.k AS b, add_.h FROM add_ JOIN del_ USING (h, i))"""


@query(f"""WITH {_L} SELECT 'move' AS kind, a, b FROM mv UNION ALL
SELECT CASE WHEN s.f IS NULL THEN 'add' ELSE 'copy' END, s.f, add_.k FROM add_ LEFT JOIN (SELECT h, min(k) AS f FROM o GROUP BY 1) s USING (h) WHERE add_.k NOT IN (SELECT b FROM mv) UNION ALL
SELECT 'delete', k, NULL FROM del_ WHERE k NOT IN (SELECT a FROM mv)""")
def tree_diff(spark, d):
    return setops.listing_diff(*_listings(spark, d))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h, printf('f%06d', doc_id) AS k FROM documents) SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' || k ELSE k END AS key, h AS hash FROM d WHERE doc_id % 4 <> 0")
def tree_apply(spark, d):
    old, new = _listings(spark, d)
    return setops.applied(old, setops.listing_diff(old, new), new)


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def uniqueize(spark, d):
    return setops.first_of(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'NEW', NULL FROM customer WHERE c_custkey % 15 = 0""")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    fresh = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return setops.upsert(c.where("c_custkey % 5 <> 0"), fresh, ["c_custkey"])


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def insert_if_absent(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fresh = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return setops.insert_if_absent(c.where("c_custkey % 2 = 0"), fresh, ["c_custkey"])


@query("""WITH e AS (SELECT user_id, event_id % 50 AS item, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'error'))
SELECT user_id, item, CASE WHEN max_by(event_type, (ts, event_id)) = 'click' THEN 'click' END AS state FROM e GROUP BY 1, 2""")
def event_fold(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'error')").withColumn("item", F.col("event_id") % 50)
    return setops.toggles(e, ["user_id", "item"], ["ts", "event_id"], "event_type", {"error": "click"})


@query("""WITH e AS (SELECT user_id, ts, event_type, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS cut FROM events)
SELECT user_id, count(*) AS n FROM e WHERE event_type = 'purchase' AND (cut IS NULL OR ts > cut) GROUP BY 1""")
def queue_counter(spark, d):
    return setops.counter_since(table(spark, d, "events"), ["user_id"], "ts", "event_type", "purchase", "signup")


@query("""SELECT c_custkey AS id, c_acctbal + coalesce(s, 0) AS v FROM customer LEFT JOIN (SELECT user_id, sum(value) AS s FROM events WHERE value > 0 GROUP BY 1) ON user_id = c_custkey""".replace("c_acctbal + coalesce(s, 0)", "round(c_acctbal + coalesce(s, 0), 4)"))
def dwell_accumulate(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("value").alias("v"))
    return setops.accumulated(c, e, "id", "v").select("id", F.round("v", 4).alias("v"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 5e0 ELSE 1e0 END END AS flag FROM customer""")
def reconcile_flags(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, 5.0).alias("flag"))
    return setops.reconciled(c, "id", "flag", c.where("id % 2 = 0"))


@query("""WITH h AS (SELECT event_type AS bin, count(*) AS n FROM events GROUP BY 1), s AS (SELECT bin, n / sum(n) OVER () * 100 AS x FROM h), f AS (SELECT bin, x - floor(x) AS r, floor(x) AS b FROM s)
SELECT bin, CAST(b + CASE WHEN row_number() OVER (ORDER BY r DESC, bin) <= 100 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS take FROM f""")
def proportional_allocation(spark, d):
    from ..operators.aggregates import histogram

    return sampling.proportional(histogram(table(spark, d, "events"), F.col("event_type")), 100)


def _c(key: str, seed: int = 0) -> str:
    """SQL of sampling.coin()."""
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"SELECT o_orderkey, CASE WHEN {_c('o_orderkey')} < 0.7 THEN 0 WHEN {_c('o_orderkey')} < 0.9 THEN 1 ELSE 2 END AS part FROM orders")
def random_split(spark, d):
    return sampling.split(table(spark, d, "orders"), "o_orderkey", [0.7, 0.2, 0.1]).select("o_orderkey", "part")


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_c('o_orderkey')}) <= count(*) OVER () * 7 // 10 THEN 0 ELSE 1 END AS part FROM orders")
def exact_split(spark, d):
    return sampling.exact_split(table(spark, d, "orders"), "o_orderkey", [0.7, 0.3]).select("o_orderkey", "part")


@query(f"SELECT doc_id, CAST(floor({_c('doc_id')} * 5) AS INT) AS fold FROM labels")
def cv_folds(spark, d):
    return sampling.folds(table(spark, d, "labels"), "doc_id", 5).select("doc_id", "fold")


@query(f"SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln(greatest({_c('o_orderkey')}, 1e-300)) / o_totalprice, o_orderkey LIMIT 100")
def weighted_sample(spark, d):
    return sampling.weighted(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 100).select("o_orderkey")


@query(f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY floor({_c('o_orderkey', 64)} * 64), o_orderkey) - 1 AS place FROM orders)
SELECT draw, o_orderkey FROM (SELECT range AS draw FROM range(200)) JOIN p ON place = floor({_c('draw')} * (SELECT count(*) FROM orders))""")
def sample_with_replacement(spark, d):
    return sampling.with_replacement(table(spark, d, "orders"), "o_orderkey", 200)


@query(f"""WITH p AS (SELECT vec_id, label, lead(vec_id) OVER w AS n, lead(label) OVER w AS l FROM embeddings WINDOW w AS (PARTITION BY floor({_c('vec_id', 1)} * 64) ORDER BY {_c('vec_id')}, vec_id)),
q AS (SELECT DISTINCT least(vec_id, n) AS a, greatest(vec_id, n) AS b, label = l AS same FROM p WHERE n IS NOT NULL AND n <> vec_id) SELECT a, b, same FROM q ORDER BY {_c('a')}, a, b LIMIT 200""")
def verification_pairs(spark, d):
    return sampling.labelled_pairs(table(spark, d, "embeddings"), "vec_id", "label", 200)
