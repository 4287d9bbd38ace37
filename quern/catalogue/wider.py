"""More functions and operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, geo, names, numbers, semi, strings, times, urls
from ..operators import joins, labels, ml, paths, sampling
from ..operators import vectors as V
from ..operators import windows as O
from ..sources import archives, files, stores
from .base import query, r6, table
from .related import _ITEMS, _collection, _scores, _tree
from .sets import _c


def lit(x):
    return F.lit(float(x))


# --- strings, URLs, times -------------------------------------------------------------------------------------------


@query("""SELECT event_id, array_to_string(list_transform([value, value + 1], lambda x: printf('%.2f', x)), ';') AS joined, format('{:,}', CAST(event_id * 1000 AS BIGINT)) AS grouped,
coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS BIGINT), 0) AS whole, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'y' ELSE '1.5' END AS DOUBLE), 0) AS real FROM events""")
def str_format_cast(spark, d):
    e = table(spark, d, "events")
    v = F.array(F.col("value"), F.col("value") + 1)
    whole = strings.int_or(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x"))
    real = strings.float_or(F.when(F.col("event_id") % 3 == 0, "y").otherwise("1.5"))
    return e.select("event_id", strings.join_items(v, ";", "%.2f").alias("joined"), strings.thousands(F.col("event_id") * 1000).alias("grouped"), whole.alias("whole"), real.alias("real"))


@query("""SELECT p_partkey, contains(' ' || lower(p_type) || ' ', ' ' || lower(split_part(p_type, ' ', 1)) || ' ') AS has, contains(' ' || lower(p_type) || ' ', ' ' || lower(substr(p_type, 1, 3)) || ' ') AS cut,
trim(regexp_replace(p_name || ' & ' || p_type, '\\s+', ' ', 'g')) AS clean FROM part""")
def str_words_clean(spark, d):
    t = F.col("p_type")
    text = F.concat(F.lit(" "), F.col("p_name"), F.lit(" \n&amp;  "), t)
    return table(spark, d, "part").select("p_partkey", strings.has_words(t, F.element_at(F.split(t, " "), 1)).alias("has"), strings.has_words(t, F.substring(t, 1, 3)).alias("cut"), strings.clean_text(text).alias("clean"))


@query("""SELECT page_id, url AS back, contains(replace(url, ' ', '%20'), ' ') AS blank, lower(coalesce(nullif(regexp_extract(url || '/pic.JPEG', '\\.([A-Za-z0-9]+)$', 1), ''), '')) = 'jpeg' AS jpeg, 'f' || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '' ELSE ' 1' END || '.txt' AS numbered FROM pages""")
def url_quote_names(spark, d):
    u = F.col("url")
    q = urls.quote(u)
    name = F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string"), F.lit(".txt"))
    return table(spark, d, "pages").select("page_id", urls.unquote(q).alias("back"), F.contains(q, F.lit(" ")).alias("blank"), (urls.image_extension(F.concat(u, F.lit("/pic.JPEG"))) == "jpg").alias("jpeg"), urls.numbered(name, F.col("page_id") % 2).alias("numbered"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(o_orderdate) AS DOUBLE) AS e, round(ln(1 + 86400.0 * (o_orderkey % 5)), 6) AS fresh, CASE WHEN o_orderdate >= make_date(year(o_orderdate), 3, 31) - CAST(dayofweek(make_date(year(o_orderdate), 3, 31)) AS INT) + INTERVAL 1 HOUR
AND o_orderdate < CASE WHEN year(o_orderdate) < 1996 THEN make_date(year(o_orderdate), 9, 30) - CAST(dayofweek(make_date(year(o_orderdate), 9, 30)) AS INT) ELSE make_date(year(o_orderdate), 10, 31) - CAST(dayofweek(make_date(year(o_orderdate), 10, 31)) AS INT) END + INTERVAL 1 HOUR THEN 7200e0 ELSE 3600e0 END AS ahead, round(10.0 / (o_orderkey % 4 + 1) * (10 - o_orderkey % 4 - 1), 6) AS rest,
'https://cal.example/?action=TEMPLATE&text=a+b&dates=' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '/' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS link FROM orders""")
def time_more(spark, d):
    o = table(spark, d, "orders")
    t = F.col("o_orderdate").cast("timestamp")
    e = times.epoch(t)
    k = F.col("o_orderkey") % 4 + 1
    return o.select("o_orderkey", times.flat_to_iso(F.date_format(t, "yyyyMMddHHmmss")).alias("iso"), times.parse_format(F.date_format(t, "dd/MM/yyyy HH:mm:ss")).alias("e"), r6(times.recency(e, e + 86400 * (F.col("o_orderkey") % 5), True)).alias("fresh"), times.utc_offset(e, "Europe/Berlin").alias("ahead"), r6(times.time_left(k, F.lit(10), lit(10))).alias("rest"), urls.calendar_link(t, t, F.lit("a b"), "https://cal.example/").alias("link"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%a%' THEN '*a*' WHEN p_name LIKE 'P%' THEN 'P*' END AS glob, CASE WHEN p_partkey % 3 = 0 THEN 'side' WHEN p_partkey % 3 = 1 THEN 'main' ELSE 'any' END AS kind FROM part""")
def name_groups(spark, d):
    kinds = [names.FileType("main", suffix=".pdf"), names.FileType("side", ".", ".json"), names.FileType("any")]
    m = F.col("p_partkey") % 3
    path = F.concat(F.lit("d/"), F.when(m == 0, ".x.json").when(m == 1, "x.pdf").otherwise("x"))
    return table(spark, d, "part").select("p_partkey", names.first_glob(F.col("p_name"), ["*a*", "P*"]).alias("glob"), names.type_column(path, kinds).alias("kind"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 7 AS n FROM orders")
def name_dates(spark, d):
    n = F.concat(F.lit("MyTrip - "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_(x).jpg"))
    return table(spark, d, "orders").select("o_orderkey", names.name_date(n).alias("day"), F.size(names.name_tokens(n)).alias("n"))


@query("""SELECT item_id, [item_id + 1.0, item_id + 2.5, 3.0]::DOUBLE[] AS a FROM benchmark""")
def subtitle_times(spark, d):
    srt = F.concat(F.lit("1\n"), strings.seconds_to_clock(F.col("item_id").cast("double")), F.lit(" --> "), strings.seconds_to_clock(F.col("item_id") + 1.5), F.lit("\nhey\n"))
    x = F.get(names.shifted(names.dialogs(srt), 1.0), 0)
    return table(spark, d, "benchmark").select("item_id", F.array(x["start"], x["end"], F.length(x["text"]).cast("double")).alias("a"))


# --- numbers, arrays, maps, geometry --------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(floor(least(greatest((value / 50 - 1 + 1) / 2, 0), 1) * 255) AS INT) AS byte, round(trunc(value / 0.25) * 0.25, 6) AS cut,
round(exp(-(value * value + 4) / (2 * 2500.0)) / (2 * pi() * 2500.0), 9) AS g2, [0.0, 0.5, 1.0]::DOUBLE[] AS steps, [1.0, 2.0, 4.0]::DOUBLE[] AS geo FROM events""")
def math_more(spark, d):
    v = F.col("value")
    b = numbers.to_byte(v / 50 - 1, -1, 1)
    return table(spark, d, "events").select("event_id", b.alias("byte"), r6(numbers.quantize(v, 0.25)).alias("cut"), F.round(numbers.gaussian2d(v, lit(2), 50), 9).alias("g2"), numbers.steps(lit(0), lit(1), 0.5).alias("steps"), F.transform(numbers.geometric(lit(1), lit(4), 3), lambda x: F.round(x, 9)).alias("geo"))


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: abs(x::DOUBLE)) AS x, list_transform(b.embedding, lambda x: abs(x::DOUBLE)) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 0.0001))), 5) AS chisq, round(list_sum(list_transform(list_zip(x, y), lambda z: sqrt(z[1] * z[2]))), 5) AS bhatt,
round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(y, lambda v: v * v))), 6) AS cosine, round(x[1] / list_sum(x), 6) AS share, round(x[2] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS unit, 384 AS n FROM p""")
def array_more(spark, d):
    e = table(spark, d, "embeddings")
    pos = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), pos(F.col("embedding")).alias("y"))
    x, y = F.col("x"), F.col("y")
    r = lambda c: F.round(c, 5)
    return e.select("vec_id", pos(F.col("embedding")).alias("x")).join(b, "vec_id").select("vec_id", r(arrays.chi_squared(x, y)).alias("chisq"), r(arrays.bhattacharyya(x, y)).alias("bhatt"), r6(arrays.cosine(x, y)).alias("cosine"), r6(F.get(arrays.scale_total(x), 0)).alias("share"), r6(F.get(arrays.scale_power(x), 1)).alias("unit"), F.size(arrays.pair_features(x, y)).alias("n"))


@query("SELECT vec_id, [embedding[6], embedding[1], embedding[2]]::FLOAT[] AS cols, list_transform(range(3, 64, 7), lambda i: embedding[i + 1]) AS strided, [8, 8] AS grid FROM embeddings")
def array_selection(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", arrays.columns_spec(v, "5,0-2").alias("cols"), arrays.strided(v, 3, 7, 50).alias("strided"), arrays.grid_dims(F.size(v)).alias("grid"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS only_k, 0 AS without_k, NULL::BIGINT AS blank, CAST(json_extract_string(props, '$.k') AS BIGINT) AS renamed, 7 AS missing, 'k' AS name FROM events""")
def map_more(spark, d):
    m = F.from_json("props", "map<string,string>")
    k = lambda c, n="k": F.try_element_at(c, F.lit(n)).cast("long")
    return table(spark, d, "events").select("event_id", k(semi.only(m, ["k"])).alias("only_k"), F.size(semi.without(m, ["k"])).alias("without_k"), k(semi.blank_keys(m, ["k.*"])).alias("blank"), k(semi.renamed(m, {"k": "q"}), "q").alias("renamed"), semi.value_or(m, "zz", "7").cast("int").alias("missing"), F.get(semi.hashable(m), 0)["key"].alias("name"))


@query("""SELECT event_id, round(CASE WHEN value <= 20 THEN sqrt((value - 20) * (value - 20) + 100) WHEN value >= 60 THEN sqrt((value - 60) * (value - 60) + 100) ELSE 10 END, 6) AS seg, round(3 + value / 10 * 0.6, 6) AS x, round(value * value * sqrt(3) / 4, 4) AS area,
round(value + 0.5 + 30 / 3600.0, 6) AS deg, (value + 10) * 8.0 AS scaled FROM events""")
def geo_more(spark, d):
    v = F.col("value")
    box = geo.rect(lit(0), lit(0), v + 10, lit(8))
    return table(spark, d, "events").select(
        "event_id", r6(geo.point_segment(v, lit(10), lit(20), lit(0), lit(60), lit(0))["distance"]).alias("seg"), r6(geo.along(v / 10, lit(3), lit(0), lit(6), lit(4))["x"]).alias("x"), F.round(geo.triangle(v, v, v)["area"], 4).alias("area"),
        r6(geo.dms(v, lit(30), lit(30), F.lit("N"))).alias("deg"), geo.rect_area(geo.rect_scaled(box, 2.0, 0.5)).alias("scaled"),
    ).withColumn("scaled", F.round("scaled", 6))


@query("""SELECT event_id, round(degrees(1000 / 6378100.0) * 2, 9) AS dlat, round(degrees(1000 / 6378100.0) / cos(radians(value - 50)) * 2, 7) AS dlon FROM events""")
def gps_box(spark, d):
    b = geo.gps_box(F.col("value") - 50, lit(10), 1000.0)
    return table(spark, d, "events").select("event_id", F.round(b["lat1"] - b["lat0"], 9).alias("dlat"), F.round(b["lon1"] - b["lon0"], 7).alias("dlon"))


@query("""SELECT user_id, round(avg(y), 6) AS first_y FROM (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2""")
def curve_interpolation(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("r", F.row_number().over(w) - 1).withColumn("x", F.col("r").cast("double"))
    c = paths.curves(e, "user_id", "r", "x", "value").where("size(curve) > 1")
    return c.select("user_id", r6(paths.interpolate(F.col("curve"), lit(0.5))["y"]).alias("first_y"))


# --- aggregates, windows ----------------------------------------------------------------------------------------------


@query("""SELECT user_id, round(avg(m), 6) AS mean FROM (SELECT user_id, avg(value) AS m FROM events, (SELECT max(epoch(ts)) AS n FROM events), (SELECT unnest([1, 2, 4]) AS k) WHERE epoch(ts) > n - 1728000.0 / k GROUP BY user_id, k) GROUP BY 1""")
def halving_windows(spark, d):
    e = table(spark, d, "events").withColumn("x", times.epoch(F.col("ts")))
    now = e.agg(F.max("x")).first()[0]
    return O.halving_means(e, "user_id", "x", "value", now, 1728000.0, 3).where("mean IS NOT NULL").select("user_id", r6("mean").alias("mean"))


@query("""SELECT event_id, round(CASE WHEN abs(value - 50) >= 30 THEN 0 ELSE 1 - abs(value - 50) / 30 END, 6) AS linear, round(CASE WHEN abs(value - 50) >= 30 THEN 0 ELSE exp(-abs(value - 50) / 30) END, 6) AS exp, round(CASE WHEN abs(value - 50) >= 30 THEN 0 ELSE sqrt(1 - abs(value - 50) / 30) END, 6) AS root FROM events""")
def kernel_weights(spark, d):
    x = F.col("value") - 50
    return table(spark, d, "events").select("event_id", *[r6(O.kernel_weight(x, 30.0, k)).alias(n) for k, n in (("linear", "linear"), ("exp", "exp"), ("sqrt", "root"))])


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), h AS (SELECT r, y, sum(y) OVER (ORDER BY r) AS h FROM r)
SELECT round(avg(h / r), 6) AS map FROM h WHERE y = 1""")
def average_precision(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return labels.map_at(o, "o_totalprice", "y", "o_orderkey").select(r6("map").alias("map"))


def _tags(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("t").alias("type"), "o_orderstatus", "o_totalprice", "o_custkey")
    one = lambda k, c: o.select("id", "type", F.lit(k).alias("key"), c.cast("string").alias("value"))
    return one("status", F.col("o_orderstatus")).union(one("price", F.col("o_totalprice"))).union(one("ident", F.concat(F.lit("x"), "id"))).union(one("title", F.lit("t"))).union(one("multi", F.col("o_orderstatus"))).union(one("multi", F.lit("z")))


@query("SELECT * FROM (VALUES ('t', 'status', 'multiclass'), ('t', 'price', 'numeric'), ('t', 'ident', 'id'), ('t', 'multi', 'multilabel')) v(type, key, kind)")
def label_inference(spark, d):
    return labels.label_kinds(_tags(spark, d)).select("type", "key", "kind")


@query("""SELECT c_custkey AS id, least(floor((c_acctbal - a) / ((b - a) / 20)), 19) AS bin FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)""")
def numeric_label_bins(spark, d):
    return labels.binned(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))


@query("SELECT s.r AS value, o_orderkey AS id, CASE WHEN o_orderstatus = s.r THEN 1 ELSE -1 END AS y FROM orders, (SELECT DISTINCT o_orderstatus AS r FROM orders) s")
def signed_label_rows(spark, d):
    return labels.signed_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value")))


@query("SELECT CAST(len(embedding) AS INT) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_check(spark, d):
    return labels.dimension_check(table(spark, d, "embeddings"), "embedding")


@query("SELECT vec_id AS id, 1 AS n FROM embeddings WHERE vec_id % 9 = 0")
def nan_check(spark, d):
    e = table(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 9 == 0, F.concat(F.col("embedding"), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return labels.nan_check(e.withColumn("v", v), "vec_id", "v")


@query("""SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.95), 6) AS p95, round(kurtosis_pop(x), 4) AS kurtosis, count(*) FILTER (x > 0) AS n_pos FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id, embedding""")
def full_array_stats(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", labels.full_stats(F.col("embedding")).alias("s"))
    return s.select("vec_id", r6("s.mean").alias("mean"), r6("s.p5").alias("p5"), r6("s.p95").alias("p95"), F.round("s.kurtosis", 4).alias("kurtosis"), "s.n_pos")


@query()
def rank_correlations(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    r = e.join(b, "vec_id").select("vec_id", labels.rank_correlations(F.col("embedding"), F.col("o")).alias("r"))
    return r.select("vec_id", r6("r.spearman").alias("spearman"), r6("r.kendall").alias("kendall"))


@query("SELECT p_brand AS tag, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, tag LIMIT 5")
def tag_counts(spark, d):
    t = archives.tagged(table(spark, d, "part").withColumn("x", F.concat(F.col("p_brand"), F.lit("; "), F.col("p_brand"))), "x")
    out = t.select(F.explode("tags").alias("low"), "p_brand").groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n"))
    return out.orderBy(F.col("n").desc(), "tag").limit(5)


# --- joins, requests, sources -----------------------------------------------------------------------------------------


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE id IN (1003, 1004, 1005, 1009)")
def request_ids(spark, d):
    return _collection(spark, d).request(ids="1003-1005,1009").select("id")


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE parent = 103 AND id IN (SELECT id FROM scores WHERE ttype = 'like' AND score >= 0.2)")
def request_min_like(spark, d):
    return _collection(spark, d).request(parent=103, min_like=0.2).select("id")


@query(f"WITH {_ITEMS} SELECT i.id FROM items i WHERE i.otype = 'customer' AND i.parent = (SELECT parent FROM items WHERE id = 1007) UNION ALL SELECT parent FROM items WHERE id = 1007")
def request_same_user(spark, d):
    c = _collection(spark, d)
    c.items = c.items.withColumn("otype", F.when(F.col("otype") == "nation", "user").otherwise(F.col("otype")))
    return c.request(same_user=1007).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE otype = 'customer' ORDER BY name DESC, id DESC LIMIT 20 OFFSET 5")
def request_page(spark, d):
    return _collection(spark, d).request(otype="customer", order="-name", limit=20, offset=5).select("id")


@query(f"WITH {_ITEMS} SELECT i.parent AS user_id, round(sum(score), 4) AS score, count(*) AS n FROM scores s JOIN items i ON i.id = s.id WHERE ttype = 'like' GROUP BY 1 HAVING count(*) >= 100")
def user_scores(spark, d):
    c = _collection(spark, d)
    c.items = c.items.withColumn("otype", F.when(F.col("otype") == "nation", "user").otherwise(F.col("otype")))
    return c.user_scores(100).select(F.col("user").alias("user_id"), F.round("score", 4).alias("score"), "n")


@query(f"WITH {_ITEMS} SELECT c.id, n.id AS ancestor, 1 AS hops FROM items c JOIN items n ON n.id = c.parent UNION ALL SELECT c.id, r.id, 2 FROM items c JOIN items n ON n.id = c.parent JOIN items r ON r.id = n.parent UNION ALL SELECT id, id, 0 FROM items")
def ancestors(spark, d):
    return joins.ancestors(_tree(spark, d), "id", "parent", 3)


@query(f"WITH {_ITEMS} SELECT p.id, coalesce(string_agg(c.name, ',' ORDER BY c.id), '') AS names FROM items p LEFT JOIN items c ON c.parent = p.id WHERE p.otype = 'nation' GROUP BY 1")
def assembled_children(spark, d):
    t = _tree(spark, d)
    return joins.children_of(t.where("otype = 'nation'"), t.where("otype = 'customer'"), "id", "parent", ["name"]).select("id", F.array_join(F.transform("children", lambda x: x["name"]), ",").alias("names"))


@query("SELECT c_custkey + 1000 AS id, round(c_acctbal / 10000, 6) AS s FROM customer")
def scores_as_map(spark, d):
    m = joins.scores_map(_scores(spark, d))
    return m.select("id", F.try_element_at("scores", F.lit("acct")).alias("a")).where("a IS NOT NULL").select("id", r6(F.get(F.map_values("a"), 0)).alias("s"))


@query("SELECT c_custkey, len(string_split(c_mktsegment, 'I')) AS n FROM customer WHERE c_custkey % 2 = 0 AND starts_with(c_mktsegment, 'B')")
def keyed_lookup(spark, d):
    c = table(spark, d, "customer")
    got = files.looked_up(files.keyed(c, c.where("c_custkey % 2 = 0"), "c_custkey"), "c_mktsegment", "prefix", "B")
    return got.select("c_custkey", F.size(F.split("c_mktsegment", "I")).cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def paged_scan(spark, d):
    return files.paged(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 1000)


@query("SELECT c_mktsegment AS name, CAST(row_number() OVER (ORDER BY c_mktsegment) + 100 AS BIGINT) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT 'BUILDING', 100")
def surrogate_ids(spark, d):
    known = spark.createDataFrame([("BUILDING", 100)], "name string, id long")
    return files.surrogate_ids(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")), "name", known).select("name", F.col("id").cast("long").alias("id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS extra FROM customer")
def metadata_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", F.create_map(F.lit("seg"), "c_mktsegment").alias("md"))
    fresh = c.where("c_custkey % 2 = 0").select("key", F.create_map(F.lit("seg"), F.lit("new"), F.lit("extra"), F.lit("x")).alias("md"))
    m = files.metadata_merged(c.select("key", "md"), fresh)
    return m.select("key", F.try_element_at("md", F.lit("seg")).alias("seg"), F.try_element_at("md", F.lit("extra")).alias("extra"))


@query("SELECT c_custkey AS k, [CAST(c_nationkey AS BIGINT)] AS names FROM customer")
def foreign_ids(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").alias("k"), F.array(F.col("n_name"), F.lit("nowhere")).alias("names"))
    return archives.foreign_ids(rows, "names", n.select("n_name", F.col("n_nationkey").cast("long").alias("n_id")), "n_name", "n_id")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 6) END AS x, NULL::DOUBLE AS extra FROM embeddings")
def extended_matrix(spark, d):
    e = table(spark, d, "embeddings")
    m = stores.widened(stores.extended(e.where("vec_id % 2 = 0").select("vec_id", "embedding"), e, "vec_id"), {"extra": "double"})
    return m.select("vec_id", r6(F.get("embedding", 0).cast("double")).alias("x"), "extra")


@query("SELECT CAST(k AS INT) AS place, round(coalesce(embedding[1]::DOUBLE, -1), 6) AS x FROM (SELECT unnest([7, 100000, 3]) AS id, unnest(range(3)) AS k) LEFT JOIN embeddings ON vec_id = id")
def dense_rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return stores.dense_rows(e, ["7", "100000", "3"], "key", "v", -1.0).select("place", r6(F.get("v", 0)).alias("x"))


# --- vectors, samples -----------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(embedding[1]::DOUBLE / list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS top, round(embedding[1]::DOUBLE / list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS one FROM embeddings""")
def row_norms(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    a = ml.normalized(e, "embedding", float("inf")).select("vec_id", r6(F.get("embedding", 0)).alias("top"))
    return a.join(ml.normalized(e, "embedding", 1.0).select("vec_id", r6(F.get("embedding", 0)).alias("one")), "vec_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, CAST(abs(a.label - b.label) AS DOUBLE) AS n, CASE WHEN a.label = b.label THEN 0e0 ELSE 1e0 END AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def label_distances(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", V.label_distance(F.col("x"), F.col("y"), "numeric").cast("double").alias("n"), V.label_distance(F.col("x"), F.col("y"), "class").alias("c"))


@query("SELECT CAST(i AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS dev FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1")
def column_stats(spark, d):
    s = V.column_stats(table(spark, d, "embeddings"), "embedding", 64)
    return s.select(F.posexplode(F.arrays_zip("means", "devs")).alias("dim", "z")).select("dim", r6("z.means").alias("mean"), r6("z.devs").alias("dev"))


@query("SELECT CAST(i AS INT) AS dim, round(avg(x * y) - avg(x) * avg(y), 6) AS cov FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i, embedding[1]::DOUBLE AS y FROM embeddings) GROUP BY 1")
def covariance_scan(spark, d):
    _, c, _ = ml.incremental_scatter(table(spark, d, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(i, float(c[i, 0])) for i in range(64)], "dim int, cov double").select("dim", r6("cov").alias("cov"))


@query(f"""WITH p AS (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY {_c('doc_id')}, doc_id LIMIT 20)
SELECT doc_id, 1 AS label FROM p UNION ALL SELECT doc_id, -1 FROM (SELECT doc_id FROM labels WHERE toxic = 0 ORDER BY {_c('doc_id')}, doc_id LIMIT 2 * (SELECT count(*) FROM p))""")
def training_set(spark, d):
    t = table(spark, d, "labels").select("doc_id", "toxic")
    return sampling.training_set(t.where("toxic = 1"), t.where("toxic = 0"), "doc_id", 20, 2)


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_c('o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 3")
def stratified_sample(spark, d):
    return sampling.per_group(table(spark, d, "orders"), "o_custkey", 3, "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts) AS start FROM events) GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming import log

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = log.windowed_counts(e, "ts", "event_type", "value", "1 day", "1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
