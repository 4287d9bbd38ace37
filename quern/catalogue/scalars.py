"""Scalar functions over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, geo, numbers, semi, strings, times, urls
from .base import query, r6, table


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS made, trim(regexp_replace(regexp_replace(lower(p_type), '[^A-Za-z0-9.-]', '_', 'g'), '_+', '_', 'g'), '_') AS safe,
chr(9) || replace(p_name, chr(10), chr(10) || chr(9)) AS indented, CASE WHEN strpos(p_type, ' ') > 0 THEN 'X' || substr(p_type, strpos(p_type, ' ')) END AS replaced,
CAST(len(regexp_extract_all(p_name, '[^ ]+')) AS INT) AS n_words FROM part""")
def str_safe(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", strings.make_safe(n).alias("made"), strings.safe(t).alias("safe"), strings.indent(n).alias("indented"), strings.replace_till(t, " ", "X").alias("replaced"), F.size(strings.words(n)).alias("n_words"))


@query("""SELECT o_orderkey, list_sort(list_distinct(flatten([range(o_orderkey % 7, o_orderkey % 7 + 3), [o_custkey]]))) AS ids FROM orders""")
def num_spec(spark, d):
    k = F.col("o_orderkey") % 7
    spec = F.concat(k.cast("string"), F.lit("-"), (k + 2).cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(",x"))
    return table(spark, d, "orders").select("o_orderkey", F.array_sort(strings.number_spec(spec)).alias("ids"))


@query("""SELECT doc_id, CASE WHEN lower(w) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(w, '^[+-]?[0-9]{1,18}$') THEN 'int' WHEN regexp_matches(w, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'str' END AS kind
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN n_chars || '.5' ELSE lang END AS w FROM documents)""")
def specialize(spark, d):
    m = F.col("doc_id") % 4
    w = F.when(m == 0, "True").when(m == 1, F.col("n_chars").cast("string")).when(m == 2, F.concat(F.col("n_chars").cast("string"), F.lit(".5"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", strings.specialize(w)["kind"].alias("kind"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower('a, B c ,a;' || item_id), '[,;]'), lambda x: regexp_replace(trim(x), '\\s+', '-', 'g')), lambda x: x <> ''))), ',') AS tags FROM benchmark""")
def tags_from_text(spark, d):
    text = F.concat(F.lit("**Notes** _x_\n"), F.col("text"), F.lit("\nTags: a, B c ,a;"), F.col("item_id").cast("string"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(strings.tags_of(text), ",").alias("tags"))


@query("""SELECT event_id, list_transform(list_filter(range(len(event_type) - 0), lambda i: substr(event_type, i + 1, 1) = 'e'), lambda i: CAST(i AS INT)) AS places,
regexp_extract_all(replace(event_type, 'r', ',r;'), '[.,;]+|[^.,;]+') AS parts FROM events""")
def str_find_tokenize(spark, d):
    c = F.col("event_type")
    return table(spark, d, "events").select("event_id", strings.find_all(c, "e").alias("places"), strings.punctuated(F.replace(c, F.lit("r"), F.lit(",r;"))).alias("parts"))


@query("""WITH w AS (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda x: nullif(regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g'), '')), lambda x: true) AS t FROM benchmark)
SELECT item_id, len(b) AS n, md5(array_to_string(b, '|')) AS grams FROM (SELECT item_id, list_transform(list_filter(range(1, len(t)), lambda i: t[i] IS NOT NULL AND t[i + 1] IS NOT NULL), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM w)""")
def ngram_counts(spark, d):
    t = F.transform(F.split("text", " "), strings.token_norm)
    return table(spark, d, "benchmark").select("item_id", strings.ngrams(t, 2).alias("b")).select("item_id", F.size("b").cast("long").alias("n"), F.md5(F.array_join("b", "|")).alias("grams"))


@query("""SELECT event_id, printf('%02d:%02d:%02d,%03d', CAST(floor(value / 3600) AS INT), CAST(floor(value / 60) AS INT) % 60, CAST(floor(value) AS INT) % 60, CAST(round(value * 1000) AS BIGINT) % 1000) AS clock FROM events""")
def clock_round_trip(spark, d):
    e = table(spark, d, "events")
    clock = strings.seconds_to_clock(F.col("value"))
    return e.select("event_id", strings.seconds_to_clock(strings.clock_to_seconds(clock)).alias("clock"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '([^.]+\\.[^.]+)$', 1) AS site,
regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.site(u).alias("site"), urls.path(u).alias("path"), F.try_element_at(urls.query(u), F.lit("page")).alias("page"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(url, '^[a-zA-Z]+://', '')), '[^A-Za-z0-9.-]', '_', 'g'), '_+', '_', 'g'), '_') AS fname,
len(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '^www\\.', '')) <= 30 AS short FROM pages""")
def url_to_file(spark, d):
    u = F.col("url")
    s = urls.shorten(u, 30)
    return table(spark, d, "pages").select("page_id", urls.to_file_name(u).alias("fname"), (~F.contains(s, F.lit("..."))).alias("short"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(o_orderdate) AS DOUBLE) AS epoch, [strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%B'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%A'),
CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END, CASE WHEN hour(o_orderdate) < 6 THEN 'night' WHEN hour(o_orderdate) < 12 THEN 'morning' WHEN hour(o_orderdate) < 18 THEN 'afternoon' ELSE 'evening' END] AS names,
[CAST(isodow(o_orderdate) - 1 AS DOUBLE), CAST(hour(o_orderdate) AS DOUBLE)] AS context FROM orders""")
def time_names(spark, d):
    e = times.epoch(F.col("o_orderdate"))
    iso = times.iso(e)
    return table(spark, d, "orders").select("o_orderkey", iso.alias("iso"), times.parse_iso(iso).alias("epoch"), times.names(e).alias("names"), times.context(e).alias("context"))


@query("""SELECT event_id, CAST(floor(s / 31536000) AS BIGINT) AS y, CAST(floor((s % 31536000) / 86400) AS BIGINT) AS d, CAST(floor((s % 86400) / 3600) AS BIGINT) AS h, CAST(floor((s % 3600) / 60) AS BIGINT) AS m, CAST(s % 60 AS BIGINT) AS s,
printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS INT), CAST(floor(s / 60) AS INT) % 60, s % 60) AS hms FROM (SELECT event_id, CAST(floor(value * 100000) AS BIGINT) AS s FROM events)""")
def collapse_secs(spark, d):
    s = F.floor(F.col("value") * 100000)
    return table(spark, d, "events").select("event_id", times.collapse(s).alias("c"), times.hms(s).alias("hms")).select("event_id", "c.*", "hms")


@query("""SELECT event_id, CASE WHEN d >= 365 THEN CAST(floor(d / 365) AS INT) || 'y' WHEN d >= 30 THEN CAST(floor(d / 30) AS INT) || 'mo' WHEN d >= 7 THEN CAST(floor(d / 7) AS INT) || 'w' WHEN d >= 1 THEN d || 'd'
WHEN s >= 3600 THEN CAST(floor(s / 3600) AS INT) || 'h' WHEN s >= 60 THEN CAST(floor(s / 60) AS INT) || 'm' ELSE CAST(floor(s) AS INT) || 's' END AS label
FROM (SELECT event_id, value * value * 10 AS s, CAST(floor(value * value * 10 / 86400) AS BIGINT) AS d FROM events)""")
def elapsed_label(spark, d):
    return table(spark, d, "events").select("event_id", times.elapsed(F.col("value") * F.col("value") * 10).alias("label"))


@query("""SELECT event_id, round(least(greatest(value / 50, 0), 1), 6) AS clamped, CASE WHEN value / 50 - 1 >= 0.8 THEN 1 WHEN value / 50 - 1 <= -0.8 THEN -1 ELSE 0 END AS three, round(1 / (1 + exp(-value / 50)), 6) AS sigmoid,
round(exp(-(value - 50) * (value - 50) / 200) / sqrt(2 * pi() * 100), 9) AS gauss, CASE WHEN value >= 50 THEN 1e0 ELSE 0e0 END AS step, round(10 + (20 - 10) * (value - 0) / 100, 6) AS lerp FROM events""")
def math_scalars(spark, d):
    v = F.col("value")
    one = lambda x: F.lit(float(x))
    return table(spark, d, "events").select("event_id", r6(numbers.clamp(v / 50)).alias("clamped"), numbers.three_way(v / 50 - 1).alias("three"), r6(numbers.sigmoid(v / 50)).alias("sigmoid"), F.round(numbers.gaussian(v, 50, 100), 9).alias("gauss"), numbers.step(v - 50).alias("step"), r6(numbers.lerp(v, one(0), one(10), one(100), one(20))).alias("lerp"))


@query("""SELECT p_partkey, p_size * 1024e0 AS bytes, p_size * 1000e0 AS metres, CAST(p_size * 1000 AS BIGINT) AS short FROM part""")
def unit_parsing(spark, d):
    s = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", numbers.memory_bytes(F.concat(s, F.lit(" kB"))).alias("bytes"), numbers.metres(F.concat(s, F.lit(" km"))).alias("metres"), numbers.short_count(F.concat(s, F.lit("K"))).alias("short"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(embedding::DOUBLE[]), 6) AS total, CAST(ceil(len(embedding) / 5) AS INT) AS n_chunks,
round(list_sort(embedding::DOUBLE[])[len(embedding) // 2 + 1], 6) AS upper, round(list_sum(list_transform(embedding[1:4]::DOUBLE[], lambda x: x * x)), 6) AS head FROM embeddings""")
def array_functions(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", r6(arrays.norm(v)).alias("norm"), r6(arrays.total(v)).alias("total"), F.size(arrays.chunks(v, 5)).alias("n_chunks"), r6(arrays.upper_median(v.cast("array<double>"))).alias("upper"), r6(arrays.dot(arrays.columns_spec(v, "0-4"), arrays.columns_spec(v, "0-4"))).alias("head"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 5) AS l1, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), 5) AS l2,
round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 5) AS linf, round(pow(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(abs(z[1]::DOUBLE - z[2]::DOUBLE), 3))), 1.0 / 3), 5) AS l3,
round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: least(z[1]::DOUBLE, z[2]::DOUBLE))), 5) AS inter FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def array_distances(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    x, y = F.col("embedding"), F.col("o")
    r = lambda c: F.round(c, 5)
    return e.join(b, "vec_id").select("vec_id", r(arrays.l1(x, y)).alias("l1"), r(arrays.l2(x, y)).alias("l2"), r(arrays.chebyshev(x, y)).alias("linf"), r(arrays.lp(x, y, 3)).alias("l3"), r(arrays.intersection(x, y)).alias("inter"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(8), lambda i: array_to_string(list_filter(['a', 'b', 'c'], lambda x: (i >> (CASE x WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END)) % 2 = 1), '')), ',') AS sets,
['1', 'a', '2', 'b', '3'] AS robin FROM part""")
def array_combinatorics(spark, d):
    sets = arrays.power_set(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    lists = F.array(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(sets, lambda s: F.array_join(s, "")), ",").alias("sets"), arrays.round_robin(lists, 5).alias("robin"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k@' || json_extract_string(props, '$.k') AS text FROM events""")
def map_functions(spark, d):
    m = F.from_json("props", "map<string,string>")
    text = strings.pairs_to_text(m)
    return table(spark, d, "events").select("event_id", strings.text_to_pairs(text)["k"].cast("long").alias("k"), text.alias("text"))


_H = "2 * 6378100.0 * asin(least(sqrt(pow(sin(radians(b2 - b1) / 2), 2) + cos(radians(b1)) * cos(radians(b2)) * pow(sin(radians(l2 - l1) / 2), 2)), 1))"


@query(f"SELECT event_id, round({_H}, 2) AS metres FROM (SELECT event_id, value - 50 AS b1, value AS l1, user_id % 80 AS b2, event_id % 170 AS l2 FROM events)")
def haversine(spark, d):
    g = geo.haversine(F.col("value") - 50, F.col("value"), F.col("user_id") % 80, F.col("event_id") % 170)
    return table(spark, d, "events").select("event_id", F.round(g, 2).alias("metres"))


@query("""SELECT event_id, x > 20.005 AND x < 80.005 AND y > 20 AND y < 60 AS inside, CASE WHEN x > 20.005 AND x < 80.005 AND y > 20 AND y < 60 THEN 0 ELSE round(sqrt(pow(greatest(20.005 - x, 0, x - 80.005), 2) + pow(greatest(20 - y, 0, y - 60), 2)), 6) END AS d, 2400e0 AS area
FROM (SELECT event_id, value AS x, user_id % 97 + 0.5 AS y FROM events)""")
def point_in_polygon(spark, d):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    poly = F.array(corner(20.005, 20), corner(80.005, 20), corner(80.005, 60), corner(20.005, 60))
    x, y = F.col("value"), (F.col("user_id") % 97).cast("double") + 0.5
    return table(spark, d, "events").select("event_id", geo.in_polygon(x, y, poly).alias("inside"), r6(geo.polygon_distance(x, y, poly)["distance"]).alias("d"), r6(geo.polygon_area(poly)).alias("area"))


@query("""SELECT event_id, round(greatest(least(x + 10, 50) - greatest(x, 0), 0) * 10 / least(100.0, 500.0), 6) AS overlap, round((x + 5 + 25) / 2, 6) AS mid FROM (SELECT event_id, value AS x FROM events)""")
def rect_overlap(spark, d):
    x = F.col("value")
    zero = F.lit(0.0)
    a, b = geo.rect(x, zero, x + 10, zero + 10), geo.rect(zero, zero, F.lit(50.0), F.lit(10.0))
    return table(spark, d, "events").select("event_id", r6(geo.rect_overlap(a, b)).alias("overlap"), r6((geo.rect_centre(a)["x"] + geo.rect_centre(b)["x"]) / 2).alias("mid"))


@query("SELECT page_id, regexp_matches(html, '(?i)<script') AS had, false AS has FROM pages")
def html_clean(spark, d):
    c = semi.clean_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.col("html").rlike("(?i)<script").alias("had"), c.rlike("(?i)<script").alias("has"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<li>')) AS links FROM pages""")
def html_rules(spark, d):
    rules = [semi.Rule("lang", "html", "lang"), semi.Rule("links", "nav li a", "href", many=True)]
    m = semi.apply_rules(F.col("html"), rules)
    return table(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", F.get_json_object(F.concat(F.lit('{"v":'), F.col("m")["lang"], F.lit("}")), "$.v").alias("lang"), F.json_array_length(F.col("m")["links"]).cast("long").alias("links"))


@query()
def html_simplified(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(semi.simplified_html(F.col("html"))).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_embedded(spark, d):
    text = F.concat(F.lit("Sure, here: "), F.col("props"), F.lit(" [done"))
    return table(spark, d, "events").select("event_id", F.get_json_object(semi.embedded_json_text(text), "$.k").cast("long").alias("k"))


@query()
def string_similarity(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", r6(strings.string_similarity("p_name", "p_type")).alias("sim"))
