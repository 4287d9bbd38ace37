"""Golden values of scalar functions and small checks of operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import arrays, geo, numbers, semi, strings, times, urls
from quern.operators import aggregates, graph, joins, ml, sampling, setops, windows
from quern.plans.items import operator_of
from quern.plans.ops import Op, Planner
from quern.sources import files
from quern.streaming import log


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_strings(spark):
    r = one(
        spark,
        strings.number_spec(F.lit("1,3-5, 4,x")),
        strings.safe(F.lit("--A b&C//d.")),
        strings.find_all(F.lit("aaa"), "aa"),
        strings.tags_of(F.lit("**x** Tags: B, a c,B")),
        strings.clock_to_seconds(F.lit("01:02:03,500")),
        strings.seconds_to_clock(F.lit(3723.5)),
        strings.text_to_pairs(F.lit("a@1::b@2::::c")),
        strings.has_words(F.lit("The Big Cat"), F.lit("big cat")),
        strings.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit("c")), 2),
        strings.int_or(F.lit("x")),
        strings.clean_text(F.lit(" a&amp;b &lt; \n c ")),
    )
    assert list(r) == [[1, 3, 4, 5], "--a_b_c_d.", [0, 1], ["a-c", "b"], 3723.5, "01:02:03,500", {"a": "1", "b": "2"}, True, ["a b"], 0, "a&b < c"]
    assert strings.matching_brackets("(a(b))") == [(2, 4), (0, 5)]
    with pytest.raises(ValueError):
        strings.matching_brackets("(a")
    assert strings.similarity("abc", "abc") == 1 and strings.similarity("", "a") == 0 and 0 < strings.similarity("abcd", "abxd") < 1


def test_urls(spark):
    u = F.lit("https://User@www.Example.co.uk:80/a/b.JPEG?x=1&y=2&x=3#f")
    r = one(spark, urls.host(u), urls.site(u), urls.path(u), urls.query(u), urls.image_extension(u), urls.shorten(F.lit("http://www.a.com/" + "x" * 60 + "/end"), 30), urls.unquote(urls.quote(F.lit("http://a b/ü?"))), urls.numbered(F.lit("d/a.txt"), F.lit(2)))
    assert list(r) == ["www.example.co.uk", "example.co.uk", "/a/b.JPEG", {"x": "1", "y": "2"}, "jpg", "a.com/.../end", "http://a b/ü?", "d/a 2.txt"]


def test_times(spark):
    r = one(spark, times.parse_iso(F.lit("2020-01-01T00:00:00+01:00")), times.parse_iso(F.lit("2020")), times.parse_iso(F.lit("12.5")), times.parse_iso(F.lit("no")), times.flat_to_iso(F.lit("20200102030405")), times.collapse(F.lit(90061)), times.elapsed(F.lit(40 * 86400)), times.utc_offset(F.lit(1577836800.0), "Europe/Berlin"))
    assert r[0] == 1577833200 and r[1] == 1577836800 and r[2] == 12.5 and r[3] is None and r[4] == "2020-01-02T03:04:05Z" and tuple(r[5]) == (0, 1, 1, 1, 1) and r[6] == "1mo" and r[7] == 3600


def test_numbers_and_arrays(spark):
    a, b = F.array(*[F.lit(float(x)) for x in (1, 2, 3)]), F.array(*[F.lit(float(x)) for x in (2, 2, 5)])
    r = one(spark, numbers.memory_bytes(F.lit("5 kB")), numbers.metres(F.lit("1,5 km".replace(",", "."))), numbers.short_count(F.lit("1.2K")), numbers.steps(F.lit(0.0), F.lit(1.0), 0.5), arrays.lp(a, b, 0), arrays.lp(a, b, 3), arrays.chebyshev(a, b), arrays.upper_median(a), arrays.chunks(a, 2, F.lit(0.0)), arrays.unit(a), arrays.grid_dims(F.lit(7)))
    assert r[0] == 5120 and r[1] == 1500 and r[2] == 1200 and r[3] == [0, 0.5, 1] and r[4] == 2 and r[5] == pytest.approx(9 ** (1 / 3)) and r[6] == 2 and r[7] == 2 and r[8] == [[1, 2], [3, 0]] and sum(x * x for x in r[9]) == pytest.approx(1) and r[10] == [3, 3]


def test_geo(spark):
    f = lambda *x: [F.lit(float(v)) for v in x]
    r = one(spark, geo.point_segment(*f(0, 1, -1, 0, 1, 0)), geo.point_segment(*f(3, 0, -1, 0, 1, 0)), geo.haversine(*f(0, 0, 0, 180)), geo.parse_gps(F.lit("47.6°, -122.3°")), geo.triangle(*f(3, 4, 5))["area"], geo.rect_intersection(geo.rect(*f(0, 0, 1, 1)), geo.rect(*f(2, 2, 3, 3))))
    assert tuple(r[0]) == (1, 0, 0) and tuple(r[1]) == (2, 1, 0) and r[2] == pytest.approx(math.pi * geo.RADIUS) and tuple(r[3]) == (47.6, -122.3) and r[4] == 6 and r[5] is None


def test_semi(spark):
    page = '<div id="a" class="x y"><p>One <b>two</b></p><p data-k="v">1.2K</p><script>no</script></div><div style="display: none">x</div>'
    root = semi.tree(page)
    rules = [semi.Rule("t", "div.x p"), semi.Rule("n", 'p[data-k="v"]', give=("int",)), semi.Rule("w", "p", many=True, give=("int",)), semi.Rule("all", "#a p", many=True, clean=(("strip",), ("lower",), ("replace", "one", "1"))), semi.Rule("k", "p", "data-k", True), semi.Rule("s", "div.x p", give=("split", " ")), semi.Rule("none", "table")]
    assert semi.rules_of(semi.rules_text(rules)) == rules and rules[0].found(root) == ["One two", "1.2K"]
    (r,) = one(spark, semi.apply_rules(F.lit(page), rules))
    assert {k: json.loads(v) for k, v in r.items()} == {"t": "One two", "n": 1200, "w": ["One two", 1200], "all": ["1 two", "1.2k"], "k": ["v"], "s": ["One", "two"], "none": None}
    assert "no" not in semi.simplified(page) and "none" not in semi.simplified(page)
    assert semi.embedded_json('x {"a": [1, 2]} tail') == {"a": [1, 2]}
    assert semi.decode_nested({"a": '{"b": "[1]"}'}) == {"a": {"b": [1]}}
    assert semi.json_ld('<script type="application/ld+json">{"@graph": [{"@type": "Recipe", "name": "x"}]}</script>', "Recipe")["name"] == "x"


def test_windows_and_kernels(spark):
    assert sum(windows.gaussian_kernel(1.0)) == pytest.approx(1) and len(windows.gaussian_kernel(1.0)) == 7
    assert windows.signal_window(3, "tri") == [0, 1, 0] and windows.regular_grid(0, 1, 0.5, True) == [0.5, 0, 1]
    df = spark.createDataFrame([(float(i),) for i in (0, 10, 20)], "t double")
    best = windows.best_offset(df, "t", "1 - abs(({t} - 3) % 10)", [(1, 1), (0.1, 0.1)], -5, 5)
    assert best == pytest.approx(3, abs=0.06)


def test_paths_and_matching(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("d", "e", 1.0)], "src string, dst string, w double")
    assert {r["id"]: r["d"] for r in graph.shortest_paths(e, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.route(e, "a", "c") == (["a", "b", "c"], 2.0) and graph.route(e, "a", "e") == ([], float("inf"))
    p = spark.createDataFrame([("g", "x", "1", 0.9), ("g", "x", "2", 0.8), ("g", "y", "1", 0.7), ("g", "y", "2", 0.1)], "g string, a string, b string, s double")
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 20) / 10) for g in "xyz" for _ in range(60)] + [("x", 1, 1, 1.5), ("x", 1, 1, 0.5)]
    best = {(g, a, b): v for g, a, b, v in sorted(rows, key=lambda r: r[3])}
    want, used = [], set()
    for (g, a, b), v in sorted(best.items(), key=lambda r: (-r[1], r[0][1:])):
        if v >= 0.3 and not used & {(g, "a", a), (g, "b", b)}:
            used |= {(g, "a", a), (g, "b", b)}
            want.append((g, a, b, v))
    got = joins.greedy_matching(spark.createDataFrame(rows, "g string, a long, b long, s double"), "g", "a", "b", "s", 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted((r["a"], r["b"]) for r in joins.greedy_matching(p, "g", "a", "b", "s", 0.05).collect()) == [("x", "1"), ("y", "2")]


def test_sets(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, hash string")
    new = spark.createDataFrame([("a", "1"), ("d", "2"), ("e", "3"), ("c", "3"), ("f", "9")], "key string, hash string")
    diff = setops.listing_diff(old, new)
    assert sorted(map(tuple, diff.collect()), key=str) == sorted([("move", "b", "d"), ("copy", "c", "e"), ("add", None, "f")], key=str)
    assert sorted(map(tuple, setops.applied(old, diff, new).collect())) == sorted(map(tuple, new.collect()))
    assert setops.listing_diff(old, old).count() == 0


def test_samples_agree_on_reruns(spark):
    df = spark.range(1000)
    assert sampling.at_most(df, 10, "id", 3).collect() == sampling.at_most(df, 10, "id", 3).collect()
    parts = {r[0]: r[1] for r in sampling.exact_split(df, "id", [0.25, 0.75]).groupBy("part").count().collect()}
    assert parts == {0: 250, 1: 750}
    assert sampling.with_replacement(df, "id", 50).count() == 50
    assert sampling.training_set(df.where("id < 50"), df, "id", 20, 3).groupBy("label").count().orderBy("label").collect() == [(-1, 60), (1, 20)]


def test_planner():
    ops = [Op("double", {"x": "n"}, "m", lambda x, by: x * by, {"2": {"by": 2}, "3": {"by": 3}}), Op("sum", {"a": "n", "b": "m"}, "s", lambda a, b: a + b, same=[("a", "b", "n")]), Op("bad", {"x": "s"}, "t", lambda x: 1 / 0)]
    p = Planner(ops)
    got = p.start({"one": ("n", 1), "ten": ("n", 10)})
    assert sorted(r.value for r in got.values() if r.kind == "s") == [3, 4, 30, 40] and len(p.errors) == 4


def test_models():
    src = np.array([[0, 0], [1, 0], [0, 1], [1, 1], [2, 3]], float)
    m = ml.similarity(src, src @ np.array([[0, 2], [-2, 0]]) + [1, 2])
    assert np.allclose((m @ np.c_[src, np.ones(5)].T).T[:, :2], src @ np.array([[0, 2], [-2, 0]]) + [1, 2])
    h = ml.homography(src, src * 2 + 1)
    assert np.allclose(h, [[2, 0, 1], [0, 2, 1], [0, 0, 1]], atol=1e-8)
    pts = np.r_[np.c_[np.arange(20.0), 2 * np.arange(20.0)], [[3, 50], [7, -9]]]
    model, inside = ml.ransac(pts, lambda p: np.polyfit(p[:, 0], p[:, 1], 1) if p[0, 0] != p[-1, 0] else None, lambda c, p: abs(np.polyval(c, p[:, 0]) - p[:, 1]), 2, 0.1)
    assert inside.sum() == 20 and np.allclose(model, [2, 0], atol=1e-6) and ml.rounds_needed(2, 0.5) >= 10


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n# id\tname\n1\tx\n2\ty\n")
    assert files.delimited(spark, str(tmp_path / "a.txt")).collect() == [("1", "x"), ("2", "y")]
    (tmp_path / "b.json").write_text('[{"a": 1, "b": "x", "http://z": 1}, {"b": "y"}]')
    assert files.json_to_table(spark, str(tmp_path / "b.json")).columns == ["b", "a"]
    (tmp_path / "c.jsonl").write_text('{"_name": "n", "_ts": 1, "v": 2}\n{"_ts": 2}\n{"_name": "n", "_ts": 3, "_copy_of": 1}\n')
    ev = files.json_lines(spark, str(tmp_path / "c.jsonl"))
    assert ev.count() == 2 and files.resolve_copies(ev).where("body LIKE '%\"v\": 2%'").count() == 2
    (tmp_path / "d.ics").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:Long\n  name\nDTSTART:20200101T100000Z\nDTEND:20200101T110000Z\nEND:VEVENT\nBEGIN:VEVENT\nUID:2\nSTATUS:CANCELLED\nDTSTART:20200101\nEND:VEVENT\nEND:VCALENDAR\n")
    assert [(r["uid"], r["summary"]) for r in files.calendar(spark, str(tmp_path / "d.ics")).collect()] == [("1", "Long name")]
    (tmp_path / "e.csv").write_text("Time(DD/MM/YYYY H:mm:ss),Carbon dioxide(ppm),Temperature(°F),Relative humidity(%),Atmospheric pressure(mmHg)\n01/02/2020 3:04:05,400,70.5,,760\nbad,1,1,1,1\n")
    r = files.sensor_files(spark, str(tmp_path / "e.csv")).collect()
    assert len(r) == 1 and r[0]["co2"] == 400 and r[0]["humidity"] is None
    import struct

    (tmp_path / "f.bin").write_bytes(struct.pack("<if", 1, 0.5) + struct.pack("<if", 2, 1.5) + b"x")
    assert files.records(spark, str(tmp_path / "f.bin"), "<if", ["a", "b"]).collect() == [(1, 0.5), (2, 1.5)]
    stored = spark.createDataFrame([("x", 5)], "k string, id long")
    assert sorted(map(tuple, files.surrogate_ids(spark.createDataFrame([("x",), ("b",), ("a",)], "k string"), "k", stored).collect())) == [("a", 6), ("b", 7), ("x", 5)]


def test_order_without_whole_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(40))]), i) for i in range(900)] + [("none", None, 900)]
    df = spark.createDataFrame(rows, "k string, t double, i int")
    kinds = {r[0] for r in rows}
    own = {k: sorted(t for j, t, _ in rows if j == k and t is not None) for k in kinds}
    got = {r["k"]: r["median"] for r in aggregates.upper_medians(df, "k", "t").collect()}
    assert got == {k: v[len(v) // 2] if v else None for k, v in own.items()}
    assert aggregates.upper_medians(df.limit(0), "k", "t").count() == 0
    want, first = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2])):
        o = first.get(k)
        want[i] = o if o is not None and t is not None and t - o <= 7 else None
        if want[i] is None:
            first[k] = t
    marked = log.recent_duplicates(df.repartition(7), ["k"], "t", "i", 7.0)
    assert marked.columns == ["k", "t", "i", "copy_of"]
    assert {r["i"]: r["copy_of"] for r in marked.collect()} == want
    assert log.recent_duplicates(df.limit(0), ["k"], "t", "i", 7.0).count() == 0
    keys = [(f"k{rng.randrange(5000)}",) for _ in range(1500)] + [(None,)]
    stored = spark.createDataFrame([("k1", 5), ("k77", 9)], "k string, id long")
    new = sorted({k for k, in keys if k not in ("k1", "k77")}, key=lambda k: (k is not None, k or ""))
    ids = {r["k"]: r["id"] for r in files.surrogate_ids(spark.createDataFrame(keys, "k string"), "k", stored).collect()}
    assert ids == {"k1": 5, "k77": 9} | {k: 10 + n for n, k in enumerate(new)}


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:05"), (3, "b", "2024-01-01 00:00:06")]
    df = spark.createDataFrame(rows, "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = log.stream_originals(stream, ["k"], "t", "1 minute").writeStream.format("memory").queryName("originals").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("originals").count() == 2
    got = []
    q = log.batched_sink(stream, lambda b, n: got.extend(r["k"] for r in b.collect()), "k", str(tmp_path / "c2"), "0 seconds", after=lambda n: got.append(n)).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x for x in got if isinstance(x, str)) == ["a", "b"] and 0 in got


def test_rates(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert aggregates.auc(aggregates.roc(df, "s", "y")).first()[0] == pytest.approx(0.75)
    assert operator_of(">=3") == (">=", 3) and operator_of("<>") == ("<>", None)


def test_neighbours_in_blocks(spark, monkeypatch):
    from quern.operators import vectors

    rng = np.random.default_rng(0)
    x = rng.integers(-9, 9, (300, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got = {}
    for r in vectors.neighbours(df, df.where("id < 20"), "id", "v", 4, "l1").collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q in range(20):
        d = np.abs(x - x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:4]
        assert [i for _, i in sorted(got[q])] == want


def test_more_scalars(spark):
    nested = F.array(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))
    kind = spark.range(1).select(nested.alias("n")).schema["n"].dataType
    r = one(spark, arrays.flat(nested, kind), arrays.shape(nested, kind), strings.cut_at(F.lit("abcdef"), [("x", 0), ("y", 2), ("z", 5)]), strings.arguments(F.array(F.lit("a=1"), F.lit("b"), F.lit("c=x=y"))), strings.random_text(F.lit(5), 12), strings.random_text(F.lit(5), 12))
    assert r[0] == [1, 2, 3] and r[1] == [1, 2, 2] and r[2] == {"x": "ab", "y": "cde", "z": "f"} and r[3]["a"]["i"] == 1 and r[3]["c"]["s"] == "x=y" and r[4] == r[5] and len(r[4]) == 12


def test_places(spark):
    f = lambda *x: [F.lit(float(v)) for v in x]
    r = one(spark, geo.located(*f(0, 0, 0, 0.001, 200), 1000), geo.located(*f(0, 0, 0, 0.005, 56), 1000)["kind"], geo.located(*f(0, 0, 5, 5, 1), 1000), geo.projected(*f(0, 0), geo.gps_box(*f(0, 0), 1000.0), 100, 50))
    assert tuple(r[0]) == ("in", 1.0) and r[1] == "near" and r[2] is None and r[3]["x"] == pytest.approx(50) and r[3]["y"] == pytest.approx(25)
    cities = spark.createDataFrame([(52.5, 13.4, "Europe/Berlin"), (40.7, -74.0, "America/New_York")], "lat double, lon double, zone string")
    df = spark.createDataFrame([(48.0, 11.0, 1577836800.0), (42.0, -71.0, 1577836800.0), (None, 1.0, 0.0)], "lat double, lon double, t double")
    got = [(r["place"], str(r["local"])) for r in joins.local_times(df, "t", "lat", "lon", cities).collect()]
    assert got == [("Europe/Berlin", "2020-01-01 01:00:00"), ("America/New_York", "2019-12-31 19:00:00"), (None, "None")]
