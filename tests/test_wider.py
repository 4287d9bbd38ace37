"""Archives, stores, names, labels, curves, clusters, features, tasks, prompts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import names, semi
from quern.operators import clusters, joins, labels, paths, predict, prompts
from quern.plans import features, tasks
from quern.sources import archives, stores


def test_timeline(spark, tmp_path):
    seg = [
        {"startTime": "2024-01-01T10:00:00.000+01:00", "endTime": "2024-01-01T11:00:00.000+01:00", "visit": {"hierarchyLevel": 0, "probability": 0.9, "topCandidate": {"placeId": "p", "semanticType": "HOME", "placeLocation": {"latLng": "47.6°, -122.3°"}}}},
        {"startTime": "2024-01-01T08:00:00Z", "endTime": "2024-01-01T08:30:00Z", "activity": {"start": {"latLng": "1.0°, 2.0°"}, "end": {"latLng": "3.0°, 4.0°"}, "distanceMeters": 12.5, "topCandidate": {"type": "WALKING"}}},
    ]
    raw = [{"position": {"timestamp": "2024-01-01T08:10:00Z", "LatLng": "5.0°, 6.0°", "source": "WIFI", "accuracyMeters": 3}}]
    (tmp_path / "t.json").write_text(json.dumps({"semanticSegments": seg, "rawSignals": raw}))
    got = archives.timeline(spark, str(tmp_path / "t.json")).collect()
    assert [r["kind"] for r in got] == ["activity", "position", "visit"] and got[0]["distance"] == 12.5 and got[2]["start"]["lat"] == 47.6 and got[2]["t0"] == 1704099600 and got[1]["accuracy"] == 3
    spans = archives.timeline(spark, str(tmp_path / "t.json"))
    assert [r["kind"] for r in archives.at_time(spans, 1704098500.0).collect()] == ["visit", "position"]
    (tmp_path / "u.json").write_text(json.dumps({"semanticSegments": [{"odd": 1}], "rawSignals": []}))
    with pytest.raises(Exception, match="unknown segment"):
        archives.timeline(spark, str(tmp_path / "u.json")).collect()
    assert archives.timeline(spark, str(tmp_path / "u.json"), strict=False).count() == 0


def test_posts(spark):
    df = spark.createDataFrame([("h", "2024-01-02T00:00:00Z", "text", "x/status/1", ["i1", "i2"], 3), ("h", "2024-01-01T00:00:00Z", "", "x/status/2", [], 0), ("h", "", "no", "x/else", [], 0)], "handle string, iso_ts string, text string, url string, image_urls array<string>, likes int")
    got = [(r["otype"], r["url"]) for r in archives.post_items(df).collect()]
    assert got == [("post", "x/status/2"), ("image", "i1"), ("image", "i2"), ("post", "x/status/1"), ("text", "x/status/1#text")]
    assert archives.post_items(df, df.where("likes = 3").select("url")).count() == 1
    blocks = spark.createDataFrame([("p1", "blog", [("video", "v", "cap", "poster")])], "url string, blog string, blocks array<struct<type:string,url:string,text:string,poster:string>>")
    assert sorted((r["url"], r["otype"]) for r in archives.block_items(blocks).collect()) == [("blog", "user"), ("p1", "post"), ("poster", "image"), ("v", "video")]


def test_diary_graph_and_logs(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Date,Name,Year,Rating,Rewatch,Tags\n2024-01-01,Up,2009,4.5,Yes,"a, b"\n2024-01-02,Down,x,,No,\n')
    (tmp_path / "r.csv").write_text("Date,Name,Review\n2024-01-01,Up,fine\n2024-01-03,Side,only\n")
    got = {r["name"]: r for r in archives.diary(spark, [str(tmp_path / "d.csv"), str(tmp_path / "none.csv")], [str(tmp_path / "r.csv")]).collect()}
    assert got["Up"]["rewatch"] and got["Up"]["tags"] == ["a", "b"] and got["Up"]["review"] == "fine" and got["Down"]["year"] is None and got["Side"]["review"] == "only"
    (tmp_path / "g.xml").write_text('<graphml><key id="d0" attr.name="type"/><key id="d1" attr.name="name"/><graph><node id="n1"><data key="d0">person</data><data key="d1">Ann</data></node><node id="n2"/></graph></graphml>')
    assert sorted(map(tuple, archives.graphml_nodes(spark, str(tmp_path / "g.xml")).collect())) == [("n1", "person", "Ann"), ("n2", None, None)]
    (tmp_path / "q.log").write_text("0.5 SELECT * FROM t WHERE a = 1\n1.5 SELECT * FROM t WHERE a = 22\nnoise\n0.1 SELECT 'x'\n")
    assert [tuple(r) for r in archives.log_summary(archives.sql_log(spark, str(tmp_path / "q.log"))).collect()][0] == ("SELECT * FROM t WHERE a = ?", 2, 2.0, 1.0, 1.5)
    r = spark.range(1).select(archives.blocks(F.lit("2\na\nb\n0\n1\nc")).alias("b"), archives.blocks(F.lit("1\na\nx\nb")).alias("c")).first()
    assert r["b"] == [["a", "b"], [], ["c"]] and r["c"] == [["a"]]
    df = spark.createDataFrame([(1, ["b", "zz", "a"])], "k int, names array<string>")
    ids = spark.createDataFrame([("a", 10), ("b", 20)], "name string, id long")
    assert archives.foreign_ids(df, "names", ids, "name", "id").first()["names"] == [20, 10]


def test_store(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "kv"), "array<float>")
    kv = lambda *rows: spark.createDataFrame(list(rows), "key string, value array<float>, md map<string,string>")
    assert s.read().count() == 0
    s.set(kv(("a", [1.0], {"x": "1"}), ("b", [2.0], None)))
    s.set(kv(("a", [3.0], None), ("c", [4.0], None)))
    s.merge_md(spark.createDataFrame([("a", {"y": "2"}), ("none", {"z": "3"})], "key string, md map<string,string>"))
    s.delete(spark.createDataFrame([("b",)], "key string"))
    got = {r["key"]: (r["value"], r["md"]) for r in s.read().collect()}
    assert got == {"a": ([3.0], {"x": "1", "y": "2"}), "c": ([4.0], {})} or got == {"a": ([3.0], {"x": "1", "y": "2"}), "c": ([4.0], None)}
    assert [r["key"] for r in s.absent(spark.createDataFrame([("a",), ("q",)], "key string")).collect()] == ["q"]
    m = stores.dense_rows(s.read(), ["c", "q", "a"], "key", "value", -1.0)
    assert [r["value"] for r in m.collect()] == [[4.0], [-1.0], [3.0]]


def test_names(spark):
    got = names.segments("MyTrip - Day_(2) [x].2024-03-05.jpg")
    assert [[t.text for t in s.tokens] for s in got] == [["My", "Trip"], ["Day"], ["2"], ["x"], ["2024", "03", "05", "jpg"]]
    tokens = [t for s in got for t in s.tokens]
    assert str(names.find_date(tokens)[0]) == "2024-03-05"
    assert [[t.text for t in s.tokens] for s in names.without_text(got, "trip day")] == [["My"], ["2"], ["x"], ["2024", "03", "05", "jpg"]]
    kinds = [names.FileType("main", suffix=".pdf"), names.FileType("side", ".", ".json"), names.FileType("any")]
    assert names.split_path("d/.a.json", kinds) == ("d", ".", "a", ".json", "side") and names.translated("d/a.pdf", "side", kinds) == "d/.a.json"
    df = spark.createDataFrame([("x/.b.json",), ("b.pdf",), ("c",)], "p string")
    assert [r[0] for r in df.select(names.type_column(F.col("p"), kinds)).collect()] == ["side", "main", "any"]
    assert [r[0] for r in df.select(names.first_glob(F.col("p"), ["*.pdf", "x/*", "?"])).collect()] == ["x/*", "*.pdf", "?"]
    srt = F.lit("1\n00:00:01,000 --> 00:00:02,500\nHi\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    r = spark.range(1).select(names.shifted(names.dialogs(srt), 1.0)).first()[0]
    assert [(x["start"], x["end"], x["text"]) for x in r] == [(2.0, 3.5, "Hi\nthere"), (4.0, 5.0, "Bye")]
    t = spark.createDataFrame([("big cat", "the big cat"), ("cat big", "big cat"), ("colour", "color"), ("a", " "), ("x", "y")], "a string, b string")
    s = [r[0] for r in t.select(names.match_score(F.col("a"), F.col("b"), {"exact": 5, "hasword": 3, "unordered": 2, "typo": 1})).collect()]
    assert s[0] == 3 and s[1] == 2 and 0.7 < s[2] < 2 and s[3] == s[4] == 0


def test_labels(spark):
    rows = [(str(i), "year", str(1990 + i % 7), "t") for i in range(20)] + [(str(i), "name", f"n{i}", "t") for i in range(20)] + [(str(i), "genre", "ab"[i % 2], "t") for i in range(20)]
    rows += [(str(i // 2), "tag", "xyz"[i % 3], "t") for i in range(20)] + [(str(i), "odd", str(i) if i % 2 else "s", "t") for i in range(20)] + [("1", "title", "T", "t")]
    got = {r["key"]: r["kind"] for r in labels.label_kinds(spark.createDataFrame(rows, "id string, key string, value string, type string")).collect()}
    assert got == {"year": "numeric", "name": "id", "genre": "multiclass", "tag": "multilabel", "odd": "mixed"}
    lab = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "y")], "id string, value string")
    assert sorted(map(tuple, labels.signed_rows(lab).collect())) == [("x", "a", 1), ("x", "b", -1), ("y", "a", 1), ("y", "b", 1)]
    v = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0, 4.0])], "id int, v array<double>")
    assert labels.nan_check(v, "id", "v").collect() == [(1, 1)] and labels.dimension_check(v, "v").count() == 2
    s = v.where("id = 2").select(labels.full_stats(F.col("v")).alias("s")).first()["s"]
    assert s["gmean"] == pytest.approx(2) and s["n_pos"] == 3 and s["median"] == 2
    r = v.where("id = 2").select(labels.rank_correlations(F.col("v"), F.array(F.lit(9.0), F.lit(4.0), F.lit(1.0))).alias("r")).first()["r"]
    assert r["spearman"] == pytest.approx(-1) and r["kendall"] == pytest.approx(-1)
    m = spark.createDataFrame([(i, 1.0 - i / 100, 1 if i in (0, 2) else 0) for i in range(50)], "i int, s double, y int")
    assert labels.map_at(m, "s", "y", "i").first()[0] == pytest.approx((1 + 2 / 3) / 2)
    n = [10, 100, 1000, 10000]
    assert [labels.complexity(n, [f(np.array(x, float)) for x in n]) for f in (lambda x: 3 * x, lambda x: x * x, lambda x: x * np.log2(x), lambda x: 2.0)] == ["n", "n^2", "n log n", "1"]
    assert labels.ranked_peaks([0, 1, 0, 5, 0, 2, 0], 1)[0] == 3
    log = spark.createDataFrame([("f", n, 2.0 * n) for n in (1, 10, 100)] + [("g", n, 1.0 * n * n) for n in (1, 10, 100)], "b string, n int, t double")
    assert sorted(map(tuple, labels.cost_profile(log, "b", "n", "t").collect())) == [("f", "n"), ("g", "n^2")]


def test_curves(spark):
    df = spark.createDataFrame([("c", 0, 0.0, 0.0), ("c", 1, 2.0, 0.0), ("c", 2, 2.0, 2.0)], "k string, i int, x double, y double")
    c = paths.curves(df, "k", "i", "x", "y")
    q = lambda *cols: c.select(*cols).first()
    r = q(paths.interpolate(F.col("curve"), F.lit(0.5)), paths.interpolate(F.col("curve"), F.lit(9.0)), paths.project(F.col("curve"), F.lit(1.0), F.lit(-1.0)), paths.curvature(F.col("curve"), F.lit(1.0), 0.5), paths.curvature(F.col("curve"), F.lit(0.5), 0.25), paths.nearest_index(F.col("curve"), F.lit(1.4)), paths.nearest_mean(F.col("curve"), F.lit(2.0), F.lit(1.9), 2))
    assert tuple(r[0]) == (1, 0) and tuple(r[1]) == (2, 2) and tuple(r[2]) == (1, 1, 0) and r[3] == pytest.approx(1) and r[4] == pytest.approx(0) and tuple(r[5]) == (2, 0) and r[6]["i"] == 1.5


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) * 0.1 + 5 * (i % 3)).tolist(), i % 3, (i % 3) if i < 30 else None) for i in range(90)]
    return spark.createDataFrame(rows, "id long, v array<double>, c int, known int")


@pytest.mark.parametrize("how", ["agglomerative", "density", "affinity", "bisecting", "guided"])
def test_clusterings(blobs, how):
    call = {"agglomerative": lambda: clusters.agglomerative(blobs, "id", "v", 3), "density": lambda: clusters.density(blobs, "id", "v", 1.0, 3), "affinity": lambda: clusters.affinity(blobs, "id", "v"), "bisecting": lambda: clusters.bisecting(blobs, "id", "v", 3), "guided": lambda: clusters.guided(blobs, "id", "v", "known", 3)}
    got = {r["id"]: r["cluster"] for r in call[how]().collect()}
    pure = {}
    for i, c in got.items():
        pure.setdefault(c, set()).add(i % 3)
    assert len(got) == 90 and all(len(s) == 1 for s in pure.values())


def test_cluster_quality(blobs):
    assert clusters.silhouette(blobs, "v", "c") > 0.9 and clusters.davies_bouldin(blobs, "v", "c", 3) < 0.2
    train = blobs.withColumn("y", (F.col("c") != 1).cast("int"))
    s = {r["id"]: r["score"] for r in clusters.mixture_scores(train, blobs, "id", "v", "y", 2).collect()}
    assert min(s[i] for i in s if i % 3 != 1) > max(s[i] for i in s if i % 3 == 1)
    tags = blobs.select("id", F.concat(F.lit("t"), "c").alias("tag"))
    assert {r["cluster"]: r["tags"] for r in clusters.named(blobs.select("id", F.col("c").alias("cluster")), tags).collect()}[2] == ["t2"]


def test_features(spark):
    f = features.Composite("all", parts=[features.Constant("one", values=(1.0, 2.0)), features.Category("lang", col="lang", values=("en", "de", "fr")), features.Category("bits", col="lang", values=("en", "de", "fr"), how="binary"), features.Recency("age", a="t0", b="t1", log=True)])
    df = spark.createDataFrame([("de", 0.0, 0.0)], "lang string, t0 double, t1 double")
    r = df.select(f.column().alias("v")).select("v", f.explain(F.col("v")).alias("e")).first()
    assert r["v"] == [1, 2, 0, 1, 0, 1, 0, 0] and r["e"]["lang"] == [0, 1, 0] and f.width == 8
    again = features.from_dict(json.loads(json.dumps(f.to_dict())))
    assert df.select(again.column()).first()[0] == r["v"]
    with pytest.raises(Exception, match="components"):
        df.select(features.Function("bad", 2).checked()).collect()


def test_tasks(spark, tmp_path):
    t = [tasks.Task("twice", ("n",), "m", lambda n, by: n.select((F.col("id") * by).alias("id")), (("by", 2),)), tasks.Task("both", ("n", "m"), "s", lambda n, m: n.union(m))]
    run = tasks.Runner(spark, str(tmp_path))
    assert run.run(t, {"n": ("1", spark.range(3))})["s"].count() == 6 and run.made == ["twice", "both"]
    again = tasks.Runner(spark, str(tmp_path))
    again.run(t, {"n": ("1", spark.range(3))})
    assert again.made == []
    with pytest.raises(ValueError):
        run.run(t, {})
    now, seen, waits = [0.0], [], []
    c = tasks.Calls(lambda x: seen.append(x) or x * 2, ttl=10, rate=1, clock=lambda: now[0], sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    assert c.many([1, 1, 2]) == [2, 2, 4] and seen == [1, 2] and waits == [1.0]
    now[0] = 100
    assert c(1) == 2 and seen == [1, 2, 1]
    s = tasks.Sources()
    s.add("range", lambda a: a.startswith("range:"), lambda spark, a: spark.range(int(a[6:])))
    assert s.read(spark, "range:4").count() == 4


def test_prompts(spark):
    def echo(p: str) -> str:
        lines = [x for x in p.splitlines() if x[:1].isdigit()]
        return "\n".join(x.upper() for x in lines if "skip" not in x)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "skip", None, "b"])], "i int, t string")
    got = {r["i"]: r["answer"] for r in prompts.batched(df, "t", "Shout", echo, 3).collect()}
    assert got[0] == "A" and got[1] is None and got[3] == "B"
    m = prompts.into_schema(df, "t", {"kind": ["x"], "n": None}, lambda p: 'Sure: {"kind": "y", "n": 1, "z": 2} done').first()["mapped"]
    assert json.loads(m) == {"n": 1}
    j = prompts.fuzzy_join(df.where("t = 'a'"), [{"id": k} for k in "pqrs"], "i", "t", lambda p: json.dumps([{"id": x["id"], "confidence": 0.5 if x["id"] == "p" else 0.9} for x in json.loads(p.split("Among: ")[1])]), chunk=2).collect()
    assert [r["match"] for r in j] == ["q", "r", "s"]
    assert prompts.tag_groups('[["A", "zz"], ["b"]]', {"a", "b"}) == [["a"], ["b"]] and prompts.tag_groups("a, b\nq", {"a", "b"}) == [["a", "b"]]


def test_ppmi_embeddings_drop_no_item(spark):
    from quern.operators import vectors

    m = spark.createDataFrame([(x, y, 1.0) for x in "abc" for y in "abc" if x != y], "a string, b string, ppmi double")
    assert {r["item"] for r in vectors.ppmi_embeddings(m, most_items=3).collect()} == set("abc")
    with pytest.raises(ValueError):
        vectors.ppmi_embeddings(m, most_items=2)


def test_predictions_by_name(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    rows = [(i, v.tolist(), int(v[0] * v[1] > 0), float(3 * v[0] - v[1])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, t double").repartition(2).cache()
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    right = lambda s, cut: sum((r["score"] > cut) == bool(rows[r["id"]][2]) for r in s.collect()) / 100
    assert right(predict.classified(train, test, "id", "v", "y", "rbf", 2, gamma=3.0, features=128), 0) > 0.85 and right(predict.classified(train, test, "id", "v", "y", "knn", 2), 0.5) > 0.85
    for method, most in (("linear", 0.05), ("ridge", 0.2), ("knn", 0.6)):
        got = predict.predicted(train, test, "id", "v", "t", method, 2).collect()
        assert len(got) == 100 and np.mean([abs(r["prediction"] - rows[r["id"]][3]) for r in got]) < most
    values, vecs = predict.eigenpairs(np.diag([1.0, 4.0, 2.0]))
    assert values.tolist() == [4, 2, 1] and abs(vecs[1, 0]) == 1 and len(predict.eigenpairs(np.diag([1.0, 4.0, 2.0]), 0.8)[0]) == 2
    few = spark.createDataFrame([(i, 1.0 if i < 9 else -1.0) for i in range(40)], "id long, value double")
    assert predict.tasks(few, "t", "class").count() == 0 and predict.tasks(few, "t", "class", 9).count() == 40
    steep = spark.createDataFrame([(1, 0.0), (2, 5000.0)], "id long, value double")
    assert {r["task"] for r in predict.tasks(steep, "s", "numeric").collect()} == {"s-regression-orig", "s-regression-log"}


def test_searches_know_no_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100)], "id long, up long")
    got = {r["id"]: r["ancestor"] for r in joins.closest_ancestor(chain, "id", "up", F.col("id") % 30 == 0).collect()}
    assert got == {i: 30 if i >= 30 else 0 for i in range(40)}
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}',)], "j string")
    assert {r["path"] for r in semi.key_paths(deep, "j").collect()} == {"a", "a.b", "a.b.c", "a.b.c.d", "a.b.c.d.e", "a.b.c.d.e.f"}


def test_signed_rows_bounds_its_values(spark):
    own = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "id int, value string")
    got = {(r["value"], r["id"]): r["y"] for r in labels.signed_rows(own, 3).collect()}
    assert got == {(v, i): 1 if (i, v) in {(1, "a"), (1, "b"), (2, "a"), (3, "c")} else -1 for v in "abc" for i in (1, 2, 3)}
    with pytest.raises(ValueError):
        labels.signed_rows(own, 2)
