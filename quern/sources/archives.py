"""Archives of personal data and other semi-structured files, as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import parse_gps
from ..functions.times import parse_iso

#: The JSON paths of the fields of a location history, by kind of segment.
SEGMENTS = {
    "timelinePath": {"points": "timelinePath"},
    "activity": {"start": "activity.start.latLng", "end": "activity.end.latLng", "distance": "activity.distanceMeters", "type": "activity.topCandidate.type", "prob": "activity.topCandidate.probability"},
    "visit": {"level": "visit.hierarchyLevel", "place_id": "visit.topCandidate.placeId", "type": "visit.topCandidate.semanticType", "prob": "visit.probability", "start": "visit.topCandidate.placeLocation.latLng", "place_prob": "visit.topCandidate.probability"},
    "timelineMemory": {"place_id": "timelineMemory.trip.destinations[0].identifier.placeId", "distance_km": "timelineMemory.trip.distanceFromOriginKms"},
}
SIGNALS = {
    "position": {"time": "position.timestamp", "start": "position.LatLng", "type": "position.source", "accuracy": "position.accuracyMeters", "altitude": "position.altitudeMeters", "speed": "position.speedMetersPerSecond"},
    "wifiScan": {"time": "wifiScan.deliveryTime", "points": "wifiScan.devicesRecords"},
    "activityRecord": {"time": "activityRecord.timestamp", "points": "activityRecord.probableActivities"},
}


def kind_of(c: Column, kinds: dict[str, dict[str, str]]) -> Column:
    """The first of the kinds that is a key of a JSON object; null if none is."""
    out = F.lit(None).cast("string")
    for k in reversed(list(kinds)):
        out = F.when(F.get_json_object(c, f"$.{k}").isNotNull(), k).otherwise(out)
    return out


def _fields(c: Column, kind: Column, kinds: dict[str, dict[str, str]], name: str) -> Column:
    out = F.lit(None).cast("string")
    for k, paths in kinds.items():
        if name in paths:
            out = F.when(kind == k, F.get_json_object(c, "$." + paths[name])).otherwise(out)
    return out


def timeline(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per segment or raw signal of a location history, ordered by (t0, t1): kind, t0, t1, places as
    struct(lat, lon), numbers, type, and points as JSON text. An object of no known kind raises if strict, else goes.
    """
    raw = spark.read.text(path, wholetext=True)
    out = None
    for name, kinds in (("semanticSegments", SEGMENTS), ("rawSignals", SIGNALS)):
        each = raw.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")).alias("o"))
        kind = kind_of(F.col("o"), kinds)
        if strict:
            kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown segment "), F.substring("o", 1, 80))).cast("string"))
        f = lambda n: _fields(F.col("o"), F.col("kind"), kinds, n)  # noqa: B023, E731
        t0 = F.coalesce(parse_iso(F.get_json_object("o", "$.startTime")), parse_iso(f("time")))
        number = lambda n: f(n).try_cast("double")
        one = each.withColumn("kind", kind).where("kind IS NOT NULL").select(
            "kind", t0.alias("t0"), F.coalesce(parse_iso(F.get_json_object("o", "$.endTime")), t0).alias("t1"),
            parse_gps(f("start")).alias("start"), parse_gps(f("end")).alias("end"), f("type").alias("type"), f("place_id").alias("place_id"),
            F.coalesce(number("distance"), number("distance_km") * 1000).alias("distance"), number("prob").alias("prob"), number("place_prob").alias("place_prob"), number("level").cast("int").alias("level"),
            number("accuracy").alias("accuracy"), number("altitude").alias("altitude"), number("speed").alias("speed"), f("points").alias("points"),
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy("t0", "t1", "kind")


def at_time(spans: DataFrame, ts: float) -> DataFrame:
    """The spans that hold an instant; if none does, the neighbours by distance of their start."""
    inside = spans.where((F.col("t0") <= ts) & (F.col("t1") >= ts))
    if not inside.isEmpty():
        return inside.orderBy("t0", "t1")
    return spans.orderBy(F.abs(F.col("t0") - ts), "t0").limit(2)


def post_items(posts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(url, parent_url, otype, name, ts, md): a post, its text and its images as items, from rows with handle,
    display_name, iso_ts, text, url, image_urls and counts; only status addresses, in time order, known ones skipped."""
    p = posts.where(F.contains("url", F.lit("/status/")))
    if known is not None:
        p = p.join(known.select("url"), "url", "left_anti")
    ts = parse_iso(F.col("iso_ts"))
    extra = [c for c in ("handle", "display_name", "likes", "replies", "reposts", "views") if c in posts.columns]
    md = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    post = p.select("url", F.lit(None).cast("string").alias("parent_url"), F.lit("post").alias("otype"), F.col("handle").alias("name"), ts.alias("ts"), md.alias("md"))
    text = p.where("text <> ''").select(F.concat("url", F.lit("#text")).alias("url"), F.col("url").alias("parent_url"), F.lit("text").alias("otype"), F.col("text").alias("name"), ts.alias("ts"), F.lit("{}").alias("md"))
    image = p.select(F.col("url").alias("parent_url"), ts.alias("ts"), F.explode("image_urls").alias("url")).select("url", "parent_url", F.lit("image").alias("otype"), F.lit(None).cast("string").alias("name"), "ts", F.lit("{}").alias("md"))
    return post.unionByName(text).unionByName(image).orderBy("ts", "url")


def block_items(posts: DataFrame) -> DataFrame:
    """(url, parent_url, otype, name): users, their posts, and a row per block (image, video with poster, text, link)
    of posts with url, blog and blocks array<struct<type,url,text,poster>>; one row per url."""
    user = posts.select(F.col("blog").alias("url"), F.lit(None).cast("string").alias("parent_url"), F.lit("user").alias("otype"), F.col("blog").alias("name"))
    post = posts.select("url", F.col("blog").alias("parent_url"), F.lit("post").alias("otype"), F.lit(None).cast("string").alias("name"))
    b = posts.select(F.col("url").alias("post"), F.posexplode("blocks").alias("i", "b"))
    block = b.select(F.coalesce("b.url", F.concat("post", F.lit("#"), "i")).alias("url"), F.col("post").alias("parent_url"), F.col("b.type").alias("otype"), F.col("b.text").alias("name"))
    poster = b.where("b.poster IS NOT NULL").select(F.col("b.poster").alias("url"), F.col("post").alias("parent_url"), F.lit("image").alias("otype"), F.lit(None).cast("string").alias("name"))
    every = user.union(post).union(block).union(poster)
    return every.groupBy("url").agg(F.min(F.struct("otype", "parent_url", "name")).alias("r")).select("url", "r.parent_url", "r.otype", "r.name")


def diary(spark: SparkSession, paths: list[str], reviews: list[str]) -> DataFrame:
    """(date, name, year, rating, rewatch, tags, review): diary files, missing ones ignored, with reviews merged in by
    (date, name), full outer."""

    def rows(files: list[str], review: bool) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "name", "year", "rating", "rewatch", "tags", "review")])
        out = spark.createDataFrame([], schema)
        for f in files:
            try:
                raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            got = {c.lower(): c for c in raw.columns}
            out = out.union(raw.select(*[F.col(f"`{got[n]}`").alias(n) if n in got else F.lit(None).cast("string").alias(n) for n in schema.names]))
        first = out.groupBy("date", "name").agg(F.min(F.struct("year", "rating", "rewatch", "tags", "review")).alias("r"))
        return first.select("date", "name", *([F.col("r").alias("b")] if review else [F.col("r").alias("a")]))

    both = rows(paths, False).join(rows(reviews, True), ["date", "name"], "full")
    pick = lambda n: F.coalesce(F.col(f"a.{n}"), F.col(f"b.{n}"))
    return both.select(
        F.col("date").try_cast("date").alias("date"), "name", pick("year").try_cast("int").alias("year"), pick("rating").try_cast("double").alias("rating"),
        (F.lower(pick("rewatch")) == "yes").alias("rewatch"), F.filter(F.split(F.coalesce(pick("tags"), F.lit("")), r",\s*"), lambda x: x != "").alias("tags"), F.col("b.review").alias("review"),
    )


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, name) of the nodes of a GraphML file, through its key declarations."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    keys = raw.select("v", F.map_from_entries(F.transform(F.regexp_extract_all("v", F.lit(r"<key [^>]*>"), F.lit(0)), lambda k: F.struct(F.regexp_extract(k, r'attr\.name="([^"]*)"', 1), F.regexp_extract(k, r'id="([^"]*)"', 1)))).alias("keys"))
    nodes = keys.select("keys", F.explode(F.regexp_extract_all("v", F.lit(r"(?s)<node [^>]*?(?:/>|>.*?</node>)"), F.lit(0))).alias("n"))
    data = F.map_from_entries(F.transform(F.regexp_extract_all("n", F.lit(r"(?s)<data [^>]*>.*?</data>"), F.lit(0)), lambda d: F.struct(F.regexp_extract(d, r'key="([^"]*)"', 1), F.regexp_extract(d, r"(?s)>(.*?)</data>", 1))))
    got = nodes.select(F.regexp_extract("n", r'id="([^"]*)"', 1).alias("id"), "keys", data.alias("d"))
    value = lambda name: F.try_element_at(F.col("d"), F.coalesce(F.try_element_at(F.col("keys"), F.lit(name)), F.lit("")))
    return got.select("id", value("type").alias("type"), value("name").alias("name"))


def sql_log(spark: SparkSession, path: str) -> DataFrame:
    """(query, seconds) of log lines '<seconds> <query>'; literals become ?, so that like queries group."""
    c = F.col("value")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"^\s*[\d.]+\s+(.*)$", 1), r"'[^']*'", "?"), r"\b\d+(\.\d+)?\b", "?")
    return spark.read.text(path).select(query.alias("query"), F.regexp_extract(c, r"^\s*([\d.]+)\s", 1).try_cast("double").alias("seconds")).where("seconds IS NOT NULL")


def log_summary(log: DataFrame) -> DataFrame:
    """(query, n, total, mean, most) by falling total."""
    return log.groupBy("query").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most")).orderBy(F.col("total").desc(), "query")


def blocks(c: Column) -> Column:
    """A text of blocks 'N' and N lines, as an array of arrays of lines; cut where a count is no number."""
    lines = F.split(c, "\n")
    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit(0).alias("left"), F.lit(True).alias("ok"))

    def step(a: Column, line: Column) -> Column:
        n = F.trim(line).try_cast("int")
        start = F.struct(F.concat(a["out"], F.array(F.array().cast("array<string>"))).alias("out"), F.coalesce(n, F.lit(0)).alias("left"), n.isNotNull().alias("ok"))
        last = F.concat(F.element_at(a["out"], -1), F.array(line))
        more = F.struct(F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(last)).alias("out"), (a["left"] - 1).alias("left"), a["ok"].alias("ok"))
        return F.when(~a["ok"], a).when(a["left"] > 0, more).otherwise(F.when(n.isNotNull(), start).otherwise(F.struct(a["out"].alias("out"), F.lit(0).alias("left"), F.lit(False).alias("ok"))))

    return F.aggregate(lines, zero, step)["out"]


def tagged(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """df with tags: the parts of a column, lower case, trimmed, distinct."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), sep), lambda x: F.lower(F.trim(x)))
    return df.withColumn("tags", F.array_distinct(F.filter(parts, lambda x: x != "")))


def named_fields(c: Column) -> Column:
    """[{id, value}, ...] as a map from id to value."""
    return F.map_from_entries(F.transform(c, lambda x: F.struct(x["id"], x["value"])))


def listed_fields(m: Column) -> Column:
    """A map from id to value as [{id, value}, ...] by id."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("value")))


def foreign_ids(df: DataFrame, column: str, target: DataFrame, name: str, ident: str) -> DataFrame:
    """df with an array column of names replaced by the ids of the rows they name, in order; unknown names go.
    Every distinct list is looked up once, so nothing depends on the order of rows."""
    lists = df.select(F.col(column).alias("list_")).where("list_ IS NOT NULL").distinct()
    each = lists.select("list_", F.posexplode("list_").alias("pos_", "name_")).join(target.select(F.col(name).alias("name_"), F.col(ident).alias("id_")), "name_")
    ids = each.groupBy("list_").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_", "id_"))), lambda x: x["id_"]).alias("ids_"))
    return df.join(ids, F.col(column) == F.col("list_"), "left").withColumn(column, F.col("ids_")).drop("list_", "ids_")
