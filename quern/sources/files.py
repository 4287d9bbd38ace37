"""Sources and sinks: delimited text, JSON, calendars, sensor files, fixed-width records, keyed vector stores."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import specialize
from ..operators import sampling


def sniff(lines: list[str]) -> str:
    """The delimiter that cuts header and first row into about as many parts: tab, comma, space, in this order."""
    head = next((x.lstrip("#").strip() for x in lines if x.startswith("#")), lines[0] if lines else "")
    body = next((x for x in lines if not x.startswith("#") and x != head), head)
    for d in "\t, ":
        h, c = len(head.split(d)), len(body.split(d))
        if 1 < c <= h <= c + 1:
            return d
    return "\t"


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Text columns of a file whose last # line, or first line, names them; other # lines are comments."""
    raw = spark.read.text(path)
    first = [r[0] for r in raw.limit(50).collect()]
    marked = [x for x in first if x.startswith("#")]
    sep = sep or sniff(first)
    head = marked[-1] if marked else (first[0] if first else "")
    names = [n.strip() for n in head.lstrip("#").strip().split(sep)]
    rows = raw.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.col("value") != head))
    parts = F.split("value", re.escape(sep))
    return rows.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def specialized(df: DataFrame) -> DataFrame:
    """Text columns as structs of what each cell is: bool, int, float or text."""
    return df.select(*[specialize(F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Named log events with their time; rows without a name are dropped."""
    raw = spark.read.text(path).select(F.col("value").alias("body"))
    get = lambda k: F.get_json_object("body", f"$.{k}")
    return raw.select(get("_name").alias("name"), get("_ts").try_cast("double").alias("ts"), get("_copy_of").try_cast("double").alias("copy_of"), "body").where("name IS NOT NULL")


def resolve_copies(events: DataFrame) -> DataFrame:
    """Events with the body of the original that a copy points to."""
    o = events.where("copy_of IS NULL").groupBy(F.col("ts").alias("copy_of")).agg(F.min("body").alias("original"))
    return events.join(o, "copy_of", "left").withColumn("body", F.coalesce("original", "body")).select(*events.columns)


def json_to_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects: columns by falling frequency, then name; keys that start with http are dropped."""
    df = spark.read.option("multiLine", True).json(path)
    keep = [c for c in df.columns if not c.startswith("http")]
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in keep]).first()
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(keep, key=lambda c: (-n[c], c))])


def sensor_files(spark: SparkSession, path: str) -> DataFrame:
    """(ts, co2, temp, humidity, pressure): readings of overlapping exports; the last file by name wins per time."""
    raw = spark.read.option("header", True).csv(path).withColumn("file", F.input_file_name())
    pick = lambda *names: F.coalesce(*[F.col(f"`{c}`") for c in raw.columns if any(c.startswith(n) for n in names)] or [F.lit(None)])
    ts = F.unix_timestamp(F.coalesce(F.try_to_timestamp(pick("Time"), F.lit("dd/MM/yyyy H:mm:ss")), F.try_to_timestamp(pick("Time"), F.lit("yyyy-MM-dd HH:mm:ss"))))
    num = lambda *n: F.nullif(F.trim(pick(*n)), F.lit("")).try_cast("double")
    rows = raw.select("file", ts.alias("ts"), num("Carbon dioxide").cast("int").alias("co2"), num("Temperature").alias("temp"), num("Relative humidity").alias("humidity"), num("Atmospheric pressure").alias("pressure")).where("ts IS NOT NULL")
    last = rows.groupBy("ts").agg(F.max(F.struct("file", "co2", "temp", "humidity", "pressure")).alias("r"))
    return last.select("ts", "r.co2", "r.temp", "r.humidity", "r.pressure")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(uid, summary, start, end): events of iCalendar files that are not cancelled."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n[ \t]", "").alias("v"))
    event = text.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("e"))
    line = lambda k: F.regexp_extract("e", rf"(?m)^{k}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    when = lambda k: F.coalesce(F.try_to_timestamp(F.regexp_replace(line(k), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(line(k), F.lit("yyyyMMdd")))
    return event.where(line("STATUS") != "CANCELLED").select(line("UID").alias("uid"), line("SUMMARY").alias("summary"), when("DTSTART").alias("start"), when("DTEND").alias("end"))


def merged_diary(diary: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Diary rows and reviews in one table, full outer on the key."""
    return diary.join(reviews, keys, "full")


def records(spark: SparkSession, path: str, fmt: str, names: list[str]) -> DataFrame:
    """Fixed-width binary records by a struct format; whole records only."""
    size = struct.calcsize(fmt)
    kinds = {"b": "int", "B": "int", "h": "int", "H": "int", "i": "int", "I": "long", "q": "long", "Q": "long", "l": "long", "L": "long", "f": "double", "d": "double"}
    schema = ", ".join(f"`{n}` {kinds[c]}" for n, c in zip(names, re.sub(r"[<>=!@\s]", "", fmt)))
    raw = spark.read.format("binaryFile").load(path).select("content")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                yield pd.DataFrame(list(struct.iter_unpack(fmt, data[: len(data) // size * size])), columns=names)

    return raw.mapInPandas(parse, schema)


def matrix(spark: SparkSession, path: str, columns: int, kind: str = "<f8", missing: float | None = None) -> DataFrame:
    """(row, v): rows of a flat binary matrix; a marker value stands for null."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                m = np.frombuffer(data, kind).reshape(-1, columns).astype(float)
                rows = [[None if missing is not None and x == missing else float(x) for x in r] for r in m]
                yield pd.DataFrame({"row": range(len(rows)), "v": rows})

    return raw.mapInPandas(parse, "row long, v array<double>")


def keyed(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a store by key; unknown keys give nothing."""
    return store.join(keys.select(key).distinct(), key, "left_semi")


def looked_up(df: DataFrame, name: str, how: str, value: str) -> DataFrame:
    """Rows by a match of their name: exact, prefix, regexp or contains."""
    c = F.col(name)
    hit: Column = {"exact": c == value, "prefix": c.startswith(value), "regexp": c.rlike(value), "contains": F.contains(c, F.lit(value))}[how]
    return df.where(hit)


def paged(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next page by key: seek instead of offset, so late pages cost no more than early ones."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def metadata_merged(stored: DataFrame, fresh: DataFrame, key: str = "key", md: str = "md") -> DataFrame:
    """Map columns merged per key, new values win."""
    f = fresh.select(key, F.col(md).alias("new_"))
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(F.col(md), empty), F.coalesce(F.col("new_"), empty)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return stored.join(f, key, "full").select(key, F.map_concat(kept, b).alias(md))


def surrogate_ids(df: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """(key, id): stored ids, and the next numbers for new keys in key order, null first.

    Keys are numbered inside ranges between a few of them; the sizes of the ranges, added up, give each its start.
    """
    new = df.select(key).distinct().join(stored, key, "left_anti")
    part = F.lit(0)
    for (cut,) in sampling.at_most(new.where(F.col(key).isNotNull()), 63, key).collect():
        part = part + (F.col(key) > F.lit(cut)).cast("int")
    placed = new.select(key, F.coalesce(part, F.lit(0)).alias("part_"))
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))
    local = F.row_number().over(W.partitionBy("part_").orderBy(key))
    numbered = placed.withColumn("local_", local).join(F.broadcast(starts), "part_").crossJoin(F.broadcast(top))
    return stored.select(key, "id").unionByName(numbered.select(key, (F.col("local_") + F.col("start_") + F.col("top_")).alias("id")))
