"""Keyed stores on Parquet: vectors and JSON with metadata, labelled matrices, atomic JSON files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import metadata_merged


@dataclass
class Store:
    """Rows (key, value, md) under a path. Each write makes a new version in full, and then a pointer to it under the next
    number; readers follow the highest, so there is no moment without a version, and a failed write changes nothing.
    Of two writers at once one fails. The pointer before stays for those who have just read it."""

    spark: SparkSession
    path: str
    value: str = "string"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def read(self) -> DataFrame:
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], f"key string, value {self.value}, md map<string,string>")
        version = self.spark.read.text(f"{self.path}/current-{numbers[-1]}").first()[0]
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, rows: DataFrame) -> None:
        numbers, version = self._numbers(), "v" + uuid.uuid4().hex
        rows.select("key", "value", "md").write.parquet(f"{self.path}/{version}")
        new, fs = self._fs(f"{self.path}/next-{version}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/current-{numbers[-1] + 1 if numbers else 1}")
        if fs.exists(to) or not fs.rename(new, to):
            raise RuntimeError(f"another writer has made {to}")
        for n in numbers[:-1]:
            fs.delete(self._fs(f"{self.path}/current-{n}")[0], False)

    def set(self, rows: DataFrame) -> None:
        """Stores (key, value[, md]) rows; known keys keep their metadata unless new ones come along."""
        rows = rows if "md" in rows.columns else rows.withColumn("md", F.lit(None).cast("map<string,string>"))
        old, new = self.read(), rows.groupBy("key").agg(F.max_by(F.struct("value", "md"), F.struct("value", F.to_json("md"))).alias("r")).select("key", "r.value", "r.md")
        both = old.alias("o").join(new.alias("n"), "key", "full")
        fresh = F.col("n.value").isNotNull()
        self.write(both.select("key", F.when(fresh, F.col("n.value")).otherwise(F.col("o.value")).alias("value"), F.coalesce("n.md", "o.md").alias("md")))

    def delete(self, keys: DataFrame) -> None:
        self.write(self.read().join(keys.select("key"), "key", "left_anti"))

    def merge_md(self, md: DataFrame) -> None:
        """Merges (key, md) maps into known keys, new values win."""
        known = self.read()
        merged = metadata_merged(known.select("key", "md"), md.join(known.select("key"), "key", "left_semi"))
        self.write(known.select("key", "value").join(merged, "key"))

    def replace_md(self, md: DataFrame) -> None:
        known = self.read()
        new = md.select("key", F.col("md").alias("new_"))
        self.write(known.join(new, "key", "left").select("key", "value", F.coalesce("new_", "md").alias("md")))

    def get(self, keys: list[str]) -> DataFrame:
        return self.read().where(F.col("key").isin(keys))

    def absent(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.read().select("key"), "key", "left_anti")


def inner_concatenated(stores: list[DataFrame]) -> DataFrame:
    """(key, value): vectors of the keys that all stores hold, one after the other."""
    from ..operators.vectors import concatenated

    return concatenated(stores, "key", "value")


def widened(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with columns it lacks, null."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns])


def extended(matrix: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """matrix with null rows for the keys it lacks."""
    new = keys.select(key).distinct().join(matrix.select(key), key, "left_anti")
    return matrix.unionByName(new, allowMissingColumns=True)


def dense_rows(matrix: DataFrame, keys: list[str], key: str, vector: str, missing: float) -> DataFrame:
    """(place, vector): the rows of the keys in their order; a marker stands for null components and absent rows."""
    width = matrix.select(F.max(F.size(vector))).first()[0] or 0
    order = matrix.sparkSession.createDataFrame(list(enumerate(keys)), f"place int, {key} string")
    filled = F.transform(F.col(vector), lambda x: F.coalesce(x, F.lit(missing)))
    return order.join(matrix.select(F.col(key).cast("string").alias(key), vector), key, "left").select("place", F.coalesce(filled, F.array_repeat(F.lit(missing), width)).alias(vector)).orderBy("place")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, all or nothing."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pretty(df: DataFrame) -> DataFrame:
    """(json): rows as indented JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))
