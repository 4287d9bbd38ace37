"""Differences, duplicates, upserts and event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listing_diff(old: DataFrame, new: DataFrame, key: str = "key", digest: str = "hash") -> DataFrame:
    """(kind, a, b): how the old listing becomes the new one.

    A new key with unknown content is an add; with known content it is a copy, or a move if the old key is gone and it
    is the first by key to take that content. An old key whose content nobody moved away is a delete. A key whose
    content changes is a delete and an add or copy.
    """
    o = old.select(F.col(key).alias("k"), F.col(digest).alias("h"))
    n = new.select(F.col(key).alias("k"), F.col(digest).alias("h"))
    added, gone = n.join(o, ["k", "h"], "left_anti"), o.join(n, ["k", "h"], "left_anti")
    sources = o.groupBy("h").agg(F.min("k").alias("first"))
    free = gone.withColumn("i", F.row_number().over(W.partitionBy("h").orderBy("k")))
    want = added.withColumn("i", F.row_number().over(W.partitionBy("h").orderBy("k")))
    moves = want.alias("w").join(free.alias("f"), ["h", "i"]).select("h", F.col("f.k").alias("a"), F.col("w.k").alias("b"))
    rest = want.select("k", "h").join(moves.select(F.col("b").alias("k"), "h"), ["k", "h"], "left_anti")
    other = rest.join(sources, "h", "left").select(F.when(F.col("first").isNull(), "add").otherwise("copy").alias("kind"), F.col("first").alias("a"), F.col("k").alias("b"))
    deleted = gone.join(moves.select(F.col("a").alias("k"), "h"), ["k", "h"], "left_anti").select(F.lit("delete").alias("kind"), F.col("k").alias("a"), F.lit(None).cast("string").alias("b"))
    return moves.select(F.lit("move").alias("kind"), "a", "b").union(other).union(deleted)


def applied(old: DataFrame, diff: DataFrame, new: DataFrame, key: str = "key", digest: str = "hash") -> DataFrame:
    """The listing after a diff: what stays, plus what its targets hold in the new listing."""
    removed = diff.where("kind IN ('move', 'delete')").select(F.col("a").alias(key))
    targets = diff.where("b IS NOT NULL").select(F.col("b").alias(key))
    kept = old.join(removed, key, "left_anti").join(targets, key, "left_anti")
    return kept.select(key, digest).union(new.join(targets, key, "left_semi").select(key, digest))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order: an order-preserving distinct."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def insert_if_absent(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those fresh rows whose key it lacks; of fresh rows with one key the smallest stays."""
    rest = [c for c in stored.columns if c not in keys]
    new = fresh.join(stored.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r_")).select(*keys, *[F.col(f"r_.{c}").alias(c) for c in rest])
    return stored.unionByName(new)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with fresh rows in place of those with their key; null fields of fresh rows keep what was stored.
    Fresh keys must be unique."""
    f = fresh.alias("f")
    s = stored.alias("s")
    on = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys]
    cols = [F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}")).alias(c) if c in fresh.columns else F.col(f"s.{c}") for c in stored.columns]
    return s.join(f, on, "full").select(*cols)


def toggles(events: DataFrame, by: list[str], order: list[str], kind: str, pairs: dict[str, str]) -> DataFrame:
    """(by, state): the last event per key decides; `pairs` maps an undoing kind to the one it undoes.

    The state is the last kind unless that one undoes, then null; a later do replaces an earlier one.
    """
    last = events.groupBy(*by).agg(F.max(F.struct(*order, kind)).alias("m"))
    return last.select(*by, F.when(~F.col(f"m.{kind}").isin(*pairs), F.col(f"m.{kind}")).alias("state"))


def counter_since(events: DataFrame, by: list[str], order: str, kind: str, add: str, reset: str) -> DataFrame:
    """(by, n): how many `add` events follow the last `reset`."""
    w = W.partitionBy(*by)
    cut = F.max(F.when(F.col(kind) == reset, F.col(order))).over(w)
    return events.withColumn("cut_", cut).where(F.col(kind) == add).where("cut_ IS NULL OR " + order + " > cut_").groupBy(*by).agg(F.count("*").alias("n"))


def accumulated(stored: DataFrame, steps: DataFrame, key: str, value: str) -> DataFrame:
    """stored totals plus the positive steps per key; keys that are not stored are skipped."""
    add = steps.where(F.col(value) > 0).groupBy(key).agg(F.sum(value).alias("add_"))
    return stored.join(add, key, "left").withColumn(value, F.col(value) + F.coalesce("add_", F.lit(0))).drop("add_")


def reconciled(items: DataFrame, key: str, flag: str, present: DataFrame) -> DataFrame:
    """items with the flag set where the other store has the key and cleared where it has not; set flags stay."""
    have = present.select(F.col(key)).distinct().withColumn("have_", F.lit(True))
    return items.join(have, key, "left").withColumn(flag, F.when(F.col("have_"), F.coalesce(F.col(flag), F.lit(1.0)))).drop("have_")
