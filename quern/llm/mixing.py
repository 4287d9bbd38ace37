"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, fresh

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target, one row per source.

    Sources in code-point order, null last, take the weights in turn and share `share` times all sizes; no target
    exceeds `cap` times its source's size, and what a full source cannot take goes to the others by weight. With
    sources in order of size per weight, the level that fills the first i of them and spreads the rest is highest at
    the true level, so one maximum finds it. The table has a row per source and stays small.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max((F.col("all") - F.col("before")) / F.col("left")).over(every))
        .withColumn("target", F.least("most", F.col("weight") * F.col("level")))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, chunk_bits: int = 10, **how) -> DataFrame:
    """docs with size, source_size, target, copies and taken (the names get underscores where docs has them).

    Within a source, documents stand in order of (size, ident, text hash). A document's expected copies are its
    source's target over its size; their prefix sum is that rate times the rank, so the copies are the integers that
    the sum, shifted by one offset drawn from the seed and the source, crosses at the document. Ordering by size keeps
    the words taken within about one largest document of the target. No document gets over `cap` copies.

    The rank is found in two levels, so no task ever sorts a whole source: a row number inside chunks of 2^chunk_bits
    ids of one (source, size) (rows without an id: of about as many text hashes), and a running total over the table
    of chunk counts. Rows are shuffled once.
    Null text has size 0, a null source is a source of its own, null ids stand last, repeated rows are documents of
    their own (interchangeable, so reruns agree); a source of size 0 takes nothing; an empty table gives no rows.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    size, source_size, target, copies, taken = fresh(docs, *names)
    key, chunk, tie, rank, before, rate, shift = fresh(docs, "key_", "chunk_", "tie_", "rank_", "before_", "rate_", "shift_")
    sized = (
        docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
        .withColumn(chunk, F.coalesce(F.shiftright(F.col(ident).cast("long"), chunk_bits), F.lit(2**62) + F.shiftright(F.xxhash64(F.col(text)), 44)))
        .withColumn(tie, F.xxhash64(F.col(text)))
    )
    own = W.partitionBy(key, size, chunk).orderBy(F.col(ident).asc_nulls_last(), tie)
    ranked = sized.withColumn(rank, F.row_number().over(own).cast("long"))

    counts = sized.groupBy(key, size, chunk).agg(F.count("*").alias("n"), F.first(source, True).alias("source"))
    of_size = counts.groupBy(key, size).agg(F.sum("n").alias("m"), F.first("source", True).alias("source"))
    less = W.partitionBy(key).orderBy(size).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(key, size).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    of_source = of_size.groupBy(key).agg(F.sum(F.col(size) * F.col("m")).alias("source_size"), F.first("source", True).alias("source"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    plan = (
        targets(of_source.select("source", "source_size"), **how)
        .withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn(rate, F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
        .withColumn(shift, offset)
        .select(key, "source_size", "target", rate, shift)
    )
    starts = (
        counts.select(key, size, chunk, F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("a"))
        .join(of_size.select(key, size, F.coalesce(F.sum("m").over(less), F.lit(0)).alias("b")), [key, size])
        .join(plan, key)
        .select(key, size, chunk, (F.col("a") + F.col("b")).alias(before), F.col("source_size").alias(source_size), F.col("target").alias(target), rate, shift)
    )
    at = F.col(before) + F.col(rank)
    crossed = lambda i: F.floor(F.col(rate) * i + F.col(shift))
    whole = how.get("cap", 2.0)
    return (
        ranked.join(starts, [key, size, chunk])
        .withColumn(copies, F.least(crossed(at) - crossed(at - 1), F.lit(int(-(-whole // 1)))).cast("long"))
        .withColumn(taken, F.col(copies) * F.col(size))
        .select(*docs.columns, size, source_size, target, copies, taken)
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with the columns of docs."""
    (copies,) = fresh(docs, "copies")
    (one,) = fresh(docs, "one")
    out = mix(docs, **how).where(F.col(copies) > 0)
    return out.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
