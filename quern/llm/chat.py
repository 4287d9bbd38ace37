"""Chat formatting: logged snapshots that begin a longer conversation collapse into it; the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n, h1, h2, turns): each turn with the rolling 128-bit hash of the turns up to it.

    A turn's two 64-bit digests cover its place, role and text; the prefix hash is their running XOR, so one window in
    the conversation's order gives every prefix.
    """
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv IS NOT NULL").distinct()
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = own.withColumn("n", F.row_number().over(order))
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blank = [F.col("role").isNull(), F.col("text").isNull()]
    d1 = F.xxhash64("n", "role", "text", *blank)
    d2 = F.xxhash64(F.lit(0x5851F42D4C957F2D), "text", "n", "role", *blank)
    return numbered.withColumn("h1", F.bit_xor(d1).over(sofar)).withColumn("h2", F.bit_xor(d2).over(sofar)).withColumn("turns", F.count("*").over(whole).cast("int"))


def maximal(turns: DataFrame, **columns) -> DataFrame:
    """The turns, with n and turns, of the conversations that are no prefix of a longer one; of equal ones the
    smallest id stays.

    Whole-conversation hashes meet the proper-prefix hashes of the same length in an anti-join; the prefixes are made
    distinct first, so a first turn that a third of all conversations share is one row a task.
    """
    p = prefixes(turns, **columns)
    ends = p.where("n = turns").groupBy("turns", "h1", "h2").agg(F.min("conv").alias("conv"))
    inner = p.where("n < turns").select(F.col("n").cast("int").alias("turns"), "h1", "h2").distinct()
    kept = ends.join(inner, ["turns", "h1", "h2"], "left_anti").select("conv")
    return p.select("conv", "turn", "role", "text", "n", "turns").join(kept, "conv")


def chats(turns: DataFrame, start: str = "<|im_start|>", stop: str = "<|im_end|>", conv: str = "conv_id", **columns) -> DataFrame:
    """(conv, n_turns, chat): each maximal conversation rendered, turn by turn, as start role NL text stop NL.

    Turns stand in order of (turn, role, text), nulls first; exact repeats of a row count once; a null role or text
    renders as empty but differs from an empty one in comparison. Rows without a conversation id belong to none and
    are left out. An empty table gives no rows.
    """
    kept = maximal(turns, conv=conv, **columns)
    one = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(stop + "\n"))
    rows = kept.groupBy("conv").agg(F.first("turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("n", one.alias("s")))).alias("a"))
    return rows.select(F.col("conv").alias(conv), "n_turns", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("chat"))
