"""A training corpus from raw documents: toxicity, near-duplicates, repeated lines, mixing, packing.

Each stage works on all that its predecessor kept. The first four return the columns of documents; the last returns a
row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, packing, simhash, toxicity
from quern.llm._common import WORD, discard, fresh, table, written
from quern.llm.queries import word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained model scores under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_one(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines and passages of twenty words or more that an earlier one has (shorter lines are mostly
    idiom that clean documents share); a document that loses all of its text goes."""
    gone, _ = fresh(docs, "n_removed", "removed")
    cut = F.coalesce(F.col(gone) > 0, F.lit(False))
    out = line_dedup.line_dedup(docs, least_words=20).where(~cut | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(docs, word_bpe))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_lines),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the toxicity model, the tokenizer or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage has read goes as soon as its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
