"""The corpus pipeline: ``run(spark, sf_dir)`` applies ``STAGES`` to the documents one after another.

Each stage takes the documents the stage before kept and is written before the next one reads it. Stages return the columns
of ``documents``, the last one a row of tokens for each document that is left. Of a group of near-duplicates the document
with the smallest id stays. Documents that line dedup empties stay as empty ones, near-dups of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from rosterlake.llm.common import stored, table
from rosterlake.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; learnt from the labelled ones among them."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur across them, ``n_chars`` counted again."""
    ship(spark)
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    ship(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed as little-endian unsigned 32-bit integers, and what they decode to."""
    ship(spark)
    tokens = bpe.encode(docs, out="tokens")
    return tokens.select("doc_id", "lang", "source", "n_chars", "tokens.n_tokens", "tokens.ids", "tokens.decoded")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_recurring_lines), ("near-dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("bpe", encode)]
#: no SQL for a trained model, a template tree, connected groups or a tokenizer; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
