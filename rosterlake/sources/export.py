"""Layers written out as CSV with their row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rosterlake.operators.scale import shuffled


def staging_layer(staging: DataFrame, batches: DataFrame, issues: DataFrame) -> DataFrame:
    """Source rows with all their issues in one text."""
    texts = issues.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("issues"))
    return staging.join(batches.select("batch_id", "file_name"), "batch_id").join(shuffled(texts), "row_id", "left").select(
        "row_id", "file_name", "row_number", F.to_json("raw").alias("raw"), "issues").orderBy("row_id")


def account_layer(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """Accounts with the creator they belong to."""
    return accounts.join(shuffled(links), "account_id", "left").orderBy("platform", F.desc_nulls_last("followers"), "account_id")


def creator_layer(creators: DataFrame, links: DataFrame) -> DataFrame:
    """Creators with their accounts in one text."""
    own = links.groupBy("creator_id").agg(F.array_join(F.array_sort(F.collect_list("account_id")), " | ").alias("accounts"))
    return creators.join(shuffled(own), "creator_id", "left").orderBy(F.desc("total_followers"), "creator_id")


def rejected_layer(issues: DataFrame, staging: DataFrame) -> DataFrame:
    """Rejected rows with their reason (A9d)."""
    return issues.where(F.col("severity") == "rejected").select("row_id", "issue").join(
        shuffled(staging.select("row_id", F.to_json("raw").alias("raw"))), "row_id")


def review_layer(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pairs with both names (A9e)."""
    a = accounts.select(F.col("account_id").alias("account_a"), F.col("name_clean").alias("name_a"))
    b = accounts.select(F.col("account_id").alias("account_b"), F.col("name_clean").alias("name_b"))
    return candidates.join(shuffled(a), "account_a").join(shuffled(b), "account_b").select(
        "status", "kind", "score", "name_a", "account_a", "name_b", "account_b", F.to_json("reasons").alias("reasons"),
        "decided_by", "decided_at").orderBy("status", F.desc("score"), "account_a", "account_b")


def snapshot_layer(snapshots: DataFrame) -> DataFrame:
    """Observations by account and time (A9f)."""
    return snapshots.orderBy("account_id", "fetched_at", "staging_row_id")


def as_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_layers(layers: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write every layer and return its row count, counted while writing. The first header cell starts with a
    byte-order mark, so spreadsheet programs read the text as UTF-8."""
    counts = {}
    for name, df in layers.items():
        seen = Observation(name)
        flat = as_text(df)
        marked = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
        marked.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").csv(
            f"{folder}/{name}", header=True, quote='"', escape='"')
        counts[name] = seen.get["rows"]
    return counts
