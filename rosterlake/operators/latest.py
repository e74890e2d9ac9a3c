"""Latest-row logic and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATS = ("followers", "er_pct", "avg_views")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key as one partial aggregate, so a key with very many rows shuffles as one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def current_stats(accounts: DataFrame, snapshots: DataFrame,
                  order: Sequence[str] = ("fetched_at", "batch_id", "staging_row_id")) -> DataFrame:
    """Patch each account with its newest snapshot; a missing figure keeps the account's own."""
    newest = latest_per_key(snapshots.select("account_id", *STATS, "source", *order), ["account_id"], order).select(
        "account_id", *[F.col(c).alias(f"_new_{c}") for c in STATS], F.col("source").alias("stats_source"),
        F.col("fetched_at").alias("stats_as_of"))
    kept = [c for c in accounts.columns if c not in (*STATS, "stats_source", "stats_as_of")]
    return accounts.drop("stats_source", "stats_as_of").join(newest, "account_id", "left").select(
        *kept, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in STATS], "stats_source", "stats_as_of")


def history(df: DataFrame, key: str, at: str, tie: str, measure: str, bucket: str = "hour") -> DataFrame:
    """Observations with the change since the one before, in time order per key.

    Rows meet only inside one (key, time bucket); the value before a bucket comes from the bucket's predecessor among
    one row per bucket. So a key with a third of all rows is spread over as many tasks as it has buckets.
    """
    df = df.withColumn("_bucket", F.date_trunc(bucket, at))
    inside = Window.partitionBy(key, "_bucket").orderBy(at, tie)
    closing = df.groupBy(key, "_bucket").agg(F.max_by(F.struct(F.col(measure).alias("v")), F.struct(at, tie)).alias("_close"))
    before = closing.select(key, "_bucket", F.lag("_close.v").over(
        Window.partitionBy(key).orderBy("_bucket")).alias("_carried"))
    stepped = df.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(measure).over(inside))
    previous = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag"))
    return stepped.join(before, [key, "_bucket"]).withColumn("change", F.col(measure) - previous).drop(
        "_bucket", "_n", "_lag", "_carried")
