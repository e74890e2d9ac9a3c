"""Enrichment from landed API payloads: metadata folded into accounts, plans and quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names, topics
from rosterlake.operators.scale import sparse_join, top_per_group

RECENT_VIDEOS = 10
MIN_VIDEO_HOURS = 48


def video_metrics(videos: DataFrame, as_of: Column, key: str = "channel_id") -> DataFrame:
    """Means over each channel's newest videos that are older than two days and have views (K1)."""
    recent = top_per_group(videos, [key], [F.desc_nulls_last("published_at"), F.col("video_id")], RECENT_VIDEOS)
    mature = recent.where((F.col("views") > 0) & (F.col("published_at") < as_of - F.expr(f"INTERVAL {MIN_VIDEO_HOURS} HOURS")))
    means = mature.groupBy(key).agg(F.avg("views").alias("_views"), F.avg("likes").alias("avg_likes"),
                                    F.avg("comments").alias("avg_comments"), F.count(F.lit(1)).alias("videos_used"))
    rate = 100 * (F.col("avg_likes") + F.coalesce("avg_comments", F.lit(0.0))) / F.col("_views")
    return means.select(key, F.bround("_views", 0).cast("bigint").alias("avg_views"), "avg_likes", "avg_comments",
                        F.bround(rate, 3).alias("er_pct"), "videos_used")


def fold_channels(accounts: DataFrame, channels: DataFrame) -> DataFrame:
    """Fold channel metadata into accounts: new categories, missing country and handle."""
    side = channels.select("channel_id", topics.channel_categories(F.col("topic_categories")).alias("_cats"),
                           F.col("country").alias("_country"),
                           F.nullif(F.lower(F.ltrim("custom_url", F.lit("@"))), F.lit("")).alias("_handle"),
                           F.lit(True).alias("_hit"))
    joined = sparse_join(accounts, side, "channel_id", "account_id")
    new = F.array_except(F.col("_cats"), F.col("categories"))
    grown = F.coalesce(F.size(new) > 0, F.lit(False))
    hit = F.coalesce("_hit", F.lit(False))
    handle = F.when(hit, F.coalesce(F.nullif(F.col("handle"), F.lit("")), F.col("_handle"))).otherwise(F.col("handle"))
    swaps = {
        "categories": F.when(grown, F.concat("categories", new)).otherwise(F.col("categories")),
        "flags": F.when(grown, F.array_sort(F.array_distinct(F.array_append("flags", "categories_added_from_youtube"))))
                  .otherwise(F.col("flags")),
        "country": F.coalesce("country", "_country"), "handle": handle,
        "handle_core": F.when(hit, names.handle_core(handle)).otherwise(F.col("handle_core"))}
    return joined.select(*[swaps[c].alias(c) if c in swaps else F.col(c) for c in accounts.columns])


def flag_missing_channels(accounts: DataFrame, asked: DataFrame, channels: DataFrame) -> DataFrame:
    """Flag accounts whose channel was asked for but not answered."""
    missing = asked.select("channel_id").distinct().join(channels.select("channel_id"), "channel_id", "left_anti").withColumn(
        "_missing", F.lit(True))
    joined = sparse_join(accounts, missing, "channel_id", "account_id")
    flags = F.when(F.col("_missing"), F.array_append("flags", "yt_channel_not_found")).otherwise(F.col("flags"))
    return joined.select(*[flags.alias(c) if c == "flags" else F.col(c) for c in accounts.columns])


def to_resolve(accounts: DataFrame) -> DataFrame:
    """Provisional handles and usernames that need a channel id."""
    key = F.col("platform_key")
    return accounts.where((F.col("platform") == "youtube") & F.col("channel_id").isNull()
                          & (key.startswith("@") | key.startswith("user:"))).select("account_id", "platform_key")


def to_refresh(accounts: DataFrame, as_of: Column, stale_days: float | None = None, limit: int | None = None) -> DataFrame:
    """Channels to fetch: never fetched first, then oldest, then biggest."""
    due = accounts.where((F.col("platform") == "youtube") & F.col("channel_id").isNotNull())
    fetched = F.coalesce(F.col("stats_source") == "youtube_api", F.lit(False))
    if stale_days is not None:
        cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_days * 86400.0))
        due = due.where((F.col("stats_source") != "youtube_api") | (F.col("stats_as_of") < cutoff))
    ordered = due.orderBy(fetched, F.asc_nulls_first("stats_as_of"), F.desc_nulls_last("followers"), "account_id")
    return (ordered.limit(limit) if limit else ordered).select("account_id", "channel_id")


def estimated_units(handles: DataFrame, channels: DataFrame, include_videos: bool = True) -> DataFrame:
    """Quota units an enrichment run would use."""
    n = F.col("n_channels")
    counted = (handles.select(F.lit(1).alias("h"), F.lit(0).alias("c"))
               .unionByName(channels.select(F.lit(0).alias("h"), F.lit(1).alias("c")))
               .agg(F.coalesce(F.sum("h"), F.lit(0)).alias("n_handles"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_channels")))
    return counted.withColumn("units", (F.col("n_handles") + F.ceil(n / 50) + (2 * n if include_videos else F.lit(0))).cast("bigint"))


def units_per_pacific_day(calls: DataFrame, at: str = "called_at", units: str = "units") -> DataFrame:
    """Quota units by day as the quota counts days, midnight to midnight Pacific."""
    day = F.to_date(F.from_utc_timestamp(F.col(at), "America/Los_Angeles"))
    return calls.groupBy(day.alias("pacific_day")).agg(F.sum(units).alias("units"))
