"""API answers landed as JSON text, flattened into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.latest import latest_per_key

CHANNELS = """items array<struct<id string,
  snippet struct<title string, description string, customUrl string, country string, publishedAt string,
    thumbnails struct<medium struct<url string>, default struct<url string>>>,
  statistics struct<subscriberCount string, viewCount string, videoCount string, hiddenSubscriberCount boolean>,
  contentDetails struct<relatedPlaylists struct<uploads string>>,
  topicDetails struct<topicCategories array<string>>,
  brandingSettings struct<channel struct<keywords string>>>>"""
VIDEOS = """items array<struct<id string, snippet struct<title string, publishedAt string>,
  contentDetails struct<duration string>, statistics struct<viewCount string, likeCount string, commentCount string>>>"""
IDS = "items array<struct<id string>>"


def _number(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).try_cast("bigint")


def channels(answers: DataFrame) -> DataFrame:
    """Channel table from landed answers (``body``, ``fetched_at``); the newest answer per channel counts (A10)."""
    items = answers.select("fetched_at", F.explode(F.from_json("body", CHANNELS)["items"]).alias("i"))
    flat = items.select(
        F.col("i.id").alias("channel_id"), "i.snippet.title", "i.snippet.description", F.col("i.snippet.customUrl").alias("custom_url"),
        "i.snippet.country", F.col("i.snippet.publishedAt").try_cast("timestamp").alias("published_at"),
        F.coalesce("i.snippet.thumbnails.medium.url", "i.snippet.thumbnails.default.url").alias("thumbnail_url"),
        F.col("i.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist"),
        F.coalesce("i.topicDetails.topicCategories", F.array().cast("array<string>")).alias("topic_categories"),
        F.col("i.brandingSettings.channel.keywords").alias("keywords"),
        F.coalesce("i.statistics.hiddenSubscriberCount", F.lit(False)).alias("subscribers_hidden"),
        _number("i.statistics.subscriberCount").alias("subscribers"), _number("i.statistics.viewCount").alias("total_views"),
        _number("i.statistics.videoCount").alias("media_count"), "fetched_at")
    return latest_per_key(flat, ["channel_id"], ["fetched_at"])


def videos(answers: DataFrame) -> DataFrame:
    """Video table from landed answers (``channel_id``, ``body``, ``fetched_at``)."""
    items = answers.select("channel_id", "fetched_at", F.explode(F.from_json("body", VIDEOS)["items"]).alias("i"))
    flat = items.select(
        F.col("i.id").alias("video_id"), "channel_id", "i.snippet.title",
        F.col("i.snippet.publishedAt").try_cast("timestamp").alias("published_at"), "i.contentDetails.duration",
        _number("i.statistics.viewCount").alias("views"), _number("i.statistics.likeCount").alias("likes"),
        _number("i.statistics.commentCount").alias("comments"), "fetched_at")
    return latest_per_key(flat, ["video_id"], ["fetched_at"])


def resolutions(answers: DataFrame) -> DataFrame:
    """Handle or username to channel id, from landed answers (``kind``, ``value``, ``body``, ``fetched_at``)."""
    first = F.try_element_at(F.from_json("body", IDS)["items"], F.lit(1))["id"]
    flat = answers.select(F.concat_ws(":", "kind", F.lower("value")).alias("input_key"), first.alias("channel_id"),
                          F.when(first.isNotNull(), "resolved").otherwise("not_found").alias("status"),
                          F.col("fetched_at").alias("resolved_at"))
    return latest_per_key(flat, ["input_key"], ["resolved_at"])


def api_snapshots(channel_table: DataFrame, metrics: DataFrame, accounts: DataFrame) -> DataFrame:
    """One observation per answered channel; a hidden audience is unknown."""
    owner = accounts.where(F.col("channel_id").isNotNull()).select("account_id", "channel_id")
    return (channel_table.join(owner, "channel_id").join(metrics, "channel_id", "left").select(
        "account_id", "fetched_at", F.lit("youtube_api").alias("source"),
        F.when(~F.col("subscribers_hidden"), F.col("subscribers")).alias("followers"), "er_pct",
        F.col("avg_views").cast("double").alias("avg_views"), "avg_likes", "avg_comments", "total_views", "media_count",
        # answers carry no import; they sort after the import of the same moment
        F.lit((1 << 62)).cast("bigint").alias("batch_id"), F.lit(None).cast("bigint").alias("staging_row_id")))
