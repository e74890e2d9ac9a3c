"""One row per creator with the derived fields used for discovery and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import values
from rosterlake.operators.merge import distinct_items
from rosterlake.operators.scale import exact_medians, shuffled
from rosterlake.session import cut_lineage

LISTS = ("platforms", "categories", "tags", "languages", "brands", "flag_list")
FIRST_KNOWN = {"er": "er_pct", "avg_views": "avg_views", "rate_reel": "rate_reel_inr", "rate_story": "rate_story_inr",
               "rate_video": "rate_video_inr", "city": "city", "state": "state", "region": "region",
               "city_tier": "city_tier", "age": "age", "gender": "gender"}
PRIMARY = {"primary_platform": "platform", "handle": "handle", "profile_url": "profile_url", "followers": "followers",
           "stats_source": "stats_source", "stats_as_of": "stats_as_of"}


def in_batches(links: DataFrame, sources: DataFrame, batch_ids: list[int]) -> DataFrame:
    """Creator links limited to creators that appear in some imports (C11)."""
    touched = sources.where(F.col("batch_id").isin(batch_ids)).select("account_id")
    chosen = links.join(touched, "account_id", "left_semi").select("creator_id")
    return links.join(chosen, "creator_id", "left_semi")


def without(profile: DataFrame, taken: DataFrame) -> DataFrame:
    """Profiles whose id is not taken yet."""
    return profile.join(taken.select("creator_id"), "creator_id", "left_anti")


def build_profiles(accounts: DataFrame, links: DataFrame, creators: DataFrame, sources: DataFrame) -> DataFrame:
    """Creator profiles: the biggest account leads, ties by first appearance in the imports."""
    appeared = sources.groupBy("account_id").agg(F.min("row_id").alias("_first_row"))
    members = (accounts.join(shuffled(links), "account_id").join(shuffled(appeared), "account_id", "left")
               .withColumn("_order", F.struct(
                   F.col("followers").isNull().alias("unknown"), (-F.coalesce("followers", F.lit(0))).alias("size"),
                   F.coalesce("_first_row", F.lit(0)).alias("first_row"), F.col("account_id").alias("id")))
               .withColumn("flag_list", F.col("flags")).withColumn("platforms", F.array("platform")))

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order")))

    facts = members.groupBy("creator_id").agg(
        *[F.min_by(F.col(c), F.col("_order")).alias(name) for name, c in PRIMARY.items()],
        *[first_known(c).alias(name) for name, c in FIRST_KNOWN.items()])
    lists = distinct_items(members, "creator_id", LISTS, F.col("_order"))
    named = creators.select("creator_id", F.col("display_name").alias("name"), "entity_type", "total_followers", "n_accounts")
    return derive(facts.join(shuffled(lists), "creator_id", "left").join(shuffled(named), "creator_id"))


def derive(profile: DataFrame) -> DataFrame:
    """Niche, bands, cost per view, and engagement against creators of the same size."""
    views = F.when(F.col("avg_views") > 0, F.col("avg_views"))
    banded = profile.withColumns({
        "niche": F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("Uncategorised")),
        "age_band": values.age_band(F.col("age")), "size_tier": values.size_tier(F.col("followers")),
        "budget_tier": values.budget_tier(F.col("rate_reel")), "cpv": F.try_divide(F.col("rate_reel").cast("double"), views),
        "suspicious_er": F.coalesce(F.array_contains("flag_list", "er_outlier_gt_15pct"), F.lit(False))})
    return against_peers(banded)


def against_peers(profile: DataFrame) -> DataFrame:
    """``er_vs_tier``: engagement over the median of the same size tier, and its class.

    The profile is written once before the medians are taken, so that the joins behind it do not run again for them. Size
    tiers are a fixed list of five, so at most five medians come back as constants.
    """
    stored = cut_lineage(profile)
    known = stored.where(F.col("size_tier").isNotNull() & F.col("er").isNotNull())
    medians = {r["size_tier"]: r["er"] for r in exact_medians(known, ["size_tier"], ["er"]).collect()}
    median = F.try_element_at(values.literal_map(medians), F.col("size_tier")) if medians else F.lit(None).cast("double")
    ratio = F.try_divide(F.col("er"), median)
    return stored.withColumn("er_vs_tier", ratio).withColumn(
        "engagement", F.when(F.col("er_vs_tier") <= 0.75, "Low").when(F.col("er_vs_tier") <= 1.3, "Typical")
        .when(F.col("er_vs_tier").isNotNull(), "High"))
