"""Exact-duplicate merge of clean rows into accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names, refs

FILL = ("name_clean", "city", "state", "country", "er_pct", "followers", "handle", "channel_id", "avg_views",
        "rate_reel_inr", "rate_story_inr", "rate_video_inr", "age", "gender", "region", "city_tier")
LISTS = ("topics", "categories", "tags", "languages", "brands")
KEPT = ("platform", "platform_key", "display_name_raw", "handle_core", "potential_reach", "entity_type",
        "entity_reason")


def distinct_items(df: DataFrame, key: str, lists: Sequence[str], order: Column) -> DataFrame:
    """Per key, each list column's distinct items by first appearance.

    Items are reduced to one row each before anything is collected, so an array holds distinct items only, however many
    rows a key has.
    """
    tagged = F.concat(*[F.transform(F.col(c), lambda x, i: F.struct(F.lit(n).alias("list"), x.alias("item"), i.alias("pos")))
                        for n, c in enumerate(lists)])
    first = (df.select(key, order.alias("_order"), F.inline(tagged))
             .groupBy(key, "list", "item").agg(F.min(F.struct("_order", "pos")).alias("seen")))
    def ordered(n):
        rows = F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("seen", "item"))))
        return F.transform(rows, lambda r: r["item"])
    return first.groupBy(key).agg(*[ordered(n).alias(c) for n, c in enumerate(lists)])


def merge_latest(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str], fill: Sequence[str],
                 lists: Sequence[str]) -> DataFrame:
    """One row per key: the last row wins, its gaps are filled from the earliest row that has a value, and list
    columns are the last row's items followed by the earlier rows' in order.

    Only partial-friendly aggregates are used; no key's rows are ever gathered.
    """
    at = F.struct(*order)

    def present(c):
        return F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c)

    scalars = df.groupBy(key).agg(
        F.max_by(F.struct(*keep, *fill, *lists), at).alias("last"),
        *[F.min_by(present(c), F.when(present(c).isNotNull(), at)).alias(f"first_{c}") for c in fill],
        F.count(F.lit(1)).alias("n_source_rows"))
    items = distinct_items(df, key, lists, at)
    return scalars.join(items, key, "left").select(
        key, *[F.col(f"last.{c}").alias(c) for c in keep],
        *[F.coalesce(F.nullif(F.col(f"last.{c}"), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(f"last.{c}"),
                     F.col(f"first_{c}")).alias(c) for c in fill],
        *[F.array_distinct(F.concat(F.col(f"last.{c}"), F.coalesce(items[c], F.array().cast("array<string>")))).alias(c)
          for c in lists],
        "n_source_rows")


def merged_flags(df: DataFrame, key: str, flags: str, measure: str) -> DataFrame:
    """Union of flags per key, plus whether rows were merged and whether they disagree on the measure by over 5%."""
    seen = df.select(key, F.explode(flags).alias("flag")).groupBy(key).agg(F.collect_set("flag").alias("seen"))
    some = F.when(F.col(measure) != 0, F.col(measure))
    spread = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.max(some).alias("top"), F.min(some).alias("bottom"))
    many = F.col("rows") > 1
    extra = F.array_compact(F.array(
        F.when(many, "exact_duplicate_rows_merged"),
        F.when(many & (F.col("top") > 1.05 * F.col("bottom")), "conflicting_follower_counts")))
    return spread.join(seen, key, "left").select(key, F.array_sort(F.array_distinct(F.concat(
        F.coalesce("seen", F.array().cast("array<string>")), extra))).alias("flags"))


def merge_accounts(rows: DataFrame) -> DataFrame:
    """Accounts from accepted clean rows. Handle core, type and reach stay those of the last row."""
    merged = merge_latest(rows, "account_id", ("batch_id", "row_id"), KEPT, FILL, LISTS)
    merged = merged.join(merged_flags(rows, "account_id", "flags", "followers"), "account_id")
    return (merged.withColumn("name_reading", names.transliterate("name_clean"))
            .withColumn("name_key", names.name_key(F.col("name_reading")))
            .withColumn("profile_url", refs.canonical_url(F.col("platform"), F.col("handle"), F.col("channel_id"))))


def account_sources(rows: DataFrame) -> DataFrame:
    return rows.select("account_id", "row_id", "batch_id")


def import_snapshots(rows: DataFrame) -> DataFrame:
    """One dated observation per source row (D3)."""
    nothing = {c: F.lit(None).cast(t) for c, t in (("avg_likes", "double"), ("avg_comments", "double"),
                                                  ("total_views", "bigint"), ("media_count", "bigint"))}
    return rows.select("account_id", F.col("ingested_at").alias("fetched_at"), F.lit("csv_import").alias("source"),
                       "followers", "er_pct", "avg_views", *[v.alias(c) for c, v in nothing.items()],
                       "batch_id", F.col("row_id").alias("staging_row_id"))


def run_counters(cleaned: DataFrame) -> DataFrame:
    """Rows read, accounts, rejected rows and duplicates merged."""
    ok = F.col("reject").isNull()
    return cleaned.agg(
        F.count(F.lit(1)).alias("staging_rows"), F.countDistinct(F.when(ok, F.col("account_id"))).alias("accounts"),
        F.count_if(~ok).alias("rejected_rows"), F.count_if(ok).alias("_kept")).select(
        "staging_rows", "accounts", "rejected_rows",
        (F.col("_kept") - F.col("accounts")).alias("exact_duplicate_rows_merged"))
