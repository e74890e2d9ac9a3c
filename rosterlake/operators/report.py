"""Import reports, overview figures and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.values import literal_map
from rosterlake.operators.clean import map_headers
from rosterlake.operators.scale import top_per_group
from rosterlake.vocab import words

UNREPORTED_FIX = "yt_handle_needs_resolution"


def flag_label(flag: Column, otherwise: Column | None = None) -> Column:
    """A flag in plain words."""
    return F.coalesce(F.try_element_at(literal_map(words.FLAG_LABELS), flag), flag if otherwise is None else otherwise)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Rows per batch, severity and issue."""
    return issues.groupBy("batch_id", "severity", "issue").agg(F.count(F.lit(1)).alias("n"))


def import_reports(batches: DataFrame, issues: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """What every import did, all batches in one pass."""
    counts = issue_counts(issues)
    bad = counts.where(F.col("severity") == "rejected")
    fixes = counts.where(F.col("severity") == "warning")
    entry = F.struct("issue", flag_label(F.col("issue")).alias("label"), F.col("n").alias("count"))
    reasons = bad.groupBy("batch_id").agg(F.sum("n").alias("rejected"), F.array_sort(F.collect_list(entry)).alias("rejected_reasons"))
    best = top_per_group(fixes.where(F.col("issue") != UNREPORTED_FIX), ["batch_id"], [F.desc("n"), F.desc("issue")], 10)
    top = best.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))),
                                                   lambda r: r["entry"]).alias("fixes"))
    total = fixes.groupBy("batch_id").agg(F.sum("n").alias("total_fixes"))
    touched = sources.groupBy("batch_id", "account_id").agg(F.lit(1).alias("_one"))
    reached = touched.join(links, "account_id", "left").groupBy("batch_id").agg(
        F.countDistinct("account_id").alias("accounts"), F.countDistinct("creator_id").alias("creators"))
    out = map_headers(batches)
    for side in (reasons, top, total, reached):
        out = out.join(side, "batch_id", "left")
    zero = F.lit(0)
    rejected, accounts = F.coalesce("rejected", zero), F.coalesce("accounts", zero)
    ignored = F.array_except("columns", F.map_values("mapping"))
    return out.select("batch_id", "file_name", F.col("row_count").alias("rows"), "ingested_at", rejected.alias("rejected"),
                      "rejected_reasons", accounts.alias("accounts"), F.coalesce("creators", zero).alias("creators"),
                      F.greatest(zero, F.col("row_count") - rejected - accounts).alias("duplicates_merged"), "fixes",
                      F.coalesce("total_fixes", zero).alias("total_fixes"), "mapping", ignored.alias("ignored_columns")).orderBy(
        F.desc("batch_id"))


def ops_reports(batches: DataFrame, issues: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows, rejects, accounts touched and accounts first seen, per batch."""
    pairs = sources.groupBy("account_id", "batch_id").agg(F.lit(1).alias("_one"))
    first = pairs.groupBy("account_id").agg(F.min("batch_id").alias("_first"))
    touched = pairs.join(first, "account_id").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("_first") == F.col("batch_id")).alias("new_accounts"))
    bad = issues.where(F.col("severity") == "rejected").groupBy("batch_id").agg(F.count(F.lit(1)).alias("rejected"))
    zero = F.lit(0)
    rejected, new = F.coalesce("rejected", zero), F.coalesce("new_accounts", zero)
    return batches.join(bad, "batch_id", "left").join(touched, "batch_id", "left").select(
        "batch_id", F.col("row_count").alias("rows"), rejected.alias("rejected"), F.coalesce("accounts", zero).alias("accounts"),
        new.alias("new_accounts"), (F.col("row_count") - rejected - new).alias("matched_existing"))


def overview(cleaned: DataFrame, accounts: DataFrame, creators: DataFrame, candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """Library counters, one row per figure."""
    def figure(df, name, test=None, value=None):
        what = F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))
        return (df if test is None else df.where(test)).agg(what.cast("bigint").alias("value")).select(F.lit(name).alias("figure"), "value")
    parts = [figure(cleaned, "raw_rows"), figure(cleaned, "rejected", F.col("reject").isNotNull()), figure(accounts, "accounts"),
             figure(creators, "creators"), figure(creators, "multi", F.col("n_accounts") > 1),
             figure(candidates, "pending", F.col("status") == "pending"),
             figure(accounts, "enriched", F.col("stats_source") == "youtube_api"), figure(batches, "batches"),
             figure(accounts, "duplicates_merged", value=F.col("n_source_rows") - 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def funnel(figures: DataFrame) -> DataFrame:
    """Raw rows to creators, as signed steps."""
    row = figures.groupBy().pivot("figure", ["raw_rows", "rejected", "duplicates_merged", "accounts", "creators"]).agg(F.max("value"))
    steps = [("Raw rows", F.col("raw_rows")), ("− rejected", -F.col("rejected")),
             ("− exact duplicates merged", -F.col("duplicates_merged")), ("= clean accounts", F.col("accounts")),
             ("− accounts linked to another", F.col("creators") - F.col("accounts")), ("= creators", F.col("creators"))]
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), v.alias("rows")) for s, v in steps])).alias("step", "s")).select(
        "step", "s.stage", "s.rows")


def by_platform(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("platform").agg(F.count(F.lit(1)).alias("accounts"), F.sum("followers").alias("followers"))


def category_frequency(accounts: DataFrame, k: int = 15) -> DataFrame:
    """Most frequent categories; accounts without any are counted under null."""
    counts = accounts.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("accounts"))
    none = accounts.where(F.size("categories") == 0).agg(F.count(F.lit(1)).alias("accounts")).select(
        F.lit(None).cast("string").alias("category"), "accounts")
    return counts.orderBy(F.desc("accounts"), "category").limit(k).unionByName(none)


def flag_frequency(issues: DataFrame) -> DataFrame:
    """Warnings by frequency with their meaning."""
    return issues.where(F.col("severity") == "warning").groupBy(F.col("issue").alias("flag")).agg(
        F.count(F.lit(1)).alias("rows")).withColumn("meaning", flag_label(F.col("flag"), F.lit(""))).orderBy(F.desc("rows"), "flag")


def freshness(accounts: DataFrame) -> DataFrame:
    """Newest and oldest figures by platform and source."""
    return accounts.groupBy("platform", "stats_source").agg(
        F.max("stats_as_of").alias("newest"), F.min("stats_as_of").alias("oldest"), F.count(F.lit(1)).alias("n"))


def biggest_creators(creators: DataFrame, k: int = 15) -> DataFrame:
    return creators.orderBy(F.desc("total_followers"), "creator_id").limit(k)


def lineage(sources: DataFrame, staging: DataFrame, batches: DataFrame) -> DataFrame:
    """Account to source rows to files."""
    return sources.select("account_id", "row_id").join(staging.select("row_id", "batch_id", "row_number", "raw"), "row_id").join(
        batches.select("batch_id", "file_name"), "batch_id")


def channel_report(channels: DataFrame, accounts: DataFrame) -> DataFrame:
    """Channels next to the accounts they belong to."""
    return channels.join(accounts.select("channel_id", "account_id", "followers", "avg_views", "er_pct"), "channel_id", "left")
