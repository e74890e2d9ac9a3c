"""Campaign results: latest post metrics, KPIs, timelines, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.latest import latest_per_key
from rosterlake.operators.scale import top_per_group
from rosterlake.vocab import words

POST_COUNTS = ("views", "likes", "comments", "shares", "saves")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Newest metric row per post (E5)."""
    return latest_per_key(metrics, ["cc_id"], ["id"])


def effective_status(creators: DataFrame, metrics: DataFrame) -> DataFrame:
    """A recorded metric moves a confirmed or submitted post to live (I4)."""
    measured = metrics.groupBy(F.col("cc_id").alias("id")).agg(F.lit(True).alias("_measured"))
    joined = creators.join(measured, "id", "left")
    moved = F.coalesce("_measured", F.lit(False)) & F.col("status").isin("confirmed", "submitted")
    return joined.withColumn("status", F.when(moved, "live").otherwise(F.col("status"))).drop("_measured")


def with_results(creators: DataFrame, metrics: DataFrame) -> DataFrame:
    """Shortlist rows with their newest figures, fee and state tests."""
    newest = latest_metrics(metrics.select("cc_id", "id", *POST_COUNTS)).select(F.col("cc_id").alias("id"), *POST_COUNTS)
    zero = F.lit(0)
    engaged = sum((F.coalesce(c, zero) for c in POST_COUNTS[1:]), F.lit(0))
    return creators.join(newest, "id", "left").withColumns({
        "fee": F.coalesce("agreed_fee", "quoted_fee", F.lit(0).cast("decimal(18,2)")), "engagements": engaged,
        "committed": F.col("status").isin(*words.COMMITTED_STATUSES), "on_air": F.col("status").isin(*words.LIVE_STATUSES)})


def campaign_kpis(campaigns: DataFrame, creators: DataFrame, metrics: DataFrame) -> DataFrame:
    """KPIs of all campaigns in one pass."""
    rows = with_results(creators, metrics)
    c = F.col
    zero = F.lit(0)
    seen = c("on_air") & (F.coalesce("views", zero) > 0)
    facts = rows.groupBy("campaign_id").agg(
        F.count_if(c("status") != "dropped").alias("creators"), F.count_if("committed").alias("committed"),
        F.count_if("on_air").alias("live"),
        *[F.count_if(c("status") == s).alias(f"n_{s}") for s in (*words.PIPELINE_STATUSES, "dropped")],
        F.sum(F.when(c("on_air"), F.coalesce("views", zero)).otherwise(0)).alias("views"),
        F.sum(F.when(c("on_air"), c("engagements")).otherwise(0)).alias("engagements"),
        F.sum(F.when(c("committed"), c("fee")).otherwise(0)).alias("committed_spend"),
        F.sum(F.when(seen, c("fee")).otherwise(0)).alias("_live_spend"),
        F.sum(F.when(c("committed"), F.coalesce("est_views", F.lit(0.0))).otherwise(0.0)).alias("est_views"))
    joined = campaigns.join(facts, campaigns["id"] == facts["campaign_id"], "left").drop("campaign_id")
    counts = ["creators", "committed", "live", *[f"n_{s}" for s in (*words.PIPELINE_STATUSES, "dropped")], "views", "engagements"]
    whole = {n: F.coalesce(n, F.lit(0)) for n in counts} | {"committed_spend": F.coalesce("committed_spend", F.lit(0).cast("decimal(18,2)"))}
    joined = joined.withColumns(whole)
    return joined.withColumns({
        "er": F.bround(F.try_divide(100.0 * c("engagements"), c("views")), 2),
        "actual_cpv": F.bround(F.try_divide(c("_live_spend").cast("double"), c("views")), 2),
        "est_cpv": F.bround(F.try_divide(c("committed_spend").cast("double"), c("est_views")), 2)}).drop("_live_spend")


def progress(kpis: DataFrame) -> DataFrame:
    """Shares confirmed and spent, in whole percent."""
    c = F.col
    return kpis.withColumns({
        "confirmed_percent": F.coalesce(F.round(F.try_divide(100.0 * c("committed"), c("creators"))), F.lit(0.0)).cast("int"),
        "spent_percent": F.coalesce(F.least(F.lit(100.0), F.round(F.try_divide(
            100.0 * c("committed_spend").cast("double"), c("budget").cast("double")))), F.lit(0.0)).cast("int")})


def daily_views(metrics: DataFrame) -> DataFrame:
    """Highest views per post and day (input of E7)."""
    return metrics.groupBy("campaign_id", "cc_id", F.to_date("recorded_at").alias("day")).agg(F.max("views").alias("views"))


def view_timeline(metrics: DataFrame) -> DataFrame:
    """Per campaign and observed day, the sum of every post's last known views.

    A post adds to a day's sum what it gained since its own previous day, so the carried-forward total is a running sum
    of gains. No grid of days times posts is built.
    """
    posts = daily_views(metrics).withColumn("views", F.coalesce("views", F.lit(0)))
    before = F.lag("views", 1, 0).over(Window.partitionBy("campaign_id", "cc_id").orderBy("day"))
    gains = posts.withColumn("gain", F.col("views") - before).groupBy("campaign_id", "day").agg(F.sum("gain").alias("gain"))
    running = Window.partitionBy("campaign_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return gains.select("campaign_id", "day", F.sum("gain").over(running).alias("views"))


def performance(creators: DataFrame, metrics: DataFrame) -> DataFrame:
    """Plan against result per committed creator (I8)."""
    c = F.col
    fee = c("fee").cast("double")
    return with_results(creators, metrics).where("committed").select(
        "campaign_id", "id", "status", "fee", "views", "est_views",
        F.when(c("views").isNotNull(), c("engagements")).alias("engagements"),
        F.round(F.try_divide(100.0 * c("engagements"), c("views")), 1).alias("er"),
        F.when(fee > 0, F.round(F.try_divide(fee, c("views")), 2)).alias("fee_per_view"))


def org_dashboard(kpis: DataFrame, invoices: DataFrame, creators: DataFrame, batches: DataFrame, members: DataFrame) -> DataFrame:
    """One row per organisation (I3). Every input carries ``org_id``."""
    def counted(df, name):
        return df.groupBy("org_id").agg(F.count(F.lit(1)).alias(name))
    active = F.col("status") == "active"
    campaigns = kpis.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("campaigns"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "draft").alias("draft"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.sum("views").alias("views"), F.sum("live").alias("live_posts"),
        F.sum(F.when(active, F.col("committed_spend")).otherwise(0)).alias("committed_spend"))
    owed = invoices.where(F.col("status") == "issued").groupBy("org_id").agg(F.sum("total").alias("outstanding"))
    out = campaigns
    for side in (owed, counted(creators, "library"), counted(batches, "imports"), counted(members, "members")):
        out = out.join(side, "org_id", "full_outer")
    return out.select("org_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "org_id"])


def activity_feed(activity: DataFrame, groups: list[str], k: int = 12) -> DataFrame:
    """Newest entries (F14); per group when groups are given."""
    if not groups:
        return activity.orderBy(F.desc("id")).limit(k)
    return top_per_group(activity, groups, [F.desc("id")], k)


def mapping_accuracy(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Rows whose account, or rejection, is as expected, next to all rows."""
    right = F.col("expected_account_id").eqNullSafe(F.col("account_id"))
    return truth.join(got, "row_number", "left").agg(F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("rows"))


def mapping_misses(truth: DataFrame, got: DataFrame) -> DataFrame:
    return truth.join(got, "row_number", "left").where(~F.col("expected_account_id").eqNullSafe(F.col("account_id")))
