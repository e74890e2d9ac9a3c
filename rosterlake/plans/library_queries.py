"""Merge, latest rows, reports, peers and enrichment."""

from pyspark.sql import functions as F

from rosterlake.operators import clean, enrich, latest, merge, profile, report, resolve, scale
from rosterlake.plans.bindings import accounts, every, profiles, sheet, table
from rosterlake.plans.catalog import query
from rosterlake.plans.cleaning_queries import SHEET_ROWS
from rosterlake.plans.sql import ACCOUNTS, PROFILE, over

STAMP = "CAST('2024-02-01 00:00:00' AS TIMESTAMP)"


@query("flagship_top_creators", over(PROFILE, """
  SELECT niche, rank, creator_id, followers, er, er_vs_tier, engagement FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY niche ORDER BY followers DESC, creator_id) AS INTEGER) AS rank FROM p WHERE followers IS NOT NULL) WHERE rank <= 10"""))
def flagship(spark, folder):
    """The biggest creators of every niche with their engagement against creators of the same size."""
    known = profiles(spark, folder).where(F.col("followers").isNotNull())
    best = scale.top_per_group(known, ["niche"], [F.desc("followers"), F.col("creator_id")], 10)
    return best.select("niche", "rank", "creator_id", "followers", "er", "er_vs_tier", "engagement")


ORDER_ROWS = """
r AS (SELECT o_custkey AS account, o_orderdate AS moment, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price,
             CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS priority, [o_orderpriority, o_orderstatus] AS tags,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back,
             CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus FROM orders)"""


def _order_rows(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("at"), k.alias("id"), F.when(every(k, 3), F.col("o_totalprice")).alias("price"),
        F.when(every(k, 2), F.col("o_orderpriority")).otherwise("").alias("priority"), F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.floor("o_totalprice").alias("size"), "o_orderstatus")


@query("d1_merge_duplicates", over(ORDER_ROWS, """,
  firsts AS (SELECT account, arg_min(price, CAST(moment AS VARCHAR) || lpad(CAST(id AS VARCHAR), 12, '0')) FILTER (WHERE price IS NOT NULL) AS price,
                    arg_min(priority, CAST(moment AS VARCHAR) || lpad(CAST(id AS VARCHAR), 12, '0')) FILTER (WHERE priority <> '') AS priority, count(*) AS n FROM r GROUP BY 1),
  items AS (SELECT account, item, min(CASE WHEN back = 1 THEN 0 ELSE 1000000 - back END * 10 + pos) AS seen FROM (
              SELECT account, back, unnest(tags) AS item, generate_subscripts(tags, 1) AS pos FROM r) GROUP BY ALL),
  lists AS (SELECT account, string_agg(item, '>' ORDER BY seen) AS tags FROM items GROUP BY 1)
  SELECT r.account, o_orderstatus, coalesce(r.price, f.price) AS price, coalesce(nullif(r.priority, ''), f.priority) AS priority, l.tags, n AS n_source_rows
  FROM r JOIN firsts f USING (account) JOIN lists l USING (account) WHERE back = 1""".replace(",\n  firsts", ", firsts", 1)))
def merge_duplicates(spark, folder):
    merged = merge.merge_latest(_order_rows(spark, folder), "account", ("at", "id"), ("o_orderstatus",), ("price", "priority"), ("tags",))
    return merged.withColumn("tags", F.array_join("tags", ">"))


@query("d2_merged_flags", over(ORDER_ROWS, """,
  spread AS (SELECT account, count(*) AS n, max(nullif(size, 0)) AS top, min(nullif(size, 0)) AS bottom, list(DISTINCT 'status_' || o_orderstatus) AS seen FROM r GROUP BY 1)
  SELECT account, array_to_string(list_sort(list_concat(seen, CASE WHEN n > 1 THEN ['exact_duplicate_rows_merged'] ELSE CAST([] AS VARCHAR[]) END,
     CASE WHEN n > 1 AND top > 1.05 * bottom THEN ['conflicting_follower_counts'] ELSE CAST([] AS VARCHAR[]) END)), '>') AS flags FROM spread""".replace(",\n  spread", ", spread", 1)))
def merged_flags(spark, folder):
    rows = _order_rows(spark, folder).withColumn("flags", F.array(F.concat(F.lit("status_"), "o_orderstatus")))
    return merge.merged_flags(rows, "account", "flags", "size").withColumn("flags", F.array_join("flags", ">"))


SHEET_FACTS = SHEET_ROWS + """,
ok AS (SELECT *, platform || ':' || key AS account_id, CAST((c_nationkey + again) % 25 + 1 AS BIGINT) AS batch_id,
              CASE c_custkey % 6 WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n * 100000 WHEN 3 THEN n * 1000000 + 500000 END AS followers FROM keyed)"""


@query("d3_import_snapshots", over(SHEET_FACTS, """
  SELECT account_id, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 HOUR + (((batch_id - 1) % 12) * INTERVAL 1 DAY) AS fetched_at, followers, row_id AS staging_row_id
  FROM ok WHERE reject IS NULL"""))
def import_snapshots(spark, folder):
    batches, staging = sheet(spark, folder)
    rows = clean.accepted(clean.clean_rows(staging, batches))
    return merge.import_snapshots(rows).select("account_id", "fetched_at", "followers", "staging_row_id")


@query("d4_run_counters", over(SHEET_FACTS, """
  SELECT count(*) AS staging_rows, count(DISTINCT CASE WHEN reject IS NULL THEN account_id END) AS accounts, count(*) FILTER (WHERE reject IS NOT NULL) AS rejected_rows,
         count(*) FILTER (WHERE reject IS NULL) - count(DISTINCT CASE WHEN reject IS NULL THEN account_id END) AS exact_duplicate_rows_merged FROM ok"""))
def run_counters(spark, folder):
    batches, staging = sheet(spark, folder)
    return merge.run_counters(clean.clean_rows(staging, batches))


@query("d1_d4_merge_sheet", over(SHEET_FACTS, """
  SELECT account_id, count(*) AS n_source_rows, coalesce(arg_max(followers, batch_id * 100000000 + c_custkey * 2 + again), max(followers)) AS followers
  FROM ok WHERE reject IS NULL GROUP BY 1"""))
def merge_sheet(spark, folder):
    batches, staging = sheet(spark, folder)
    return merge.merge_accounts(clean.accepted(clean.clean_rows(staging, batches))).select("account_id", "n_source_rows", "followers")


@query("d7_profiles", over(ACCOUNTS, """,
  m AS (SELECT *, 'cr_' || row_id // 3 AS creator_id, row_number() OVER (PARTITION BY row_id // 3 ORDER BY followers DESC NULLS LAST, row_id, account_id) AS place FROM accounts),
  f AS (SELECT creator_id, arg_min(platform, place) AS primary_platform, arg_min(handle, CASE WHEN place = 1 THEN 1 END) AS handle, max(followers) AS followers,
               arg_min(er_pct, place) FILTER (WHERE er_pct IS NOT NULL) AS er, arg_min(city, place) FILTER (WHERE city IS NOT NULL) AS city,
               arg_min(age, place) FILTER (WHERE age IS NOT NULL) AS age, count(*) AS n FROM m GROUP BY 1),
  pl AS (SELECT creator_id, string_agg(platform, '>' ORDER BY first) AS platforms FROM (SELECT creator_id, platform, min(place) AS first FROM m GROUP BY ALL) GROUP BY 1),
  ca AS (SELECT creator_id, string_agg(c, '>' ORDER BY first) AS categories FROM (SELECT creator_id, categories[1] AS c, min(place) AS first FROM m GROUP BY ALL) GROUP BY 1)
  SELECT f.creator_id, primary_platform, (SELECT handle FROM m WHERE m.creator_id = f.creator_id AND place = 1) AS handle, followers, er, city, age, platforms, categories, n AS n_accounts
  FROM f JOIN pl USING (creator_id) JOIN ca USING (creator_id)""".replace(",\n  m", ", m", 1)))
def build_profiles(spark, folder):
    acc = accounts(spark, folder)
    nothing = F.array().cast("array<string>")
    blank = {c: F.lit(None).cast("bigint") for c in ("rate_reel_inr", "rate_story_inr", "rate_video_inr")}
    acc = acc.withColumns(blank | {c: F.lit(None).cast("string") for c in ("state", "region", "city_tier", "gender")} | {
        "tags": nothing, "languages": nothing, "brands": nothing, "stats_as_of": F.lit(None).cast("timestamp_ntz")})
    members = acc.withColumn("creator_id", F.concat(F.lit("cr_"), F.floor(F.col("row_id") / 3).cast("string")))
    creators = resolve.roll_up_creators(members)
    built = profile.build_profiles(acc, members.select("creator_id", "account_id"), creators, acc.select("account_id", "row_id", "batch_id"))
    return built.select("creator_id", "primary_platform", "handle", "followers", "er", "city", "age", F.array_join("platforms", ">").alias("platforms"),
                        F.array_join("categories", ">").alias("categories"), "n_accounts")


@query("d8_derived_columns", over(PROFILE, "SELECT creator_id, niche, age_band, size_tier, budget_tier, cpv, suspicious_er FROM banded"))
def derived_columns(spark, folder):
    return profiles(spark, folder).select("creator_id", "niche", "age_band", "size_tier", "budget_tier", "cpv", "suspicious_er")


ISSUES = """
issues AS (SELECT o_orderkey AS row_id, CAST(c_nationkey + 1 AS BIGINT) AS batch_id, CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'warning' END AS severity,
             CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'platform_unknown' ELSE 'no_account_identifier' END
                  WHEN o_orderkey % 5 = 0 THEN 'yt_handle_needs_resolution' ELSE (['er_missing','topics_missing','name_case_fixed','followers_missing','age_unparseable',
                  'er_unparseable','reach_unparseable','name_unreadable','url_params_stripped','name_from_handle','avg_views_unparseable','name_non_latin_script'])[o_orderkey % 12 + 1] END AS issue,
             'acc' || o_custkey AS account_id FROM orders JOIN customer ON o_custkey = c_custkey)"""
WARNINGS = ("er_missing", "topics_missing", "name_case_fixed", "followers_missing", "age_unparseable", "er_unparseable", "reach_unparseable",
            "name_unreadable", "url_params_stripped", "name_from_handle", "avg_views_unparseable", "name_non_latin_script")


def _issues(spark, folder):
    """Orders as source rows with one issue each."""
    from rosterlake.plans.bindings import pick
    customers = scale.shuffled(table(spark, folder, "customer").select("c_custkey", "c_nationkey"))
    o = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    bad = F.col("o_orderstatus") == "P"
    issue = (F.when(bad & every(k, 2), "platform_unknown").when(bad, "no_account_identifier").when(every(k, 5), "yt_handle_needs_resolution")
             .otherwise(pick(WARNINGS, F.pmod(k, F.lit(12)))))
    return o.select(k.alias("row_id"), (F.col("c_nationkey") + 1).cast("bigint").alias("batch_id"), F.when(bad, "rejected").otherwise("warning").alias("severity"),
                    issue.alias("issue"), F.concat(F.lit("acc"), F.col("o_custkey").cast("string")).alias("account_id"))


def _order_batches(spark, folder, issues):
    batches, _ = sheet(spark, folder)
    return batches.drop("row_count").join(issues.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count")), "batch_id")


@query("d9_import_reports", over(ISSUES, """,
  rej AS (SELECT batch_id, sum(n) AS rejected, string_agg(issue || '=' || n, ';' ORDER BY issue) AS reasons FROM (SELECT batch_id, issue, count(*) AS n FROM issues WHERE severity = 'rejected' GROUP BY ALL) GROUP BY 1),
  warn AS (SELECT batch_id, issue, count(*) AS n FROM issues WHERE severity = 'warning' GROUP BY ALL),
  fix AS (SELECT batch_id, string_agg(issue || '=' || n, ';' ORDER BY n DESC, issue DESC) AS fixes FROM (
            SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, issue DESC) AS place FROM warn WHERE issue <> 'yt_handle_needs_resolution') WHERE place <= 10 GROUP BY 1),
  tot AS (SELECT batch_id, sum(n) AS total_fixes FROM warn GROUP BY 1),
  acc AS (SELECT batch_id, count(DISTINCT account_id) AS accounts, count(*) AS rows FROM issues GROUP BY 1),
  cre AS (SELECT batch_id, count(DISTINCT CAST(substr(account_id, 4) AS BIGINT) // 4) AS creators FROM issues GROUP BY 1)
  SELECT batch_id, rows, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected, reasons, accounts, creators, greatest(0, rows - CAST(coalesce(rejected, 0) AS BIGINT) - accounts) AS duplicates_merged, fixes,
         CAST(total_fixes AS BIGINT) AS total_fixes, 'Remarks' AS ignored
  FROM acc LEFT JOIN rej USING (batch_id) LEFT JOIN fix USING (batch_id) LEFT JOIN tot USING (batch_id) LEFT JOIN cre USING (batch_id)""".replace(",\n  rej", ", rej", 1)))
def import_reports(spark, folder):
    issues = _issues(spark, folder)
    sources = issues.select("account_id", "row_id", "batch_id")
    links = table(spark, folder, "customer").select(F.concat(F.lit("acc"), F.col("c_custkey").cast("string")).alias("account_id"),
                                                    F.floor(F.col("c_custkey") / 4).cast("string").alias("creator_id"))
    def text(c):
        return F.array_join(F.transform(c, lambda e: F.concat(e["issue"], F.lit("="), e["count"].cast("string"))), ";")
    out = report.import_reports(_order_batches(spark, folder, issues), issues, sources, links)
    return out.select("batch_id", "rows", "rejected", text("rejected_reasons").alias("reasons"), "accounts", "creators", "duplicates_merged",
                      text("fixes").alias("fixes"), "total_fixes", F.array_join("ignored_columns", ",").alias("ignored"))


@query("d10_ops_reports", over(ISSUES, """,
  firsts AS (SELECT account_id, min(batch_id) AS first FROM issues GROUP BY 1),
  t AS (SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE severity = 'rejected') AS rejected, count(DISTINCT account_id) AS accounts,
               count(DISTINCT CASE WHEN first = batch_id THEN account_id END) AS new_accounts FROM issues JOIN firsts USING (account_id) GROUP BY 1)
  SELECT *, rows - rejected - new_accounts AS matched_existing FROM t""".replace(",\n  firsts", ", firsts", 1)))
def ops_reports(spark, folder):
    issues = _issues(spark, folder)
    return report.ops_reports(_order_batches(spark, folder, issues), issues, issues.select("account_id", "row_id", "batch_id"))


LIBRARY = ACCOUNTS + """, creators AS (SELECT row_id // 5 AS creator, count(*) AS n_accounts, CAST(sum(followers) AS BIGINT) AS total_followers FROM accounts GROUP BY 1)"""


def _library(spark, folder):
    acc = accounts(spark, folder)
    creators = acc.groupBy(F.floor(F.col("row_id") / 5).alias("creator")).agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("followers").alias("total_followers"))
    cleaned = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "P", "platform_unknown").alias("reject"))
    pairs = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").otherwise("linked").alias("status"))
    return report.overview(cleaned, acc, creators, pairs, table(spark, folder, "nation"))


@query("d11_overview", over(LIBRARY, """
  SELECT 'raw_rows' AS figure, count(*) AS value FROM orders UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'accounts', count(*) FROM accounts UNION ALL SELECT 'creators', count(*) FROM creators UNION ALL SELECT 'multi', count(*) FROM creators WHERE n_accounts > 1
  UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'enriched', count(*) FROM accounts WHERE stats_source = 'youtube_api'
  UNION ALL SELECT 'batches', count(*) FROM nation UNION ALL SELECT 'duplicates_merged', 0"""))
def overview(spark, folder):
    return _library(spark, folder)


@query("d11_funnel", over(LIBRARY, """
  SELECT CAST(0 AS INTEGER) AS step, 'Raw rows' AS stage, count(*) AS rows FROM orders UNION ALL SELECT 1, '− rejected', -count(*) FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 2, '− exact duplicates merged', 0 UNION ALL SELECT 3, '= clean accounts', count(*) FROM accounts
  UNION ALL SELECT 4, '− accounts linked to another', (SELECT count(*) FROM creators) - count(*) FROM accounts UNION ALL SELECT 5, '= creators', count(*) FROM creators"""))
def funnel(spark, folder):
    return report.funnel(_library(spark, folder))


@query("d12_by_platform", over(ACCOUNTS, "SELECT platform, count(*) AS accounts, CAST(sum(followers) AS BIGINT) AS followers FROM accounts GROUP BY 1"))
def by_platform(spark, folder):
    return report.by_platform(accounts(spark, folder))


@query("d13_category_frequency", over(PROFILE, """
  SELECT * FROM (SELECT c AS category, count(*) AS accounts FROM (SELECT unnest(categories) AS c FROM base) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
  UNION ALL SELECT NULL, count(*) FROM base WHERE len(categories) = 0"""))
def category_frequency(spark, folder):
    from rosterlake.plans.bindings import base_profiles
    return report.category_frequency(base_profiles(spark, folder), 15)


@query("d14_flag_frequency", over(ISSUES, "SELECT issue AS flag, count(*) AS rows FROM issues WHERE severity = 'warning' GROUP BY 1"))
def flag_frequency(spark, folder):
    return report.flag_frequency(_issues(spark, folder)).select("flag", "rows")


@query("d15_freshness", over(PROFILE, """
  SELECT primary_platform AS platform, stats_source, max(stats_as_of) AS newest, min(stats_as_of) AS oldest, count(*) AS n FROM base GROUP BY ALL"""))
def freshness(spark, folder):
    from rosterlake.plans.bindings import base_profiles
    return report.freshness(base_profiles(spark, folder).withColumnRenamed("primary_platform", "platform"))


@query("d16_biggest_creators", over(PROFILE, "SELECT creator_id, name, total_followers FROM base ORDER BY total_followers DESC, creator_id LIMIT 15"))
def biggest(spark, folder):
    from rosterlake.plans.bindings import base_profiles
    return report.biggest_creators(base_profiles(spark, folder).where(F.col("total_followers").isNotNull())).select("creator_id", "name", "total_followers")


@query("d18_units_per_pacific_day", """
  SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS pacific_day, CAST(sum(CASE WHEN event_type = 'purchase' THEN 100 ELSE 1 END) AS BIGINT) AS units
  FROM events GROUP BY 1""")
def units_per_day(spark, folder):
    calls = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("called_at"), F.when(F.col("event_type") == "purchase", 100).otherwise(1).alias("units"))
    return enrich.units_per_pacific_day(calls)


SNAPS = """
snap AS (SELECT user_id AS account_id, ts AS fetched_at, event_id AS id, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS followers,
                CASE WHEN event_id % 3 > 0 THEN value END AS er_pct, event_type AS source FROM events)"""


def _snapshots(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("account_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("followers"),
        F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("value")).alias("er_pct"), F.lit(None).cast("double").alias("avg_views"), F.col("event_type").alias("source"))


@query("e1_current_stats", over(SNAPS, """
  SELECT c_custkey AS account_id, coalesce(l.followers, CAST(floor(abs(c_acctbal)) AS BIGINT)) AS followers, coalesce(l.er_pct, -1.0) AS er_pct, source AS stats_source, fetched_at AS stats_as_of
  FROM customer LEFT JOIN (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY fetched_at DESC, id DESC) = 1) l ON account_id = c_custkey"""))
def current_stats(spark, folder):
    acc = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"), F.floor(F.abs("c_acctbal")).alias("followers"),
                                                  F.lit(-1.0).alias("er_pct"), F.lit(None).cast("double").alias("avg_views"))
    return latest.current_stats(acc, _snapshots(spark, folder), ("fetched_at", "id")).drop("avg_views")


@query("e2_e3_engagement_against_peers", over(PROFILE, "SELECT creator_id, size_tier, er, er_vs_tier, engagement FROM p"))
def against_peers(spark, folder):
    return profiles(spark, folder).select("creator_id", "size_tier", "er", "er_vs_tier", "engagement")


@query("e4_percent_ranks", """
  WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_custkey AS DOUBLE) END AS x, o_totalprice AS y FROM orders),
  r AS (SELECT o_orderkey, x, rank() OVER (ORDER BY x) AS lo, count(*) OVER (PARTITION BY x) AS same, (SELECT count(x) FROM v) AS n,
               rank() OVER (ORDER BY y DESC) AS down, count(*) OVER (PARTITION BY y) AS tied, (SELECT count(y) FROM v) AS m FROM v)
  SELECT o_orderkey, CASE WHEN x IS NULL THEN 0.3 ELSE (lo - nulls + (same - 1) / 2.0) / n END AS up, (down + (tied - 1) / 2.0) / m AS down
  FROM r, (SELECT 0 AS nulls)""")
def percent_ranks(spark, folder):
    """Tie-averaged ranks over all orders; customers repeat, so values tie heavily."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ranked = scale.percent_ranks(o, "o_orderkey", {"up": (F.when(~every(F.col("o_orderkey"), 9), F.col("o_custkey")), True),
                                                   "down": (F.col("o_totalprice"), False)})
    return ranked.select("o_orderkey", "up", "down")


@query("e4_exact_medians", """
  SELECT l_returnflag, l_linestatus, median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL""")
def medians(spark, folder):
    """Exact medians of two measures in very large groups."""
    return scale.exact_medians(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])


@query("e6_primary_accounts", over(ACCOUNTS, """
  SELECT row_id // 3 AS creator, account_id FROM accounts QUALIFY row_number() OVER (PARTITION BY row_id // 3 ORDER BY followers DESC NULLS LAST, row_id, account_id) = 1"""))
def primary_accounts(spark, folder):
    ranked = scale.top_per_group(accounts(spark, folder).withColumn("creator", F.floor(F.col("row_id") / 3)), ["creator"],
                                 [F.desc_nulls_last("followers"), F.col("row_id"), F.col("account_id")], 1)
    return ranked.select("creator", "account_id")


@query("e8_snapshot_history", over(SNAPS, """
  SELECT account_id, id, followers, followers - lag(followers) OVER (PARTITION BY account_id ORDER BY fetched_at, id) AS change FROM snap"""))
def snapshot_history(spark, folder):
    return latest.history(_snapshots(spark, folder), "account_id", "fetched_at", "id", "followers").select("account_id", "id", "followers", "change")


VIDEOS = """
v AS (SELECT user_id AS channel_id, event_id AS video_id, ts AS published_at, CAST(floor(value) AS BIGINT) AS views,
             CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS likes, CASE WHEN event_id % 2 = 0 THEN CAST(3 AS BIGINT) END AS comments FROM events)"""


@query("k1_video_metrics", over(VIDEOS, f"""
  SELECT channel_id, CAST(round_even(avg(views), 0) AS BIGINT) AS avg_views, avg(likes) AS avg_likes, avg(comments) AS avg_comments,
         round_even(100 * (avg(likes) + coalesce(avg(comments), 0)) / avg(views), 3) AS er_pct, count(*) AS videos_used
  FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id) <= 10)
  WHERE views > 0 AND published_at < {STAMP} - INTERVAL 48 HOUR GROUP BY 1"""))
def video_metrics(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    videos = table(spark, folder, "events").select(
        F.col("user_id").alias("channel_id"), F.col("event_id").alias("video_id"), F.col("ts").alias("published_at"), F.floor("value").alias("views"),
        F.when(F.col("event_type") != "error", k).alias("likes"), F.when(every(F.col("event_id"), 2), F.lit(3).cast("bigint")).alias("comments"))
    return enrich.video_metrics(videos, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


CHANNEL_ACCOUNTS = """
a AS (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 4 > 0 THEN 'UC' || c_custkey END AS channel_id,
             CASE WHEN c_custkey % 8 = 0 THEN '@h' || c_custkey WHEN c_custkey % 8 = 4 THEN 'c:' || c_custkey ELSE 'UC' || c_custkey END AS platform_key,
             CASE WHEN c_custkey % 3 = 0 THEN 'youtube_api' ELSE 'csv_import' END AS stats_source, last AS stats_as_of, CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _channel_accounts(spark, folder):
    k = F.col("c_custkey")
    seen = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("stats_as_of"))
    text = k.cast("string")
    channel = F.when(~every(k, 4), F.concat(F.lit("UC"), text))
    return table(spark, folder, "customer").join(seen, k == F.col("o_custkey"), "left").select(
        k.alias("account_id"), F.lit("youtube").alias("platform"), channel.alias("channel_id"),
        F.when(every(k, 8), F.concat(F.lit("@h"), text)).when(every(k, 8, 4), F.concat(F.lit("c:"), text)).otherwise(channel).alias("platform_key"),
        F.when(every(k, 3), "youtube_api").otherwise("csv_import").alias("stats_source"), "stats_as_of", F.floor(F.abs("c_acctbal")).alias("followers"),
        F.array().cast("array<string>").alias("flags"))


@query("f12_to_resolve", over(CHANNEL_ACCOUNTS, "SELECT account_id, platform_key FROM a WHERE channel_id IS NULL AND platform_key LIKE '@%'"))
def to_resolve(spark, folder):
    return enrich.to_resolve(_channel_accounts(spark, folder))


@query("f12_to_refresh", over(CHANNEL_ACCOUNTS, """
  SELECT account_id, channel_id FROM a WHERE channel_id IS NOT NULL AND (stats_source <> 'youtube_api' OR stats_as_of < CAST('2001-08-01' AS TIMESTAMP) - INTERVAL 30 DAY)
  ORDER BY stats_source = 'youtube_api', stats_as_of NULLS FIRST, followers DESC, account_id"""))
def to_refresh(spark, folder):
    return enrich.to_refresh(_channel_accounts(spark, folder), F.lit("2001-08-01").cast("timestamp_ntz"), 30)


@query("f13_estimated_units", over(CHANNEL_ACCOUNTS, """
  SELECT h AS n_handles, c AS n_channels, h + CAST(ceil(c / 50.0) AS BIGINT) + 2 * c AS units FROM (
    SELECT count(*) FILTER (WHERE channel_id IS NULL AND platform_key LIKE '@%') AS h, count(*) FILTER (WHERE channel_id IS NOT NULL) AS c FROM a)"""))
def estimated_units(spark, folder):
    acc = _channel_accounts(spark, folder)
    return enrich.estimated_units(enrich.to_resolve(acc), enrich.to_refresh(acc, F.lit("2001-08-01").cast("timestamp_ntz")))


@query("a14_missing_channels", over(CHANNEL_ACCOUNTS, """
  SELECT account_id, CASE WHEN channel_id IS NOT NULL AND account_id % 7 = 1 THEN 'yt_channel_not_found' ELSE '' END AS flags FROM a"""))
def missing_channels(spark, folder):
    acc = _channel_accounts(spark, folder)
    asked = acc.where(F.col("channel_id").isNotNull())
    answered = asked.where(~every(F.col("account_id"), 7, 1))
    return enrich.flag_missing_channels(acc, asked, answered).select("account_id", F.array_join("flags", ">").alias("flags"))
