"""Campaign results and billing."""

from pyspark.sql import functions as F

from rosterlake.operators import billing, campaign, clean, latest
from rosterlake.plans.bindings import every, invoices, post_metrics, sheet, shortlist, table
from rosterlake.plans.catalog import query
from rosterlake.plans.cleaning_queries import SHEET_ROWS
from rosterlake.plans.sql import INVOICES, SHORTLIST, over
from rosterlake.session import cut_lineage
from rosterlake.vocab import words


@query("e5_latest_metrics", over(SHORTLIST, "SELECT cc_id, id, views, likes, comments FROM latest"))
def latest_metrics(spark, folder):
    return campaign.latest_metrics(post_metrics(spark, folder)).select("cc_id", "id", "views", "likes", "comments")


@query("e7_view_timeline", over(SHORTLIST, """,
  daily AS (SELECT campaign_id, cc_id, CAST(recorded_at AS DATE) AS day, coalesce(max(views), 0) AS views FROM pm GROUP BY ALL),
  days AS (SELECT DISTINCT campaign_id, day FROM daily), posts AS (SELECT DISTINCT campaign_id, cc_id FROM daily),
  grid AS (SELECT d.campaign_id, d.day, p.cc_id FROM days d JOIN posts p USING (campaign_id)),
  carried AS (SELECT g.campaign_id, g.day, g.cc_id, last_value(views IGNORE NULLS) OVER (PARTITION BY g.campaign_id, g.cc_id ORDER BY g.day) AS v
              FROM grid g LEFT JOIN daily x ON x.campaign_id = g.campaign_id AND x.cc_id = g.cc_id AND x.day = g.day)
  SELECT campaign_id, day, CAST(sum(coalesce(v, 0)) AS BIGINT) AS views FROM carried GROUP BY ALL""".replace(",\n  daily", ", daily", 1)))
def view_timeline(spark, folder):
    return campaign.view_timeline(post_metrics(spark, folder))


@query("e9_metric_history", over(SHORTLIST, """
  SELECT cc_id, id, views, views - lag(views) OVER (PARTITION BY cc_id ORDER BY recorded_at, id) AS change FROM pm"""))
def metric_history(spark, folder):
    return latest.history(post_metrics(spark, folder), "cc_id", "recorded_at", "id", "views").select("cc_id", "id", "views", "change")


@query("f14_activity_feed", over(SHORTLIST, "SELECT campaign_id, id, source FROM pm QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY id DESC) <= 40"))
def activity_feed(spark, folder):
    return campaign.activity_feed(post_metrics(spark, folder), ["campaign_id"], 40).select("campaign_id", "id", "source")


@query("f14_call_log", "SELECT event_id AS id, event_type, ts FROM events ORDER BY event_id DESC LIMIT 200")
def call_log(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_id").alias("id"), "event_type", "ts")
    return campaign.activity_feed(log, [], 200)


_STATES = (*words.PIPELINE_STATUSES, "dropped")
KPI = SHORTLIST + """,
k AS (SELECT c.id, c.org_id, c.status, c.budget, count(*) FILTER (WHERE r.status <> 'dropped') AS creators, count(*) FILTER (WHERE committed) AS committed, count(*) FILTER (WHERE on_air) AS live,
  """ + ", ".join(f"count(*) FILTER (WHERE r.status = '{s}') AS n_{s}" for s in _STATES) + """,
  CAST(coalesce(sum(views) FILTER (WHERE on_air), 0) AS BIGINT) AS views, CAST(coalesce(sum(engagements) FILTER (WHERE on_air), 0) AS BIGINT) AS engagements,
  coalesce(sum(fee) FILTER (WHERE committed), 0) AS committed_spend, coalesce(sum(est_views) FILTER (WHERE committed), 0) AS est_views,
  coalesce(sum(fee) FILTER (WHERE on_air AND coalesce(views, 0) > 0), 0) AS live_spend
  FROM campaigns c LEFT JOIN results r ON r.campaign_id = c.id GROUP BY ALL)"""
RATIOS = """round_even(CASE WHEN views > 0 THEN 100.0 * CAST(engagements AS DOUBLE) / views END, 2) AS er,
  round_even(CASE WHEN views > 0 THEN CAST(live_spend AS DOUBLE) / views END, 2) AS actual_cpv,
  round_even(CASE WHEN est_views > 0 THEN CAST(committed_spend AS DOUBLE) / est_views END, 2) AS est_cpv"""


def _kpis(spark, folder):
    campaigns, creators = shortlist(spark, folder)
    return campaign.campaign_kpis(campaigns, creators, post_metrics(spark, folder))


@query("i1_i2_campaign_kpis", over(KPI, "SELECT id, creators, committed, live, " + ", ".join(f"n_{s}" for s in _STATES) + f""", views, engagements,
  CAST(committed_spend AS DOUBLE) AS committed_spend, est_views, {RATIOS} FROM k"""))
def campaign_kpis(spark, folder):
    return _kpis(spark, folder).select("id", "creators", "committed", "live", *[f"n_{s}" for s in _STATES], "views", "engagements",
                                       F.col("committed_spend").cast("double").alias("committed_spend"), "est_views", "er", "actual_cpv", "est_cpv")


@query("i3_org_dashboard", over(KPI + ", " + INVOICES.strip(), """,
  a AS (SELECT org_id, count(*) AS campaigns, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'draft') AS draft,
               count(*) FILTER (WHERE status = 'completed') AS completed, CAST(sum(views) AS BIGINT) AS views, CAST(sum(live) AS BIGINT) AS live_posts,
               CAST(coalesce(sum(committed_spend) FILTER (WHERE status = 'active'), 0) AS DOUBLE) AS committed_spend FROM k GROUP BY 1),
  o AS (SELECT org_id % 5 AS org_id, CAST(sum(total) AS DOUBLE) AS outstanding FROM inv WHERE status = 'issued' GROUP BY 1),
  l AS (SELECT c_nationkey % 5 AS org_id, count(*) AS library FROM customer GROUP BY 1), n AS (SELECT n_nationkey % 5 AS org_id, count(*) AS imports FROM nation GROUP BY 1),
  s AS (SELECT s_nationkey % 5 AS org_id, count(*) AS members FROM supplier GROUP BY 1)
  SELECT * FROM a FULL JOIN o USING (org_id) FULL JOIN l USING (org_id) FULL JOIN n USING (org_id) FULL JOIN s USING (org_id)""".replace(",\n  a AS", ", a AS", 1)))
def org_dashboard(spark, folder):
    def org(c):
        return F.pmod(F.col(c), F.lit(5)).cast("bigint").alias("org_id")
    inv, _, _ = invoices(spark, folder)
    out = campaign.org_dashboard(
        _kpis(spark, folder), inv.select(org("org_id"), "status", "total"), table(spark, folder, "customer").select(org("c_nationkey")),
        table(spark, folder, "nation").select(org("n_nationkey")), table(spark, folder, "supplier").select(org("s_nationkey")))
    return out.withColumns({c: F.col(c).cast("double") for c in ("committed_spend", "outstanding")})


@query("i4_effective_status", over(SHORTLIST, """
  SELECT id, CASE WHEN status IN ('confirmed','submitted') AND id IN (SELECT cc_id FROM pm) THEN 'live' ELSE status END AS status FROM cc"""))
def effective_status(spark, folder):
    return campaign.effective_status(shortlist(spark, folder)[1], post_metrics(spark, folder)).select("id", "status")


@query("i5_unbilled", over(SHORTLIST, "SELECT campaign_id, count(*) AS creators FROM cc WHERE NOT billed AND status IN ('confirmed','submitted','live','completed') GROUP BY 1"))
def unbilled(spark, folder):
    return billing.unbilled(shortlist(spark, folder)[1])


ISSUED = """, due AS (SELECT campaign_id, count(*) AS qty FROM cc WHERE NOT billed AND status IN ('confirmed','submitted','live','completed') GROUP BY 1),
  orgs AS (SELECT n_nationkey AS org_id, CASE WHEN n_nationkey % 2 = 1 THEN 300 + n_nationkey END AS fee FROM nation),
  old AS (SELECT s_nationkey % 5 AS org_id, count(*) AS issued FROM supplier GROUP BY 1),
  b AS (SELECT c.*, qty, CAST(coalesce(fee, 499) AS DECIMAL(18,2)) AS unit_price, coalesce(issued, 0) + row_number() OVER (PARTITION BY c.org_id ORDER BY c.id) AS place
        FROM campaigns c JOIN due ON campaign_id = c.id LEFT JOIN orgs o ON o.org_id = c.org_id LEFT JOIN old ON old.org_id = c.org_id WHERE c.status IN ('active','completed'))"""


def _bills(spark, folder):
    campaigns, creators = shortlist(spark, folder)
    nation = F.col("n_nationkey").cast("bigint")
    orgs = table(spark, folder, "nation").select(nation.alias("org_id"), F.when(every(nation, 2, 1), 300 + nation).alias("fee_per_creator"))
    org = F.pmod("s_nationkey", F.lit(5)).cast("bigint")
    old = table(spark, folder, "supplier").select(
        org.alias("org_id"), F.concat(F.lit("CA-2024-"), F.lpad(org.cast("string"), 3, "0"), F.lit("-"), "s_suppkey").alias("number"))
    return creators, billing.billing_run(campaigns, creators, orgs, old, F.lit("2024-03-01").cast("timestamp_ntz"))


@query("i6_billing_run", over(SHORTLIST + ISSUED, """
  SELECT id AS campaign_id, 'CA-2024-' || lpad(CAST(org_id AS VARCHAR), 3, '0') || '-' || lpad(CAST(place AS VARCHAR), 4, '0') AS number, qty, CAST(unit_price AS DOUBLE) AS unit_price,
         CAST(unit_price * qty AS DOUBLE) AS subtotal, CAST(round(unit_price * qty * 0.18, 2) AS DOUBLE) AS tax, CAST(unit_price * qty + round(unit_price * qty * 0.18, 2) AS DOUBLE) AS total,
         CAST('2024-03-08' AS TIMESTAMP) AS due_at, 'Platform service fee — ' || name || ' (' || qty || ' confirmed creator' || CASE WHEN qty = 1 THEN '' ELSE 's' END || ')' AS description FROM b"""))
def billing_run(spark, folder):
    _, bills = _bills(spark, folder)
    return bills.select("campaign_id", "number", "qty", *[F.col(c).cast("double").alias(c) for c in ("unit_price", "subtotal", "tax", "total")], "due_at", "description")


@query("i6_mark_billed", over(SHORTLIST + ISSUED, """
  SELECT cc.id, billed OR (cc.campaign_id IN (SELECT id FROM b) AND status IN ('confirmed','submitted','live','completed')) AS billed FROM cc"""))
def mark_billed(spark, folder):
    creators, bills = _bills(spark, folder)
    return billing.mark_billed(creators, bills).select("id", "billed")


@query("i7_receivables", over(INVOICES, """,
  q AS (SELECT invoice_id, sum(qty) AS n FROM lines GROUP BY 1)
  SELECT org_id, count(*) AS invoices, CAST(coalesce(sum(total) FILTER (WHERE status = 'issued'), 0) AS DOUBLE) AS outstanding,
         CAST(coalesce(sum(total) FILTER (WHERE status = 'issued' AND due_at < CAST('1998-06-01' AS TIMESTAMP)), 0) AS DOUBLE) AS overdue,
         CAST(coalesce(sum(total) FILTER (WHERE status = 'paid'), 0) AS DOUBLE) AS paid, CAST(coalesce(sum(n) FILTER (WHERE status <> 'void'), 0) AS BIGINT) AS creators_billed
  FROM inv LEFT JOIN q ON invoice_id = id GROUP BY 1""".replace(",\n  q AS", ", q AS", 1)))
def receivables(spark, folder):
    inv, lines, _ = invoices(spark, folder)
    out = billing.receivables(inv, lines, F.lit("1998-06-01").cast("timestamp_ntz"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("outstanding", "overdue", "paid")})


@query("i7_pending_campaigns", over(SHORTLIST + ISSUED, "SELECT c.id AS campaign_id, c.org_id, qty AS creators FROM campaigns c JOIN due ON campaign_id = c.id WHERE status = 'active'"))
def pending_campaigns(spark, folder):
    return billing.pending_campaigns(*shortlist(spark, folder))


@query("i8_performance", over(SHORTLIST, """
  SELECT campaign_id, id, status, CAST(fee AS DOUBLE) AS fee, views, est_views, CAST(CASE WHEN views IS NOT NULL THEN engagements END AS BIGINT) AS engagements,
         round(CASE WHEN views > 0 THEN 100.0 * CAST(engagements AS DOUBLE) / views END, 1) AS er, round(CASE WHEN views > 0 AND fee > 0 THEN CAST(fee AS DOUBLE) / views END, 2) AS fee_per_view FROM results WHERE committed"""))
def performance(spark, folder):
    _, creators = shortlist(spark, folder)
    return campaign.performance(creators, post_metrics(spark, folder)).withColumn("fee", F.col("fee").cast("double"))


@query("i9_progress", over(KPI, """
  SELECT id, CAST(coalesce(round(CASE WHEN creators > 0 THEN 100.0 * CAST(committed AS DOUBLE) / creators END), 0) AS INTEGER) AS confirmed_percent,
         CAST(coalesce(least(100, round(CASE WHEN budget > 0 THEN 100.0 * CAST(committed_spend AS DOUBLE) / CAST(budget AS DOUBLE) END)), 0) AS INTEGER) AS spent_percent FROM k"""))
def progress(spark, folder):
    return campaign.progress(_kpis(spark, folder)).select("id", "confirmed_percent", "spent_percent")


@query("i10_invoice_documents", over(INVOICES, """
  SELECT id, org_id, status, (SELECT count(*) FROM lines WHERE invoice_id = inv.id) AS n_lines, coalesce((SELECT CAST(sum(qty) AS BIGINT) FROM lines WHERE invoice_id = inv.id), 0) AS qty,
         CASE WHEN status = 'paid' THEN CAST(total AS DOUBLE) ELSE 0 END AS paid FROM inv"""))
def invoice_documents(spark, folder):
    docs = billing.invoice_documents(*invoices(spark, folder))
    line, zero = F.col("part") == "line", F.lit(0).cast("bigint")
    return docs.groupBy("id", "org_id", "status").agg(
        F.count_if(line).alias("n_lines"), F.coalesce(F.sum(F.when(line, F.col("qty"))), zero).alias("qty"),
        F.coalesce(F.sum(F.when(F.col("part") == "payment", F.col("amount"))).cast("double"), F.lit(0.0)).alias("paid"))


@query("i11_mapping_accuracy", "SELECT count(*) FILTER (WHERE c_custkey % 10 > 0) AS correct, count(*) AS rows FROM customer")
def mapping_accuracy(spark, folder):
    """Every tenth row was mapped to another account; every fourth is expected to be rejected."""
    k = F.col("c_custkey")
    expected = F.when(~every(k, 4), F.col("c_name"))
    rows = table(spark, folder, "customer")
    return campaign.mapping_accuracy(
        rows.select(k.alias("row_number"), expected.alias("expected_account_id")),
        rows.select(k.alias("row_number"), F.when(every(k, 10), F.lit("other")).otherwise(expected).alias("account_id")))


#: rows of the sheets of which every fifth is expected to be another account, next to what a cleaning run makes of them
TRUTH = SHEET_ROWS + """,
got AS (SELECT row_id, CASE WHEN reject IS NULL THEN platform || ':' || key END AS account_id, c_custkey FROM keyed),
judged AS (SELECT row_id, CASE WHEN c_custkey % 5 = 0 THEN 'instagram:cust' || c_custkey ELSE account_id END AS expected_account_id, account_id FROM got)"""


def _judged(spark, folder):
    batches, staging = sheet(spark, folder)
    rows = cut_lineage(clean.clean_rows(staging, batches))
    got = rows.select(F.col("row_id").alias("row_number"), F.when(F.col("reject").isNull(), F.col("account_id")).alias("account_id"))
    k = F.floor(F.pmod("row_number", F.lit(1 << 40)) / 2)
    truth = got.select("row_number", F.when(every(k, 5), F.concat(F.lit("instagram:cust"), k.cast("string"))).otherwise(F.col("account_id")).alias("expected_account_id"))
    return truth, got


@query("i11_run_accuracy", over(TRUTH, """
  SELECT count(*) FILTER (WHERE expected_account_id IS NOT DISTINCT FROM account_id) AS correct, count(*) AS rows FROM judged"""))
def run_accuracy(spark, folder):
    """Accounts and rejections of a cleaning run of all sheets against expected ones."""
    return campaign.mapping_accuracy(*_judged(spark, folder))


@query("i11_mapping_misses", over(TRUTH, """
  SELECT row_id AS row_number, expected_account_id, account_id FROM judged WHERE expected_account_id IS DISTINCT FROM account_id"""))
def mapping_misses(spark, folder):
    """The rows of that run that are not as expected."""
    return campaign.mapping_misses(*_judged(spark, folder))
