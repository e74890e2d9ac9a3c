"""SQL text shared by the oracle queries: the bindings of ``bindings.py`` as common table expressions."""

LETTERS = "translate(substr(md5(CAST({k} AS VARCHAR)), 1, {n}), '0123456789', 'ghijklmnop')"
CODE = LETTERS.format(k="c_custkey", n=8)
NICHE = ("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Food' WHEN 'MACHINERY' THEN 'Tech' WHEN 'FURNITURE' THEN 'Home & Garden' "
         "WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'BUILDING' THEN 'Lifestyle' END")

BASE = f"""
spend AS (
  SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend,
         max(o_orderdate) AS last_order FROM orders GROUP BY 1),
bought AS (
  SELECT o_custkey, sum(l_quantity) AS avg_views, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS er,
         list_sort(list(DISTINCT p_name)) AS tags, list_sort(list(DISTINCT p_brand)) AS brands
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
facts AS (
  SELECT c_custkey AS k, c_nationkey AS nk, c_name, n_name, r_name, last_order, er, avg_views, tags, brands,
         CASE WHEN c_acctbal >= 0 THEN CAST(floor(spend / n_orders / 10) AS BIGINT) END AS rate,
         CAST(floor(CASE c_nationkey % 5 WHEN 0 THEN spend * 5 WHEN 1 THEN spend WHEN 2 THEN spend / 10 WHEN 3 THEN spend / 100
                    ELSE spend / 1000 END) AS BIGINT) AS followers,
         list_filter([{NICHE}, CASE c_custkey % 6 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Gaming' WHEN 2 THEN 'Music'
                      WHEN 3 THEN 'Fashion' WHEN 4 THEN 'Comedy' END], lambda x: x IS NOT NULL) AS cats,
         list_filter(['instagram', CASE WHEN c_custkey % 3 = 0 THEN 'youtube' END,
                      CASE WHEN c_custkey % 5 = 0 THEN 'tiktok' END], lambda x: x IS NOT NULL) AS platforms,
         (['Hindi','English','Hinglish','Marathi','Tamil','Telugu','Kannada','Malayalam','Bengali','Gujarati','Punjabi',
           'Odia','Assamese','Urdu','Bhojpuri'])[c_nationkey % 15 + 1] AS tongue
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN spend s ON c_custkey = s.o_custkey LEFT JOIN bought b ON c_custkey = b.o_custkey),
base AS (
  SELECT k, 'cr_' || k AS creator_id, c_name AS name, lower(replace(c_name, '#', '_')) AS handle,
         CASE WHEN k % 17 = 0 THEN 'brand_media' ELSE 'person' END AS entity_type, platforms,
         CASE WHEN k % 6 = 0 THEN 'youtube' ELSE 'instagram' END AS primary_platform, followers,
         followers * len(platforms) AS total_followers, er, avg_views, rate AS rate_reel,
         CAST(floor(CAST(rate AS DOUBLE) * CAST(0.4 AS DOUBLE)) AS BIGINT) AS rate_story, CASE WHEN k % 3 = 0 THEN rate * 2 END AS rate_video,
         CASE WHEN k % 13 <> 0 THEN n_name END AS city, CASE WHEN k % 13 <> 0 THEN r_name END AS region,
         CASE WHEN k % 11 <> 0 THEN CAST(18 + k % 40 AS INTEGER) END AS age,
         CASE WHEN k % 2 = 0 THEN 'Female' WHEN k % 4 = 1 THEN 'Male' END AS gender,
         CASE WHEN k % 19 = 0 THEN CAST([] AS VARCHAR[]) ELSE cats END AS categories, tags, brands,
         CASE WHEN k % 7 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 2 = 0 AND tongue <> 'English' THEN [tongue, 'English']
              ELSE [tongue] END AS languages,
         coalesce(er > 5.5, false) AS suspicious_er, CASE WHEN k % 3 = 0 THEN 'youtube_api' ELSE 'csv_import' END AS stats_source,
         last_order AS stats_as_of, CAST(len(platforms) AS BIGINT) AS n_accounts
  FROM facts)"""

PROFILE = BASE + """,
banded AS (
  SELECT *, coalesce(categories[1], 'Uncategorised') AS niche,
         CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age IS NOT NULL THEN '45+' END AS age_band,
         CASE WHEN followers < 10000 THEN 'Nano' WHEN followers < 100000 THEN 'Micro' WHEN followers < 1000000 THEN 'Mid-tier'
              WHEN followers < 10000000 THEN 'Macro' WHEN followers IS NOT NULL THEN 'Mega' END AS size_tier,
         CASE WHEN rate_reel < 10000 THEN 'Under ₹10K' WHEN rate_reel < 50000 THEN '₹10K-50K' WHEN rate_reel < 200000 THEN '₹50K-2L'
              WHEN rate_reel < 1000000 THEN '₹2L-10L' WHEN rate_reel IS NOT NULL THEN '₹10L+' END AS budget_tier,
         CASE WHEN avg_views > 0 THEN CAST(rate_reel AS DOUBLE) / avg_views END AS cpv FROM base),
tier AS (SELECT size_tier AS st, median(er) AS med FROM banded WHERE size_tier IS NOT NULL GROUP BY 1),
p AS (
  SELECT b.*, er / med AS er_vs_tier, CASE WHEN er / med <= 0.75 THEN 'Low' WHEN er / med <= 1.3 THEN 'Typical'
         WHEN er / med IS NOT NULL THEN 'High' END AS engagement
  FROM banded b LEFT JOIN tier ON size_tier = st)"""

ACCOUNTS = f"""
src AS (SELECT *, {CODE} AS code, 'nat' || chr(97 + c_nationkey) || 'x' AS tail, {NICHE} AS niche,
               upper(substr({CODE}, 1, 1)) || substr({CODE}, 2) AS named FROM customer),
acc AS (
  SELECT 'instagram:' || code || tail AS account_id, 'instagram' AS platform, code || tail AS platform_key, code || tail AS handle,
         CAST(NULL AS VARCHAR) AS channel_id, named || ' Nat' || substr(tail, 4) AS name_clean, code || tail AS name_key,
         code || tail AS handle_core, * FROM src
  UNION ALL SELECT 'threads:' || code || tail, 'threads', code || tail, code || tail, NULL, named || ' Nat' || substr(tail, 4),
         code || tail, code || tail, * FROM src WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'youtube:UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22), 'youtube', 'UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22),
         NULL, 'UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22), named || ' Tv', code || 'tv', '', * FROM src WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'tiktok:' || code || '_7', 'tiktok', code || '_7', code || '_7', NULL, named, code, code, * FROM src WHERE c_custkey % 7 = 0),
accounts AS (
  SELECT account_id, platform, platform_key, handle, channel_id, name_clean, name_key, handle_core,
         CAST(floor(abs(c_acctbal) * (length(platform) - 5)) AS BIGINT) AS followers,
         CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 90 AS DOUBLE) / 10 END AS er_pct,
         CASE WHEN platform <> 'youtube' THEN 'NATION_' || c_nationkey END AS city,
         CASE WHEN platform <> 'tiktok' THEN CAST(18 + c_custkey % 40 AS INTEGER) END AS age, [niche] AS categories,
         CASE WHEN c_custkey % 17 = 0 THEN 'brand_media' ELSE 'person' END AS entity_type,
         CASE WHEN platform = 'tiktok' THEN ['name_from_handle'] ELSE CAST([] AS VARCHAR[]) END AS flags,
         CASE WHEN platform = 'youtube' THEN 'youtube_api' ELSE 'csv_import' END AS stats_source,
         c_custkey AS row_id, CAST(c_nationkey + 1 AS BIGINT) AS batch_id FROM acc)"""

SHORTLIST = """
cc AS (
  SELECT c_custkey AS id, CAST(floor(c_custkey / 25) AS BIGINT) AS campaign_id, 'cr_' || c_custkey AS creator_id, c_name AS name,
         (['shortlisted','contacted','negotiating','confirmed','submitted','live','completed','dropped'])[c_custkey % 8 + 1] AS status,
         CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS quoted_fee,
         CASE WHEN c_custkey % 3 = 0 THEN abs(CAST(c_acctbal AS DECIMAL(18,2))) END AS agreed_fee,
         CAST(c_custkey % 500 AS DOUBLE) AS est_views, c_custkey % 4 = 0 AS billed FROM customer),
campaigns AS (
  SELECT campaign_id AS id, campaign_id % 5 AS org_id, 'Campaign ' || campaign_id AS name,
         (['draft','active','completed','cancelled'])[campaign_id % 4 + 1] AS status,
         CAST(campaign_id * 100 + 1000 AS DECIMAL(18,2)) AS budget FROM (SELECT DISTINCT campaign_id FROM cc)),
pm AS (
  SELECT event_id AS id, user_id AS cc_id, CAST(floor(user_id / 25) AS BIGINT) AS campaign_id, ts AS recorded_at,
         CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS views,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS likes,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) - 10 END AS comments,
         CAST(1 AS BIGINT) AS shares, CAST(NULL AS BIGINT) AS saves, event_type AS source FROM events),
latest AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY cc_id ORDER BY id DESC) = 1),
results AS (
  SELECT cc.*, l.views, l.likes, l.comments, l.shares, l.saves, coalesce(agreed_fee, quoted_fee, 0) AS fee,
         coalesce(l.likes, 0) + coalesce(l.comments, 0) + coalesce(l.shares, 0) + coalesce(l.saves, 0) AS engagements,
         status IN ('confirmed','submitted','live','completed') AS committed, status IN ('live','completed') AS on_air
  FROM cc LEFT JOIN latest l ON l.cc_id = cc.id)"""

INVOICES = """
inv AS (
  SELECT o_orderkey AS id, c_nationkey AS org_id, CASE o_orderstatus WHEN 'O' THEN 'issued' WHEN 'F' THEN 'paid' ELSE 'void' END AS status,
         o_orderdate AS issued_at, o_orderdate + INTERVAL 7 DAY AS due_at, CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS id, CAST(l_quantity AS BIGINT) AS qty,
                 CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)"""


def over(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"
