"""Entity resolution on customers read as accounts of several platforms."""

from pyspark.sql import functions as F

from rosterlake.operators import clean, enrich, pairing, profile, report, resolve
from rosterlake.plans.bindings import accounts, every, profiles, sheet, shortlist, table
from rosterlake.plans.catalog import query
from rosterlake.plans.cleaning_queries import SHEET_ROWS
from rosterlake.plans.sql import ACCOUNTS, PROFILE, SHORTLIST, over
from rosterlake.session import cut_lineage


@query("c1_resolve_channel_keys", over(SHEET_ROWS, """
  SELECT row_id, CASE WHEN hit THEN 'youtube:UCres' || c_custkey ELSE platform || ':' || key END AS account_id,
         CASE WHEN hit THEN platform || ':' || key END AS renamed_from,
         CASE WHEN hit THEN 'yt_resolved_via_api' WHEN key LIKE '@%' THEN 'yt_handle_needs_resolution' END AS flag
  FROM (SELECT *, key LIKE '@%' AND c_custkey % 10 <> 3 AS hit FROM keyed WHERE reject IS NULL)"""))
def resolve_channel_keys(spark, folder):
    batches, staging = sheet(spark, folder)
    k = F.col("c_custkey").cast("string")
    answers = table(spark, folder, "customer").select(
        F.concat(F.lit("handle:cust"), k).alias("input_key"), F.when(~every(F.col("c_custkey"), 10, 3), F.concat(F.lit("UCres"), k)).alias("channel_id"),
        F.when(every(F.col("c_custkey"), 10, 3), "not_found").otherwise("resolved").alias("status"))
    rows = resolve.resolve_keys(clean.accepted(clean.clean_rows(staging, batches)), answers)
    state = F.filter("flags", lambda f: f.startswith("yt_"))
    return rows.select("row_id", "account_id", "renamed_from", F.try_element_at(state, F.lit(1)).alias("flag"))


DECISIONS = """
log AS (SELECT least(o_custkey, o_custkey % 97) AS a, greatest(o_custkey, o_custkey % 97) AS b, o_orderkey AS seq, o_orderdate AS decided_at,
               CASE o_orderstatus WHEN 'F' THEN 'linked' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status FROM orders WHERE o_custkey <> o_custkey % 97)"""


def _decision_log(spark, folder):
    o = table(spark, folder, "orders")
    near = F.pmod("o_custkey", F.lit(97))
    a, b = F.least("o_custkey", near), F.greatest("o_custkey", near)
    return o.where(F.col("o_custkey") != near).select(
        F.concat_ws("|", a.cast("string"), b.cast("string")).alias("pair_id"), a.cast("string").alias("account_a"), b.cast("string").alias("account_b"),
        F.lit("cross_platform_fuzzy").alias("kind"), F.lit(0.8).alias("score"), F.array(F.lit("as reviewed")).alias("reasons"),
        F.when(F.col("o_orderstatus") == "F", "linked").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending").alias("status"),
        F.lit("reviewer").alias("decided_by"), F.col("o_orderdate").alias("decided_at"), F.col("o_orderkey").alias("seq"))


@query("c2_carry_decisions", over(DECISIONS, """,
  last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY decided_at DESC, seq DESC) = 1),
  moved AS (SELECT CASE WHEN a % 5 = 0 THEN a + 1 ELSE a END AS x, CASE WHEN b % 5 = 0 THEN b + 1 ELSE b END AS y, status,
                   CASE WHEN a % 5 = 0 OR b % 5 = 0 THEN 1 ELSE 0 END AS moved FROM last),
  named AS (SELECT least(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) AS account_a, greatest(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) AS account_b, status, moved FROM moved),
  firsts AS (SELECT *, min(moved) OVER (PARTITION BY account_a, account_b) AS first FROM named)
  SELECT account_a, account_b, status, count(*) AS n FROM firsts WHERE moved = first GROUP BY ALL""".replace(",\n  last", ", last", 1)))
def carry_decisions(spark, folder):
    from rosterlake.operators.latest import latest_per_key
    log = latest_per_key(_decision_log(spark, folder), ["pair_id"], ["decided_at", "seq"])
    old = F.col("c_custkey")
    renames = table(spark, folder, "customer").where(every(old, 5)).select(
        old.cast("string").alias("old_id"), (old + 1).cast("string").alias("new_id"))
    moved = resolve.carry_decisions(log, renames)
    return moved.groupBy("account_a", "account_b", "status").agg(F.count(F.lit(1)).alias("n"))


BLOCKS = ACCOUNTS + """,
keys AS (SELECT DISTINCT account_id, unnest(list_concat(
           CASE WHEN length(name_key) >= 4 THEN ['p:' || left(name_key, 5), 's:' || right(name_key, 5)] ELSE CAST([] AS VARCHAR[]) END,
           CASE WHEN length(handle_core) >= 4 THEN ['p:' || left(handle_core, 5), 's:' || right(handle_core, 5)] ELSE CAST([] AS VARCHAR[]) END)) AS block FROM accounts),
sizes AS (SELECT block, count(*) AS members FROM keys GROUP BY 1)"""


@query("c3_block_sizes", over(BLOCKS, "SELECT block, members FROM sizes"))
def block_sizes(spark, folder):
    blocked = accounts(spark, folder).select(pairing.block_keys(F.col("name_key"), F.col("handle_core")).alias("blocks"))
    return pairing.block_sizes(blocked)


#: every pair that shares a block with its evidence and similarities; the common subsequence is counted with one bit a character
LIKENESS = """,
met AS (SELECT DISTINCT x.account_id AS ia, y.account_id AS ib FROM keys x JOIN keys y ON x.block = y.block AND x.account_id < y.account_id),
facts AS (
  SELECT account_id, platform, handle, name_key, handle_core, categories, nullif(city, '') AS city, age,
         array_to_string(list_sort(string_split(lower(name_clean), ' ')), ' ') AS words FROM accounts),
shown AS (
  SELECT a.account_id AS account_a, b.account_id AS account_b, a.platform = b.platform AS same_platform, coalesce(a.city <> b.city, false) AS cities_differ,
         coalesce(abs(a.age - b.age) > 4, false) AS ages_differ, coalesce(a.city = b.city, false) AS same_city, a.city AS city_a, b.city AS city_b,
         a.age AS age_a, b.age AS age_b, length(a.handle_core) >= 4 AND a.handle_core = b.handle_core AS exact, coalesce(a.handle = b.handle, false) AS same_handle,
         list_sort(list_intersect(a.categories, b.categories)) AS shared,
         CAST(len(list_intersect(a.categories, b.categories)) AS DOUBLE) / len(list_distinct(list_concat(a.categories, b.categories))) AS overlap,
         a.platform AS pa, b.platform AS pb, a.handle_core AS ca, b.handle_core AS cb, a.name_key AS ka, b.name_key AS kb, a.words AS wa, b.words AS wb
  FROM met JOIN facts a ON a.account_id = ia JOIN facts b ON b.account_id = ib),
weighed AS (
  SELECT *, CAST(cities_differ AS INTEGER) + CAST(ages_differ AS INTEGER) AS contrary,
         exact AND same_handle AND NOT same_platform AND pa IN ('instagram', 'threads') AND pb IN ('instagram', 'threads') AS mirrored FROM shown),
open AS (
  SELECT * FROM weighed WHERE mirrored OR CASE WHEN same_platform THEN contrary = 0 AND least(length(ka), length(kb)) >= 6 ELSE contrary < 2 END),
texts AS (
  SELECT ca AS x, cb AS y FROM open UNION SELECT ka, kb FROM open UNION SELECT wa, wb FROM open UNION SELECT ka, cb FROM open UNION SELECT kb, ca FROM open),
bits AS (
  SELECT x, y, (CAST(1 AS BIGINT) << length(x)) - 1 AS whole, list_transform(string_split(y, ''), lambda c: CAST(list_sum(list_transform(
    range(length(x)), lambda i: CASE WHEN substr(x, i + 1, 1) = c THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS marks FROM texts WHERE x <> '' AND y <> ''),
likeness AS (
  SELECT x, y, CAST(200 AS DOUBLE) * (length(x) - bit_count(list_reduce(list_prepend(whole, marks), lambda r, m: ((r + (r & m)) | (r - (r & m))) & whole)))
         / (length(x) + length(y)) AS sim FROM bits),
similar_pairs AS (
  SELECT o.*, coalesce(h.sim, 0) AS handle_sim, greatest(n.sim, coalesce(k.sim, 0)) AS name_sim, greatest(coalesce(p.sim, 0), coalesce(q.sim, 0)) AS cross_sim
  FROM open o LEFT JOIN likeness h ON h.x = ca AND h.y = cb LEFT JOIN likeness n ON n.x = wa AND n.y = wb LEFT JOIN likeness k ON k.x = ka AND k.y = kb
  LEFT JOIN likeness p ON p.x = ka AND p.y = cb LEFT JOIN likeness q ON q.x = kb AND q.y = ca)"""

KEPT = """,
summed AS (
  SELECT *, greatest(handle_sim, cross_sim) / 100 AS hand,
         0.5 * (greatest(handle_sim, cross_sim) / 100) + 0.35 * name_sim / 100 + 0.15 * overlap - 0.2 * contrary AS plain FROM similar_pairs),
raised AS (SELECT *, CASE WHEN exact THEN greatest(plain, 0.9 - 0.2 * contrary) ELSE plain END AS raw FROM summed),
kept AS (
  SELECT * FROM raised WHERE mirrored OR CASE WHEN same_platform THEN name_sim >= 92
    ELSE raw >= 0.72 AND (exact OR hand >= 0.7 OR name_sim >= 95 AND same_city) END)"""

SCORED = """
SELECT account_a || '|' || account_b AS pair_id, account_a, account_b,
  CASE WHEN mirrored THEN 'ig_threads_same_handle' WHEN same_platform THEN 'same_platform_similar'
       WHEN exact AND name_sim >= 90 AND contrary = 0 THEN 'cross_platform_exact_handle_and_name' WHEN exact THEN 'cross_platform_exact_handle' ELSE 'cross_platform_fuzzy' END AS kind,
  CASE WHEN mirrored THEN CAST(1 AS DOUBLE) WHEN same_platform THEN name_sim / 100 * 0.9 ELSE CAST(printf('%.3f', raw) AS DOUBLE) END AS score,
  CASE WHEN mirrored THEN 'identical handle on Instagram and Threads (Threads uses the Instagram username)'
       WHEN same_platform THEN 'same platform, names ' || printf('%.0f', name_sim) || '% similar - two accounts of one creator, a fan page, or a brand network?'
       ELSE array_to_string(list_filter([
         CASE WHEN exact THEN 'identical handle core ''' || ca || '''' END, CASE WHEN same_city THEN 'same city (' || city_a || ')' END,
         CASE WHEN cities_differ THEN 'but different cities (' || city_a || ' vs ' || city_b || ')' WHEN ages_differ THEN 'but ages differ (' || age_a || ' vs ' || age_b || ')'
              WHEN handle_sim >= 80 THEN 'handles ' || printf('%.0f', handle_sim) || '% similar' END,
         CASE WHEN cross_sim >= 85 AND NOT exact THEN 'name matches the other account''s handle (' || printf('%.0f', cross_sim) || '%)' END,
         CASE WHEN name_sim >= 80 THEN 'names ' || printf('%.0f', name_sim) || '% similar' END,
         CASE WHEN len(shared) > 0 THEN 'shared categories: ' || array_to_string(shared, ', ') END], lambda r: r IS NOT NULL), '; ') END AS reasons FROM kept"""

#: the same accounts with one common end of all long names and handles, so that most of them share a single block
CROWDED = BLOCKS.replace("acc AS (", "own AS (").replace("accounts AS (", """acc AS (
  SELECT * REPLACE (regexp_replace(name_key, 'nat.x$', 'zonex') AS name_key, regexp_replace(handle_core, 'nat.x$', 'zonex') AS handle_core) FROM own),
accounts AS (""")


@query("c4_candidate_pairs", over(BLOCKS + LIKENESS + KEPT, "SELECT account_a, account_b FROM kept"))
def candidate_pairs(spark, folder):
    """Pairs that share a block of any size and that the rules accept."""
    return resolve.find_candidates(accounts(spark, folder)).select("account_a", "account_b")


@query("c5_scored_pairs", over(BLOCKS + LIKENESS + KEPT, SCORED))
def scored_pairs(spark, folder):
    """Scores, kinds and reasons of all candidate pairs."""
    return resolve.find_candidates(accounts(spark, folder)).withColumn("reasons", F.array_join("reasons", "; "))


@query("c5_crowded_pairs", over(CROWDED + LIKENESS + KEPT, SCORED))
def crowded_pairs(spark, folder):
    """Scores of accounts most of which share one block."""
    acc = accounts(spark, folder).withColumns({c: F.regexp_replace(c, "nat.x$", "zonex") for c in ("name_key", "handle_core")})
    return resolve.find_candidates(acc).withColumn("reasons", F.array_join("reasons", "; "))


@query("c5_safe_links", over(ACCOUNTS, """
  SELECT i.account_id AS account_a, t.account_id AS account_b, CAST(1.0 AS DOUBLE) AS score FROM accounts i JOIN accounts t
  ON i.handle = t.handle AND i.platform = 'instagram' AND t.platform = 'threads'"""))
def safe_links(spark, folder):
    """Pairs linked because both networks show the same handle."""
    scored = resolve.find_candidates(accounts(spark, folder))
    return scored.where(F.col("kind") == "ig_threads_same_handle").select("account_a", "account_b", "score")


@query("c6_c7_decision_status", over(DECISIONS, """,
  last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY decided_at DESC, seq DESC) = 1),
  rule AS (SELECT DISTINCT least(c_custkey, c_custkey % 97) AS a, greatest(c_custkey, c_custkey % 97) AS b, c_custkey % 2 = 0 AS safe FROM customer WHERE c_custkey <> c_custkey % 97),
  human AS (SELECT a, b, status FROM last WHERE status <> 'pending')
  SELECT coalesce(r.a, h.a) || '|' || coalesce(r.b, h.b) AS pair_id, coalesce(h.status, CASE WHEN safe THEN 'auto_linked' ELSE 'pending' END) AS status,
         CASE WHEN h.status IS NOT NULL THEN 'reviewer' WHEN safe THEN 'rule' END AS decided_by
  FROM rule r FULL OUTER JOIN human h ON r.a = h.a AND r.b = h.b""".replace(",\n  last", ", last", 1)))
def decision_status(spark, folder):
    k, near = F.col("c_custkey"), F.pmod("c_custkey", F.lit(97))
    a, b = F.least(k, near).cast("string"), F.greatest(k, near).cast("string")
    scored = table(spark, folder, "customer").where(k != near).select(
        F.concat_ws("|", a, b).alias("pair_id"), a.alias("account_a"), b.alias("account_b"),
        F.when(every(k, 2), "ig_threads_same_handle").otherwise("cross_platform_fuzzy").alias("kind"), F.lit(0.9).alias("score"),
        F.array(F.lit("rule")).alias("reasons"))
    return resolve.apply_decisions(scored, _decision_log(spark, folder)).select("pair_id", "status", "decided_by")


def _runs(spark, folder):
    """Orders linked to the next order when both have one status."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("next_status"))
    code = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    nodes = o.select(code.alias("account_id"))
    edges = o.join(after, "o_orderkey").where(F.col("o_orderstatus") == F.col("next_status")).select(
        code.alias("account_a"), F.lpad((F.col("o_orderkey") + 1).cast("string"), 12, "0").alias("account_b"))
    return nodes, edges


RUNS = """
runs AS (SELECT o_orderkey, sum(starts) OVER (ORDER BY o_orderkey) AS run FROM (
  SELECT o_orderkey, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) = o_orderstatus AND lag(o_orderkey) OVER (ORDER BY o_orderkey) = o_orderkey - 1
         THEN 0 ELSE 1 END AS starts FROM orders))"""


@query("c8_connected_groups", over(RUNS, """
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS account_id, lpad(CAST(min(o_orderkey) OVER (PARTITION BY run) AS VARCHAR), 12, '0') AS group_id FROM runs"""))
def connected_groups(spark, folder):
    return resolve.connected_groups(*_runs(spark, folder))


@query("c9_creator_ids", "SELECT c_custkey, 'cr_' || substr(sha1('instagram:' || c_name), 1, 10) AS creator_id FROM customer")
def creator_ids(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", resolve.creator_id(F.concat(F.lit("instagram:"), "c_name")).alias("creator_id"))


@query("c10_fold_channels", over(ACCOUNTS, """
  SELECT account_id, CASE WHEN channel_id IS NOT NULL AND categories[1] <> 'Food' AND row_id % 2 = 0 THEN categories[1] || '>Food' ELSE categories[1] END AS categories,
         CASE WHEN channel_id IS NOT NULL AND row_id % 2 = 0 THEN CASE WHEN row_id % 4 = 0 THEN 'IN' END END AS country,
         CASE WHEN channel_id IS NOT NULL AND row_id % 2 = 0 THEN 'chan' || row_id ELSE handle END AS handle,
         CASE WHEN channel_id IS NOT NULL AND row_id % 2 = 0 THEN 'chan' ELSE handle_core END AS handle_core FROM accounts"""))
def fold_channels(spark, folder):
    acc = accounts(spark, folder).withColumn("country", F.lit(None).cast("string"))
    k = F.col("c_custkey")
    channels = table(spark, folder, "customer").where(every(k, 2)).select(
        F.concat(F.lit("UC"), F.substring(F.md5(k.cast("string")), 1, 22)).alias("channel_id"),
        F.array(F.lit("https://en.wikipedia.org/wiki/Food")).alias("topic_categories"), F.when(every(k, 4), "IN").alias("country"),
        F.concat(F.lit("@Chan"), k.cast("string")).alias("custom_url"))
    return enrich.fold_channels(acc, channels).select("account_id", F.array_join("categories", ">").alias("categories"), "country", "handle", "handle_core")


@query("c11_scope_to_batches", over(ACCOUNTS, """
  SELECT 'cr_' || row_id AS creator_id, account_id FROM accounts WHERE row_id IN (SELECT row_id FROM accounts WHERE batch_id IN (2, 3, 5))"""))
def scope_to_batches(spark, folder):
    acc = accounts(spark, folder)
    links = acc.select(F.concat(F.lit("cr_"), F.col("row_id").cast("string")).alias("creator_id"), "account_id")
    return profile.in_batches(links, acc.select("account_id", "batch_id"), [2, 3, 5])


@query("c12_exclude_members", over(PROFILE + "," + SHORTLIST, """
  SELECT creator_id, followers FROM p WHERE creator_id NOT IN (SELECT creator_id FROM cc WHERE status <> 'shortlisted')"""))
def exclude_members(spark, folder):
    _, members = shortlist(spark, folder)
    return profile.without(profiles(spark, folder), members.where(F.col("status") != "shortlisted")).select("creator_id", "followers")


PAIRS = ACCOUNTS + """,
mirror AS (SELECT i.account_id AS account_a, t.account_id AS account_b, i.name_clean AS name_a, t.name_clean AS name_b, i.followers AS followers_a, t.followers AS followers_b
  FROM accounts i JOIN accounts t ON i.handle = t.handle AND i.platform = 'instagram' AND t.platform = 'threads')"""


def _mirrors(acc):
    a = acc.where(F.col("platform") == "instagram").select(F.col("account_id").alias("account_a"), "handle")
    b = acc.where(F.col("platform") == "threads").select(F.col("account_id").alias("account_b"), "handle")
    return a.join(b, "handle").select(F.concat_ws("|", "account_a", "account_b").alias("pair_id"), "account_a", "account_b",
                                      F.lit("ig_threads_same_handle").alias("kind"), F.lit(1.0).alias("score"), F.lit("auto_linked").alias("status"))


@query("c13_review_queue", over(PAIRS, """
  SELECT account_a || '|' || account_b AS pair_id, 'auto_linked' AS status, name_a AS name_clean_a, name_b AS name_clean_b, followers_a, followers_b FROM mirror"""))
def review_queue(spark, folder):
    acc = accounts(spark, folder)
    return resolve.review_queue(_mirrors(acc), acc, "auto_linked").select(
        "pair_id", "status", "name_clean_a", "name_clean_b", "followers_a", "followers_b")


@query("c14_pair_history", over(PAIRS, """
  SELECT account_a || '|' || account_b AS pair_id FROM mirror WHERE account_a IN (SELECT account_id FROM accounts WHERE batch_id = 4)
  OR account_b IN (SELECT account_id FROM accounts WHERE batch_id = 4)"""))
def pair_history(spark, folder):
    acc = accounts(spark, folder)
    links = acc.select(F.concat(F.lit("cr_"), F.col("batch_id").cast("string")).alias("creator_id"), "account_id")
    return resolve.pair_history(_mirrors(acc), links, "cr_4").select("pair_id")


@query("c15_lineage", over(ACCOUNTS, """
  SELECT account_id, row_id, 'sheet_' || lower(n_name) || '.csv' AS file_name FROM accounts JOIN nation ON n_nationkey + 1 = batch_id"""))
def lineage(spark, folder):
    acc = accounts(spark, folder)
    batches, _ = sheet(spark, folder)
    staging = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") + 1).cast("bigint").alias("batch_id"), F.lit(1).alias("row_number"),
        F.create_map(F.lit("name"), F.col("c_name")).alias("raw"))
    return report.lineage(acc.select("account_id", "row_id"), staging, batches).select("account_id", "row_id", "file_name")


@query("c16_channel_report", over(ACCOUNTS, """
  SELECT 'UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22) AS channel_id, c_mktsegment AS title, account_id, followers
  FROM customer LEFT JOIN accounts ON channel_id = 'UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22)"""))
def channel_report(spark, folder):
    channels = table(spark, folder, "customer").select(
        F.concat(F.lit("UC"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 22)).alias("channel_id"), F.col("c_mktsegment").alias("title"))
    return report.channel_report(channels, accounts(spark, folder)).select("channel_id", "title", "account_id", "followers")


ROLLED = ACCOUNTS + """,
m AS (SELECT *, 'cr_' || row_id // 5 AS creator_id, row_number() OVER (PARTITION BY row_id // 5 ORDER BY followers DESC, account_id) AS place FROM accounts),
cats AS (SELECT creator_id, string_agg(c, '>' ORDER BY first) AS categories FROM (SELECT creator_id, categories[1] AS c, min(place) AS first FROM m GROUP BY ALL) GROUP BY 1),
rolled AS (SELECT creator_id, coalesce(arg_min(name_clean, place) FILTER (WHERE platform <> 'tiktok'), arg_min(name_clean, place)) AS display_name,
  CASE WHEN bool_or(entity_type = 'brand_media') THEN 'brand_media' ELSE 'person' END AS entity_type, arg_min(account_id, place) AS primary_account_id,
  array_to_string(list_sort(list(DISTINCT platform)), '>') AS platforms, count(*) AS n_accounts, CAST(sum(followers) AS BIGINT) AS total_followers FROM m GROUP BY 1)"""


def _members(spark, folder):
    return accounts(spark, folder).withColumn("creator_id", F.concat(F.lit("cr_"), F.floor(F.col("row_id") / 5).cast("string")))


@query("d5_roll_up_creators", over(ROLLED, "SELECT rolled.*, categories FROM rolled JOIN cats USING (creator_id)"))
def roll_up_creators(spark, folder):
    return resolve.roll_up_creators(_members(spark, folder)).withColumns(
        {"platforms": F.array_join("platforms", ">"), "categories": F.array_join("categories", ">")})


@query("d6_creator_counts", over(ROLLED, "SELECT count(*) AS creators, count(*) FILTER (WHERE n_accounts > 1) AS multi_platform_creators FROM rolled"))
def creator_counts(spark, folder):
    return resolve.creator_counts(resolve.roll_up_creators(_members(spark, folder)))


@query("c_resolve_end_to_end")
def resolve_end_to_end(spark, folder):
    """Blocking, scoring, linking and roll-up of all accounts."""
    acc = accounts(spark, folder)
    found = cut_lineage(resolve.find_candidates(acc).withColumn(
        "status", F.when(F.col("kind").isin(*resolve.SAFE_KINDS), "auto_linked").otherwise("pending")))
    creators, _ = resolve.build_creators(acc, found)
    return creators.withColumns({"platforms": F.array_join("platforms", ">"), "categories": F.array_join("categories", ">")})
