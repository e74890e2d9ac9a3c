"""Cleaning rules run on text made from the tables, against what the numbers behind the text say."""

from pyspark.sql import functions as F

from rosterlake.functions import names, refs, topics, values
from rosterlake.operators import clean, report
from rosterlake.plans.bindings import every, letters, pick, profiles, sheet, table
from rosterlake.plans.catalog import query
from rosterlake.plans.sql import CODE, PROFILE, over
from rosterlake.vocab import places
from rosterlake.vocab.topics import CHANNEL_TOPICS, TOPICS


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("n"), "o_orderpriority")


def _choose(key, options):
    out = F.lit(None).cast("string")
    for i, option in reversed(list(enumerate(options))):
        out = F.when(every(key, len(options), i), option).otherwise(out)
    return out


@query("b1_map_headers", """
  SELECT b.batch_id, f.field, f.header FROM (SELECT CAST(n_nationkey + 1 AS BIGINT) AS batch_id FROM nation) b,
  (VALUES ('name','Creator Name'),('url','Profile Link'),('platform','Platform'),('followers','Followers'),('er','Engagement %'),
          ('topics','Category'),('city','City'),('age','Age'),('gender','Gender'),('languages','Language'),
          ('rate_reel','Rate per Reel (₹)'),('brands','Past Brand Collabs')) f(field, header)""")
def map_headers(spark, folder):
    batches, _ = sheet(spark, folder)
    return clean.map_headers(batches).select("batch_id", F.explode("mapping").alias("field", "header"))


@query("b2_missing_tokens", """
  SELECT o_orderpriority, CAST(o_orderkey % 6 AS BIGINT) AS form, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 6 < 4 THEN 1 ELSE 0 END) AS BIGINT) AS missing
  FROM orders GROUP BY ALL""")
def missing_tokens(spark, folder):
    k = F.col("k")
    text = _choose(k, [F.lit(" N/A "), F.lit("—"), F.lit("Null"), F.lit(""), F.col("o_orderpriority"), F.col("n").cast("string")])
    return _orders(spark, folder).groupBy("o_orderpriority", F.pmod("k", F.lit(6)).alias("form")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(values.is_missing(text)).alias("missing"))


@query("b3_counts", """
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n * 100000 WHEN 3 THEN n * 10000000 WHEN 4 THEN n * 1000000 + 500000
    WHEN 5 THEN n WHEN 6 THEN NULL ELSE NULL END AS count, o_orderkey % 8 = 6 AS unreadable
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def counts(spark, folder):
    n = F.col("n").cast("string")
    forms = [F.format_number(F.col("n"), 0), F.concat(n, F.lit("K")), F.concat(n, F.lit(" lakh")), F.concat(n, F.lit("Crore")),
             F.concat(n, F.lit(".5M followers")), F.concat(n, F.lit("+")), F.concat(F.lit("about "), n), F.lit("-")]
    df = _orders(spark, folder).withColumn("text", _choose(F.col("k"), forms)).withColumn("count", values.count_value(F.col("text")))
    return df.select(F.col("k").alias("o_orderkey"), "count", values.unreadable(F.col("text"), F.col("count")).alias("unreadable"))


@query("b4_percents", """
  SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, sum(CASE l_orderkey % 4 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d / 100.0 END) AS points,
         CAST(sum(CASE WHEN l_orderkey % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS unreadable
  FROM (SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS d FROM lineitem) GROUP BY ALL""")
def percents(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    share = F.format_string("0.%02d", "d")
    text = _choose(F.col("l_orderkey"), [F.concat(F.col("d").cast("string"), F.lit(" %")), share, share, F.concat(F.col("d").cast("string"), F.lit("d"))])
    read = line.withColumn("text", text).withColumn("points", values.percent_value(F.col("text"), F.pmod("l_orderkey", F.lit(4)) == 2))
    return read.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"), F.count_if(values.unreadable(F.col("text"), F.col("points"))).alias("unreadable"))


@query("b5_money", """
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 25000 WHEN 3 THEN n + 500 WHEN 4 THEN NULL WHEN 5 THEN NULL
         ELSE n * 100000 END AS rupees,
         CASE o_orderkey % 7 WHEN 2 THEN 'range_midpoint' WHEN 3 THEN 'range_midpoint' WHEN 4 THEN 'on_request' END AS note,
         o_orderkey % 7 = 5 AS unreadable
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def money(spark, folder):
    n = F.col("n").cast("string")
    forms = [F.concat(F.lit("₹"), F.format_number(F.col("n"), 0)), F.concat(F.lit("Rs. "), n, F.lit(" per reel")), F.lit("20-30k"),
             F.concat(n, F.lit(" to "), (F.col("n") + 1000).cast("string")), F.lit("DM for rates"), F.concat(F.lit("call "), n),
             F.concat(F.lit("INR "), n, F.lit("L"))]
    read = values.with_money(_orders(spark, folder).withColumn("text", _choose(F.col("k"), forms)), {"text": "rupees"})
    return read.select(F.col("k").alias("o_orderkey"), "rupees", F.col("rupees_note").alias("note"), F.col("rupees_unreadable").alias("unreadable"))


@query("b6_ages", """
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN a BETWEEN 13 AND 90 THEN a END WHEN 1 THEN CASE WHEN a + 5 BETWEEN 13 AND 90 THEN a + 5 END END AS age,
         c_custkey % 4 = 2 AS unreadable FROM (SELECT c_custkey, CAST(c_custkey % 100 AS INTEGER) AS a FROM customer)""")
def ages(spark, folder):
    a = F.pmod("c_custkey", F.lit(100)).cast("int")
    text = _choose(F.col("c_custkey"), [F.concat(a.cast("string"), F.lit(" yrs")), F.concat(a.cast("string"), F.lit("-"), (a + 10).cast("string")),
                                        F.lit("young"), F.lit("n/a")])
    return table(spark, folder, "customer").select("c_custkey", values.age_value(text).alias("age"), values.age_unreadable(text).alias("unreadable"))


@query("b7_lists", """
  SELECT p_partkey, p_brand || '>' || split_part(p_name, ' ', 1) || '>' || split_part(p_name, ' ', 2) AS items FROM part""")
def lists(spark, folder):
    text = F.concat(F.col("p_brand"), F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("/"), F.col("p_brand"), F.lit(";; "))
    return table(spark, folder, "part").select("p_partkey", F.array_join(values.split_list(text), ">").alias("items"))


@query("b8_name_and_handle", """
  SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 <> 2 THEN 'c.' || c_custkey END AS handle FROM customer""")
def name_and_handle(spark, folder):
    at = F.concat(F.lit("@c."), F.col("c_custkey").cast("string"))
    text = F.concat_ws(" ", "c_name", F.when(~every(F.col("c_custkey"), 3, 2), at))
    name, handle = names.split_name_handle(F.concat(F.lit(" "), text, F.lit("  ")))
    return table(spark, folder, "customer").select("c_custkey", name.alias("name"), handle.alias("handle"))


NAME_FORMS = f"""
  SELECT c_custkey, named || CASE WHEN c_custkey % 4 = 2 THEN '' ELSE ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS name_clean,
         CASE c_custkey % 4 WHEN 0 THEN 'name_case_fixed' WHEN 1 THEN 'name_hashtags_removed,name_symbols_removed'
              WHEN 2 THEN 'name_case_fixed,name_spaced_letters_joined' ELSE '' END AS flags
  FROM (SELECT *, upper(substr({CODE}, 1, 1)) || substr({CODE}, 2) AS named FROM customer)"""


@query("b9_display_names", NAME_FORMS)
def display_names(spark, folder):
    name = F.concat(F.initcap(letters(F.col("c_custkey"))), F.lit(" "), F.initcap("c_mktsegment"))
    spaced = F.rtrim(F.regexp_replace(F.upper(letters(F.col("c_custkey"))), "(.)", "$1 "))
    text = _choose(F.col("c_custkey"), [F.upper(name), F.concat(name, F.lit(" ✨ #love_it")), spaced, F.concat(F.lit("@ "), name, F.lit(" -"))])
    df = names.with_display_name(table(spark, folder, "customer").withColumn("text", text), "text", "name_clean", "flags")
    return df.select("c_custkey", "name_clean", F.array_join("flags", ",").alias("flags"))


@query("b9_document_names")
def document_names(spark, folder):
    """Display-name cleaning over every whole document text."""
    df = names.with_display_name(table(spark, folder, "documents").select("doc_id", "text"), "text", "name_clean", "flags")
    return df.select("doc_id", F.length("name_clean").alias("length"), F.array_join("flags", ",").alias("flags"))


@query("b10_name_keys", """
  SELECT doc_id, length(regexp_replace(regexp_replace(s, '\\b(official|offl|offical|officiel|real|the|iam|im|channel)\\b', ' ', 'g'), '[^a-z0-9]', '', 'g')) AS length,
         md5(regexp_replace(regexp_replace(s, '\\b(official|offl|offical|officiel|real|the|iam|im|channel)\\b', ' ', 'g'), '[^a-z0-9]', '', 'g')) AS key_md5
  FROM (SELECT doc_id, lower(strip_accents(replace(replace(text, 'ß', ''), 'ẞ', ''))) AS s FROM documents)""".replace("\\\\", "\\"))
def name_keys(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", names.transliterate("text").alias("reading"))
    key = names.name_key(F.col("reading"))
    return df.select("doc_id", F.length(key).cast("bigint").alias("length"), F.md5(key).alias("key_md5"))


@query("b11_handle_cores", rf"""
  SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace({CODE} || '.official-' || lower(c_mktsegment) || '_' || c_custkey,
         'official|offl|offical|real|iam|tiktok', '', 'g'), '[._-]', '', 'g'), '[0-9]+$', '') AS core FROM customer""")
def handle_cores(spark, folder):
    k = F.col("c_custkey")
    text = F.concat(F.lit("@_"), F.upper(letters(k)), F.lit(".official-"), F.lower("c_mktsegment"), F.lit("_"), k.cast("string"))
    return table(spark, folder, "customer").select("c_custkey", names.handle_core(text).alias("core"))


@query("b12_profile_refs", r"""
  SELECT page_id, CASE WHEN host LIKE '%.com' THEN 'instagram' WHEN host LIKE '%.net' THEN 'tiktok' END AS platform,
         CASE WHEN host LIKE '%.com' THEN lower(first) END AS handle,
         CASE WHEN host LIKE '%.net' THEN 'tiktok_url_not_profile' WHEN host LIKE '%.org' THEN 'unknown_host' END AS note
  FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^(www\.|m\.|mobile\.)', '') AS host,
               regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]*)', 1) AS first FROM pages)""")
def profile_refs(spark, folder):
    """Link rules over the crawled addresses, with two of their hosts standing for platforms."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.lit(None).cast("string").alias("hint"))
    df = refs.with_profile_ref(pages, "url", "hint", "ref", {"example.com": "instagram", "example.net": "tiktok"})
    return df.select("page_id", "ref.platform", "ref.handle", "ref.note")


@query("b13_channel_ids", "SELECT c_custkey, c_custkey % 3 = 0 AS is_channel FROM customer")
def channel_ids(spark, folder):
    k = F.col("c_custkey")
    size = F.when(every(k, 3), 22).otherwise(20)
    text = F.concat(F.lit("UC"), F.expr("substring(md5(cast(c_custkey as string)), 1, CASE WHEN c_custkey % 3 = 0 THEN 22 ELSE 20 END)"))
    return table(spark, folder, "customer").select("c_custkey", names.is_channel_id(text).alias("is_channel"))


@query("b14_canonical_urls", """
  SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://www.instagram.com/h' || c_custkey || '/' WHEN 1 THEN 'https://www.threads.net/@h' || c_custkey
    WHEN 2 THEN 'https://www.tiktok.com/@h' || c_custkey WHEN 3 THEN 'https://www.youtube.com/@h' || c_custkey
    ELSE 'https://www.youtube.com/channel/UC' || c_custkey END AS url FROM customer""")
def canonical_urls(spark, folder):
    k = F.col("c_custkey")
    platform = pick(("instagram", "threads", "tiktok", "youtube", "youtube"), F.pmod(k, F.lit(5)))
    channel = F.when(every(k, 5, 4), F.concat(F.lit("UC"), k.cast("string")))
    return table(spark, folder, "customer").select(
        "c_custkey", refs.canonical_url(platform, F.concat(F.lit("h"), k.cast("string")), channel).alias("url"))


@query("b15_platform_text", """
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' WHEN 2 THEN 'youtube' WHEN 3 THEN 'threads' WHEN 4 THEN 'tiktok' END AS platform FROM part""")
def platform_text(spark, folder):
    text = _choose(F.col("p_partkey"), [F.lit("IG"), F.concat(F.lit("YouTube "), "p_name"), F.lit("yt"), F.lit("Threads app"),
                                        F.concat(F.col("p_name"), F.lit(" Tik Tok")), F.concat(F.lit("yt "), "p_name")])
    return table(spark, folder, "part").select("p_partkey", refs.platform_from_text(text).alias("platform"))


SHEET_ROWS = f"""
rows AS (SELECT c.*, again, CAST(CAST((c_nationkey + again) % 25 + 1 AS BIGINT) * 1099511627776 + c_custkey * 2 + again AS BIGINT) AS row_id,
                CAST(c_nationkey * 1000 + c_custkey % 1000 + 1 + 100 * again AS BIGINT) AS n,
                CASE c_custkey % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' END AS stated, 'cust' || c_custkey AS h,
                'UC' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 22) AS chan
         FROM customer c JOIN (VALUES (0), (1)) t(again) ON again = 0 OR c_custkey % 8 = 0),
placed AS (SELECT *, CASE c_custkey % 7 WHEN 0 THEN 'instagram' WHEN 1 THEN stated WHEN 2 THEN 'youtube' WHEN 3 THEN 'youtube' WHEN 5 THEN 'tiktok'
                     ELSE stated END AS platform,
                  CASE WHEN c_custkey % 7 IN (0, 1, 2, 3, 5) OR c_custkey % 4 = 1 THEN h END AS found FROM rows),
keyed AS (SELECT *, CASE WHEN platform IS NULL THEN 'platform_unknown' WHEN found IS NULL THEN 'no_account_identifier' END AS reject,
                 CASE WHEN c_custkey % 7 = 3 THEN chan WHEN platform = 'youtube' THEN '@' || found ELSE found END AS key FROM placed)"""


@query("b16_b18_identity_and_rejects", over(SHEET_ROWS, """
  SELECT row_id, CASE WHEN reject IS NULL THEN platform || ':' || key END AS account_id, reject FROM keyed"""))
def identity(spark, folder):
    batches, staging = sheet(spark, folder)
    cleaned = clean.clean_rows(staging, batches)
    return cleaned.select("row_id", F.when(F.col("reject").isNull(), F.col("account_id")).alias("account_id"), "reject")


@query("b17_account_keys", over(SHEET_ROWS, """
  SELECT platform, CASE WHEN key LIKE 'UC%' THEN 'channel' WHEN key LIKE '@%' THEN 'provisional' ELSE 'handle' END AS form, count(*) AS n
  FROM keyed WHERE reject IS NULL GROUP BY ALL"""))
def account_keys(spark, folder):
    batches, staging = sheet(spark, folder)
    key = F.col("platform_key")
    form = F.when(key.startswith("UC"), "channel").when(key.startswith("@"), "provisional").otherwise("handle")
    return clean.accepted(clean.clean_rows(staging, batches)).groupBy("platform", form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("b19_names_from_handles", over(SHEET_ROWS, """
  SELECT row_id, CASE WHEN platform = 'tiktok' THEN 'Cust' || c_custkey ELSE 'Cust' || c_custkey END AS name_clean FROM keyed
  WHERE reject IS NULL AND c_custkey % 7 <> 3"""))
def names_from_handles(spark, folder):
    """Rows whose name cell is blank take their name from the handle."""
    batches, staging = sheet(spark, folder)
    blank = staging.withColumn("raw", F.map_concat(
        F.map_filter("raw", lambda k, v: k != "Creator Name"), F.create_map(F.lit("Creator Name"), F.concat(
            F.lit("✨ "), F.regexp_extract(F.try_element_at("raw", F.lit("Creator Name")), "@[a-z0-9]+$", 0)))))
    return clean.accepted(clean.clean_rows(blank, batches)).where(
        ~F.coalesce(names.is_channel_id(F.col("channel_id")), F.lit(False))).select("row_id", "name_clean")


@query("b20_metric_flags", over(SHEET_ROWS, """
  SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([
     CASE WHEN c_custkey % 6 = 4 THEN 'followers_unparseable' END, CASE WHEN c_custkey % 6 >= 4 THEN 'followers_missing' END,
     CASE WHEN c_custkey % 3 = 1 THEN 'er_missing' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 20 > 15 THEN 'er_outlier_gt_15pct' END,
     CASE WHEN c_custkey % 4 = 2 THEN 'age_unparseable' END, CASE WHEN c_custkey % 4 = 0 THEN 'rate_reel_range_midpoint' END,
     CASE WHEN c_custkey % 4 = 2 THEN 'rate_reel_on_request' END, CASE WHEN c_custkey % 4 = 3 THEN 'rate_reel_unparseable' END,
     CASE WHEN c_custkey % 4 = 3 THEN 'topics_missing' END, CASE WHEN c_custkey % 4 = 2 THEN 'topics_unmapped_words' END,
     CASE WHEN c_custkey % 5 = 4 THEN 'city_not_in_reference_list' END], lambda x: x IS NOT NULL)) AS flag FROM keyed WHERE reject IS NULL) GROUP BY 1"""))
def metric_flags(spark, folder):
    batches, staging = sheet(spark, folder)
    flags = clean.accepted(clean.clean_rows(staging, batches)).select(F.explode("flags").alias("flag"))
    metric = "^(followers|er|age|rate|topics|city)_"
    return flags.where(F.col("flag").rlike(metric)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


PHRASES = sorted(TOPICS, key=lambda p: -len(p.split()))
_SQL_PHRASES = "|".join(p.replace("'", "''").replace(" ", "  ") for p in PHRASES)
_SQL_TOPICS = ", ".join("('" + p.replace("'", "''") + "', '" + ";".join(c) + "', '" + ";".join(t).replace("'", "''") + "')" for p, (c, t) in TOPICS.items())
_SQL_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in TOPICS) + "]"


@query("b21_topics", f"""
  WITH texts AS (SELECT c_custkey, ({_SQL_LIST})[c_custkey % {len(TOPICS)} + 1] || ' ' || lower(c_mktsegment) || ' ' || ({_SQL_LIST})[c_nationkey * 7 % {len(TOPICS)} + 1] AS text FROM customer),
  parts AS (SELECT c_custkey, unnest(list_transform(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', ' (?:{_SQL_PHRASES}|\\S+) '), lambda x: replace(trim(x), '  ', ' '))) AS part,
                   generate_subscripts(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', ' (?:{_SQL_PHRASES}|\\S+) '), 1) AS pos FROM texts),
  vocab(phrase, cats, tags) AS (VALUES {_SQL_TOPICS}),
  named AS (SELECT c_custkey, part, pos, cats FROM parts LEFT JOIN vocab ON part = phrase),
  firsts AS (SELECT c_custkey, part, min(pos) AS pos, any_value(cats) AS cats FROM named WHERE cats IS NOT NULL GROUP BY ALL)
  SELECT t.c_custkey, coalesce((SELECT string_agg(part, '>' ORDER BY pos) FROM firsts f WHERE f.c_custkey = t.c_custkey), '') AS topics,
         coalesce((SELECT string_agg(part, '>' ORDER BY pos) FROM named n WHERE n.c_custkey = t.c_custkey AND cats IS NULL AND part NOT IN ('and','the','of')), '') AS unknown
  FROM texts t""")
def split_topics(spark, folder):
    c = table(spark, folder, "customer")
    text = F.concat_ws(" ", pick(TOPICS, F.pmod("c_custkey", F.lit(len(TOPICS)))), F.lower("c_mktsegment"),
                       pick(TOPICS, F.pmod(F.col("c_nationkey") * 7, F.lit(len(TOPICS)))))
    df = topics.with_topics(c.withColumn("text", text), "text")
    return df.select("c_custkey", F.array_join("topics", ">").alias("topics"), F.array_join("unknown_topic_words", ">").alias("unknown"))


@query("b21_document_topics")
def document_topics(spark, folder):
    """Topic split over every whole document text."""
    df = topics.with_topics(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return df.select("doc_id", F.array_join("topics", ">").alias("topics"), F.array_join("categories", ">").alias("categories"),
                     F.size("unknown_topic_words").alias("unknown_words"))


_SLUGS = list(CHANNEL_TOPICS)
_SQL_SLUGS = ", ".join(f"('{s}', '{c}')" for s, c in CHANNEL_TOPICS.items())


@query("b22_channel_categories", f"""
  WITH m(slug, cat) AS (VALUES {_SQL_SLUGS}), slugs AS (SELECT [{", ".join(f"'{s}'" for s in _SLUGS)}] AS s),
  used AS (SELECT p_partkey, s[p_partkey % {len(_SLUGS)} + 1] AS a, s[p_size % {len(_SLUGS)} + 1] AS b FROM part, slugs)
  SELECT p_partkey, CASE WHEN x.cat = y.cat THEN x.cat ELSE x.cat || '>' || y.cat END AS categories
  FROM used JOIN m x ON x.slug = a JOIN m y ON y.slug = b""")
def channel_categories(spark, folder):
    head = F.lit("https://en.wikipedia.org/wiki/")
    urls = F.array(F.concat(head, pick(_SLUGS, F.pmod("p_partkey", F.lit(len(_SLUGS))))), F.concat(head, F.lit("Unlisted")),
                   F.concat(head, pick(_SLUGS, F.pmod("p_size", F.lit(len(_SLUGS))))))
    return table(spark, folder, "part").select("p_partkey", F.array_join(topics.channel_categories(urls), ">").alias("categories"))


_PLACES = list(places.CITY_NAMES)
_SQL_PLACES = ", ".join(f"('{a}', '{c}', '{places.CITY_STATE[c]}', '{places.STATE_REGION.get(places.CITY_STATE[c], '')}')" for a, c in places.CITY_NAMES.items())


@query("b23_b24_cities", f"""
  WITH m(alias, city, state, region) AS (VALUES {_SQL_PLACES}), a AS (SELECT [{", ".join(f"'{p}'" for p in _PLACES)}] AS l)
  SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'Atlan''Tis' ELSE city END AS city, CASE WHEN c_custkey % 4 <> 3 THEN state END AS state,
         CASE WHEN c_custkey % 4 <> 3 THEN nullif(region, '') END AS region,
         CASE WHEN c_custkey % 4 <> 3 AND city IN ('Mumbai','Delhi','Bengaluru','Hyderabad','Chennai','Kolkata','Pune','Ahmedabad') THEN 'Metro' ELSE 'Tier 2/3' END AS tier
  FROM customer, a JOIN m ON alias = l[c_custkey % {len(_PLACES)} + 1]""")
def cities(spark, folder):
    place = pick(_PLACES, F.pmod("c_custkey", F.lit(len(_PLACES))))
    text = _choose(F.col("c_custkey"), [F.upper(place), F.concat(F.lit(" nowhere / "), place), F.concat(place, F.lit(", India")), F.lit("atlan'tis")])
    df = table(spark, folder, "customer").withColumn("text", text).withColumn("reading", names.transliterate("text"))
    df = df.withColumn("m", topics.city_match(F.col("text"), F.col("reading")))
    return df.select("c_custkey", "m.city", "m.state", topics.region_of(F.col("m.state")).alias("region"), topics.city_tier(F.col("m.city")).alias("tier"))


@query("b25_languages", """
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Hindi>English' WHEN 1 THEN 'Bengali>Odia' ELSE '' END AS languages FROM customer""")
def languages(spark, folder):
    text = _choose(F.col("c_custkey"), [F.lit("hindi/ENG & Hindi"), F.lit("Bangla and oriya"), F.col("c_mktsegment")])
    return table(spark, folder, "customer").select("c_custkey", F.array_join(topics.language_list(text), ">").alias("languages"))


@query("b26_gender", """
  SELECT CASE c_custkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Non-binary / other' END AS gender, count(*) AS n FROM customer GROUP BY 1""")
def gender(spark, folder):
    text = _choose(F.col("c_custkey"), [F.lit(" F "), F.lit("Boy"), F.lit("NB"), F.col("c_mktsegment")])
    return table(spark, folder, "customer").groupBy(topics.gender_class(text).alias("gender")).agg(F.count(F.lit(1)).alias("n"))


@query("b27_entity_types", """
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'brand_media' WHEN 1 THEN 'brand_media' ELSE 'person' END AS entity_type,
         CASE p_partkey % 4 WHEN 0 THEN 'name contains ''records''' WHEN 1 THEN 'name ends with ''India''/''Official''' END AS reason FROM part""")
def entity_types(spark, folder):
    text = _choose(F.col("p_partkey"), [F.concat(F.col("p_name"), F.lit(" Records")), F.concat(F.col("p_name"), F.lit(" India ")),
                                        F.col("p_name"), F.lit("Official")])
    df = table(spark, folder, "part").withColumn("e", names.entity_guess(text))
    return df.select("p_partkey", F.col("e.type").alias("entity_type"), F.col("e.reason").alias("reason"))


@query("b28_countries", """
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN c_mktsegment END AS country FROM customer""")
def countries(spark, folder):
    text = _choose(F.col("c_custkey"), [F.lit("Bharat"), F.lower("c_mktsegment"), F.lit("")])
    return table(spark, folder, "customer").select("c_custkey", topics.country_code(text).alias("country"))


@query("b29_bands", over(PROFILE, """
  SELECT age_band, size_tier, budget_tier, count(*) AS n FROM banded GROUP BY ALL"""))
def bands(spark, folder):
    return profiles(spark, folder).groupBy("age_band", "size_tier", "budget_tier").agg(F.count(F.lit(1)).alias("n"))


@query("b30_flag_labels", """
  SELECT event_type AS flag, CASE event_type WHEN 'error' THEN 'No follower count' ELSE 'code_' || event_type END AS label, count(*) AS n FROM events GROUP BY ALL""")
def flag_labels(spark, folder):
    code = F.when(F.col("event_type") == "error", "followers_missing").otherwise(F.concat(F.lit("code_"), "event_type"))
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("event_type").alias("flag"), report.flag_label(code).alias("label"), "n")


@query("scalar_ago", """
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'never' WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ago' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
         WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ago' ELSE 'just now' END AS ago
  FROM (SELECT *, CAST(floor((epoch_us(CAST('2024-02-01' AS TIMESTAMP)) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS s FROM events)""")
def moments_ago(spark, folder):
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, folder, "events").select("event_id", values.ago(at, F.lit("2024-02-01").cast("timestamp_ntz")).alias("ago"))


@query("scalar_video_ids", """
  SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN substr(md5(CAST(p_partkey AS VARCHAR)), 1, 11) END AS video_id FROM part""")
def video_ids(spark, folder):
    vid = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 11)
    text = _choose(F.col("p_partkey"), [F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=3")), F.concat(F.lit("https://www.youtube.com/watch?v="), vid),
                                        F.concat(F.lit("youtube.com/shorts/"), vid), F.concat(F.lit("https://www.instagram.com/reel/"), vid)])
    return table(spark, folder, "part").select("p_partkey", refs.video_id(text).alias("video_id"))
