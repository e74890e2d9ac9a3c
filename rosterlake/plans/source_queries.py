"""File layer, landed payloads, exports and streams, fed from the tables."""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import functions as F

from rosterlake.functions.refs import platform_from_file_name
from rosterlake.operators import campaign, clean, enrich
from rosterlake.operators.latest import latest_per_key
from rosterlake.operators.scale import shuffled
from rosterlake.plans.bindings import accounts, base_profiles, every, post_metrics, sheet, table
from rosterlake.plans.catalog import query
from rosterlake.plans.library_queries import ISSUES, _issues
from rosterlake.plans.sql import ACCOUNTS, PROFILE, SHORTLIST, over
from rosterlake.session import scratch_folder
from rosterlake.sources import export, files, landed
from rosterlake.streaming import feeds


#: rows of a sheet that is read whole
SMALL_SHEET = 2000


def _document_files(spark, folder):
    """Every document as the bytes of a file."""
    return table(spark, folder, "documents").select(
        F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".csv"))).alias("file_name"),
        F.encode("text", "UTF-8").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))


@query("a1_a6_ingest_rows", """
  WITH f AS (SELECT DISTINCT text, string_split(text, chr(10)) AS l FROM documents)
  SELECT sha256(text) AS file_sha256, CAST(len(list_filter(l[2:], lambda x: x <> '')) AS BIGINT) AS row_count,
         CAST(len(list_filter(l[2:], lambda x: x <> '')) AS BIGINT) AS last_row FROM f""")
def ingest_rows(spark, folder):
    """Whole documents parsed as sheets: rows are numbered per file and identical files are read once."""
    rows = files.parse_rows(files.fingerprinted(_document_files(spark, folder)))
    return rows.groupBy("file_sha256").agg(F.count_if(F.col("row_number") > 0).alias("row_count"), F.max("row_number").alias("last_row"))


@query("a2_content_hashes", """
  SELECT sha256(text) AS file_sha256, min(source || '_' || lang || '_' || doc_id || '.csv') AS file_name FROM documents GROUP BY 1""")
def content_hashes(spark, folder):
    return files.fingerprinted(_document_files(spark, folder)).select("file_sha256", "file_name")


@query("a2_skip_known_content", """
  SELECT DISTINCT sha256(text) AS file_sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')""")
def skip_known(spark, folder):
    docs = table(spark, folder, "documents")
    known = docs.where(F.col("lang") == "en").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("file_sha256")).distinct()
    return files.not_seen(files.fingerprinted(_document_files(spark, folder)), known).select("file_sha256")


@query("a3_decode", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode(spark, folder):
    """Texts written in three encodings and read back."""
    docs = table(spark, folder, "documents")
    latin = F.encode(F.when(~F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]"), F.col("text")), "ISO-8859-1")
    data = F.when(every(F.col("doc_id"), 3), F.encode("text", "UTF-16")).when(every(F.col("doc_id"), 3, 1) & latin.isNotNull(), latin).otherwise(F.encode("text", "UTF-8"))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts of a few files at once
                part = batch.slice(at, 256)
                texts = pa.array([files.decode(c.as_py()) for c in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["doc_id", "text"])
    read_back = docs.select(F.col("doc_id").cast("bigint"), data.alias("content")).mapInArrow(read, "doc_id bigint, text string")
    return read_back.select("doc_id", F.md5("text").alias("text_md5"))


@query("a4_platform_hints", """
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'youtube' WHEN 2 THEN 'instagram' WHEN 3 THEN 'instagram' WHEN 4 THEN NULL ELSE 'threads' END AS hint FROM pages""")
def platform_hints(spark, folder):
    n = F.col("page_id").cast("string")
    name = (F.when(every(F.col("page_id"), 6), F.concat(F.lit("TikTok_list_"), n)).when(every(F.col("page_id"), 6, 1), F.concat(F.lit("drop_YT_"), n))
            .when(every(F.col("page_id"), 6, 2), F.concat(F.lit("ig_"), n)).when(every(F.col("page_id"), 6, 3), F.concat(F.lit("my insta "), n))
            .when(every(F.col("page_id"), 6, 4), F.concat(F.lit("list_"), n, F.lit("_yt"))).otherwise(F.concat(F.lit("yt_threads_"), n)))
    return table(spark, folder, "pages").select("page_id", platform_from_file_name(F.concat(name, F.lit(".csv"))).alias("hint"))


@query("a5_register_batches", """
  SELECT CAST((n_nationkey) + 1 AS BIGINT) AS batch_id, 'sheet_' || lower(n_name) || '.csv' AS file_name, count(c_custkey) AS row_count, CAST(13 AS INTEGER) AS n_columns
  FROM nation LEFT JOIN (SELECT c_custkey, (c_nationkey + again) % 25 AS b FROM customer JOIN (VALUES (0), (1)) t(again) ON again = 0 OR c_custkey % 8 = 0) ON b = n_nationkey GROUP BY ALL""")
def register_batches(spark, folder):
    batches, _ = sheet(spark, folder)
    return batches.select("batch_id", "file_name", "row_count", F.size("columns").alias("n_columns"))


@query("a1_large_files", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, true AS same FROM documents")
def large_files(spark, folder):
    """Whole documents written as sheets with quoted line breaks and quotes, read by byte ranges and by whole files."""
    place = f"{scratch_folder(spark)}/sheets-{uuid4().hex}"
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the big files, and the same rows in files of the size that is read whole
    for form, most in (("big", 0), ("small", SMALL_SHEET)):
        docs.write.option("maxRecordsPerFile", most).csv(
            f"{place}/{form}", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    _, ranged = files.large_csv(spark, f"{place}/big", 1)
    whole = files.parse_rows(files.read_drop(spark, f"{place}/small")).where(F.col("row_number") > 0)
    mine = ranged.select(F.col("raw")["doc_id"].alias("doc_id"), F.md5(F.col("raw")["text"]).alias("text_md5"))
    other = whole.select(F.col("raw")["doc_id"].alias("doc_id"), F.md5(F.col("raw")["text"]).alias("other_md5"))
    return mine.join(other, "doc_id", "left").select("doc_id", "text_md5", F.coalesce(F.col("text_md5") == F.col("other_md5"), F.lit(False)).alias("same"))


@query("a5_ingested_batches", """
  WITH f AS (SELECT text, min(source || '_' || lang || '_' || doc_id || '.csv') AS file_name FROM documents GROUP BY 1)
  SELECT row_number() OVER (ORDER BY file_name, sha256(text)) AS batch_id, file_name, CAST(len(list_filter(string_split(text, chr(10))[2:], lambda x: x <> '')) AS BIGINT) AS row_count,
         CAST(len(list_filter(string_split(text, chr(10))[2:], lambda x: x <> '')) AS BIGINT) AS staged FROM f""")
def ingested_batches(spark, folder):
    """Whole documents imported as files: registered once per content, numbered by name, their rows staged."""
    batches, rows = files.ingest(files.fingerprinted(_document_files(spark, folder)), F.lit("2024-01-01").cast("timestamp"))
    staged = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("staged"))
    return batches.join(staged, "batch_id", "left").select("batch_id", "file_name", "row_count", F.coalesce("staged", F.lit(0)).alias("staged"))


@query("a7_kept_originals", """
  SELECT sha256(text) AS file_sha256, min(source || '_' || lang || '_' || doc_id || '.csv') AS file_name, sha256(text) AS content_sha256 FROM documents GROUP BY text""")
def kept_originals(spark, folder):
    """Untouched copies of whole documents, one per content, read back."""
    place = f"{scratch_folder(spark)}/originals-{uuid4().hex}"
    files.keep_originals(files.fingerprinted(_document_files(spark, folder)), place)
    return spark.read.parquet(place).select("file_sha256", "file_name", F.sha2("content", 256).alias("content_sha256"))


@query("s1_staged_drops", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def staged_drops(spark, folder):
    """Customers dropped as sheets and picked up by the file stream in two runs; the second finds the same contents again and some new ones."""
    place = f"{scratch_folder(spark)}/drops-{uuid4().hex}"
    own = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for run, rows in enumerate((own.where(F.col("c_custkey") % 2 == 0), own)):
        halves = rows.withColumn("half", F.col("c_custkey") % 2).repartition("half").sortWithinPartitions("half", "c_custkey")
        halves.write.partitionBy("half").csv(f"{place}/in/run={run}", header=True)
        feeds.stage_drops(feeds.watch_drops(spark, f"{place}/in"), f"{place}/lake", f"{place}/progress").awaitTermination()
    staged = spark.read.parquet(f"{place}/lake/staging_rows")
    return staged.select(*[F.col("raw")[c].alias(c) for c in own.columns])


@query("a6_dense_row_numbers", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS row_number FROM pages")
def dense_row_numbers(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return files.dense_index(pages, [F.col("url"), F.col("page_id")], "row_number").select("page_id", "row_number")


@query("a8_remove_batch", over(ACCOUNTS, "SELECT account_id FROM accounts WHERE batch_id <> 4"))
def remove_batch(spark, folder):
    (kept,) = files.without_batch(4, accounts(spark, folder))
    return kept.select("account_id")


@query("a9a_staging_layer", over(ISSUES, """
  SELECT row_id, 'sheet_' || lower(n_name) || '.csv' AS file_name, '{"id":"' || account_id || '"}' AS raw,
         CASE WHEN row_id % 3 = 0 THEN array_to_string(list_sort([issue, 'duplicate_row']), '; ') WHEN row_id % 3 = 1 THEN issue END AS issues
  FROM issues JOIN nation ON n_nationkey + 1 = batch_id"""))
def staging_layer(spark, folder):
    """Every source row with none, one or two issues of any severity."""
    issues = _issues(spark, folder)
    batches, _ = sheet(spark, folder)
    staging = issues.select("row_id", "batch_id", F.lit(1).alias("row_number"), F.create_map(F.lit("id"), F.col("account_id")).alias("raw"))
    said = F.when(every(F.col("row_id"), 3), F.array(F.col("issue"), F.lit("duplicate_row"))).when(every(F.col("row_id"), 3, 1), F.array("issue"))
    found = issues.select("row_id", F.explode(said).alias("issue"))
    return export.staging_layer(staging, batches, found).select("row_id", "file_name", "raw", "issues")


@query("a9b_account_layer", over(ACCOUNTS, "SELECT account_id, followers, CASE WHEN row_id % 2 = 0 THEN 'cr_' || row_id END AS creator_id FROM accounts"))
def account_layer(spark, folder):
    acc = accounts(spark, folder)
    links = acc.where(every(F.col("row_id"), 2)).select("account_id", F.concat(F.lit("cr_"), F.col("row_id").cast("string")).alias("creator_id"))
    return export.account_layer(acc, links).select("account_id", "followers", "creator_id")


@query("a9c_creator_layer", over(ACCOUNTS, """
  SELECT 'cr_' || row_id AS creator_id, CAST(sum(followers) AS BIGINT) AS total_followers, string_agg(account_id, ' | ' ORDER BY account_id) AS accounts FROM accounts GROUP BY 1"""))
def creator_layer(spark, folder):
    acc = accounts(spark, folder).withColumn("creator_id", F.concat(F.lit("cr_"), F.col("row_id").cast("string")))
    creators = acc.groupBy("creator_id").agg(F.sum("followers").alias("total_followers"))
    return export.creator_layer(creators, acc.select("creator_id", "account_id"))


@query("a9d_rejected_layer", over(ISSUES, """SELECT row_id, issue, '{"id":"' || account_id || '"}' AS raw FROM issues WHERE severity = 'rejected'"""))
def rejected_layer(spark, folder):
    issues = _issues(spark, folder)
    return export.rejected_layer(issues, issues.select("row_id", F.create_map(F.lit("id"), F.col("account_id")).alias("raw")))


@query("a9e_review_layer", over(ACCOUNTS, """
  SELECT i.account_id AS account_a, t.account_id AS account_b, i.name_clean AS name_a, t.name_clean AS name_b, '["same handle"]' AS reasons
  FROM accounts i JOIN accounts t ON i.handle = t.handle AND i.platform = 'instagram' AND t.platform = 'threads'"""))
def review_layer(spark, folder):
    acc = accounts(spark, folder)
    a = acc.where(F.col("platform") == "instagram").select(F.col("account_id").alias("account_a"), "handle")
    b = acc.where(F.col("platform") == "threads").select(F.col("account_id").alias("account_b"), "handle")
    pairs = a.join(shuffled(b), "handle").select("account_a", "account_b", F.lit("auto_linked").alias("status"), F.lit("mirror").alias("kind"), F.lit(1.0).alias("score"),
                                       F.array(F.lit("same handle")).alias("reasons"), F.lit("rule").alias("decided_by"), F.lit(None).cast("timestamp").alias("decided_at"))
    return export.review_layer(pairs, acc).select("account_a", "account_b", "name_a", "name_b", "reasons")


@query("a9f_snapshot_layer", "SELECT user_id AS account_id, ts AS fetched_at, event_id AS staging_row_id FROM events")
def snapshot_layer(spark, folder):
    return export.snapshot_layer(table(spark, folder, "events").select(F.col("user_id").alias("account_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("staging_row_id")))


@query("a9_a16_written_layers", over(PROFILE, """
  SELECT creator_id, name, CAST(followers AS VARCHAR) AS followers, CAST(to_json(categories) AS VARCHAR) AS categories FROM base WHERE followers IS NOT NULL"""))
def written_layers(spark, folder):
    """Profiles written as CSV with a byte-order mark and read back."""
    # real exports name their own folder
    place = f"{scratch_folder(spark)}/export-{uuid4().hex}"
    shown = base_profiles(spark, folder).where(F.col("followers").isNotNull()).select("creator_id", "name", "followers", "categories")
    export.write_layers({"creators": shown}, place)
    back = spark.read.csv(f"{place}/creators", header=True, quote='"', escape='"')
    return back.select(F.col(back.columns[0]).alias("creator_id"), "name", "followers", "categories")


def _layers(spark, folder):
    """The layers of an export, each over the whole tables."""
    return {"staging": staging_layer(spark, folder), "accounts": account_layer(spark, folder), "creators": creator_layer(spark, folder),
            "rejected": rejected_layer(spark, folder), "review": review_layer(spark, folder), "snapshots": snapshot_layer(spark, folder), "channels": channels(spark, folder)}


@query("a9_all_layers", over(ACCOUNTS, """
  SELECT 'staging' AS layer, count(*) AS rows, count(*) AS read_back FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'accounts', count(*), count(*) FROM accounts UNION ALL SELECT 'creators', count(DISTINCT row_id), count(DISTINCT row_id) FROM accounts
  UNION ALL SELECT 'rejected', count(*), count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'review', count(*), count(*) FROM accounts i JOIN accounts t ON i.handle = t.handle AND i.platform = 'instagram' AND t.platform = 'threads'
  UNION ALL SELECT 'snapshots', count(*), count(*) FROM events UNION ALL SELECT 'channels', count(*), count(*) FROM customer"""))
def all_layers(spark, folder):
    """All layers written in one export, with the rows counted while writing and those read back."""
    place = f"{scratch_folder(spark)}/export-{uuid4().hex}"
    written = export.write_layers(_layers(spark, folder), place)
    back = None
    for name in written:
        rows = spark.read.csv(f"{place}/{name}", header=True, quote='"', escape='"', multiLine=True).agg(F.count(F.lit(1)).alias("read_back")).select(
            F.lit(name).alias("layer"), F.lit(written[name]).cast("bigint").alias("rows"), "read_back")
        back = rows if back is None else back.unionByName(rows)
    return back


@query("a15_preview", """
  SELECT c_custkey * 2 + again AS row_number, CAST(12 AS INTEGER) AS mapped, c_custkey % 3 AS kind
  FROM customer JOIN (VALUES (0), (1)) t(again) ON again = 0 OR c_custkey % 8 = 0 ORDER BY (c_nationkey + again) % 25, row_number LIMIT 8""")
def preview(spark, folder):
    batches, staging = sheet(spark, folder)
    k = F.floor(F.col("row_number") / 2)
    return clean.preview(staging, batches, 8).select("row_number", F.size("mapping").alias("mapped"), F.pmod(k, F.lit(3)).alias("kind"))


def _channel_answers(spark, folder):
    """Customers as landed channel answers: an older and a newer one each."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    medium = F.when(every(k, 2), F.struct(F.concat(F.lit("https://img.example.com/m/"), text).alias("url")))
    item = F.struct(
        F.concat(F.lit("UC"), text).alias("id"),
        F.struct(F.concat_ws(" ", "c_name", F.col("v").cast("string")).alias("title"), F.concat(F.lit("@Chan"), text).alias("customUrl"), F.lit("IN").alias("country"),
                 F.struct(medium.alias("medium"), F.struct(F.concat(F.lit("https://img.example.com/d/"), text).alias("url")).alias("default")).alias("thumbnails")).alias("snippet"),
        F.struct(F.when(~every(k, 9), (k * 10 + F.col("v")).cast("string")).alias("subscriberCount"), (k * 100).cast("string").alias("viewCount"),
                 F.lit("7").alias("videoCount"), every(k, 5).alias("hiddenSubscriberCount")).alias("statistics"),
        F.struct(F.struct(F.concat(F.lit("UU"), text).alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"),
        F.struct(F.array(F.lit("https://en.wikipedia.org/wiki/Food")).alias("topicCategories")).alias("topicDetails"))
    versions = table(spark, folder, "customer").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    return versions.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"),
                           F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("v"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).alias("fetched_at"))


@query("a10_channels", """
  SELECT 'UC' || c_custkey AS channel_id, c_name || ' 2' AS title, 'https://img.example.com/' || CASE WHEN c_custkey % 2 = 0 THEN 'm/' ELSE 'd/' END || c_custkey AS thumbnail_url,
         'UU' || c_custkey AS uploads_playlist, c_custkey % 5 = 0 AS subscribers_hidden, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 10 + 2 END AS subscribers, CAST('2024-01-02' AS TIMESTAMP) AS fetched_at FROM customer""")
def channels(spark, folder):
    return landed.channels(_channel_answers(spark, folder)).select("channel_id", "title", "thumbnail_url", "uploads_playlist", "subscribers_hidden", "subscribers", "fetched_at")


def _video_answers(spark, folder):
    """Events as landed video answers, one answer per user and day with all its events as items."""
    stats = F.struct(F.floor("value").cast("string").alias("viewCount"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).alias("likeCount"),
                     F.when(every(F.col("event_id"), 4), F.lit("")).otherwise("3").alias("commentCount"))
    item = F.struct(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("id"),
                    F.struct(F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"), stats.alias("statistics"))
    return table(spark, folder, "events").select(F.concat(F.lit("UC"), F.col("user_id").cast("string")).alias("channel_id"),
                                                 F.to_json(F.struct(F.array(item).alias("items"))).alias("body"), F.col("ts").alias("fetched_at"))


@query("a11_videos", """
  SELECT 'v' || event_id AS video_id, 'UC' || user_id AS channel_id, event_type AS title, CAST(floor(value) AS BIGINT) AS views,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS likes, CASE WHEN event_id % 4 > 0 THEN CAST(3 AS BIGINT) END AS comments FROM events""")
def videos(spark, folder):
    return landed.videos(_video_answers(spark, folder)).select("video_id", "channel_id", "title", "views", "likes", "comments")


@query("a12_resolutions", """
  SELECT 'handle:c' || c_custkey AS input_key, CASE WHEN c_custkey % 3 > 0 THEN 'UC' || c_custkey END AS channel_id, CASE WHEN c_custkey % 3 > 0 THEN 'resolved' ELSE 'not_found' END AS status FROM customer""")
def resolutions(spark, folder):
    text = F.col("c_custkey").cast("string")
    none = F.array().cast("array<struct<id:string>>")
    items = F.when(every(F.col("c_custkey"), 3), none).otherwise(F.array(F.struct(F.concat(F.lit("UC"), text).alias("id"))))
    answers = table(spark, folder, "customer").select(F.lit("handle").alias("kind"), F.concat(F.lit("C"), text).alias("value"),
                                                      F.to_json(F.struct(items.alias("items"))).alias("body"), F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"))
    return landed.resolutions(answers).select("input_key", "channel_id", "status")


@query("a13_api_snapshots", """
  WITH v AS (SELECT user_id AS u, CAST(floor(value) AS BIGINT) AS views FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, 'v' || event_id) <= 10),
  m AS (SELECT u, CAST(round_even(avg(views), 0) AS DOUBLE) AS avg_views FROM v WHERE views > 0 GROUP BY 1)
  SELECT 'youtube:UC' || c_custkey AS account_id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 9 <> 0 THEN c_custkey * 10 + 2 END AS followers, avg_views, c_custkey * 100 AS total_views, CAST(7 AS BIGINT) AS media_count
  FROM customer LEFT JOIN m ON u = c_custkey""")
def api_snapshots(spark, folder):
    channel_id = F.concat(F.lit("UC"), F.col("c_custkey").cast("string"))
    owners = table(spark, folder, "customer").select(F.concat(F.lit("youtube:"), channel_id).alias("account_id"), channel_id.alias("channel_id"))
    metrics = enrich.video_metrics(landed.videos(_video_answers(spark, folder)), F.lit("2025-01-01").cast("timestamp"))
    out = landed.api_snapshots(landed.channels(_channel_answers(spark, folder)), metrics, owners)
    return out.select("account_id", "followers", "avg_views", "total_views", "media_count")


def _events_stream(spark, folder):
    """The events table as a stream of its one file."""
    source = table(spark, folder, "events")
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _drain(spark, stream):
    """Everything a stream has landed once it has seen all there is."""
    place = f"{scratch_folder(spark)}/feed-{uuid4().hex}"
    feeds.land_updates(stream, f"{place}/rows", f"{place}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(*stream.columns)


@query("s2_current_stats_stream", """
  SELECT user_id AS account_id, ts AS fetched_at, event_type AS source, CAST(floor(value * 100) AS BIGINT) AS followers FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def current_stats_stream(spark, folder):
    feed = _events_stream(spark, folder).select(F.col("user_id").alias("account_id"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("source"),
                                                F.floor(F.col("value") * 100).alias("followers"), F.col("event_id").alias("snapshot_id"))
    return latest_per_key(_drain(spark, feeds.current_stats(feed)), ["account_id"], ["fetched_at"])


@query("s3_daily_views_stream", over(SHORTLIST, """
  SELECT cc_id, CAST(recorded_at AS DATE) AS day, max(views) AS views FROM pm GROUP BY ALL"""))
def daily_views_stream(spark, folder):
    feed = _events_stream(spark, folder).select(
        F.col("user_id").alias("cc_id"), F.col("ts").cast("timestamp").alias("recorded_at"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("views"))
    return _drain(spark, feeds.daily_views(feed)).groupBy("cc_id", "day").agg(F.max("views").alias("views"))


@query("e7_daily_views", over(SHORTLIST, "SELECT campaign_id, cc_id, CAST(recorded_at AS DATE) AS day, max(views) AS views FROM pm GROUP BY ALL"))
def daily_views(spark, folder):
    return campaign.daily_views(post_metrics(spark, folder))
