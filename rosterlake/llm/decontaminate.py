"""Benchmark decontamination (native): windows of benchmark words that stand in training documents.

A window is ``window`` consecutive words of an item, or the whole item when it has fewer. A window of w words covers, wherever
it stands, one whole block of ceil(w/2) words that begins at a multiple of that block length, so only such blocks of a document
are looked up in the hash set of item grams; the words around the few blocks found are then cut into windows and compared as text,
so hash collisions change nothing. The set is broadcast up to ``MOST_BROADCAST`` grams and joined by shuffle beyond that.

Null texts and texts without words have no words and no hits. Documents equal in id and text are looked up once and returned as
often as they occur. Items repeated under one id count once; windows of items without an id hit, but such items are not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import table, words_of

WINDOW = 10
#: hashes of 8 bytes, windows of about 100: at most a few hundred MB
MOST_BROADCAST = 2_000_000


def _gram(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(w, gram, items): every distinct window, its word count and the sorted ids of the items that hold it, as strings."""
    worded = (items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
              .where(F.size("words") > 0).withColumn("w", F.least(F.size("words"), F.lit(window))))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("w") + 1)
    each = worded.select("item", "w", "words", F.explode(starts).alias("start"))
    return (each.select("item", "w", _gram(F.col("words"), F.col("start"), F.col("w")).alias("gram")).distinct()
            .groupBy("w", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _lookup(df: DataFrame, known: DataFrame, on: list[str], rows: int, how: str) -> DataFrame:
    """Join to ``known``, broadcast where its counted rows allow it."""
    return df.join(F.broadcast(known) if rows <= MOST_BROADCAST else known, on, how)


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, hits, items): one row per document.

    ``hits`` are the windows found as (start, w), words counted from 0 and in order; ``items`` the sorted ids of the items found.
    """
    windows = item_windows(items, item_id, item_text, window)
    sizes = {r["w"]: r["n"] for r in windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), words_of(F.col(text)).alias("words"))
    docs = docs.withColumn("n_words", F.size("words"))
    whole = F.struct(F.lit(0).alias("w"), F.lit(0).alias("start"), F.lit(None).cast("long").alias("block"), F.lit("").alias("around"))
    groups = [F.array(whole)]
    for w in sizes:
        b = (w + 1) // 2
        blocks = F.sequence(F.lit(0), F.col("n_words") - b, F.lit(b))
        found = F.transform(blocks, lambda at: F.struct(
            F.lit(w).alias("w"), F.greatest(at - (w - b), F.lit(0)).alias("start"),
            F.xxhash64(_gram(F.col("words"), at + 1, F.lit(b))).alias("block"),
            _gram(F.col("words"), F.greatest(at - (w - b), F.lit(0)) + 1,
                  at + w - F.greatest(at - (w - b), F.lit(0))).alias("around")))
        groups.append(F.when(F.col("n_words") >= b, found).otherwise(F.array().cast(
            "array<struct<w:int,start:int,block:bigint,around:string>>")))
    placed = docs.select("doc_id", F.xxhash64("text").alias("_t"), "n_words", F.explode(F.concat(*groups)).alias("_b"))
    placed = placed.select("doc_id", "_t", "n_words", "_b.*")
    grams = windows.select("w", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("w") - F.floor((F.col("w") + 1) / 2).cast("int")),
        lambda i: F.xxhash64(_gram(F.split("gram", " "), i + 1, F.floor((F.col("w") + 1) / 2).cast("int"))))).alias("block"))
    grams = grams.distinct().withColumn("_known", F.lit(True))
    n = sum(sizes.values())
    near = _lookup(placed, grams, ["w", "block"], n * (window // 2 + 1), "left").where((F.col("w") == 0) | F.col("_known"))
    around = F.split("around", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size(around) - F.col("w")), lambda i: F.struct(
        (F.col("start") + i).alias("start"), _gram(around, i + 1, F.col("w")).alias("gram")))
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("gram")))
    tried = near.select("doc_id", "_t", "n_words", "w", F.explode(F.when(F.col("w") == 0, none).when(
        F.size(around) >= F.col("w"), cut).otherwise(F.slice(none, 1, 0))).alias("_g")).select("doc_id", "_t", "n_words", "w", "_g.*")
    hit = _lookup(tried, windows, ["w", "gram"], n, "left").where((F.col("w") == 0) | F.col("items").isNotNull())
    return (hit.groupBy("doc_id", "_t").agg(
                F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("w") == 0).alias("_n"),
                F.array_sort(F.collect_set(F.when(F.col("w") > 0, F.struct("start", "w")))).alias("hits"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .select("doc_id", F.col("_t").alias("text_hash"), "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).drop("_i"))


def hit_words(hits: Column) -> Column:
    """How many words the windows of ``hits`` cover together."""
    def step(acc, h):
        end = h["start"] + h["w"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(end - F.greatest(h["start"], acc["end"]), F.lit(0))).alias("n"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")


def keep_clean(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``df`` in which no window of ``items`` stands, columns unchanged."""
    found = contamination(df, items, doc_id, text, **names).where(F.size("hits") > 0).select(
        F.col("doc_id").alias("_found"), F.col("text_hash").alias("_hash")).distinct()
    same = df[doc_id].eqNullSafe(F.col("_found")) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == F.col("_hash"))
    return df.join(found, same, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item_id, words, least(len(words), 10) AS w, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, w, array_to_string(words[s:s + w - 1], ' ') AS gram FROM bw),
sizes AS (SELECT DISTINCT w FROM win),
dw AS (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS s FROM d, sizes WHERE len(words) >= w),
hits AS (SELECT doc_id, s, w, item_id FROM (SELECT doc_id, s, w, array_to_string(words[s:s + w - 1], ' ') AS gram FROM dw) JOIN win USING (w, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + w)) AS p FROM (SELECT DISTINCT doc_id, s, w FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.listed, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op6_decontaminate", SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("hits"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
