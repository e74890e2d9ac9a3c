"""Line dedup with a log-template tree: lines that follow a template recurring across documents are dropped.

A line descends a tree of fixed depth: by its number of tokens, then by its first ``LEADING`` tokens, fields with digits or addresses
read as ``<*>``. Within a leaf a token that fewer than ``LEAST_DOCUMENTS`` documents have at its place is a variable field and
becomes ``<*>`` too; what results is the line's template. A template recurs when enough documents have it, and a line that differs
from a recurring one in a single field belongs to it as well, from ``LEAST_TOKENS`` tokens on.

Copies of whole documents are not this operator's business, and dropping their lines would hide them from near-dedup. So a template
that ``LEAST_DOCUMENTS`` documents have is only a candidate; it recurs when it stands in ``LEAST_DOCUMENTS`` different classes of
documents, however many copies one class has. A document's class is the hash of its own lines, those of no candidate. Where own
lines make at most ``MOST_OWN`` of the text (two such texts are alike by 0.8 and up, which is near-dedup's business), its class for
a template is the rarest other candidate in it, which near copies share.

Counting works on hashes that are aggregated before they are shuffled. The texts are shuffled once, to take the lines out.

Null texts stay null, empty lines are never dropped, a text whose lines all go becomes empty. Documents are told apart by id and content
hash; rows repeated in full get the same result each and count as one document. Other columns stay as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import xor

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import free, stored, table, text_function

LEADING = 3
LEAST_DOCUMENTS = 5
#: (1 - x) / (1 + x) is the likeness of two texts with a share x of their own each: 0.8 for a ninth
MOST_OWN = 1 / 9
#: a template keeps at least this share of its tokens as they are
LEAST_FIXED = 0.8
#: lines of fewer tokens must follow a recurring template in every field
LEAST_TOKENS = 8
FIELD = "<*>"
#: a token with one of these is a field
FIELD_BYTES = b"0123456789@"
SEED = 42
#: line hashes of 8 bytes that one broadcast may hold
MOST_BROADCAST = 2_000_000


def masked_line(line: Column) -> Column:
    """A line with single blanks and with fields for tokens that hold digits or addresses."""
    blanks = F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(blanks, r"[^ ]*[0-9@][^ ]*", FIELD))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hashes(text: bytes) -> tuple:
    """The lines of a text that are not empty, masked: exclusive or of their distinct hashes, their letters, and of each its place, leaf,
    hash and letters."""
    places, leaves, lines, sizes = [], [], [], []
    for at, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        if not tokens:
            continue
        if len(line.translate(None, FIELD_BYTES)) < len(line):
            tokens = [FIELD.encode() if len(t.translate(None, FIELD_BYTES)) < len(t) else t for t in tokens]
        whole = b" ".join(tokens)
        places.append(at)
        leaves.append(_signed(xxhash.xxh64_intdigest(b"%d %s" % (len(tokens), b" ".join(tokens[:LEADING])), SEED)))
        lines.append(_signed(xxhash.xxh64_intdigest(whole, SEED)))
        sizes.append(len(whole.decode("utf-8", "replace")))
    return reduce(xor, set(lines), 0), sum(sizes), places, leaves, lines, sizes


def _placed(docs: DataFrame) -> DataFrame:
    """(id, h, whole, size, at, leaf, line, size): every line that is not empty, with the hash and size of the document's lines."""
    reader = text_function(line_hashes, "_whole long, _size long, _at array<int>, leaf array<long>, line array<long>, size array<int>")
    read = docs.select("_id", "_h", reader(F.col("_text")).alias("_l"))
    zipped = F.arrays_zip("_l._at", "_l.leaf", "_l.line", "_l.size")
    return read.select("_id", "_h", "_l._whole", "_l._size", F.explode(zipped).alias("_e")).select(
        "_id", "_h", "_whole", "_size", F.col("_e._at").alias("_at"), F.col("_e.leaf").alias("leaf"), F.col("_e.line").alias("line"), F.col("_e.size").alias("size"))


def _small(df: DataFrame, width: int = 1) -> DataFrame:
    """``df``, stored, marked for broadcast when its rows of ``width`` hashes are few enough."""
    return F.broadcast(df) if df.count() * width <= MOST_BROADCAST else df


def _place(at: Column, token: Column) -> Column:
    """Hash of a token at its place; those of all places, combined by exclusive or, are a template's key."""
    return F.xxhash64(at, token)


def _following(general: DataFrame, templates: DataFrame) -> DataFrame:
    """The lines of ``general`` that follow one of ``templates`` (leaf, key, template) or differ from one in a single field."""
    changed = F.transform("template", lambda x, i: F.col("key").bitwiseXOR(_place(i, x)).bitwiseXOR(_place(i, F.lit(FIELD))))
    one_field = templates.where(F.size("template") >= LEAST_TOKENS).select("leaf", F.explode(changed).alias("key"))
    return general.join(templates.select("leaf", "key").unionByName(one_field).distinct(), ["leaf", "key"], "left_semi")


def recurring_lines(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(line): hashes of the masked lines that follow a recurring template. ``placed``: the stored hashes of ``docs``."""
    # a document counts once however often it has the line
    seen = stored(placed.select("leaf", "line", F.xxhash64("_id", "_h").alias("_doc")).distinct()
                  .groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs")))
    busy = seen.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    lines = stored(seen.join(busy.select("leaf"), "leaf", "left_semi"))
    # one place where each line stands, so that only the documents of those places are read again
    spots = placed.join(lines.select("line"), "line", "left_semi").groupBy("line").agg(F.min(F.struct("_id", "_h", "_at")).alias("p"))
    wanted = stored(spots.groupBy(F.col("p._id").alias("_i"), F.col("p._h").alias("_g")).agg(
        F.collect_list(F.struct("line", F.col("p._at").alias("at"))).alias("_w")))
    if (wanted.agg(F.sum(F.size("_w"))).first()[0] or 0) <= MOST_BROADCAST // 2:
        wanted = F.broadcast(wanted)
    read = docs.join(wanted, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_g")))
    found = F.transform(F.array(F.split("_text", "\n")), lambda own: F.transform("_w", lambda w: F.struct(
        w["line"].alias("line"), masked_line(F.get(own, w["at"])).alias("text"))))
    texts = read.select(F.inline(F.flatten(found))).groupBy("line").agg(F.min("text").alias("text"))
    known = stored(lines.join(texts, "line"))
    tokens = known.select("leaf", "line", "docs", F.posexplode(F.split("text", " ")).alias("at", "token"))
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select(
        "leaf", "at", "token", F.lit(True).alias("fixed"))
    masked = tokens.join(fixed, ["leaf", "at", "token"], "left").withColumn("token", F.when(F.col("fixed"), F.col("token")).otherwise(FIELD))
    general = stored(masked.groupBy("leaf", "line", "docs").agg(
        F.bit_xor(_place(F.col("at"), F.col("token"))).alias("key"), F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
        .select("leaf", "line", "docs", "key", F.col("t.token").alias("template")))
    kept = F.size(F.filter("template", lambda t: t != FIELD)) / F.size("template")
    candidates = stored(general.groupBy("leaf", "key").agg(F.sum("docs").alias("n"), F.any_value("template").alias("template")).where(
        (F.col("n") >= LEAST_DOCUMENTS) & (kept >= LEAST_FIXED)))
    # lines that only follow a candidate in all but one field are not a document's own, but count for no template
    shared = stored(_following(general, candidates).select("line", "leaf", "key").join(candidates.drop("template"), ["leaf", "key"], "left").select(
        "line", F.when(F.col("n").isNotNull(), F.xxhash64("leaf", "key")).alias("k"), "n"))
    recurring = stored(_classes(placed, shared).groupBy("k").agg(F.count(F.lit(1)).alias("classes")).where(
        F.col("classes") >= LEAST_DOCUMENTS).select("k"))
    named = candidates.withColumn("k", F.xxhash64("leaf", "key")).join(recurring, "k", "left_semi")
    return _following(general, named).select("line").distinct()


def _classes(placed: DataFrame, shared: DataFrame) -> DataFrame:
    """(k, class): the classes of documents in which each candidate template stands, once each.

    ``shared``: line, k and n, the lines that follow a candidate with the template's key and documents.
    """
    docs = placed.join(_small(shared, 3), "line").groupBy("_id", "_h", "_whole", "_size").agg(
        F.collect_set(F.struct("n", "k", "line", "_at", "size")).alias("s"))
    own = F.aggregate(F.array_distinct(F.col("s.line")), F.col("_whole"), lambda s, x: s.bitwiseXOR(x))
    rest = F.col("_size") - F.aggregate(F.col("s.size"), F.lit(0), lambda s, x: s + x)
    templates = F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda x: x["k"].isNotNull()), lambda x: F.struct(
        x["n"].alias("n"), x["k"].alias("k")))))
    each = docs.select(own.alias("own"), (rest <= MOST_OWN * F.col("_size")).alias("copy"), templates.alias("t")).select(
        "own", "copy", F.get("t.k", F.lit(0)).alias("first"), F.get("t.k", F.lit(1)).alias("second"), F.explode("t.k").alias("k"))
    other = F.coalesce(F.when(F.col("first") == F.col("k"), F.col("second")).otherwise(F.col("first")), F.lit(0))
    return each.select("k", "copy", F.when(F.col("copy"), other).otherwise(F.col("own")).alias("class")).distinct()


def drop_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with ``text`` rid of the lines of recurring templates; ``count``, when given, gets the number of lines taken out."""
    i, h, g = free(df, "_id"), free(df, "_hash"), free(df, "_gone")
    identity = F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(F.col(text))
    docs = df.select(identity[0].alias("_id"), identity[1].alias("_h"), F.col(text).alias("_text"))
    placed = stored(_placed(docs))
    gone = placed.join(recurring_lines(docs, placed), "line", "left_semi").groupBy("_id", "_h").agg(F.collect_set("_at").alias(g))
    joined = df.select("*", identity[0].alias(i), identity[1].alias(h)).join(gone.select(
        F.col("_id").alias(i), F.col("_h").alias(h), g), [i, h], "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, n: ~F.array_contains(F.col(g), n)), "\n")
    result = joined.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(left))
    if count:
        result = result.withColumn(count, F.coalesce(F.size(g), F.lit(0)))
    return result.select(*df.columns, *([count] if count and count not in df.columns else []))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, count="n_dropped").select("doc_id", "text", F.col("n_dropped").cast("long").alias("n_dropped"))
