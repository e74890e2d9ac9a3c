"""Document fingerprints (native): invertible Bloom lookup sketches of paragraph digests, subtracted between versions and peeled.

A text is cut into pieces, its sentences within lines, at most 200 characters each; a piece's key hashes its digest and how many
equal pieces came before it, so repeats count. A sketch keeps in each cell the number, the XOR of keys and the XOR of key checks;
a key sits in one cell of each of three sub-tables. Subtracting two sketches cancels the common pieces, and peeling takes
a cell with a single key off the other cells until none is left: what comes out are the pieces that differ. Keys are dealt by
their own bits, repeats of one piece too, over parts of about ``PER_PART`` keys, each with its own small sketch, so the work grows
with the text. A part that cannot be peeled is tried again with half as many cells more; should all ``LEVELS`` sizes fail, its keys
are compared one by one.

Everything is column expressions on a row. Only the pairing of each document with the next needs a shuffle, one of the texts and
their keys, which are worked out once for each document: documents are dealt by ranges of ids, and each range also gets a copy of
the first document of the range after it.

Null texts count as empty, which have no pieces; two empty texts are fully alike. Documents are ordered by descending id, then
content hash; those without an id come last. Rows repeated in full stay separate documents that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import table

PIECE = r"[^\n.!?]{1,200}[.!?]*|[.!?]+"
PER_PART = 6
CELLS, GROWTH, LEVELS, ROUNDS = 4, 1.5, 10, 12
BASE_CELLS = 3
CHECK = 7
#: number of a digest's first occurrence, whose place counts from 0 and its position from 1
FIRST = -1


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once. A fold over nothing: unlike ``transform`` it does not copy what it returns."""
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def digests(text: Column) -> Column:
    """array<long>: digest of every piece of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))


def parts_needed(n: Column) -> Column:
    return F.greatest(F.ceil(n / PER_PART), F.lit(1)).cast("int")


def dealt(keys: Column, parts: Column) -> Column:
    """array<array<long>>: hashes dealt over at least ``parts`` parts, in two steps so that the work stays near n * sqrt(parts).

    Bits 44 and up, then 24 and up: the lowest bits that places are worked out from (0, 20 and 40 up) stay free.
    """
    def deal(outer):
        inner = F.ceil(parts / outer).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), outer - 1), lambda a: _let(
            F.filter(keys, lambda k: F.shiftrightunsigned(k, 44) % outer == a),
            lambda some: F.transform(F.sequence(F.lit(0), inner - 1), lambda b: F.filter(
                some, lambda k: F.shiftrightunsigned(k, 24) % inner == b)))))
    return _let(F.ceil(F.sqrt(parts)).cast("int"), deal)


def occurrence_keys(part: Column) -> Column:
    """Keys of one part: each digest hashed with the number of equal ones before it."""
    return _let(F.sort_array(part), lambda s: F.transform(s, lambda d, i: F.xxhash64(d, i.cast("long") - F.array_position(s, d))))


def numbered(found: Column) -> Column:
    """array<long>: keys of the digests of a whole text. Equal digests share a part, so their occurrences are counted within it;
    where all digests differ there is nothing to count, and each gets the key of a first occurrence."""
    def keys(found):
        counted = F.flatten(F.transform(_let(parts_needed(F.size(found)), lambda parts: dealt(found, parts)), occurrence_keys))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.transform(
            found, lambda d: F.xxhash64(d, F.lit(FIRST).cast("long")))).otherwise(counted)
    return _let(found, keys)


def _places(key: Column, cells: Column) -> list[Column]:
    """Cell of a key in each sub-table, from 20 bits of the key that are the table's own."""
    return [F.pmod(F.shiftrightunsigned(key, 20 * t), cells).cast("int").alias(f"at{t}") for t in range(3)]


def _cell(n, k, h) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), h.alias("h"))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def sketch(keys: Column, cells: Column) -> Column:
    """Cells of three sub-tables of ``cells`` cells each, one after another."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def tables(placed):
        return F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.aggregate(
            F.filter(placed, lambda p: p[f"at{t}"] == c), empty,
            lambda acc, p: _cell(acc["n"] + 1, acc["k"].bitwiseXOR(p["k"]), acc["h"].bitwiseXOR(p["h"])))) for t in range(3)]))
    return _let(F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *_places(k, cells))), tables)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def _peel_round(state: Column, cells: Column) -> Column:
    single = F.array_distinct(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))))

    def take(found):
        more = F.size(F.filter(found, lambda p: p["n"] == 1))

        def settle(placed):
            return F.flatten(F.array(*[F.transform(F.slice(state["cells"], t * cells + 1, cells), lambda cell, i: F.aggregate(
                F.filter(placed, lambda p: p[f"at{t}"] == i), cell,
                lambda acc, p: _cell(acc["n"] - p["n"], acc["k"].bitwiseXOR(p["k"]), acc["h"].bitwiseXOR(p["h"])))) for t in range(3)]))
        placed = F.transform(found, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["h"].alias("h"), *_places(p["k"], cells)))
        return F.when(F.size(found) == 0, F.struct(
            state["cells"].alias("cells"), state["gone"].alias("gone"), state["come"].alias("come"), F.lit(True).alias("over"))).otherwise(
            F.struct(_let(placed, settle).alias("cells"), (state["gone"] + more).alias("gone"),
                     (state["come"] + F.size(found) - more).alias("come"), F.lit(False).alias("over")))
    return F.when(state["over"], state).otherwise(_let(single, take))


def peel(difference: Column, cells: Column) -> Column:
    """struct<gone, come, whole>: keys only in the first and only in the second sketch; whole when nothing was left over."""
    start = F.struct(difference.alias("cells"), F.lit(0).alias("gone"), F.lit(0).alias("come"), F.lit(False).alias("over"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: _peel_round(state, cells))
    return _let(rounds, lambda s: F.struct(s["gone"].alias("gone"), s["come"].alias("come"), (~F.exists(
        s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))).alias("whole")))


def part_difference(a: Column, b: Column, first: Column) -> Column:
    """struct<gone, come, whole, tries> of two key arrays through sketches that grow, from level ``first``, until they can be
    peeled; ``tries`` is the number of levels up to that one."""
    unknown = F.struct(F.lit(0).alias("gone"), F.lit(0).alias("come"), F.lit(False).alias("whole"), F.lit(0).alias("tries"))

    def attempt(state, level):
        cells = (CELLS * F.pow(F.lit(GROWTH), level)).cast("int")
        tried = _let(cells, lambda c: peel(subtract(sketch(a, c), sketch(b, c)), c))
        return F.when(state["whole"] | (level < first), state).otherwise(_let(tried, lambda t: F.struct(
            t["gone"].alias("gone"), t["come"].alias("come"), t["whole"].alias("whole"), (level + 1).alias("tries"))))

    plain = F.struct(F.size(F.array_except(a, b)).alias("gone"), F.size(F.array_except(b, a)).alias("come"), F.lit(True).alias("whole"),
                     F.lit(LEVELS + 1).alias("tries"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), unknown, attempt),
                lambda s: F.when(s["whole"], s).otherwise(plain))


def difference(a: Column, b: Column) -> Column:
    """struct<gone, come, tries>: keys only in the first and only in the second of two key arrays, and the tries of the last part.

    Once a part needed more than the smallest sketch, the parts after it begin with the second size.
    """
    def pairs(parts):
        return F.arrays_zip(dealt(a, parts).alias("x"), dealt(b, parts).alias("y"))

    def add(acc, part):
        return _let(part_difference(part["x"], part["y"], F.least(F.greatest(acc["tries"] - 1, F.lit(0)), F.lit(1))), lambda d: F.struct(
            (acc["gone"] + d["gone"]).alias("gone"), (acc["come"] + d["come"]).alias("come"), d["tries"].alias("tries")))
    total = F.struct(F.lit(0).alias("gone"), F.lit(0).alias("come"), F.lit(0).alias("tries"))
    return F.aggregate(_let(parts_needed(F.greatest(F.size(a), F.size(b))), pairs), total, add)


def likeness(a: Column, b: Column) -> Column:
    """Common pieces by all pieces of two key arrays, 0 to 1; 1 where both are empty."""
    return _let(difference(a, b), lambda d: F.when(F.size(a) + d["come"] == 0, 1.0).otherwise(
        (F.size(a) - d["gone"]).cast("double") / (F.size(a) + d["come"])))


def fingerprint(keys: Column) -> Column:
    """The base sketch of a text as a string: number, key and check of every cell in hexadecimal digits."""
    return F.array_join(F.transform(sketch(keys, F.lit(BASE_CELLS)), lambda c: F.concat(
        F.hex(c["n"]), F.lit("."), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0"))), "-")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **of_text: Column) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one by descending id; after the last comes the first.

    ``doc_id`` is an integer column. ``of_text``: columns of ``text`` that both documents of a pair need, worked out once for each
    document before the shuffle; ``name`` and ``next_name`` come out.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    inside = F.lit(0)
    if cuts:  # the block whose first cut is the last one below the id, then the place inside it
        heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
        rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks])
        inside = _let(F.size(F.filter(heads, lambda c: c < F.col("doc_id"))), lambda k: F.when(k == 0, F.lit(0)).otherwise(
            (k - 1) * width + F.size(F.filter(F.get(rows, k - 1), lambda c: c < F.col("doc_id")))))
    # ids that are missing are dealt by hash, below all ranges
    docs = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.shiftright(F.col("_h"), 58).cast("int") - 100).otherwise(inside))
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))
    firsts = docs.groupBy("_range").agg(F.max(place).alias("p")).collect()  # a row for each range
    firsts = sorted(((r["_range"], r["p"]["id"], r["p"]["h"]) for r in firsts), key=lambda r: r[0])
    after = [(firsts[k][0], *firsts[k - 1][1:]) for k in range(len(firsts))]  # below the lowest range comes the highest
    goal = docs.sparkSession.createDataFrame(after, "_to int, _id long, _of long")
    copies = (docs.join(F.broadcast(goal), docs["doc_id"].eqNullSafe(goal["_id"]) & (docs["_h"] == goal["_of"]))
              .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("_h"), F.col("_to").alias("_range"),
                      F.lit(1).alias("_copy")))
    all_rows = docs.withColumn("_copy", F.lit(0)).unionByName(copies).withColumns(of_text)
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("_h"))
    following = {f"next_{name}": F.lead(name).over(order) for name in ("text", *of_text)}
    return all_rows.withColumns(following).where("_copy = 0").select("doc_id", "text", *of_text, *following)


@query("op8_paragraph_sketch")
def op8_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pairs = with_next(table(spark, sf_dir, "documents"), keys=numbered(digests(F.col("text")))).withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    known = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("keys").alias("a"),
                         numbered(digests(F.col("edited"))).alias("e"), F.col("next_keys").alias("x"))
    return known.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
                        fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"),
                        likeness(F.col("a"), F.col("x")).alias("near_next"))
