"""SimHash near-dedup: fingerprints embedded as bit counts of their segments, a grid join on the counts, exact verification.

A fingerprint is cut into ``SEGMENTS`` segments; its embedding is the number of set bits in each. Changing one bit moves one
count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The segments
form ``GROUPS`` groups; when two embeddings are at most 3 apart, at least three groups of the six agree exactly, so joining on the
grid cell of every three groups finds each such pair. Pairs that meet are filtered by Manhattan distance and then
verified on the bits.

Texts are reduced to distinct fingerprints first, so copies cost one row whatever their number. A crowded cell, with more than
``CROWDED`` fingerprints, emits no pairs: each of its fingerprints visits the points within two bits of it, and at a point
that one fingerprint reaches with one bit at most, all visitors are linked to that one (they are within three bits of it).
Two fingerprints within three bits always share such a point, so no link is lost and the work stays proportional to the cell.
Groups of linked fingerprints then come from repeated contraction of the links, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import free, once, stored, table, text_function, with_part
from rosterlake.operators.resolve import connected_groups
from rosterlake.operators.scale import hot_first_join

SHINGLE = 3
DISTANCE = 3
SEGMENTS, GROUPS, TOGETHER = 32, 6, 3
#: from here on visiting 2,081 points costs less than the pairs of a cell
CROWDED = 512
SEED = 42


def fingerprint_bits(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a text: a bit is set when more than half of its shingles' hashes set it; 0 without words."""
    words = text.lower().split()  # on bytes both touch ASCII only: A-Z, and the blank with \t to \r
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # eight times the bytes at once, for a bounded piece
        piece = hashes[at:at + 65_536]
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Add ``out``, the fingerprint as a signed long. Null, empty and blank texts have fingerprint 0."""
    reader = text_function(lambda t: (fingerprint_bits(t, shingle),), "fp long")
    return with_part(df, out, reader(F.col(text)), "fp")


def embedding(fp: Column) -> list[Column]:
    """Set bits in each segment of a fingerprint."""
    width = 64 // SEGMENTS
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(SEGMENTS)]


def _groups() -> list[list[int]]:
    return [list(part) for part in np.array_split(np.arange(SEGMENTS), GROUPS)]


def _packed(counts: Column, parts: list[int]) -> Column:
    """The counts of some segments as one number: a segment of two bits has counts up to 2, so three fit a base of 3."""
    base = 64 // SEGMENTS + 1
    value = F.lit(0).cast("long")
    for i in parts:
        value = value * base + F.get(counts, F.lit(i))
    return value


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.array(*embedding(a)), F.array(*embedding(b)), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` whose connected groups are those of all pairs within ``DISTANCE`` bits.

    Pairs outside crowded cells are all listed, those inside one only as far as they connect it.
    """
    counts = F.array(*embedding(F.col("fp")))
    grouped = distinct.select("fp", counts.alias("_c")).select("fp", F.array(*[_packed(F.col("_c"), g) for g in _groups()]).alias("_g"))
    base = 3 ** max(len(g) for g in _groups())
    cells = F.array(*[F.struct(F.lit(n).alias("which"), ((F.get("_g", F.lit(x)) * base + F.get("_g", F.lit(y))) * base + F.get(
        "_g", F.lit(z))).alias("place"))
        for n, (x, y, z) in enumerate(combinations(range(GROUPS), TOGETHER))])
    placed = grouped.select("fp", F.inline(cells))
    met = stored(placed.groupBy("which", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small, crowded = met.where(F.col("n") <= CROWDED).drop("n"), met.where(F.col("n") > CROWDED).drop("n")
    near = stored(placed.join(small, ["which", "place"], "left_semi"))
    pairs = (near.select("which", "place", F.col("fp").alias("a")).join(near.select("which", "place", F.col("fp").alias("b")), ["which", "place"])
             .where("a < b").where(manhattan(F.col("a"), F.col("b")) <= DISTANCE)
             .where(hamming(F.col("a"), F.col("b")) <= DISTANCE).select("a", "b").distinct())
    if crowded.isEmpty():
        return pairs
    dense = stored(placed.join(crowded, ["which", "place"], "left_semi").select("fp").distinct())
    return pairs.unionByName(_ball_links(dense))


def _ball_links(dense: DataFrame) -> DataFrame:
    """Links that connect all fingerprints within three bits, through the points they share."""
    one = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function(
        "shiftleft", F.lit(1).cast("long"), i))))
    near = dense.select("fp", F.explode(one).alias("point"))
    least = stored(near.groupBy("point").agg(F.min("fp").alias("a")))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.col(
        "fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    visits = near.unionByName(dense.select("fp", F.explode(two).alias("point")))
    return visits.join(least, "point").where("fp <> a").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(df: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, group_id, component_id, n): every distinct fingerprint, its group, the smallest document id in the group, and the
    documents that have the fingerprint.

    Documents without an id are linked like others but never give a group its id (it is null where no member has one).
    """
    ids = stored(df.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least_id"), F.count(F.lit(1)).alias("n")))
    linked = stored(links(ids.select("fp")).select(F.col("a").alias("account_a"), F.col("b").alias("account_b")))
    ends = linked.select(F.explode(F.array("account_a", "account_b")).alias("account_id")).distinct()
    groups = connected_groups(ends, linked).select(F.col("account_id").alias("fp"), "group_id")
    named = once(groups.join(ids, "fp").select("fp", "group_id", "least_id"))
    least = named.groupBy("group_id").agg(F.min("least_id").alias("component_id"))
    merged = named.join(least, "group_id").select("fp", "group_id", "component_id")
    return ids.join(merged, "fp", "left").select("fp", F.coalesce("group_id", "fp").alias("group_id"), F.when(
        F.col("group_id").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), "n")


def with_components(docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """Add ``group_id`` and ``component_id`` to every row; rows of the most frequent fingerprints stay out of the shuffle."""
    return hot_first_join(docs, components(docs, doc_id, fp), [fp], "n", doc_id, ["group_id", "component_id"])


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of its smallest document id, of several such rows the one with the least content hash.

    A row without an id stays only where no row of its group has one. The columns of ``df`` come back unchanged.
    """
    i, h = free(df, "_id"), free(df, "_hash")
    keyed = df.select("*", F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(i), F.xxhash64(*sorted(df.columns)).alias(h))
    plain = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(i).alias("i"), F.col(h).alias("h"))
    narrow = stored(fingerprints(plain).select("doc_id", "i", "h", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("h").alias("h"), F.col("i").alias("i"))
    first = (with_components(narrow).groupBy("group_id").agg(F.min(order).alias("w")).select(F.col("w.i").alias(i), F.col("w.h").alias(h)))
    # the join leaves the rows of a key together, so taking one of equal rows needs no further shuffle
    return keyed.join(first, [i, h], "left_semi").dropDuplicates([i, h]).select(*df.columns)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    return with_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
