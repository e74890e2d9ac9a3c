"""Vector code compression: product codes from Lloyd's rounds in which members stay with their owners.

Vectors become integers, are cut into consecutive parts, and each part position has a codebook. An owner is a
(position, entry, salt) and holds the parts that its entry is nearest to. The salt comes from the row and runs over all partitions,
so an entry with any share of the rows is spread evenly over them. In a round the owners sum up their resident members (at most one
row per position and entry reaches the driver), the new codebooks go out, owners look for the nearest entries again,
and only parts whose owner changes go through the next shuffle; the others stay where they are. Every
round's residents are checkpointed in the shared folder, so a lost executor replays one round at most.

Rows whose vector is null or empty, holds a null or non-finite component, or cannot be cut into equal parts are left out; so are
those of another length than the usable vector with the smallest id. Components beyond +-2^27 once scaled count as that, which keeps
distances within a long. Rows without an id or label are compressed like others; they are starting points only where
fewer rows than entries have an id. Repeated rows count each time; of rows with one id those with the smaller vector come first as
starting points. With fewer rows than entries the codebooks are that much shorter, and an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import finite, scaled, stored, table
from rosterlake.operators.scale import hot_first_join
from rosterlake.session import scratch_folder

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: bytes of members a partition should hold
RESIDENT_BYTES = 32_000_000

#: rows, slots (position times entries plus entry) and components of some members
Members = tuple[np.ndarray, np.ndarray, np.ndarray]


def _nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and the squared distance to it."""
    best = np.zeros(len(values), np.int64)
    least = np.full(len(values), np.iinfo(np.int64).max)
    for entry, centre in enumerate(book):
        far = ((values - centre) ** 2).sum(axis=1)
        nearer = far < least
        best[nearer], least[nearer] = entry, far[nearer]
    return best, least


def assign(members: Members, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New slots of members and their squared distances; ``books`` is positions x entries x components."""
    rows, slots, values = members
    new, far, k = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), books.shape[1]
    position = slots // k
    for p in np.unique(position):
        at = position == p
        entry, far[at] = _nearest(values[at].astype(np.int64), books[p])
        new[at] = p * k + entry
    return new, far


def _dealt(rows: np.ndarray, slots: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each member's owner: its salt, moved on by its slot."""
    salt = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % partitions
    return (salt + slots) % partitions


def _owner(key: int) -> int:
    """Members are keyed by the partition of their owner."""
    return key


def _split(members: Members, keys: np.ndarray) -> Iterator[tuple[int, Members]]:
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    for key, at in zip(found, np.split(order, starts[1:])):
        yield int(key), tuple(x[at] for x in members)


def _merged(pieces: Iterator[tuple[int, Members]]) -> Iterator[tuple[int, Members]]:
    """The members of a partition as one piece."""
    pieces = list(pieces)
    if pieces:
        yield pieces[0][0], tuple(np.concatenate(x) for x in zip(*(m for _, m in pieces)))


def _sums(pieces: Iterator[tuple[int, Members]]) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, components summed and the count behind them) of the members in a partition."""
    for _, (_, slots, values) in pieces:
        for slot in np.unique(slots):
            mine = values[slots == slot].astype(np.int64)
            yield int(slot), np.append(mine.sum(axis=0), len(mine))


def _moved_on(books: np.ndarray, partitions: int):
    def run(pieces):
        for _, (rows, slots, values) in pieces:
            slots, _ = assign((rows, slots, values), books)
            yield from _split((rows, slots, values), _dealt(rows, slots, partitions))
    return run


def _first_places(books: np.ndarray, partitions: int):
    """Arrow function: vectors as members under the first codebooks, one pickled piece for each partition they go to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, k, width = books.shape
        for batch in batches:
            rows = batch.column("row").to_numpy()
            whole = batch.column("ints").flatten().to_numpy().reshape(len(rows), positions, width).astype(np.int32)
            members = (np.repeat(rows, positions), np.tile(np.arange(positions) * k, len(rows)), whole.reshape(-1, width))
            slots, _ = assign(members, books)
            pieces = list(_split((members[0], slots, members[2]), _dealt(members[0], slots, partitions)))
            columns = [pa.array([key for key, _ in pieces], pa.int32())]
            columns += [pa.array([m[i].tobytes() for _, m in pieces], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rows", "slots", "ints"])
    return run


def _settled(pieces: RDD) -> RDD:
    """One piece for each partition, kept at hand and checkpointed."""
    residents = pieces.mapPartitions(_merged, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    residents.checkpoint()
    return residents


def _shares(books: np.ndarray):
    """Bytes of (row, slot, distance) of every member under the last codebooks."""
    def run(pieces):
        for _, members in pieces:
            slots, far = assign(members, books)
            yield bytearray(members[0].astype("<i8").tobytes()), bytearray(slots.astype("<i8").tobytes()), bytearray(far.astype("<i8").tobytes())
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in zip(*(batch.column(c) for c in ("rows", "slots", "far"))):
            columns = [pa.array(np.frombuffer(x.as_py(), "<i8")) for x in piece]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "slot", "far"])


def numbered(df: DataFrame, vec_id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """(row, vec_id, label, ints): the vectors that can be compressed, as integers, written once with a number each."""
    fit = df.where(finite(F.col(vector)) & (F.size(vector) % parts == 0)).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled(F.col(vector), scale).alias("ints"))
    first = fit.orderBy(F.asc_nulls_last("vec_id"), "ints").select(F.size("ints")).first()
    if first is not None:
        fit = fit.where(F.size("ints") == first[0])
    return stored(fit.select(F.monotonically_increasing_id().alias("row"), "*"))


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, RDD]:
    """(codebooks, residents) after all rounds; ``vectors`` has (row, vec_id, ints) and at least one row."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
    seeds = [r["ints"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    member_bytes = 4 * books.shape[2] + 16
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), vectors.count() * parts * member_bytes // RESIDENT_BYTES)
    width = books.shape[2]
    placed = vectors.select("row", "ints").mapInArrow(_first_places(books, partitions), "key int, rows binary, slots binary, ints binary")
    keyed = placed.rdd.map(lambda r: (r[0], (np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int32).reshape(-1, width))))
    residents = _settled(keyed.partitionBy(partitions, _owner))
    for step in range(rounds):
        sums = residents.mapPartitions(_sums).reduceByKey(add, min(partitions, books.shape[0] * books.shape[1])).collect()
        books = books.copy()
        for slot, total in sums:
            books[slot // books.shape[1], slot % books.shape[1]] = total[:-1] // total[-1]
        if step == rounds - 1:  # the last codebooks only need distances; nobody has to move for that
            return books, residents
        residents = migrate(residents, books, partitions)
    return books, residents


def migrate(residents: RDD, books: np.ndarray, partitions: int) -> RDD:
    """Residents under new codebooks: pieces that stay keep their partition, only the others are shuffled."""
    # the pieces that stay do keep the partitioning; those that leave are dealt out again below
    dealt = residents.mapPartitions(_moved_on(books, partitions), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    stay = dealt.mapPartitionsWithIndex(lambda i, pieces: (x for x in pieces if x[0] == i), preservesPartitioning=True)
    leave = dealt.mapPartitionsWithIndex(lambda i, pieces: (x for x in pieces if x[0] != i))
    after = _settled(stay.union(leave.partitionBy(partitions, _owner)))
    after.count()  # writes the checkpoint; what it was made of can go
    dealt.unpersist()
    residents.unpersist()
    return after


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(codes, codebooks)``: (vec_id, label, code, error) of every vector that can be compressed.

    ``code`` has two hexadecimal digits for each of at most 8 parts with at most 256 entries.
    """
    spark = df.sparkSession
    vectors = numbered(df, vec_id, vector, label, parts, scale)
    shares = spark.createDataFrame([], "row long, slot long, far long")
    books = np.zeros((parts, 0, 0), np.int64)
    if not vectors.isEmpty():
        books, residents = learn(vectors, parts, entries, rounds)
        packed = spark.createDataFrame(residents.mapPartitions(_shares(books)), "rows binary, slots binary, far binary")
        shares = stored(packed.mapInArrow(_unpacked, "row long, slot long, far long"))
        residents.unpersist()
    k = max(1, books.shape[1])
    place = 8 * (parts - 1 - F.floor(F.col("slot") / k)).cast("int")
    byte = F.call_function("shiftleft", F.col("slot") % k, place)
    codes = shares.groupBy("row").agg(F.bit_or(byte).alias("bits"), F.sum("far").alias("error"))
    text = F.right(F.lpad(F.lower(F.hex("bits")), 16, "0"), F.lit(2 * parts))
    return vectors.select("row", "vec_id", "label").join(codes, "row").select("vec_id", "label", text.alias("code"), "error"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of a label; rows without a label form one group."""
    keyed = codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return hot_first_join(keyed, totals, ["_none", "_label"], "_n", "code", ["label_error"]).drop("_none", "_label")


def _sql() -> str:
    """The same rounds as joins of (vector, part, position) with the entries' components."""
    def nearest(step):
        return f"""
a{step} AS (
  SELECT vec_id, p, min(far) AS far, arg_min(e, far * 16 + e) AS e FROM (
    SELECT vec_id, x.p, e, sum((v - c) * (v - c)) AS far FROM x JOIN b{step} b ON x.p = b.p AND x.i = b.i GROUP BY ALL) GROUP BY ALL)"""

    def moved(step):
        return f"""
m{step} AS (
  SELECT x.p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{step} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL),
b{step + 1} AS (
  SELECT b.p, b.e, b.i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM b{step} b LEFT JOIN m{step} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""
    rounds = ",".join(f"{nearest(s)},{moved(s)}" for s in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (
  SELECT vec_id, (j - 1) // w AS p, (j - 1) % w AS i, CAST(floor(4096 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS j FROM kept)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16),
b0 AS (SELECT p, e, i, v AS c FROM x JOIN seeds USING (vec_id)),{rounds},{nearest(ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
