"""Which account pairs are worth scoring (C3, C4): blocks of any size, none left out.

Pairs share a block: the first or last five characters of a name key or handle core. Blocks of at most ``PLAIN`` members are
compared whole. In a larger block two members meet only on evidence without which the scoring rules cannot accept them:

* **Alike texts.** A score is at most 0.5 h + 0.35 n + 0.15 o - 0.2 c, with h and n the similarities of handles and names, o the overlap
  of the categories and c the facts that speak against the pair. Unless o > 0 and c = 0, the greater of h and n must
  reach ``ALIKE`` = 0.72 / 0.85; two names on one platform must even reach 0.92. Texts that similar share a number of two-letter
  grams that follows from both lengths, so they share one, or where that number allows two or three, among the rarest few of each (prefix
  filter). Rare is what few members of the block show, so what all of them share is nobody's key. Both lengths are part of the key.
* **Weak evidence.** Pairs of two platforms with a common category and nothing against them need less similarity. They meet on category,
  city and a band of ages; of city and age only what both accounts give counts.

Rows meet by a number, with 64 bits for the letters of each text; these bound from above what two texts have in common, so most pairs end
where they meet. Pairs on weak evidence, the square of a block's accounts of one category, city and age, are compared exactly there
as well: only pairs that may be accepted are shuffled.

Keys only decide where a pair is looked at; a pair met at several keys comes out once, and the order in which grams count as rare
changes no result. ``PLAIN`` and the limits in ``functions/letters.py`` change the plan alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rosterlake.functions.letters import GRAM_SLOTS, LENGTH_SLOTS, frequencies, gram_keys, letter_marks
from rosterlake.functions.similarity import pair_similarity
from rosterlake.operators.scale import hot_first_join, spread_evenly
from rosterlake.session import cut_lineage

# Fixed values of the matching rules.
REVIEW_SCORE = 0.72
TEXT_WEIGHT = 0.85
ALIKE = REVIEW_SCORE / TEXT_WEIGHT
#: what texts must reach if one fact speaks against the pair, whatever its categories; less than 0.92, which names on one platform need
STRICT = (REVIEW_SCORE + 0.2 - 0.15) / TEXT_WEIGHT
#: blocks up to this size cost less as pairs than as keys
PLAIN = 64
#: accounts whose ages are further apart than this have that against them
AGE_GAP = 4
TEXTS = ("handle_core", "name_key", "name_words")
#: the letters of every text and their number
_COMPARED = tuple(f"_{what}_{c}" for what in ("n", "mark") for c in TEXTS)


def block_keys(*texts: Column) -> Column:
    """First and last five characters of every text with at least four, in one namespace."""
    def ends(text):
        return F.when(F.length(text) >= 4, F.array(F.concat(F.lit("p:"), F.left(text, F.lit(5))),
                                                   F.concat(F.lit("s:"), F.right(text, F.lit(5)))))
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(ends(t), nothing) for t in texts]))


def block_sizes(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    return df.select(F.explode(blocks).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("members"))


def prefix_length(n: Column, alike: float = ALIKE) -> Column:
    """How many of its rarest grams a text of ``n`` letters has to show to meet every text at least ``alike`` to it.

    With k letters in common order, texts of n and m letters share at least 3 k - n - m - 1 grams, as a letter left out of the one
    breaks two of its grams and one put in breaks one. Similarity 2 k / (n + m) >= alike bounds m from below by
    n alike / (2 - alike), so at least (1.5 alike - 1) (n + m) - 1 grams are shared by any such pair.
    """
    least = F.ceil(n * (alike / (2 - alike)) - 1e-9)
    shared = F.greatest(F.ceil((n + least) * (1.5 * alike - 1) - 1 - 1e-9), F.lit(1))
    return F.greatest(n - shared, F.lit(1)).cast("int")


def _read(batch: pa.RecordBatch) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray]:
    """``(texts, blocks, spaces, rows)`` of accounts with their large blocks; handles and name keys share one space, name words have
    another."""
    lists = batch.column("crowd")
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    core, name, words = ([t or "" for t in batch.column(c).to_pylist()] for c in TEXTS)
    texts, rows, spaces = [], [], []
    for i in range(batch.num_rows):
        if ends[i] < ends[i + 1]:
            # two empty names are equal, two empty handles are not
            own = [(0, t) for t in dict.fromkeys((core[i], name[i])) if t] + [(1, words[i])]
            texts += [t for _, t in own]
            spaces += [space for space, _ in own]
            rows += [i] * len(own)
    return texts, [flat[ends[i]:ends[i + 1]] for i in rows], np.array(spaces, np.int64), np.array(rows, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of grams and, behind them, of lengths, those that are not nought."""
    both = np.zeros(GRAM_SLOTS + LENGTH_SLOTS, np.int64)
    for batch in batches:
        texts, blocks, spaces, _ = _read(batch)
        frequencies(texts, blocks, spaces, both[:GRAM_SLOTS], both[GRAM_SLOTS:])
    used = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[used])], ["slot", "n"])


_MET = StructType([StructField(c, LongType(), False) for c in ("_id", "_k", "_mark", "_platform", "_place", "_spare")])


def _meet(counters: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of the texts of accounts in large blocks, each with the marks of its text and how many letters that can spare: 31 bits for what
    any pair of that key must have in common, 31 for pairs with something against them, and one bit for names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts, blocks, spaces, rows = _read(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))
                at, keys, partners = gram_keys(texts, blocks, spaces, counters[:GRAM_SLOTS], counters[GRAM_SLOTS:], ALIKE)
                letters = np.fromiter(map(len, texts), np.int64, len(texts))[at]
                spare, strict = (letters - np.ceil(least * (letters + partners) / 2 - 1e-9).astype(np.int64) for least in (ALIKE, STRICT))
                own = batch.select(["_id", "_platform", "_place"]).take(pa.array(rows[at]))
                packed = spaces[at] << 62 | np.maximum(strict + 1, 0) << 31 | spare
                yield pa.RecordBatch.from_arrays([own.column("_id"), pa.array(keys), pa.array(letter_marks(texts)[at]), own.column("_platform"),
                                                  own.column("_place"), pa.array(packed)], _MET.names)
    return run


def _alike_rows(side: DataFrame) -> DataFrame:
    """A row per key of an account in large blocks; grams are ordered by how many texts of the block show them.

    The driver holds one counter for every slot, whatever the number of blocks and grams.
    """
    crowded = side.where(F.size("crowd") > 0).select("_id", "crowd", *TEXTS, "_platform", "_place")
    counted = crowded.mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(GRAM_SLOTS + LENGTH_SLOTS, np.int64)
    counters[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return crowded.mapInArrow(_meet(counters), _MET)


def _weak_keys(asking: bool) -> Column:
    """Keys on which accounts of large blocks meet by category, city and age.

    ``known`` has bit 1 for an age, bit 2 for a city. Of two accounts the one with the smaller number asks and the other offers, on what
    both know; of two equal ones each does both. A band of ages is asked for by its own number and offered with its neighbours, between equal
    ones only with the one before: there the lower band asks. ``present`` has a bit for each number that a block has.
    """
    nothing = F.array().cast("array<bigint>")
    known, age = F.col("known"), F.col("age")
    band = F.floor(age / (AGE_GAP + 1)).cast("long")

    def met(other):
        city = F.when((known >= 2) & F.lit(other >= 2), F.col("city")).otherwise("")
        offered = F.when(known == other, F.array(band - 1, band)).otherwise(F.array(band - 1, band, band + 1))
        bands = F.when((known % 2 == 1) & F.lit(other % 2 == 1), F.array(band) if asking else offered).otherwise(
            F.array(F.lit(None).cast("long")))
        low, high = (known, F.lit(other)) if asking else (F.lit(other), known)
        there = F.filter("homes", lambda h: h["present"].bitwiseAND(F.lit(1 << other)) != 0)
        keys = F.flatten(F.flatten(F.transform(there, lambda h: F.transform("categories", lambda c: F.transform(bands, lambda b: F.xxhash64(
            h["block"], F.lit("category"), c, low, high, city, b))))))
        return F.when(low <= high, F.coalesce(keys, nothing)).otherwise(nothing)
    return F.array_distinct(F.concat(*[met(other) for other in range(4)]))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [pa.array(letter_marks([t or "" for t in batch.column(c).to_pylist()])) for c in TEXTS]
        yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, *[f"_mark_{c}" for c in TEXTS]])


def _placed(df: DataFrame, key: str, plain: int) -> DataFrame:
    """The rows of accounts that share a block with others: ``_id`` numbers the accounts, ``open`` and ``crowd`` are their small and large
    blocks, ``homes`` the large ones with what their accounts know; and what rows compare where they meet."""
    known = F.coalesce(F.col("age") > 0, F.lit(False)).cast("int") + 2 * F.coalesce(F.col("city") != "", F.lit(False)).cast("int")
    blocked = df.select(key, known.alias("known"), F.xxhash64(F.coalesce("platform", F.lit(""))).alias("_network"),
                        F.transform(block_keys(F.col("name_key"), F.col("handle_core")), lambda b: F.xxhash64(b)).alias("_blocks"))
    spread = blocked.select(key, "known", "_network", F.explode("_blocks").alias("block"))
    sizes = spread.groupBy("block").agg(
        F.count(F.lit(1)).alias("members"),
        F.when(F.min("_network") < F.max("_network"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("known")))).otherwise(0).alias("present"))
    sized = hot_first_join(spread.select(key, "block"), sizes, ["block"], "members", key, ["members", "present"])
    placed = sized.where(F.col("members") > 1).groupBy(key).agg(
        F.collect_set(F.when(F.col("members") <= plain, F.col("block"))).alias("open"),
        F.collect_set(F.when(F.col("members") > plain, F.struct("block", "present"))).alias("homes"))
    numbered = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()))
    city = F.when(F.col("city") != "", F.hash("city")).otherwise(0).cast("long")
    age = F.when(F.col("age") > 0, F.col("age")).otherwise(0).cast("long")
    full = spread_evenly(df.join(numbered, key)).withColumns({
        "known": known, "crowd": F.transform("homes", lambda h: h["block"]), "_platform": F.xxhash64("platform"), "_handle": F.xxhash64("handle"),
        # 32 bits each, nought for what is not known
        "_place": F.shiftleft(city, 32).bitwiseOR(age), **{f"_n_{c}": F.coalesce(F.length(c), F.lit(0)) for c in TEXTS}})
    return full.mapInArrow(_marked, StructType([*full.schema, *[StructField(f"_mark_{c}", LongType(), False) for c in TEXTS]]))


def with_pair_keys(df: DataFrame, key: str, plain: int = PLAIN) -> DataFrame:
    """Add ``keys``, on which two rows meet, and ``asks`` and ``offers``, on which rows of two platforms meet with weaker evidence;
    ``known`` orders the two sides of the latter.

    Needs platform, handle, name_key, handle_core, name_words, categories, city and age; the keys are hashes, so a chance collision costs a look
    at a pair and nothing else. A row's lists are bounded by its texts and the lengths of those it may resemble.
    """
    side = cut_lineage(_placed(df, key, plain))
    alike = _alike_rows(side).groupBy("_id").agg(F.collect_set("_k").alias("_alike"))
    keys = F.concat("open", F.coalesce("_alike", F.array().cast("array<bigint>")))
    return side.join(alike, "_id", "left").select(*df.columns, F.array_distinct(keys).alias("keys"), _weak_keys(True).alias("asks"),
                                                  _weak_keys(False).alias("offers"), "known")


def _lacking(mark: str, other: str) -> Column:
    """Letters of one text that the other has not, at least."""
    return F.bit_count(F.col(mark).bitwiseAND(F.bitwise_not(other)))


def _may_reach(a: str, b: str, percent: int) -> Column:
    """False if the marks of two texts tell that they are less similar than that; two empty ones may be."""
    n, m = F.col(f"_n_{a}_a"), F.col(f"_n_{b}_b")
    shared = F.least(n - _lacking(f"_mark_{a}_a", f"_mark_{b}_b"), m - _lacking(f"_mark_{b}_b", f"_mark_{a}_a"))
    return 200 * shared >= percent * (n + m)


def _may_match(names: int) -> Column:
    """Whether handles, names with handles included, may reach 70 % or names as much as given: no rule accepts a pair with less."""
    return (_may_reach("handle_core", "handle_core", 70) | _may_reach("name_key", "handle_core", 70) | _may_reach("handle_core", "name_key", 70)
            | _may_reach("name_words", "name_words", names) | _may_reach("name_key", "name_key", names))


def _contrary() -> Column:
    """Facts against a pair, from what both sides know; cities of one hash pass for one."""
    city_a, city_b = (F.shiftright(f"_place_{s}", 32) for s in "ab")
    age_a, age_b = (F.col(f"_place_{s}").bitwiseAND(F.lit(0xFFFFFFFF)) for s in "ab")
    return ((city_a != 0) & (city_b != 0) & (city_a != city_b)).cast("int") + (
        (age_a != 0) & (age_b != 0) & (F.abs(age_a - age_b) > AGE_GAP)).cast("int")


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select("_k", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "_k"]) for s in "ab")


def _apart() -> Column:
    return F.col("_platform_a") != F.col("_platform_b")


def _open_pairs(side: DataFrame) -> DataFrame:
    """Pairs of small blocks."""
    a, b = _halves(side.select(F.explode("open").alias("_k"), "_id", "_platform", "_place", "_handle", *_COMPARED))
    # one fact against a pair is too many on one platform and two are on any, but for one handle on two networks
    fits = (_contrary() == 0) | (_apart() & ((_contrary() == 1) | (F.col("_handle_a") == F.col("_handle_b"))))
    return a.join(b, "_k").where((F.col("_id_a") < F.col("_id_b")) & fits & _may_match(92)).select("_id_a", "_id_b")


def _alike_pairs(side: DataFrame) -> DataFrame:
    """Pairs of large blocks with one text of each that are alike enough."""
    a, b = _halves(_alike_rows(side))
    lack_a, lack_b = _lacking("_mark_a", "_mark_b"), _lacking("_mark_b", "_mark_a")
    near = (lack_a <= F.col("_spare_a").bitwiseAND(F.lit(0x7FFFFFFF))) & (lack_b <= F.col("_spare_b").bitwiseAND(F.lit(0x7FFFFFFF)))
    nearer = (lack_a < F.shiftright("_spare_a", 31).bitwiseAND(F.lit(0x7FFFFFFF))) & (lack_b < F.shiftright("_spare_b", 31).bitwiseAND(F.lit(0x7FFFFFFF)))
    same_handle = (F.shiftright("_spare_a", 62) == 0) & (lack_a == 0) & (lack_b == 0)
    fits = F.when(_contrary() == 0, _apart() | nearer).otherwise(_apart() & (((_contrary() == 1) & nearer) | same_handle))
    return a.join(b, "_k").where((F.col("_id_a") < F.col("_id_b")) & near & fits).select("_id_a", "_id_b")


def _weak_pairs(side: DataFrame) -> DataFrame:
    """Pairs of large blocks and two platforms with a category in common and nothing against them."""
    spark = side.sparkSession
    # the work is the pairs of a key and not its bytes, so small partitions must not be put together again
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def half(on, name):
        return side.select(F.explode(on).alias("_k"), *[F.col(c).alias(f"{c}_{name}") for c in (
            "_id", "_platform", "_place", "known", *TEXTS, *_COMPARED)]).repartition(parts, "_k")
    a, b = F.col("_id_a"), F.col("_id_b")
    age_a, age_b = (F.col(f"_place_{s}").bitwiseAND(F.lit(0xFFFFFFFF)) for s in "ab")
    by_band = F.col("known_a") % 2 == 1
    lower = by_band & (F.floor(age_a / (AGE_GAP + 1)) < F.floor(age_b / (AGE_GAP + 1)))
    once = (F.col("known_a") < F.col("known_b")) | (a < b) | lower
    of_age = (age_a == 0) | (age_b == 0) | (F.abs(age_a - age_b) <= AGE_GAP)
    met = half(_weak_keys(True), "a").join(half(_weak_keys(False), "b"), "_k").where(_apart() & of_age & (a != b) & once & _may_match(95))
    near = met.select("_id_a", "_id_b", pair_similarity(*[f"{c}_{s}" for c in TEXTS for s in "ab"]).alias("sim"))
    hand, name = F.greatest("sim.handle_sim", "sim.cross_sim"), F.col("sim.name_sim")
    return near.where((0.5 * hand / 100 + 0.35 * name / 100 + 0.15 >= REVIEW_SCORE - 1e-9) & ((hand >= 70 - 1e-9) | (name >= 95 - 1e-9))).select(
        "_id_a", "_id_b")


def candidate_pairs(df: DataFrame, key: str, carry: list[str], plain: int = PLAIN) -> DataFrame:
    """Pairs that share a block and may be accepted, each once, with the columns in ``carry`` of both sides as ``*_a`` and ``*_b`` (C4).

    Rows meet by the numbers of their accounts alone; the columns are added once a pair is known. Which pairs beyond the acceptable ones come
    along depends on the sizes of the blocks.
    """
    side = cut_lineage(_placed(df, key, plain))
    a, b = F.col("_id_a"), F.col("_id_b")
    ids = _open_pairs(side).unionByName(_alike_pairs(side)).unionByName(_weak_pairs(side)).select(
        F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")).distinct()
    columns = [key, *carry]

    def facts(name):
        return side.select(F.col("_id").alias(f"_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    pairs = ids.join(facts("x"), "_x").join(facts("y"), "_y")
    ordered = F.col(f"{key}_x") < F.col(f"{key}_y")
    return pairs.select(*[F.when(ordered, F.col(f"{c}_{one}")).otherwise(F.col(f"{c}_{other}")).alias(f"{c}_{s}")
                          for s, one, other in (("a", "x", "y"), ("b", "y", "x")) for c in columns])
