"""Filter interaction audit: what every order of five document filters keeps, removes and removes twice.

Four filters look at one text; the fifth fails a text that a document with a smaller id has too, word for word, anywhere in the
table. Equal texts are found in radix tries. Every task inserts the texts it reads into a compressed trie that holds, where a text
ends, the smallest id seen and what the documents with it are counted under; a document pushed aside by a smaller id is settled
at once. So each task sends a text once, whatever number of copies it has. Texts are range-partitioned by prefixes as long as they
need to be to cut the table into even parts, and the same trie per part finds the smallest id of all.
What is left of a document is its mask of failed filters; masks are counted by part of the table, and the 120 orders are read off
those counts.

Null texts count as empty. Ids are integers; a document without one has no labels, neither fails the copy filter nor makes another fail it, and
documents that share both text and smallest id all pass. Repeated rows count each time. Where ``labels`` repeats an id, one row saying 1 is enough.
A part of the table is a value of ``lang``, null being the empty string; an empty table has no parts and gives no rows. Texts
of any length are read whole; a trie holds a bounded number of bytes more than its longest text before a task sends it on. Only the named columns are
read, so others may have any names.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import stored, table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BLANK_BYTES = bytes([0x20, *range(0x09, 0x0E)])
CAPITALS = bytes(range(0x41, 0x5B))
SYMBOLS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))

#: texts sampled for each part, to place the cuts between parts; the cuts decide only where a text is dealt to
SAMPLE = 64
#: first length of a prefix, and how much longer it gets where too many texts share it
PREFIX, LONGER = 32, 4
#: characters a part should hold
PART_CHARS = 32_000_000
#: bytes a task's trie holds before it is sent on
TRIE_BYTES = 48_000_000


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # on bytes: the blank and \t to \r
    n, capitals = len(words), len(text) - len(text.translate(None, CAPITALS))
    failed = (n < 100, 100 * len(set(words)) < 80 * n, 100 * capitals > 10 * len(text.translate(None, CONTINUATION)),
              len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


class RadixTrie:
    """A compressed trie of byte strings that keeps the smallest id of each string and the rows that have it.

    A node is ``[edges by first byte, end]``, an edge ``[label, node]``, an end ``[id, counts by row]``.
    """

    def __init__(self):
        self.root, self.size = [{}, None], 0

    def place(self, text: bytes) -> list:
        """The node where ``text`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                leaf = [{}, None]
                node[0][text[at]] = [text[at:], leaf]
                self.size += len(text) - at + 400
                return leaf
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, differ = 0, min(len(label), len(text) - at) + 1  # the first ``same`` bytes agree, ``differ`` of them do not
            while differ - same > 1:
                middle = (same + differ) // 2
                if text.startswith(label[:middle], at):
                    same = middle
                else:
                    differ = middle
            fork = [{label[same]: [label[same:], child]}, None]
            edge[:] = [label[:same], fork]
            self.size += 400
            node, at = fork, at + same
        return node

    def insert(self, text: bytes, ident: int, row: tuple, n: int) -> list[tuple]:
        """Count ``row`` at ``text``; returns the (id, row, n) that are now known to have a smaller id beside them."""
        node = self.place(text)
        end = node[1]
        if end is None:
            node[1] = [ident, {row: n}]
            return []
        if ident > end[0]:
            return [(ident, row, n)]
        if ident == end[0]:
            end[1][row] = end[1].get(row, 0) + n
            return []
        aside = [(end[0], r, k) for r, k in end[1].items()]
        node[1] = [ident, {row: n}]
        return aside

    def ends(self) -> Iterator[tuple[bytes, int, dict]]:
        """(text, smallest id, counts by row) of every string, in depth-first order."""
        ahead = [(b"", self.root)]
        while ahead:
            text, node = ahead.pop()
            if node[1] is not None:
                yield text, node[1][0], node[1][1]
            ahead.extend((text + label, child) for label, child in node[0].values())


_DEALT = pa.schema([("to", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_DEALT_DDL = "to int, text binary, doc_id long, part string, mask int, n long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; the second value of a row may be long bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[1]) if isinstance(row[1], bytes) else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _deal(parts: int, cuts: list[bytes]):
    """Arrow function over (doc_id, text, part): texts once per task with their smallest id, documents settled already without text."""
    def spread(ident):
        return (ident or 0) * 0x9E3779B1 % 2 ** 32 * parts >> 32  # evenly over the parts

    def send(trie):
        for text, ident, rows in trie.ends():
            to = bisect_right(cuts, text)
            for (part, mask), n in rows.items():
                yield to, text, ident, part, mask, n

    def rows(batches):
        trie = RadixTrie()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for ident, text, part in zip(batch.column("doc_id").to_pylist(), texts, batch.column("part").to_pylist()):
                text = text.as_py() or b""
                mask = text_mask(text)
                if ident is None:
                    yield 0, None, None, part, mask, 1
                    continue
                for i, (p, m), n in trie.insert(text, ident, (part, mask), 1):
                    yield spread(i), None, i, p, m | COPY, n
                if trie.size > TRIE_BYTES:
                    yield from send(trie)
                    trie = RadixTrie()
        yield from send(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _DEALT)
    return run


_SETTLED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over one part: the smallest id of every text in it, and with it the whole mask of every document."""
    def rows():
        trie = RadixTrie()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "n")]
            for text, ident, part, mask, n in zip(batch.column("text"), *columns):
                text = text.as_py()
                if text is None:
                    yield ident, part, mask, n
                    continue
                for i, (p, m), k in trie.insert(text, ident, (part, mask), n):
                    yield i, p, m | COPY, k
        for _, ident, held in trie.ends():
            for (part, mask), n in held.items():
                yield ident, part, mask, n
    yield from _batches(rows(), _SETTLED)


def prefix_cuts(docs: DataFrame, parts: int, rows: int) -> list[bytes]:
    """Prefixes that cut the texts into about even parts, at most ``parts`` - 1 of them, in order.

    Works on a hashed sample of ``SAMPLE`` distinct texts a part. Prefixes start short and grow only where too many characters
    stand behind one, so a long passage at the head of many texts costs a few more rounds and not a crowded part.
    """
    share = max(1, rows // (SAMPLE * parts))
    sampled = stored(docs.select("text", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(share)) == 0).dropDuplicates(["h"]).select(
        "text", (F.length("text") + 200).alias("weight")))
    total = sampled.agg(F.sum("weight")).first()[0] or 0
    leaves, width, rest = [], PREFIX, sampled
    while True:
        prefix = F.substring("text", 1, width)
        found = rest.groupBy(prefix.alias("prefix")).agg(F.sum("weight").alias("weight"), F.max(F.length("text")).alias("longest")).collect()
        heavy = [r["prefix"] for r in found if r["weight"] > total / (2 * parts) and r["longest"] > width]
        known = set(heavy)
        leaves += [(r["prefix"].encode(), r["weight"]) for r in found if r["prefix"] not in known]
        if not heavy:
            break
        rest, width = rest.where(prefix.isin(heavy)), width * LONGER
    cuts, passed = [], 0
    for prefix, weight in sorted(leaves):
        if passed >= total / parts * (len(cuts) + 1) and prefix:
            cuts.append(prefix)
        passed += weight
    return cuts[:parts - 1]


def document_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): the filters that documents fail, as bits of ``FILTERS``, and how many rows say so."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows, chars = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS)
    cuts = prefix_cuts(plain.select("text"), parts, rows)
    dealt = plain.mapInArrow(_deal(parts, cuts), _DEALT_DDL).repartitionById(parts, F.col("to"))
    return dealt.mapInArrow(_settle, "doc_id long, part string, mask int, n long")


def tally(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by failed filters, and how many of them are labelled good and toxic."""
    def said(column):
        return F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0)).alias(column)
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left")
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def all_steps() -> list[dict]:
    """Every step of every order: the bit of its filter and the bits of the filters before it."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            found.append({"filter_order": "".join(order), "step": step, "own": bit, "before": before})
            before |= bit
    return found


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step from the counts of ``tally``; sums over at most 32 masks, zeros included.

    A document that fails s filters is removed by each of them in 120 / s of the orders, which gives ``shapley`` directly.
    """
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.from_json(F.lit(json.dumps(all_steps())), "array<struct<filter_order string, step int, own int, before int>>")
    each = masks.select("part", "masks", F.inline(steps))
    own, before, none = F.col("own"), F.col("before"), F.lit(0).cast("long")

    def over(which, of):
        return F.aggregate(F.filter("masks", which), none, lambda s, m: s + of(m))

    def fails(m):
        return m["mask"].bitwiseAND(own) != 0

    def gone(m):
        return m["mask"].bitwiseAND(before) != 0

    def here(m):
        return fails(m) & ~gone(m)
    return each.select(
        "part", "filter_order", "step", over(lambda m: m["mask"].bitwiseAND(before.bitwiseOR(own)) == 0, lambda m: m["n"]).alias("kept"),
        over(here, lambda m: m["n"]).alias("removed"), over(lambda m: fails(m) & gone(m), lambda m: m["n"]).alias("redundant"),
        over(lambda m: m["mask"] == own, lambda m: m["n"]).alias("unique_fails"), over(here, lambda m: m["good"]).alias("good_lost"),
        over(here, lambda m: m["toxic"]).alias("toxic_lost"),
        over(fails, lambda m: (m["n"] * 120 / F.bit_count(m["mask"])).cast("long")).alias("shapley"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts),
marks AS (SELECT doc_id AS marked, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
docs AS (SELECT part, [a, b, c, d, e] AS f, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM failed LEFT JOIN marks ON doc_id = marked),
groups AS (
  SELECT part, f, len(list_filter(f, lambda x: x)) AS s, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, s, n, good, bad, f[ascii(substr(filter_order, step, 1)) - 64] AS own,
         len(list_filter(range(1, step), lambda i: f[ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 64])) > 0 AS gone FROM groups, steps)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE own AND s = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(bad) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(s, 1)) FILTER (WHERE own), 0) AS BIGINT) AS shapley
FROM seen GROUP BY ALL"""


@query("op12_filter_audit", SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = document_masks(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return interactions(tally(masks, table(spark, sf_dir, "labels")))
