"""Exact top-k search by inner product: pivot tables give bounds, candidates are scored in the order of their bounds.

With integer vectors q and v, 2 q.v = |q|^2 + |v|^2 - d(q, v)^2, and for any pivot p the distance d(q, v) is at least
|d(q, p) - d(v, p)|. The largest of these over all pivots bounds the score from above. Distances to the pivots are worked
out once per vector. Vectors are ranged by nearest pivot and the distance to it, and cut into blocks of at most ``BLOCK`` rows, so
neither a crowded cell nor a vector that a third of the rows repeat makes a large block. A query first meets its own block; its
k-th score there is what other blocks have to reach. A block is visited only if the intervals of its members' pivot distances allow
such a score; in it candidates are scored from the highest bound down until the bound falls below the k-th score
known. Nothing is approximated, and no query or candidate is left out.

Rows without an id, and vectors that are null, empty or hold null or non-finite components, take no part; nor do vectors of
another length than the one with the smallest id. Rows that repeat an id count once, with the smaller vector. Components beyond +-2^27 once scaled count
as that; scores must fit a long. Equal scores go to the smaller id. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import finite, scaled, stored, table

TOP, SCALE, EVERY = 5, 256, 50
#: pivots, and the rows they are chosen from (those with the least hashes of their ids)
PIVOTS, SAMPLE = 32, 2048
BLOCK = 4096
#: queries compared with a block at once, and candidates scored before the bounds are looked at again
TOGETHER, STRIDE = 64, 128
#: a bound is a little more than the floating-point one, which errs by far less
SLACK = 1e-9


def choose_pivots(sample: np.ndarray, wanted: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample far from each other: each next one is the farthest from those already chosen."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < wanted and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _scores(left: np.ndarray, right: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products of two sets of integer vectors; ``norms`` is at least the product of the largest two norms."""
    if norms < 2.0 ** 52:  # every partial sum is a whole number that a double holds
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _measured(pivots: np.ndarray):
    """Arrow function: adds the squared norm, the distances to the pivots and the nearest pivot to (vec_id, ints)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _matrix(batch.column("ints"), len(batch)).astype(np.int64)
            far = np.stack([np.sqrt(((ints - p) ** 2).sum(axis=1).astype(np.float64)) for p in pivots], axis=1)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("ints"), pa.array((ints ** 2).sum(axis=1)), _lists(far), pa.array(cell.astype(np.int32)),
                 pa.array(far[np.arange(len(far)), cell])], names=["vec_id", "ints", "norm", "far", "cell", "near"])
    return run


def _blocks(top: int, every: int, size: int):
    """Arrow function over a range of rows: numbers their blocks and gives every query its ``top``-th score in its own block."""
    def block(number, rows):
        ids, norms = rows.column("vec_id").to_numpy(), rows.column("norm").to_numpy()
        ints = _matrix(rows.column("ints").combine_chunks(), len(rows))
        least = np.full(len(ids), np.iinfo(np.int64).min)
        if len(ids) > top:
            asked = np.flatnonzero(ids % every == 0)
            for at in np.array_split(asked, len(asked) // TOGETHER + 1):
                if len(at):
                    scores = _scores(ints[at], ints, float(norms.max()))
                    scores[np.arange(len(at)), at] = np.iinfo(np.int64).min
                    least[at] = np.partition(scores, -top, axis=1)[:, -top]
        yield from rows.select(["vec_id", "ints", "norm", "far"]).append_column("least", pa.array(least)).append_column(
            "block", pa.array(np.full(len(ids), number))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while len(held) >= size:
                yield from block(number, held.slice(0, size))
                number, held = number + 1, held.slice(size)
        if held is not None and len(held):
            yield from block(number, held)
    return run


def _search(top: int):
    """Arrow function over blocks: the rows of a block come first, then the queries that visit it."""
    def best(ids, scores):
        order = np.lexsort((ids, -scores))[:top]
        return ids[order], scores[order]

    def visit(block, asked):
        ids, ints, norms, far = block
        q_ids, q_ints, q_norms, q_far, q_least = asked
        apart = np.zeros((len(q_ids), len(ids)))
        for p in range(far.shape[1]):
            np.maximum(apart, np.abs(q_far[:, p, None] - far[None, :, p]), out=apart)
        both = q_norms[:, None].astype(np.float64) + norms[None, :]
        bounds = (both - apart ** 2) / 2 + SLACK * both + 1e-6
        reach = float(np.sqrt(float(q_norms.max()) * float(norms.max())))
        for i in range(len(q_ids)):
            bound, least = bounds[i], q_least[i]
            alive = np.flatnonzero((bound >= least) & (ids != q_ids[i]))
            alive = alive[np.argsort(-bound[alive], kind="stable")]
            found, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STRIDE
            while at < len(alive) and bound[alive[at]] >= least:
                now = alive[at:at + step]
                now = now[bound[now] >= least]
                found, scores = best(np.append(found, ids[now]), np.append(scores, _scores(q_ints[i:i + 1], ints[now], reach)[0]))
                if len(scores) == top:
                    least = max(least, scores[-1])
                at, step = at + step, 2 * step
            yield from zip([int(q_ids[i])] * len(found), found.tolist(), scores.tolist())

    def columns(batch, at):
        part = batch.take(pa.array(at))
        return (part.column("vec_id").to_numpy(), _matrix(part.column("ints"), len(at)), part.column("norm").to_numpy(),
                _matrix(part.column("far"), len(at)), part.column("least").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, block = None, [], None
        for batch in batches:
            numbers, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            out = []
            for here in sorted(set(numbers.tolist())):
                if here != number:
                    number, pieces, block = here, [], None
                mine = numbers == here
                members, asked = np.flatnonzero(mine & ~asks), np.flatnonzero(mine & asks)
                if len(members):
                    pieces.append(columns(batch, members)[:4])
                for at in np.array_split(asked, len(asked) // TOGETHER + 1):
                    if len(at):
                        block = block or tuple(np.concatenate(x) for x in zip(*pieces))
                        out += visit(block, columns(batch, at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])
    return run


def blocked(df: DataFrame, vec_id: str, vector: str, top: int, every: int, scale: int, size: int) -> tuple[DataFrame, int]:
    """``(rows, ranges)``: (block, vec_id, ints, norm, far, least) of every vector that takes part, and the ranges blocks lie in."""
    fit = df.where(finite(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("ints"))
    first = fit.orderBy("vec_id", "ints").select(F.size("ints")).first()
    fit = fit.where(F.size("ints") == (first[0] if first else 0))
    vectors = stored(fit.groupBy("vec_id").agg(F.min("ints").alias("ints")))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("ints").collect()
    pivots = choose_pivots(np.array([r[0] for r in sample], np.int64)) if sample else np.zeros((1, 0), np.int64)
    measured = stored(vectors.mapInArrow(_measured(pivots), "vec_id long, ints array<int>, norm long, far array<double>, cell int, near double"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "near", "vec_id"]
    rows = measured.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(
        _blocks(top, every, size), "vec_id long, ints array<int>, norm long, far array<double>, least long, block long")
    return stored(rows), len(pivots)


def visits(rows: DataFrame, pivots: int, every: int) -> DataFrame:
    """The query rows of ``blocked``, once for each block that may hold one of their best, under that block's number."""
    def each(pick):
        return F.array(*[pick(F.get("far", F.lit(i))) for i in range(pivots)])
    of_range = F.shiftright("block", 32)
    spans = stored(rows.groupBy("block").agg(F.max("norm").alias("_norm"), each(F.min).alias("_low"), each(F.max).alias("_high"))
                   .withColumn("_range", of_range))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).drop("block")
    # each query meets the blocks range by range, so that the ranges can be worked on apart
    last = spans.agg(F.max("_range")).first()[0] or 0
    met = asked.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(spans, "_range")
    apart = F.array_max(F.zip_with("far", F.arrays_zip("_low", "_high"), lambda d, s: F.greatest(d - s["_high"], s["_low"] - d, F.lit(0.0))))
    both = (F.col("norm") + F.col("_norm")).cast("double")
    return met.where((both - apart * apart) / 2 + SLACK * both + 1e-6 >= F.col("least")).select("block", "vec_id", "ints", "norm", "far", "least")


def search(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, every: int = EVERY, scale: int = SCALE,
           block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best other rows for each row whose id is divisible by ``every``."""
    rows, pivots = blocked(df, vec_id, vector, top, every, scale, block)
    columns = ["block", "vec_id", "ints", "norm", "far", "least"]
    both = rows.select(*columns, F.lit(False).alias("asks")).unionByName(visits(rows, pivots, every).withColumn("asks", F.lit(True)))
    found = both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(_search(top), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= {TOP}"""


@query("op13_topk_search", SQL)
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
