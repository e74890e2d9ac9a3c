"""Order statistics and joins that stay flat when one key or value holds a large share of the rows.

Three ideas are shared by every job that ranks, takes medians or joins back an aggregate:

* values are counted first (map-side combine), so a value repeated a billion times is one row afterwards;
* cumulative counts are taken inside value buckets cut at approximate quantiles, and the bucket totals, of which
  there are a few for each shuffle partition, are accumulated separately, so no window sees a whole group;
* when an aggregate is joined back to its rows, the heaviest keys travel in a broadcast of at most ``HOT_KEYS``
  rows and their rows are spread by a salt, so no reducer receives a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import cut_lineage

#: least number of value buckets; more partitions cut more of them
BUCKETS = 64
HOT_KEYS = 1000
SPREAD = 1021


def cumulative_counts(df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None,
                      weight: str | None = None) -> DataFrame:
    """Distinct ``(groups, value)`` with ``n`` rows, ``before`` rows below the value and ``total`` in the group.

    Values keep their type, a number or a string. Null values are left out. A row counts ``weight`` times, once without it. Exact:
    the approximate quantiles only decide where buckets are cut.
    """
    groups = list(groups)
    buckets = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*groups, F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")))
    # rises with the value, not always strictly: enough to cut buckets
    height = F.col("value").cast("double")
    if dict(counted.dtypes)["value"] == "string":
        height = F.conv(F.rpad(F.substring(F.hex(F.encode("value", "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("double")
    cuts = counted.agg(F.percentile_approx(height, F.lit([i / buckets for i in range(1, buckets)]), max(1000, 20 * buckets))
                       .alias("cuts")).scalar()
    placed = counted.withColumn("_height", height).withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<double>"))).withColumn(
        "bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_height")))).drop("_cuts", "_height")
    inside = Window.partitionBy(*groups, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = (placed.groupBy(*groups, "bucket").agg(F.sum("n").alias("_in"))
               .withColumn("_offset", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
               .withColumn("total", F.sum("_in").over(whole))
               .select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("bucket").alias("_b"), "_offset", "total"))
    match = [placed[g].eqNullSafe(offsets[f"_g_{g}"]) for g in groups] + [placed["bucket"] == offsets["_b"]]
    condition = match[0]
    for extra in match[1:]:
        condition = condition & extra
    return (placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(offsets, condition)
            .select(*groups, "value", "n", (F.col("_inside") + F.col("_offset")).alias("before"), "total"))


def spread_evenly(df: DataFrame) -> DataFrame:
    """The same rows dealt in equal shares, whatever their keys and however few files or row groups they were read from.

    For rows that cost much more than their bytes tell. The number of shares is explicit, as small partitions would be put
    together again: four a core, or a quarter of the shuffle partitions where these were raised.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: both sides are shuffled and sorted, whatever size is expected of it.

    Expected sizes start from compressed files and know nothing of rows that are made of one row, so tables of millions of accounts pass for
    a few MB and would be collected on the driver to be broadcast.
    """
    return df.hint("merge")


def unpivot_measures(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long form ``(groups, measure, value)`` of several numeric columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(*groups, F.inline(pairs))


def exact_medians(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per group with the exact median of every measure under its own name (null when it has no values)."""
    groups = list(groups)
    counts = cumulative_counts(unpivot_measures(df, groups, measures), [*groups, "measure"], "value")
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    reach = F.col("before") + F.col("n")
    middle = counts.groupBy(*groups, "measure").agg(
        ((F.min(F.when(reach > low, F.col("value"))) + F.min(F.when(reach > high, F.col("value")))) / 2).alias("mid"))
    return middle.groupBy(*groups).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("mid"))).alias(m) for m in measures])


def hot_first_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, spread_by: str,
                   take: Sequence[str]) -> DataFrame:
    """Left join to a ``right`` that is unique on ``on``, with the heaviest keys kept out of the shuffle.

    ``weight`` is the number of left rows behind a right row. The heaviest ``HOT_KEYS`` right rows are broadcast, a
    bound that holds at any input size; the rows they match get a random-looking salt that finds no partner in the
    shuffled join, so they spread evenly instead of meeting in one task.
    """
    on = list(on)
    payload = F.struct(*take)
    hot = right.orderBy(F.desc(weight), *on).limit(HOT_KEYS).select(
        *[F.col(k).alias(f"_h_{k}") for k in on], payload.alias("_hot"))
    cold = right.select(*[F.col(k).alias(f"_c_{k}") for k in on], payload.alias("_cold"),
                        F.lit(0).alias("_cold_salt"))
    with_hot = left.join(F.broadcast(hot), [left[k] == hot[f"_h_{k}"] for k in on], "left")
    resting = F.col("_hot").isNotNull()
    for k in on:
        resting = resting | F.col(k).isNull()
    salted = with_hot.withColumn(
        "_salt", F.when(resting, 1 + F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int"))
    joined = salted.join(cold, [F.col(k) == F.col(f"_c_{k}") for k in on] + [F.col("_salt") == F.col("_cold_salt")],
                         "left")
    return joined.select(*left.columns,
                         *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in take])


def sparse_join(left: DataFrame, right: DataFrame, on: str, spread_by: str) -> DataFrame:
    """Left join on a key that most left rows lack. Rows without it find no partner anyway, so a salt spreads them
    instead of sending them all to the reducer of the null key."""
    salt = F.when(F.col(on).isNull(), 1 + F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0)), [on, "_salt"], "left").drop("_salt")


def percent_ranks(df: DataFrame, key: str, specs: dict[str, tuple[Column, bool]], absent: float = 0.3) -> DataFrame:
    """Add tie-averaged percent ranks (E4): ``specs`` maps output name to (value, higher is better).

    The rank is ``(average position among non-null values) / (their count)``, counted from the best-ranked-last end,
    and null values get ``absent``. Ranks are looked up for distinct combinations of values, which are narrow rows; the
    rows themselves, however wide, are shuffled once, whatever the number of ranks.
    """
    names = list(specs)
    parts = [f"_v{i}" for i in range(len(names))]
    wide = df.withColumns({v: specs[name][0].cast("double") for v, name in zip(parts, names)})
    # written once: the counts and every rank read them
    combos = cut_lineage(wide.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows")))
    # written once: each rank reads one slice of it twice, and a filter pushed into it would rebuild it every time
    counts = cut_lineage(cumulative_counts(
        combos.select("_rows", F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(v).alias("_value"))
                                                  for i, v in enumerate(parts)]))), ["_m"], "_value", weight="_rows"))
    ranked = combos.withColumn("_mixed", F.xxhash64(*parts))
    average = F.col("before") + (F.col("n") + 1) / 2
    for i, name in enumerate(names):
        place = average if specs[name][1] else F.col("total") - F.col("before") - (F.col("n") - 1) / 2
        table = counts.where(F.col("_m") == i).select(F.col("value").alias(parts[i]), "n",
                                                      (place / F.col("total")).alias(name))
        ranked = hot_first_join(ranked, table, [parts[i]], "n", "_mixed", [name])
    # a struct is never null itself and equal where all its parts are, nulls included
    together = F.struct(*parts)
    wide = hot_first_join(wide.withColumn("_values", together), ranked.withColumn("_values", together), ["_values"], "_rows", key, names)
    return wide.withColumns({name: F.coalesce(F.col(name), F.lit(absent)) for name in names}).drop("_values", *parts)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark limits each map task to ``k`` rows per group before it shuffles."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
