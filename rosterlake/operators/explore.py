"""Faceted exploration of the profile table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import values
from rosterlake.operators.scale import exact_medians, top_per_group
from rosterlake.vocab import words

FACETS = ("region", "city", "age_band", "gender", "size_tier", "budget_tier", "languages", "engagement",
          "primary_platform", "segment")
FIXED_ORDER = {"age_band": [b[0] for b in words.AGE_BANDS], "budget_tier": [b[0] for b in words.BUDGET_TIERS],
               "size_tier": [b[0] for b in words.SIZE_TIERS], "engagement": list(words.ENGAGEMENT_ORDER)}
SORTS = {"fit_value": ("cpv", True), "followers": ("followers", False), "er": ("er_vs_tier", False),
         "price_low": ("rate_reel", True), "price_high": ("rate_reel", False)}
CITY_FACET_SIZE = 18
SAMPLE_SIZE = 500
MEASURES = {"median_followers": "followers", "median_er": "er", "median_rate": "rate_reel", "median_cpv": "cpv"}


def filter_columns(df: DataFrame, filters: dict) -> dict[str, Column]:
    """One condition per active filter."""
    out = {}
    for field, wanted in filters.items():
        if not wanted:
            continue
        if field == "q":
            text = wanted.strip().lower().lstrip("@")
            hay = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("handle", F.lit("")),
                                      F.coalesce("city", F.lit("")), F.array_join("tags", " ")))
            if text:
                out[field] = hay.contains(text)
        elif field in ("niche", "languages"):
            column = "categories" if field == "niche" else "languages"
            out[field] = F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))
        elif field in df.columns:
            out[field] = F.col(field).isin(list(wanted))
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def apply_filters(df: DataFrame, filters: dict, skip: str | None = None) -> DataFrame:
    return df.where(_all([c for f, c in filter_columns(df, filters).items() if f != skip]))


def page(df: DataFrame, filters: dict, sort: str = "fit_value", offset: int = 0, limit: int = 24) -> DataFrame:
    """One page of creators, unknown values last (F1)."""
    column, rising = SORTS.get(sort, SORTS["followers"])
    by = F.asc_nulls_last(column) if rising else F.desc_nulls_last(column)
    return apply_filters(df, filters).orderBy(by, "creator_id").offset(offset).limit(limit)


def facet_counts(df: DataFrame, filters: dict, facets=FACETS) -> DataFrame:
    """Counts per facet value, each facet under every filter but its own, in one scan."""
    conditions = filter_columns(df, filters)
    nothing = F.array().cast("array<string>")
    entries = []
    for facet in [f for f in facets if f in df.columns]:
        chosen = F.coalesce(F.col(facet), nothing) if facet == "languages" else F.array(F.col(facet).cast("string"))
        others = _all([c for f, c in conditions.items() if f != facet])
        entries.append(F.struct(F.lit(facet).alias("facet"), F.when(others, chosen).otherwise(nothing).alias("vals")))
    counts = (df.select(F.inline(F.array(*entries))).select("facet", F.explode("vals").alias("value"))
              .where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count")))
    place = F.lit(99)
    for facet, order in FIXED_ORDER.items():
        position = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), F.col("value")), F.lit(0)), F.lit(99))
        place = F.when(F.col("facet") == facet, position).otherwise(place)
    order = [place, F.desc("count"), F.col("value")]
    cities = top_per_group(counts.where(F.col("facet") == "city"), ["facet"], order, CITY_FACET_SIZE, "position")
    rest = counts.where(F.col("facet") != "city").withColumn(
        "position", F.row_number().over(Window.partitionBy("facet").orderBy(*order)))
    return rest.unionByName(cities)


def top_values(df: DataFrame, group: str, value: Column, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values per group as one ordered list."""
    counts = (df.select(group, value.alias("value")).where(F.col("value").isNotNull())
              .groupBy(group, "value").agg(F.count(F.lit(1)).alias("n")))
    best = top_per_group(counts, [group], [F.desc("n"), F.col("value")], k)
    return best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                                               lambda r: r["value"]).alias(name))


def niche_tiles(df: DataFrame, filters: dict) -> DataFrame:
    """Per niche: size, medians, leading cities and tags; ignores the niche filter."""
    shown = apply_filters(df, filters, skip="niche")
    medians = exact_medians(shown, ["niche"], list(MEASURES.values())).select(
        "niche", *[F.col(c).alias(name) for name, c in MEASURES.items()])
    nothing = F.array().cast("array<string>")
    tiles = (shown.groupBy("niche").agg(F.count(F.lit(1)).alias("count")).join(medians, "niche", "left")
             .join(top_values(shown, "niche", F.col("city"), 3, "top_cities"), "niche", "left")
             .join(top_values(shown, "niche", F.explode("tags"), 4, "top_tags"), "niche", "left"))
    return tiles.withColumn("top_cities", F.coalesce("top_cities", nothing)).withColumn(
        "top_tags", F.coalesce("top_tags", nothing)).orderBy(F.desc("count"), "niche")


def matched_stats(df: DataFrame, filters: dict) -> DataFrame:
    """Medians and distinct counts of the matched set, one row per statistic."""
    shown = apply_filters(df, filters)
    medians = exact_medians(shown, [], list(MEASURES.values())).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("stat"), F.col(c).alias("value")) for name, c in MEASURES.items()])))
    distinct = (shown.select(F.lit("cities").alias("stat"), F.col("city").alias("v"))
                .unionByName(shown.select(F.lit("languages").alias("stat"), F.explode("languages").alias("v")))
                .groupBy("stat").agg(F.countDistinct("v").cast("double").alias("value")))
    return medians.unionByName(distinct)


def niche_budget_tree(df: DataFrame, filters: dict) -> DataFrame:
    """Niche by budget tier, biggest niche first."""
    counts = apply_filters(df, filters).groupBy("niche", F.coalesce("budget_tier", F.lit("Rate unknown")).alias("budget")).agg(
        F.count(F.lit(1)).alias("n"))
    tiers = F.array(*[F.lit(b[0]) for b in words.BUDGET_TIERS])
    place = F.coalesce(F.nullif(F.array_position(tiers, F.col("budget")), F.lit(0)), F.lit(99)).cast("int")
    return counts.groupBy("niche").agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("budget"), F.col("n")))).alias("children")).orderBy(
        F.desc("total"), "niche")


def scatter_sample(df: DataFrame, filters: dict, size: int = SAMPLE_SIZE, seed: int = 1) -> DataFrame:
    """A fixed-size repeatable sample of rows with followers and engagement."""
    shown = apply_filters(df, filters).where(F.col("followers").isNotNull() & F.col("er").isNotNull())
    return shown.orderBy(F.md5(F.concat_ws("|", "creator_id", F.lit(str(seed)))), "creator_id").limit(size).select(
        "creator_id", "name", "niche", "followers", "er", "rate_reel", "city")


def coverage(df: DataFrame) -> DataFrame:
    """Percent of creators with a value, per field (F8)."""
    fields = {"city": "city", "age": "age", "rate": "rate_reel", "views": "avg_views", "er": "er"}
    shares = df.agg(*[F.bround(F.avg(F.col(c).isNotNull().cast("int")) * 100, 0).alias(f) for f, c in fields.items()])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("percent")) for f in fields])))


def segment_counts(df: DataFrame, filters: dict) -> DataFrame:
    """Creators per segment inside the current filter."""
    mine = _all(filter_columns(df, filters).values())
    return df.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(mine).alias("in_filter"))


def options(df: DataFrame) -> DataFrame:
    """Values to offer in a brief form, most frequent first."""
    one = {"niches": "niche", "cities": "city", "regions": "region"}
    many = {"languages": "languages", "brands": "brands"}
    nothing = F.array().cast("array<string>")
    entries = [F.struct(F.lit(o).alias("option"), F.array(F.col(c)).alias("vals")) for o, c in one.items()]
    entries += [F.struct(F.lit(o).alias("option"), F.coalesce(F.col(c), nothing).alias("vals")) for o, c in many.items()]
    return (df.select(F.inline(F.array(*entries))).select("option", F.explode("vals").alias("value"))
            .where(F.col("value").isNotNull()).groupBy("option", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("option", F.desc("count"), "value"))


def search_accounts(accounts: DataFrame, links: DataFrame, creators: DataFrame, *, text: str = "", platforms=(), categories=(),
                    cities=(), min_er: float = 0.0, flag: str | None = None, tiers=(), entity: str | None = None,
                    multi: bool = False) -> DataFrame:
    """Account search rolled up to creators."""
    conditions = []
    if text:
        t = text.lower().lstrip("@")
        conditions.append(F.lower("name_clean").contains(t) | F.coalesce(F.col("handle").contains(t), F.lit(False))
                          | F.lower("display_name_raw").contains(t))
    if platforms:
        conditions.append(F.col("platform").isin(list(platforms)))
    if categories:
        conditions.append(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    if cities:
        conditions.append(F.col("city").isin(list(cities)))
    if min_er > 0:
        conditions.append(F.coalesce("er_pct", F.lit(-1.0)) >= min_er)
    if flag:
        conditions.append(F.array_contains("flags", flag))
    joined = accounts.join(links, "account_id")
    hits = joined.where(_all(conditions)).select("creator_id").distinct()
    facts = joined.join(hits, "creator_id", "left_semi").groupBy("creator_id").agg(
        F.max("followers").alias("largest"), F.max("er_pct").alias("best_er"), F.max("stats_as_of").alias("updated"),
        F.max_by("stats_source", F.struct("stats_as_of", "account_id")).alias("source"))
    view = creators.join(facts, "creator_id").withColumn("tier", values.long_size_tier(F.col("largest")))
    if tiers:
        view = view.where(F.col("tier").isin(list(tiers)))
    if entity:
        view = view.where(F.col("entity_type") == entity)
    if multi:
        view = view.where(F.col("n_accounts") > 1)
    return view.orderBy(F.desc("total_followers"), "creator_id")
