"""Smart segments: k-means over size, engagement, price and value, named from the centroids."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.explore import top_values
from rosterlake.operators.scale import exact_medians
from rosterlake.session import cut_lineage
from rosterlake.vocab import words

FEATURES = ("log_followers", "log_er_vs_tier", "log_rate", "log_cpv", "age")
FALLBACK = ("Solid all-rounders", "Around the middle on size, engagement and price.")
WARNING = " Some show suspicious spikes - check the ⚠ flag before booking."
LEAST_ROWS = 12


def raw_features(profile: DataFrame) -> DataFrame:
    """Log-scaled features, gaps filled with the exact median, then zero (G1)."""
    def floored(c, low):
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c).cast("double"), F.lit(low)))
    feats = profile.where(F.col("followers").isNotNull()).select(
        "creator_id", F.log10(floored("followers", 100.0)).alias("log_followers"),
        F.log2(floored("er_vs_tier", 0.05)).alias("log_er_vs_tier"), F.log10(floored("rate_reel", 100.0)).alias("log_rate"),
        F.log10(floored("cpv", 0.01)).alias("log_cpv"), F.col("age").cast("double").alias("age"))
    mid = exact_medians(feats, [], FEATURES).first()  # one row of five numbers
    fill = {f: (mid[f] if mid is not None and mid[f] is not None else 0.0) for f in FEATURES}
    return feats.select("creator_id", *[F.coalesce(F.col(f), F.lit(fill[f])).alias(f) for f in FEATURES])


def standardise(feats: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation; a constant feature keeps a divisor of one."""
    facts = [F.avg(f).alias(f"mean_{f}") for f in FEATURES] + [F.stddev_pop(f).alias(f"dev_{f}") for f in FEATURES]
    seen = feats.agg(*facts).first()  # one row of ten numbers
    return feats.withColumns({f: (F.col(f) - F.lit(seen[f"mean_{f}"])) / F.lit(seen[f"dev_{f}"] or 1.0) for f in FEATURES})


def name_centroids(centroids: dict[int, list[float]]) -> dict[int, tuple[str, str]]:
    """Names for at most a handful of centroids: the most distinctive one picks first."""
    named, used = {}, set()
    for cluster in sorted(centroids, key=lambda c: (-max(map(abs, centroids[c])), c)):
        by_strength = sorted(zip(FEATURES, centroids[cluster]), key=lambda fv: -abs(fv[1]))
        traits = (words.SEGMENT_TRAITS[f, 1 if v > 0 else -1] for f, v in by_strength)
        named[cluster] = next((t for t in traits if t[0] not in used), FALLBACK)
        used.add(named[cluster][0])
    return named


def segment(profile: DataFrame, k: int | None = None, seed: int = 7, restarts: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(profile + segment, cards)``; fewer than twelve usable creators give no segments."""
    points = cut_lineage(standardise(raw_features(profile)).withColumn("features", array_to_vector(F.array(*FEATURES))))
    usable = points.count()
    if usable < LEAST_ROWS:
        empty = profile.withColumn("segment", F.lit(None).cast("string"))
        return empty, segment_cards(empty)
    k = k or max(3, min(6, usable // 60))
    best = min((KMeans(k=k, seed=seed + i, maxIter=50).fit(points) for i in range(restarts)),
               key=lambda model: model.summary.trainingCost)
    labelled = best.transform(points).select("creator_id", F.col("prediction").alias("cluster"))
    names = name_centroids({i: [float(x) for x in c] for i, c in enumerate(best.clusterCenters())})
    title = F.create_map(*[x for c, (name, _) in names.items() for x in (F.lit(c), F.lit(name))])
    # clusters that fall back to one shared name stay apart by their number
    with_segment = profile.join(labelled, "creator_id", "left").withColumn("segment", F.try_element_at(title, F.col("cluster")))
    return with_segment, segment_cards(with_segment)


def segment_cards(df: DataFrame) -> DataFrame:
    """One card per segment, biggest first."""
    key = [c for c in ("cluster", "segment") if c in df.columns]
    members = df.where(F.col("segment").isNotNull()).withColumn("_id", F.concat_ws("|", *key))
    medians = exact_medians(members, ["_id"], ["followers", "er", "rate_reel", "cpv", "age"]).select(
        "_id", F.bround("followers", 0).cast("bigint").alias("median_followers"), F.bround("er", 2).alias("median_er"),
        F.bround("rate_reel", 0).cast("bigint").alias("median_rate"), F.bround("cpv", 2).alias("median_cpv"),
        F.bround("age", 0).cast("bigint").alias("median_age"))
    text = F.create_map(*[x for name, line in (*words.SEGMENT_TRAITS.values(), FALLBACK) for x in (F.lit(name), F.lit(line))])
    cards = members.groupBy("_id").agg(F.first("segment").alias("name"), F.count(F.lit(1)).alias("count"),
                                       F.avg(F.col("suspicious_er").cast("int")).alias("_spikes"))
    warn = (F.col("name") == "Engagement stars") & (F.col("_spikes") > 0.3)
    cards = cards.withColumn("description", F.concat(F.try_element_at(text, F.col("name")),
                                                     F.when(warn, WARNING).otherwise("")))
    return (cards.join(medians, "_id").join(top_values(members, "_id", F.col("niche"), 3, "top_niches"), "_id", "left")
            .join(top_values(members, "_id", F.col("city"), 3, "top_cities"), "_id", "left")
            .drop("_id", "_spikes").orderBy(F.desc("count"), "name"))
