"""Which accounts belong to the same creator: blocking, pair scores, decisions, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names
from rosterlake.functions.similarity import pair_similarity
from rosterlake.functions.steps import once
from rosterlake.operators.latest import latest_per_key
from rosterlake.operators.merge import distinct_items
from rosterlake.operators.pairing import REVIEW_SCORE, candidate_pairs
from rosterlake.operators.scale import hot_first_join, sparse_join, spread_evenly
from rosterlake.session import cut_lineage

# Fixed values of the matching rules.
SAME_PLATFORM_NAME = 92
SAFE_KINDS = ("ig_threads_same_handle", "cross_platform_exact_handle_and_name")
FACTS = ("account_id", "platform", "handle", "handle_core", "name_key", "name_words", "categories", "city", "age")


def with_name_words(accounts: DataFrame) -> DataFrame:
    """Add the sorted words of the transliterated name, once per account rather than once per pair."""
    reading = F.trim(F.regexp_replace("_reading", r"\s+", " "))
    return accounts.withColumn("_reading", names.transliterate(F.coalesce("name_clean", F.lit("")))).withColumn(
        "name_words", F.array_join(F.array_sort(F.split(reading, " ")), " ")).drop("_reading")


def _reach(a: str, b: str) -> Column:
    """Highest similarity two texts of these lengths could have; two empty names are equal."""
    n, m = F.length(f"{a}_a"), F.length(f"{b}_b")
    return F.coalesce(F.try_divide(200.0 * F.least(n, m), n + m), F.lit(100.0 if a == b == "name_words" else 0.0))


def _edited(a: str, b: str) -> Column:
    """Highest similarity two texts could have that are this many edits apart: leaving out and putting in is no fewer."""
    x, y = F.col(f"{a}_a"), F.col(f"{b}_b")
    return F.coalesce(100.0 - F.try_divide(100.0 * F.levenshtein(x, y), F.length(x) + F.length(y)), F.lit(100.0 if a == b == "name_words" else 0.0))


def _evidence() -> dict[str, Column]:
    """What two accounts show besides the likeness of their texts, from the facts of both sides."""
    c = F.col
    known_city = F.nullif(c("city_a"), F.lit("")).isNotNull() & F.nullif(c("city_b"), F.lit("")).isNotNull()
    ages_differ = F.coalesce((c("age_a") > 0) & (c("age_b") > 0) & (F.abs(c("age_a") - c("age_b")) > 4), F.lit(False))
    cities_differ = known_city & (c("city_a") != c("city_b"))
    both_lists = (F.size("categories_a") > 0) & (F.size("categories_b") > 0)
    overlap = F.size(F.array_intersect("categories_a", "categories_b"))
    exact = F.coalesce((F.length("handle_core_a") >= 4) & (c("handle_core_a") == c("handle_core_b")), F.lit(False))
    same_platform = c("platform_a") == c("platform_b")
    mirrored = exact & c("platform_a").isin("instagram", "threads") & c("platform_b").isin(
        "instagram", "threads") & ~same_platform & (c("handle_a") == c("handle_b"))
    return {"same_platform": same_platform, "exact": exact, "mirrored": F.coalesce(mirrored, F.lit(False)),
            "same_city": known_city & (c("city_a") == c("city_b")), "cities_differ": cities_differ, "ages_differ": ages_differ,
            "contrary": cities_differ.cast("int") + ages_differ.cast("int"),
            "overlap": F.when(both_lists, F.try_divide(overlap, F.size(F.array_union("categories_a", "categories_b")))).otherwise(0.0)}


def _tops(reach) -> tuple[Column, Column]:
    """Highest similarity of the names and, by handles, of the accounts, if ``reach`` bounds that of two texts."""
    return (F.greatest(reach("name_words", "name_words"), reach("name_key", "name_key")),
            F.greatest(reach("handle_core", "handle_core"), reach("name_key", "handle_core"), reach("handle_core", "name_key")) / 100)


def _possible(e: dict[str, Column], tops: tuple[Column, Column]) -> Column:
    """False for pairs that no rule can accept if ``tops`` bound the similarities of their texts."""
    name_top, handle_top = tops
    twins = (e["contrary"] == 0) & (F.least(F.length("name_key_a"), F.length("name_key_b")) >= 6) & (name_top >= SAME_PLATFORM_NAME - 1e-9)
    penalty = 0.2 * e["contrary"]
    best = F.greatest(0.5 * handle_top + 0.35 * name_top / 100 + 0.15 * e["overlap"] - penalty, F.when(e["exact"], 0.9 - penalty).otherwise(0.0))
    across = (best >= REVIEW_SCORE - 1e-9) & (e["exact"] | (handle_top >= 0.7 - 1e-9) | ((name_top >= 95 - 1e-9) & e["same_city"]))
    return F.coalesce(e["mirrored"] | F.when(e["same_platform"], twins).otherwise((e["contrary"] < 2) & across), F.lit(False))


def hopeful_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that may be accepted by bounds from lengths and then from edit distances, with their evidence."""
    facts = once(pairs, **_evidence())
    known = {n: F.col(n) for n in _evidence()}
    near = once(facts.where(_possible(known, _tops(_reach))), **dict(zip(("_name_top", "_handle_top"), _tops(_edited))))
    return near.where(_possible(known, (F.col("_name_top"), F.col("_handle_top")))).drop("_name_top", "_handle_top")


def with_similarities(pairs: DataFrame) -> DataFrame:
    """Pairs that may be accepted, with their evidence and the similarities of handles, names and names with handles.

    Bounds remove hopeless pairs before the Arrow similarity function sees them.
    """
    return hopeful_pairs(pairs).withColumn("sim", pair_similarity("handle_core_a", "handle_core_b", "name_key_a", "name_key_b",
                                                     "name_words_a", "name_words_b")).select("*", "sim.*").drop("sim")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Score, kind and reasons of account pairs; pairs not worth a review are left out."""
    c = F.col
    penalty = 0.2 * c("contrary")
    sim = with_similarities(pairs).withColumn("shared", F.array_sort(F.array_intersect("categories_a", "categories_b")))
    hand = F.greatest("handle_sim", "cross_sim") / 100
    raw = 0.5 * hand + 0.35 * c("name_sim") / 100 + 0.15 * c("overlap") - penalty
    sim = sim.withColumn("raw", F.when(c("exact"), F.greatest(raw, 0.9 - penalty)).otherwise(raw))
    kept_twin = c("same_platform") & (c("name_sim") >= SAME_PLATFORM_NAME)
    kept_across = ~c("same_platform") & (c("raw") >= REVIEW_SCORE) & (
        c("exact") | (hand >= 0.7) | ((c("name_sim") >= 95) & c("same_city")))
    sim = sim.where(c("mirrored") | kept_twin | kept_across)

    def whole(x):
        return F.bround(x, 0).cast("int").cast("string")

    differ = F.array_join(F.array_compact(F.array(
        F.when(c("cities_differ"), F.concat(F.lit("different cities ("), "city_a", F.lit(" vs "), "city_b", F.lit(")"))),
        F.when(c("ages_differ"), F.concat(F.lit("ages differ ("), c("age_a").cast("string"), F.lit(" vs "),
                                          c("age_b").cast("string"), F.lit(")"))))), " and ")
    across_reasons = F.array_compact(F.array(
        F.when(c("exact"), F.concat(F.lit("identical handle core '"), "handle_core_a", F.lit("'"))),
        F.when(c("same_city"), F.concat(F.lit("same city ("), "city_a", F.lit(")"))),
        F.when(c("contrary") > 0, F.concat(F.lit("but "), differ)).when(
            c("handle_sim") >= 80, F.concat(F.lit("handles "), whole(c("handle_sim")), F.lit("% similar"))),
        F.when((c("cross_sim") >= 85) & ~c("exact"),
               F.concat(F.lit("name matches the other account's handle ("), whole(c("cross_sim")), F.lit("%)"))),
        F.when(c("name_sim") >= 80, F.concat(F.lit("names "), whole(c("name_sim")), F.lit("% similar"))),
        F.when(F.size("shared") > 0, F.concat(F.lit("shared categories: "), F.array_join("shared", ", ")))))
    twin_reason = F.array(F.concat(
        F.lit("same platform, names "), whole(c("name_sim")),
        F.lit("% similar - two accounts of one creator, a fan page, or a brand network?")))
    mirror_reason = F.array(F.lit("identical handle on Instagram and Threads (Threads uses the Instagram username)"))
    kind = (F.when(c("mirrored"), "ig_threads_same_handle").when(c("same_platform"), "same_platform_similar")
            .when(c("exact") & (c("name_sim") >= 90) & (c("contrary") == 0), "cross_platform_exact_handle_and_name")
            .when(c("exact"), "cross_platform_exact_handle").otherwise("cross_platform_fuzzy"))
    score = (F.when(c("mirrored"), 1.0).when(c("same_platform"), c("name_sim") / 100 * 0.9)
             .otherwise(_rounded(c("raw"))))
    return sim.select(
        F.concat_ws("|", "account_id_a", "account_id_b").alias("pair_id"), c("account_id_a").alias("account_a"),
        c("account_id_b").alias("account_b"), kind.alias("kind"), score.alias("score"),
        F.when(c("mirrored"), mirror_reason).when(c("same_platform"), twin_reason).otherwise(across_reasons).alias("reasons"))


def _rounded(x: Column) -> Column:
    """Three decimals of a positive number by its exact binary value, halves to even: 0.7875, a little less than that, gives 0.787."""
    head = x.cast("float").cast("double")  # the rest has so few digits that both products are exact
    k = F.floor(x * 1000)
    beyond = (head * 1000 - (k + 0.5)) + (x - head) * 1000
    return (k + F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), 1).otherwise(0)) / 1000


def similar_pairs(accounts: DataFrame) -> DataFrame:
    """Candidate pairs of one account table with their facts, one row each."""
    facts = cut_lineage(with_name_words(spread_evenly(accounts)).select(*FACTS))  # names are read once
    return candidate_pairs(facts, "account_id", [f for f in FACTS if f != "account_id"])


def find_candidates(accounts: DataFrame) -> DataFrame:
    """Scored pairs of one account table: all that share a block of any size and that the rules accept."""
    return score_pairs(similar_pairs(accounts))


def apply_decisions(scored: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates with status.

    ``log`` is the append-only record of human decisions (pair_id, status, decided_by, decided_at, seq, and the scored
    columns as of then); the latest per pair counts and ``pending`` undoes. A decided pair keeps its status when the
    rules no longer propose it, with the score it had.
    """
    latest = latest_per_key(log, ["pair_id"], ["decided_at", "seq"]).where(F.col("status") != "pending")
    old = latest.select("pair_id", *[F.col(c).alias(f"_old_{c}") for c in (
        "account_a", "account_b", "kind", "score", "reasons", "status", "decided_by", "decided_at")])
    safe = F.col("kind").isin(*SAFE_KINDS)
    kept = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in ("account_a", "account_b", "kind", "score", "reasons")]
    return scored.join(old, "pair_id", "full_outer").select(
        "pair_id", *kept, F.coalesce("_old_status", F.when(safe, "auto_linked").otherwise("pending")).alias("status"),
        F.coalesce("_old_decided_by", F.when(safe, "rule")).alias("decided_by"),
        F.col("_old_decided_at").alias("decided_at"))


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count(F.lit(1)).alias("pairs"))


def resolve_keys(rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Swap provisional video-channel keys for resolved channel ids (C1); ``renamed_from`` keeps the old id."""
    key = F.col("platform_key")
    lookup = F.when((F.col("platform") == "youtube") & F.col("channel_id").isNull(),
                    F.when(key.startswith("@"), F.concat(F.lit("handle:"), F.substr(key, F.lit(2))))
                    .when(key.startswith("user:"), F.concat(F.lit("username:"), F.substr(key, F.lit(6)))))
    found = resolutions.where(F.col("status") == "resolved").select(
        F.col("input_key").alias("_lookup"), F.col("channel_id").alias("_resolved"))
    joined = sparse_join(rows.withColumn("_lookup", lookup), found, "_lookup", "row_id")
    hit = F.col("_resolved").isNotNull()
    settled = F.concat(F.filter("flags", lambda f: ~f.endswith("needs_resolution")), F.array(F.lit("yt_resolved_via_api")))
    swaps = {"channel_id": F.coalesce("_resolved", "channel_id"), "platform_key": F.coalesce("_resolved", "platform_key"),
             "account_id": F.when(hit, F.concat(F.lit("youtube:"), "_resolved")).otherwise(F.col("account_id")),
             "flags": F.when(hit, settled).otherwise(F.col("flags"))}
    return joined.select(*[swaps[c].alias(c) if c in swaps else F.col(c) for c in rows.columns],
                         F.when(hit, F.col("account_id")).alias("renamed_from"))


def carry_decisions(log: DataFrame, renames: DataFrame) -> DataFrame:
    """Rewrite decided pairs after accounts were renamed (C2). ``renames``: old_id, new_id.

    Where a rewritten pair meets one that already had that name, the latter is kept.
    """
    one = renames.groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    a = one.select(F.col("old_id").alias("account_a"), F.col("new_id").alias("_to_a"))
    b = one.select(F.col("old_id").alias("account_b"), F.col("new_id").alias("_to_b"))
    x, y = F.coalesce("_to_a", "account_a"), F.coalesce("_to_b", "account_b")
    moved = (log.join(a, "account_a", "left").join(b, "account_b", "left")
             .withColumn("_moved", (F.col("_to_a").isNotNull() | F.col("_to_b").isNotNull()).cast("int"))
             .withColumn("_x", F.least(x, y)).withColumn("_y", F.greatest(x, y))
             .withColumn("pair_id", F.concat_ws("|", "_x", "_y"))
             .withColumn("account_a", F.col("_x")).withColumn("account_b", F.col("_y")))
    settled = moved.groupBy("pair_id").agg(F.min("_moved").alias("_first"))
    return moved.join(settled, "pair_id").where(F.col("_moved") == F.col("_first")).select(*log.columns)


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(account_id, group_id)`` where the group id is the least account id that is linked to it.

    ``nodes``: account_id; ``edges``: account_a, account_b. Large-star / small-star contraction: each round hooks
    neighbours to the least one around them, so the number of rounds grows with the logarithm of a group's diameter.
    A round is partial aggregates and joins on a node that keep the busiest nodes out of the shuffle, and ends in a
    checkpoint in the shared folder.
    """
    known = nodes.select("account_id")
    valid = (edges.join(known.withColumnRenamed("account_id", "account_a"), "account_a", "left_semi")
             .join(known.withColumnRenamed("account_id", "account_b"), "account_b", "left_semi"))
    links = cut_lineage(valid.select(F.greatest("account_a", "account_b").alias("u"), F.least("account_a", "account_b").alias("v"))
                        .where("u <> v").distinct())
    mark = _fingerprint(links)
    settled = False
    while not settled:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = (hot_first_join(both.where("v > u"), least, ["u"], "degree", "v", ["m"])
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = (hot_first_join(large, low, ["u"], "degree", "v", ["m"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = cut_lineage(small)
        before, mark = mark, _fingerprint(links)
        settled = mark == before
    return known.join(links.select(F.col("u").alias("account_id"), F.col("v").alias("_m")), "account_id", "left").select(
        "account_id", F.coalesce("_m", "account_id").alias("group_id"))


def _fingerprint(links: DataFrame) -> tuple:
    """Size and order-free hash of an edge set; one row reaches the driver."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def creator_id(group_id: Column) -> Column:
    """Stable id of a group."""
    return F.concat(F.lit("cr_"), F.substring(F.sha1(group_id), 1, 10))


def build_creators(accounts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(creators, creator_accounts)`` from the linked pairs."""
    linked = candidates.where(F.col("status").isin("auto_linked", "linked")).select("account_a", "account_b")
    links = connected_groups(accounts, linked).select(creator_id(F.col("group_id")).alias("creator_id"), "account_id")
    return roll_up_creators(accounts.join(links, "account_id")), links


def roll_up_creators(members: DataFrame) -> DataFrame:
    """One row per creator from its accounts: biggest account first, then account id."""
    order = F.struct((-F.coalesce("followers", F.lit(0))).alias("size"), F.col("account_id").alias("id"))
    readable = (F.col("name_clean") != "") & ~F.col("name_clean").rlike(r"[^\x00-\x7F]") & ~F.array_contains(
        "flags", "name_from_handle")
    members = members.withColumn("_order", order)
    facts = members.groupBy("creator_id").agg(
        F.coalesce(F.min_by("name_clean", F.when(readable, F.col("_order"))), F.min_by("name_clean", "_order")).alias("display_name"),
        F.when(F.bool_or(F.col("entity_type") == "brand_media"), "brand_media").otherwise("person").alias("entity_type"),
        F.min_by("account_id", "_order").alias("primary_account_id"),
        F.array_sort(F.collect_set("platform")).alias("platforms"), F.count(F.lit(1)).alias("n_accounts"),
        F.sum(F.coalesce("followers", F.lit(0))).alias("total_followers"))
    return facts.join(distinct_items(members, "creator_id", ["categories"], F.col("_order")), "creator_id", "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>")))


def creator_counts(creators: DataFrame) -> DataFrame:
    return creators.agg(F.count(F.lit(1)).alias("creators"), F.count_if(F.col("n_accounts") > 1).alias("multi_platform_creators"))


def review_queue(candidates: DataFrame, accounts: DataFrame, status: str | None = None) -> DataFrame:
    """Pairs next to both accounts, best score first."""
    shown = ("platform", "name_clean", "display_name_raw", "handle", "profile_url", "followers", "er_pct", "entity_type")
    def side(s):
        return accounts.select(F.col("account_id").alias(f"account_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in shown])
    pairs = candidates if status is None else candidates.where(F.col("status") == status)
    return pairs.join(side("a"), "account_a").join(side("b"), "account_b").orderBy(F.desc("score"), "pair_id")


def pair_history(candidates: DataFrame, links: DataFrame, creator: str) -> DataFrame:
    """Pairs with either side among one creator's accounts (C14)."""
    mine = links.where(F.col("creator_id") == creator).select("account_id")
    either = candidates.withColumn("account_id", F.explode(F.array("account_a", "account_b")))
    touched = either.join(mine, "account_id", "left_semi").select("pair_id").distinct()
    return candidates.join(touched, "pair_id", "left_semi")
