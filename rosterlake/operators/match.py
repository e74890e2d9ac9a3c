"""Campaign matching: briefs scored against every creator, explained, and filled under a budget."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import values
from rosterlake.operators.scale import percent_ranks, top_per_group
from rosterlake.session import cut_lineage
from rosterlake.vocab import words
from rosterlake.vocab.topics import RELATED

AGES = [b[0] for b in words.AGE_BANDS]
CHUNK = 900
SUSPICION = 6
COMPONENTS = ("relevance", "location", "audience", "language", "performance", "value")


@dataclass(frozen=True)
class Brief:
    """One request: whom a campaign looks for, for what, and with how much money."""

    brief_id: str
    niches: Sequence[str] = ()
    keywords: str = ""
    cities: Sequence[str] = ()
    regions: Sequence[str] = ()
    age_bands: Sequence[str] = ()
    languages: Sequence[str] = ()
    platforms: Sequence[str] = ()
    exclude_brands: str = ""
    deliverable: str = "reel"
    objective: str = "awareness"
    gender: str = "any"
    min_er: float = 0.0
    max_rate: float | None = None
    budget: float = 0.0
    count: int = 10
    exclude_brand_media: bool = True

    @property
    def words(self) -> list[str]:
        return [k.strip().lower() for k in re.split("[,;]", self.keywords) if k.strip()]

    @property
    def competitors(self) -> list[str]:
        return [k.strip().lower() for k in re.split("[,;]", self.exclude_brands) if k.strip()]

    @property
    def related(self) -> list[str]:
        return sorted({r for n in self.niches for r in RELATED.get(n, [])} - set(self.niches))

    @property
    def city_cap(self) -> int:
        return self.count if len(set(self.cities)) == 1 else max(2, -(-self.count * 2 // 5))


def _texts(items) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def _overlap(column: str, items) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), _texts(items)), F.lit(False)) if items else F.lit(False)


def _rank_names(deliverable: str) -> tuple[str, str]:
    return f"_rank_views_{deliverable}", f"_rank_cpv_{deliverable}"


def _est_views(deliverable: str) -> Column:
    return F.col("avg_views") * words.DELIVERABLES[deliverable][2]


def _cost_per_view(deliverable: str) -> Column:
    return F.try_divide(F.col(words.DELIVERABLES[deliverable][0]).cast("double"), _est_views(deliverable))


def with_ranks(profile: DataFrame, deliverables: Sequence[str]) -> DataFrame:
    """Percent ranks of views and cost per view over all rows, once per deliverable, whatever the briefs."""
    specs = {}
    for d in sorted(set(deliverables)):
        views, cpv = _rank_names(d)
        clipped = F.when(_est_views(d).isNotNull(), F.greatest(_est_views(d), F.lit(1.0)))
        specs[views], specs[cpv] = (clipped, True), (_cost_per_view(d), False)
    return percent_ranks(profile, "creator_id", specs)


def exclusion(b: Brief) -> Column:
    """Why a creator cannot be on the brief; the last rule that applies is the one reported (H1, H2)."""
    rate = F.col(words.DELIVERABLES[b.deliverable][0])
    rival = F.try_element_at(F.filter("brands", lambda x: F.exists(
        _texts(b.competitors), lambda k: F.contains(F.lower(x), k))), F.lit(1)) if b.competitors else None
    rules: list[Column] = []
    if b.max_rate:
        rules.append(F.when(rate > b.max_rate, F.concat(F.lit("rate above "), values.inr(F.lit(float(b.max_rate))), F.lit(" cap"))))
    if b.exclude_brand_media:
        rules.append(F.when(F.col("entity_type") == "brand_media", "brand / media account, not a creator"))
    if rival is not None:
        rules.append(F.when(rival.isNotNull(), F.concat(F.lit("worked with competitor "), rival)))
    if b.min_er:
        rules.append(F.when(F.coalesce("er", F.lit(0.0)) < b.min_er, f"ER below {float(b.min_er)}%"))
    if b.gender and b.gender != "any":
        rules.append(F.when(F.col("gender") != b.gender, f"gender preference ({b.gender})"))
    if b.deliverable == "video":
        rules.append(F.when(~F.array_contains("platforms", "youtube"), "no YouTube channel"))
    if b.platforms:
        rules.append(F.when(~_overlap("platforms", b.platforms), "platform not in brief"))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def keyword_hits(b: Brief) -> Column:
    """Keywords found whole, or by any of their words longer than three letters, in tags and categories (H3)."""
    if not b.words:
        return F.array().cast("array<string>")
    hay = F.lower(F.concat_ws(" ", F.array_join("tags", " "), F.array_join("categories", " ")))
    found = []
    for k in b.words:
        test = hay.contains(k)
        for w in (w for w in k.split() if len(w) > 3):
            test = test | hay.contains(w)
        found.append(F.when(test, k))
    return F.array_compact(F.array(*found))


def _components(b: Brief, regions: Column) -> dict[str, Column]:
    niche = (F.when(F.col("niche").isin(list(b.niches)), 1.0).when(_overlap("categories", b.niches), 0.85)
             .when(_overlap("categories", b.related), 0.45).otherwise(0.0)) if b.niches else F.lit(0.7)
    if b.cities or b.regions:
        place = (F.when(F.col("city").isin(list(b.cities)), 1.0).when(F.array_contains(regions, F.col("region")), 0.6)
                 .when(F.col("city").isNull(), 0.3).otherwise(0.05))
    else:
        place = F.lit(1.0)
    near = [AGES[j] for a in b.age_bands for j in (AGES.index(a) - 1, AGES.index(a) + 1) if 0 <= j < len(AGES)]
    audience = (F.when(F.col("age_band").isNull(), 0.4).when(F.col("age_band").isin(list(b.age_bands)), 1.0)
                .when(F.col("age_band").isin(near), 0.5).otherwise(0.1)) if b.age_bands else F.lit(1.0)
    language = (F.when(_overlap("languages", b.languages), 1.0).when(F.size("languages") == 0, 0.4).otherwise(0.1)
                if b.languages else F.lit(1.0))
    views, cpv = _rank_names(b.deliverable)
    engagement = F.coalesce(F.least(F.col("er_vs_tier"), F.lit(2.5)), F.lit(0.8)) / 2.5
    by_er, by_views = (0.35, 0.65) if b.objective == "awareness" else (0.7, 0.3)
    rate = F.col(words.DELIVERABLES[b.deliverable][0])
    return {"relevance": F.least(F.lit(1.0), niche + 0.15 * F.size(keyword_hits(b))), "location": place,
            "audience": audience, "language": language, "performance": by_er * engagement + by_views * F.col(views),
            "value": F.when(rate.isNotNull(), F.col(cpv)).otherwise(0.2)}


def reasons(b: Brief) -> Column:
    """The fit in plain words."""
    c = F.col
    label = words.DELIVERABLES[b.deliverable][1]
    first_tags = F.array_join(F.slice("tags", 1, 2), ", ")
    on_niche = (c("niche").isin(list(b.niches)) | _overlap("categories", b.niches)) if b.niches else F.lit(False)
    adjacent = F.array_join(F.array_sort(F.array_intersect("categories", _texts(b.related))), ", ")
    hits = keyword_hits(b)
    city = F.nullif(c("city"), F.lit(""))
    suffix = F.lit("")
    if b.cities or b.regions:
        suffix = F.when(c("city").isin(list(b.cities)), " — target city").otherwise(
            F.coalesce(F.concat(F.lit(" ("), "region", F.lit(")")), F.lit("")))
    er = F.concat(F.lit("ER "), F.format_string("%.1f", c("er")), F.lit("%"))
    strong = F.concat(er, F.lit(" — "), F.format_string("%.1f", c("er_vs_tier")), F.lit("× typical for "),
                      F.lower(F.coalesce("size_tier", F.lit(""))), F.lit(" creators"))
    price = F.concat(values.inr(c("cost")), F.lit(f" per {label}"), F.coalesce(
        F.concat(F.lit(" · ₹"), F.format_string("%.2f", c("cpv_deliverable")), F.lit("/view")), F.lit("")))
    spoken = F.array_join(F.array_sort(F.array_intersect("languages", _texts(b.languages))), ", ")
    return F.array_compact(F.array(
        F.when(on_niche, F.concat(c("niche"), F.lit(" creator"), F.when(first_tags != "", F.concat(
            F.lit(" ("), first_tags, F.lit(")"))).otherwise(""))).when(adjacent != "", F.concat(F.lit("Adjacent niche: "), adjacent)),
        F.when(F.size(hits) > 0, F.concat(F.lit("Matches: "), F.array_join(hits, ", "))),
        F.when(city.isNotNull(), F.concat(F.lit("Based in "), city, suffix)),
        F.when(c("er_vs_tier") >= 1.3, strong).otherwise(er),
        F.when(c("cost").isNotNull(), price).otherwise(F.lit(f"No {label} rate on file — ask for a quote")),
        F.when(spoken != "", F.concat(F.lit("Speaks "), spoken)),
        F.when(c("age_band").isin(list(b.age_bands)), F.concat(F.lit("Age "), c("age").cast("int").cast("string"),
               F.lit(" — in your "), "age_band", F.lit(" target"))) if b.age_bands else F.lit(None).cast("string"),
        F.when(c("suspicious_er"), "⚠ Engagement spike — verify before booking")))


def score(profile: DataFrame, briefs: Sequence[Brief]) -> DataFrame:
    """Every creator under every brief: exclusion, components, fit, cost, estimated views and reasons.

    Briefs are request bodies, so they enter as constants: each becomes one projection over the ranked profile, which is
    written once for all of them, and conditions a brief does not use fold away.
    """
    ranked = with_ranks(profile, [b.deliverable for b in briefs])
    if len(briefs) > 1:
        ranked = cut_lineage(ranked)
    return _union([_score_one(ranked, profile, b) for b in briefs])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _score_one(ranked: DataFrame, profile: DataFrame, b: Brief) -> DataFrame:
    regions = _texts(sorted(b.regions))
    if b.cities:
        reached = profile.where(F.col("city").isin(list(b.cities)) & F.col("region").isNotNull()).agg(
            F.collect_set("region")).scalar()
        regions = F.array_union(regions, reached)
    weights = words.OBJECTIVE_WEIGHTS.get(b.objective, words.OBJECTIVE_WEIGHTS["awareness"])
    named = {f"s_{k}": v for k, v in _components(b, regions).items()}
    step = ranked.withColumns({
        "brief_id": F.lit(b.brief_id), "excluded": exclusion(b),
        "cost": F.col(words.DELIVERABLES[b.deliverable][0]).cast("double"), "est_views": _est_views(b.deliverable),
        "cpv_deliverable": _cost_per_view(b.deliverable), **named})
    total = F.lit(0.0)
    for k in COMPONENTS:
        total = total + F.col(f"s_{k}") * weights[k]
    fit = total * 100 - F.when(F.col("suspicious_er"), float(SUSPICION)).otherwise(0.0)
    step = step.withColumn("fit", F.bround(F.greatest(F.least(fit, F.lit(100.0)), F.lit(0.0)), 1))
    return step.withColumn("reasons", reasons(b)).drop(*[c for c in step.columns if c.startswith("_rank_")])


# ---------------------------------------------------------------- budgeted pool

PICK_SCHEMA = "brief_id string, creator_id string, fit double, cost double, city string"
NARROW = ("brief_id", "creator_id", "fit", "cost", "city")


def _pick(frame: pd.DataFrame, budget: float, want: int, cap: int, taken: list[dict]) -> list[dict]:
    """Walk one brief's next candidates in fit order and return the ones that are taken."""
    spent = sum(t["cost"] for t in taken)
    cities = [t["city"] for t in taken if t["city"]]
    out: list[dict] = []
    for row in frame.sort_values(["fit", "creator_id"], ascending=[False, True]).to_dict("records"):
        open_slots = want - len(taken) - len(out)
        if open_slots <= 0:
            break
        left = budget - spent
        if budget and (row["cost"] > left or (open_slots > 1 and row["cost"] > 2.5 * left / open_slots)):
            continue
        if row["city"] and cities.count(row["city"]) >= cap:
            continue
        out.append(row)
        spent += row["cost"]
        cities += [row["city"]] if row["city"] else []
    return out


def _still_open(b: Brief, taken: list[dict]) -> tuple[Column, Column]:
    """``(never again affordable or allowed is ruled out, allowed right now)`` for one brief's next pick."""
    spent = sum(t["cost"] for t in taken)
    left, slots = b.budget - spent, b.count - len(taken)
    full = [c for c in {t["city"] for t in taken if t["city"]} if sum(t["city"] == c for t in taken) >= b.city_cap]
    lasting = F.col("brief_id") == b.brief_id
    if taken:
        last = taken[-1]
        lasting = lasting & ((F.col("fit") < last["fit"]) | ((F.col("fit") == last["fit"]) & (F.col("creator_id") > last["creator_id"])))
    if b.budget:
        lasting = lasting & (F.col("cost") <= left)
    if full:
        lasting = lasting & ~F.coalesce(F.col("city").isin(full), F.lit(False))
    now = lasting
    if b.budget and slots > 1:
        now = now & (F.col("cost") <= 2.5 * left / slots)
    return lasting, now


def choose_pool(scored: DataFrame, briefs: Sequence[Brief]) -> DataFrame:
    """Greedy pick per brief in fit order under budget, share and city limits (H13): ``(brief_id, seq, creator_id)``.

    The walk is sequential, so it is never run over a whole library. A round looks up, with one partial aggregate, the
    next creator each brief could take, and walks the ``CHUNK`` candidates from there; a pick at least is made in every
    round, so a brief ends after at most ``count`` rounds and nearly always after one. Only picks reach the driver.
    """
    spark = scored.sparkSession
    pool = cut_lineage(scored.where(F.col("excluded").isNull() & F.col("cost").isNotNull()).select(*NARROW))
    taken: dict[str, list[dict]] = {b.brief_id: [] for b in briefs}
    live = [b for b in briefs if b.count > 0]
    while live:
        states = {b.brief_id: _still_open(b, taken[b.brief_id]) for b in live}
        key = F.struct((-F.col("fit")).alias("f"), F.col("creator_id").alias("c"))
        nexts = {r["brief_id"]: r["at"] for r in pool.where(_any([now for _, now in states.values()]))
                 .groupBy("brief_id").agg(F.min(key).alias("at")).collect()}
        live = [b for b in live if b.brief_id in nexts]
        if not live:
            break
        reach = _any([states[b.brief_id][0] & (key >= F.struct(F.lit(nexts[b.brief_id]["f"]).alias("f"),
                                                              F.lit(nexts[b.brief_id]["c"]).alias("c"))) for b in live])
        chunk = top_per_group(pool.where(reach), ["brief_id"], [F.desc("fit"), F.col("creator_id")], CHUNK).drop("rank")
        limits = {b.brief_id: (b.budget, b.count, b.city_cap, taken[b.brief_id]) for b in live}

        def walk(frame: pd.DataFrame) -> pd.DataFrame:
            picks = _pick(frame, *limits[frame["brief_id"].iloc[0]])
            return pd.DataFrame(picks, columns=list(NARROW))

        for row in sorted(chunk.groupBy("brief_id").applyInPandas(walk, PICK_SCHEMA).collect(),
                          key=lambda r: (-r["fit"], r["creator_id"])):
            taken[row["brief_id"]].append(row.asDict())
        live = [b for b in live if len(taken[b.brief_id]) < b.count]
    rows = [(b, i + 1, t["creator_id"], t["fit"], t["cost"], t["city"]) for b, ts in taken.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "brief_id string, seq int, creator_id string, fit double, cost double, city string")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def why_not(b: Brief, picks: list) -> Column:
    """Why an eligible creator was passed over, from the picks made before its turn."""
    c = F.col
    reason = F.lit("lower fit than the chosen pool")
    cases = []
    for n in range(len(picks) + 1):
        before = picks[:n]
        if n >= b.count:
            break
        spent = sum(p["cost"] for p in before)
        left, slots = b.budget - spent, b.count - n
        full = [x for x in {p["city"] for p in before if p["city"]} if sum(p["city"] == x for p in before) >= b.city_cap]
        turn = F.lit(True)
        if n:
            turn = (c("fit") < before[-1]["fit"]) | ((c("fit") == before[-1]["fit"]) & (c("creator_id") > before[-1]["creator_id"]))
        if n < len(picks):
            after = picks[n]
            turn = turn & ((c("fit") > after["fit"]) | ((c("fit") == after["fit"]) & (c("creator_id") < after["creator_id"])))
        text = F.lit(None).cast("string")
        if full:
            text = F.when(c("city").isin(full), F.concat(F.lit(f"already {b.city_cap} from "), c("city")))
        if b.budget and slots > 1:
            text = F.when(c("cost") > 2.5 * left / slots, "would crowd out the rest of the pool").otherwise(text)
        if b.budget:
            text = F.when(c("cost") > left, "over remaining budget").otherwise(text)
        cases.append(F.when(turn & c("cost").isNotNull(), text))
    return F.coalesce(*cases, reason) if cases else reason


@dataclass
class Pools:
    """What a matching run returns, one table each."""

    pool: DataFrame
    summary: DataFrame
    excluded: DataFrame
    alternates: DataFrame
    unpriced: DataFrame
    conflicts: DataFrame


def build_pools(scored: DataFrame, briefs: Sequence[Brief]) -> Pools:
    """Pools, their summaries, and what stayed outside."""
    picks = choose_pool(scored, briefs)
    by_brief: dict[str, list] = {b.brief_id: [] for b in briefs}
    for row in picks.orderBy("brief_id", "seq").collect():
        by_brief[row["brief_id"]].append(row)
    # as many rows as the briefs ask for, so this side is always small
    chosen = F.broadcast(picks.select("brief_id", "creator_id", "seq"))
    pool = scored.join(chosen, ["brief_id", "creator_id"])
    eligible = scored.where(F.col("excluded").isNull())
    rest = eligible.join(chosen, ["brief_id", "creator_id"], "left_anti")
    order = [F.desc("fit"), F.col("creator_id")]
    reason = F.lit(None).cast("string")
    for b in briefs:
        reason = F.when(F.col("brief_id") == b.brief_id, why_not(b, by_brief[b.brief_id])).otherwise(reason)
    return Pools(
        pool=pool, summary=pool_summary(scored, pool, briefs), excluded=exclusion_counts(scored),
        alternates=top_per_group(rest.withColumn("why_not", reason), ["brief_id"], order, 12),
        unpriced=top_per_group(eligible.where(F.col("cost").isNull()), ["brief_id"], order, 6),
        conflicts=top_per_group(scored.where(F.col("excluded").startswith("worked with")), ["brief_id"],
                                [F.col("creator_id")], 10))


def exclusion_counts(scored: DataFrame) -> DataFrame:
    """Creators ruled out per reason; competitor names are merged."""
    merged = F.when(F.col("excluded").startswith("worked"), "worked with a competitor").otherwise(F.col("excluded"))
    return scored.where(F.col("excluded").isNotNull()).groupBy("brief_id", merged.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


def pool_summary(scored: DataFrame, pool: DataFrame, briefs: Sequence[Brief]) -> DataFrame:
    """Totals of each brief's pool next to how many were eligible."""
    ok = F.col("excluded").isNull()
    able = scored.groupBy("brief_id").agg(F.count_if(ok).alias("eligible"),
                                          F.count_if(ok & F.col("cost").isNotNull()).alias("priced"))
    facts = pool.groupBy("brief_id").agg(
        F.count(F.lit(1)).alias("creators"), F.sum("cost").alias("spent"), F.sum("est_views").alias("_views"),
        F.bround(F.avg("er"), 2).alias("avg_er"), F.bround(F.avg("fit"), 1).alias("avg_fit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"))
    cities = pool.where(F.col("city").isNotNull()).groupBy("brief_id", "city").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "brief_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("city", "n")))).alias("cities"))
    budget = F.create_map(*[x for b in briefs for x in (F.lit(b.brief_id), F.lit(float(b.budget)))])
    asked = F.element_at(budget, F.col("brief_id"))
    spent = F.coalesce("spent", F.lit(0.0))
    return able.join(facts, "brief_id", "left").join(cities, "brief_id", "left").select(
        "brief_id", F.coalesce("creators", F.lit(0)).alias("creators"), asked.alias("budget"), spent.alias("spent"),
        F.when(asked > 0, asked - spent).alias("remaining"), F.bround("_views", 0).cast("bigint").alias("est_views"),
        F.bround(F.try_divide(spent, F.col("_views")), 2).alias("blended_cpv"), "avg_er", "avg_fit", "cities", "languages",
        "eligible", "priced")


def suggestions(profile: DataFrame, brief: Brief, members: DataFrame, k: int = 16) -> DataFrame:
    """More creators for a running campaign: no budget, a dozen picks, then the alternates."""
    open_brief = replace(brief, budget=0.0, count=12)
    free = profile.join(members.select("creator_id"), "creator_id", "left_anti")
    pools = build_pools(cut_lineage(score(free, [open_brief])), [open_brief])
    first = pools.pool.select("creator_id", "name", "fit", "reasons", F.col("seq").alias("place"))
    second = pools.alternates.select("creator_id", "name", "fit", "reasons", (F.col("rank") + 12).alias("place"))
    return first.unionByName(second).orderBy("place").limit(k)
