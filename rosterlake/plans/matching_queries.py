"""Briefs against the customer profiles."""

from pyspark.sql import functions as F

from rosterlake.operators import match
from rosterlake.operators.match import Brief
from rosterlake.plans.bindings import profiles, shortlist
from rosterlake.plans.catalog import query
from rosterlake.plans.sql import PROFILE, over
from rosterlake.session import cut_lineage
from rosterlake.vocab import words

BRIEFS = [
    Brief("launch", niches=("Food", "Travel"), keywords="red ring, gadget plates", cities=("NATION_1", "NATION_7"), age_bands=("25-34",),
          languages=("English", "Tamil"), budget=200_000.0, count=10, exclude_brands="brand#13", objective="awareness"),
    Brief("story", niches=("Tech",), regions=("ASIA", "EUROPE"), languages=("Hindi",), platforms=("youtube", "tiktok"), deliverable="story",
          objective="engagement", gender="Female", min_er=4.0, budget=60_000.0, count=15, max_rate=12_000.0, exclude_brand_media=False),
    Brief("video", cities=("NATION_3",), age_bands=("18-24", "45+"), deliverable="video", objective="conversions", budget=150_000.0, count=6),
]


def _sql_list(items):
    return "CAST([" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "] AS VARCHAR[])"


def _brief_sql(b: Brief) -> str:
    """One brief scored in SQL."""
    rate, _, share = words.DELIVERABLES[b.deliverable]
    w = words.OBJECTIVE_WEIGHTS[b.objective]
    rules = []
    if b.platforms:
        rules.append(f"CASE WHEN NOT list_has_any(platforms, {_sql_list(b.platforms)}) THEN 'platform not in brief' END")
    if b.deliverable == "video":
        rules.append("CASE WHEN NOT list_contains(platforms, 'youtube') THEN 'no YouTube channel' END")
    if b.gender != "any":
        rules.append(f"CASE WHEN gender <> '{b.gender}' THEN 'gender preference ({b.gender})' END")
    if b.min_er:
        rules.append(f"CASE WHEN coalesce(er, 0) < {b.min_er} THEN 'ER below {float(b.min_er)}%' END")
    if b.competitors:
        rules.append("'worked with competitor ' || list_filter(brands, lambda x: contains(lower(x), '" + b.competitors[0] + "'))[1]")
    if b.exclude_brand_media:
        rules.append("CASE WHEN entity_type = 'brand_media' THEN 'brand / media account, not a creator' END")
    if b.max_rate:
        rules.append(f"CASE WHEN {rate} > {b.max_rate} THEN 'rate above ₹{b.max_rate / 1000:.0f}K cap' END")
    excluded = "coalesce(" + ", ".join(reversed(rules)) + ", NULL)"
    hay = "lower(array_to_string(tags, ' ') || ' ' || array_to_string(categories, ' '))"
    hits = " + ".join("CASE WHEN " + " OR ".join(f"contains({hay}, '{t}')" for t in [k, *[x for x in k.split() if len(x) > 3]]) + " THEN 1 ELSE 0 END" for k in b.words) or "0"
    if b.niches:
        rel = (f"CASE WHEN list_contains({_sql_list(b.niches)}, niche) THEN 1.0 WHEN list_has_any(categories, {_sql_list(b.niches)}) THEN 0.85 "
               f"WHEN list_has_any(categories, {_sql_list(b.related)}) THEN 0.45 ELSE 0.0 END")
    else:
        rel = "0.7"
    loc = "1.0"
    if b.cities or b.regions:
        loc = (f"CASE WHEN list_contains({_sql_list(b.cities)}, city) THEN 1.0 WHEN region IS NOT NULL AND (list_contains({_sql_list(b.regions)}, region) OR "
               f"region IN (SELECT region FROM p WHERE list_contains({_sql_list(b.cities)}, city))) THEN 0.6 WHEN city IS NULL THEN 0.3 ELSE 0.05 END")
    aud = "1.0"
    if b.age_bands:
        near = [match.AGES[j] for a in b.age_bands for j in (match.AGES.index(a) - 1, match.AGES.index(a) + 1) if 0 <= j < 4]
        aud = (f"CASE WHEN age_band IS NULL THEN 0.4 WHEN list_contains({_sql_list(b.age_bands)}, age_band) THEN 1.0 "
               f"WHEN list_contains({_sql_list(near)}, age_band) THEN 0.5 ELSE 0.1 END")
    lang = f"CASE WHEN list_has_any(languages, {_sql_list(b.languages)}) THEN 1.0 WHEN len(languages) = 0 THEN 0.4 ELSE 0.1 END" if b.languages else "1.0"
    by_er, by_views = ("0.35", "0.65") if b.objective == "awareness" else ("0.7", "0.3")
    def num(x):
        return f"CAST({x} AS DOUBLE)"
    total = " + ".join(f"s_{k} * {num(w[k])}" for k in match.COMPONENTS)
    return f"""SELECT '{b.brief_id}' AS brief_id, creator_id, {excluded} AS excluded, cost, est_views, cpv_deliverable, s_relevance, s_location, s_audience, s_language, s_performance, s_value,
    round_even(greatest(least(({total}) * 100 - CASE WHEN suspicious_er THEN 6.0 ELSE 0.0 END, 100.0), 0.0), 1) AS fit, er, city, languages, avg_views FROM (
    SELECT *, CAST(least(1.0, {rel} + 0.15 * ({hits})) AS DOUBLE) AS s_relevance, CAST({loc} AS DOUBLE) AS s_location, CAST({aud} AS DOUBLE) AS s_audience, CAST({lang} AS DOUBLE) AS s_language,
      {num(by_er)} * (coalesce(least(er_vs_tier, CAST(2.5 AS DOUBLE)), CAST(0.8 AS DOUBLE)) / CAST(2.5 AS DOUBLE)) + {num(by_views)} * CASE WHEN est_views IS NULL THEN CAST(0.3 AS DOUBLE) ELSE (vlo + (vsame - 1) / CAST(2 AS DOUBLE)) / vn END AS s_performance,
      CASE WHEN cost IS NULL THEN CAST(0.2 AS DOUBLE) WHEN cpv_deliverable IS NULL THEN CAST(0.3 AS DOUBLE) ELSE (clo + (csame - 1) / CAST(2 AS DOUBLE)) / cn END AS s_value FROM (
      SELECT *, rank() OVER (ORDER BY vclip NULLS LAST) AS vlo, count(*) OVER (PARTITION BY vclip) AS vsame, count(vclip) OVER () AS vn,
        rank() OVER (ORDER BY cpv_deliverable DESC NULLS LAST) AS clo, count(*) OVER (PARTITION BY cpv_deliverable) AS csame, count(cpv_deliverable) OVER () AS cn FROM (
        SELECT *, CAST({rate} AS DOUBLE) AS cost, avg_views * {num(share)} AS est_views, CASE WHEN avg_views * {num(share)} <> 0 THEN CAST({rate} AS DOUBLE) / (avg_views * {num(share)}) END AS cpv_deliverable,
               CASE WHEN avg_views IS NOT NULL THEN greatest(avg_views * {num(share)}, 1) END AS vclip FROM p)))"""


def scored_sql(briefs=BRIEFS) -> str:
    return PROFILE + ",\nscored AS (" + "\nUNION ALL ".join(_brief_sql(b) for b in briefs) + ")"


def _greedy(b: Brief) -> str:
    """The sequential pick of one brief as a recursive walk over its ranked candidates."""
    tight = f"cost > {b.budget} - spent OR (slots > 1 AND cost > 2.5 * ({b.budget} - spent) / slots)" if b.budget else "false"
    full = f"(city IS NOT NULL AND len(list_filter(cities, lambda x: x = city)) >= {b.city_cap})"
    cap, n = b.city_cap, b.brief_id
    return f""",
q_{n} AS (SELECT creator_id, fit, cost, city, row_number() OVER (ORDER BY fit DESC, creator_id) AS rn FROM scored WHERE brief_id = '{n}' AND excluded IS NULL AND cost IS NOT NULL),
w_{n} AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS creator_id, CAST(0 AS DOUBLE) AS spent, CAST({b.count} AS BIGINT) AS slots, CAST([] AS VARCHAR[]) AS cities, false AS taken
  UNION ALL
  SELECT q.rn, q.creator_id, CASE WHEN pick THEN spent + q.cost ELSE spent END, CASE WHEN pick THEN slots - 1 ELSE slots END,
         CASE WHEN pick AND q.city IS NOT NULL THEN list_append(cities, q.city) ELSE cities END, pick
  FROM (SELECT w.*, q.rn AS qrn, NOT ({tight}) AND NOT {full} AS pick FROM w_{n} w JOIN q_{n} q ON q.rn = w.rn + 1 WHERE slots > 0) s JOIN q_{n} q ON q.rn = s.qrn)"""


def pool_sql() -> str:
    chosen = " UNION ALL ".join(f"SELECT '{b.brief_id}' AS brief_id, creator_id, CAST(row_number() OVER (ORDER BY rn) AS INTEGER) AS seq FROM w_{b.brief_id} WHERE taken" for b in BRIEFS)
    return "WITH RECURSIVE " + scored_sql().strip() + "".join(_greedy(b) for b in BRIEFS) + f",\nchosen AS ({chosen})\n"


@query("h1_h2_exclusions", over(scored_sql(), "SELECT brief_id, creator_id, excluded FROM scored"))
def exclusions(spark, folder):
    return match.score(profiles(spark, folder), BRIEFS).select("brief_id", "creator_id", "excluded")


@query("h3_h10_fit_scores", over(scored_sql(), """
  SELECT brief_id, creator_id, cost, est_views, cpv_deliverable, s_relevance, s_location, s_audience, s_language, s_performance, s_value, fit FROM scored"""))
def fit_scores(spark, folder):
    scored = match.score(profiles(spark, folder), BRIEFS)
    return scored.select("brief_id", "creator_id", "cost", "est_views", "cpv_deliverable", *[f"s_{k}" for k in match.COMPONENTS], "fit")


@query("h11_reasons", over(PROFILE, """
  SELECT creator_id, array_to_string(list_filter([
    CASE WHEN list_contains(categories, 'Tech') OR niche = 'Tech' THEN niche || ' creator' || CASE WHEN len(tags) > 0 THEN ' (' || array_to_string(tags[1:2], ', ') || ')' ELSE '' END
         WHEN list_has_any(categories, ['Education','Gaming']) THEN 'Adjacent niche: ' || array_to_string(list_sort(list_intersect(categories, ['Education','Gaming'])), ', ') END,
    CASE WHEN city IS NOT NULL THEN 'Based in ' || city || ' (' || region || ')' END,
    CASE WHEN list_contains(languages, 'Hindi') THEN 'Speaks Hindi' END,
    CASE WHEN suspicious_er THEN '⚠ Engagement spike — verify before booking' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM p"""))
def reasons(spark, folder):
    """Reasons without numbers; the wording of figures differs between engines."""
    scored = match.score(profiles(spark, folder), BRIEFS[1:2])
    text = F.filter("reasons", lambda r: ~r.rlike("^(ER |₹|No story)"))
    return scored.select("creator_id", F.array_join(text, "; ").alias("reasons"))


@query("h11_all_reasons")
def all_reasons(spark, folder):
    """Every reason of every brief in full."""
    return match.score(profiles(spark, folder), BRIEFS).select("brief_id", "creator_id", F.array_join("reasons", "; ").alias("reasons"))


def _pools(spark, folder):
    return match.build_pools(cut_lineage(match.score(profiles(spark, folder), BRIEFS)), BRIEFS)


@query("h13_budgeted_pool", pool_sql() + "SELECT brief_id, creator_id, seq FROM chosen")
def budgeted_pool(spark, folder):
    scored = match.score(profiles(spark, folder), BRIEFS)
    return match.choose_pool(scored, BRIEFS).select("brief_id", "creator_id", "seq")


@query("h14_pool_summary", pool_sql() + """
  SELECT s.brief_id, count(c.creator_id) AS creators, coalesce(sum(cost) FILTER (WHERE c.creator_id IS NOT NULL), 0) AS spent,
         CAST(round_even(sum(est_views) FILTER (WHERE c.creator_id IS NOT NULL), 0) AS BIGINT) AS est_views,
         round_even(coalesce(sum(cost) FILTER (WHERE c.creator_id IS NOT NULL), 0) / sum(est_views) FILTER (WHERE c.creator_id IS NOT NULL), 2) AS blended_cpv,
         round_even(avg(er) FILTER (WHERE c.creator_id IS NOT NULL), 2) AS avg_er, round_even(avg(fit) FILTER (WHERE c.creator_id IS NOT NULL), 1) AS avg_fit,
         count(*) FILTER (WHERE excluded IS NULL) AS eligible, count(*) FILTER (WHERE excluded IS NULL AND cost IS NOT NULL) AS priced,
         array_to_string(list_sort(list_distinct(flatten(list(languages) FILTER (WHERE c.creator_id IS NOT NULL)))), '>') AS languages
  FROM scored s LEFT JOIN chosen c ON c.brief_id = s.brief_id AND c.creator_id = s.creator_id GROUP BY 1""")
def pool_summary(spark, folder):
    return _pools(spark, folder).summary.select("brief_id", "creators", "spent", "est_views", "blended_cpv", "avg_er", "avg_fit", "eligible", "priced",
                                                F.array_join("languages", ">").alias("languages"))


@query("h14_exclusion_counts", over(scored_sql(), """
  SELECT brief_id, CASE WHEN excluded LIKE 'worked%' THEN 'worked with a competitor' ELSE excluded END AS reason, count(*) AS n FROM scored WHERE excluded IS NOT NULL GROUP BY ALL"""))
def exclusion_counts(spark, folder):
    return match.exclusion_counts(match.score(profiles(spark, folder), BRIEFS))


def _why_sql(b: Brief) -> str:
    tight = f"WHEN s.cost > {b.budget} - prev.spent THEN 'over remaining budget' WHEN prev.slots > 1 AND s.cost > 2.5 * ({b.budget} - prev.spent) / prev.slots THEN 'would crowd out the rest of the pool'"
    return f"""SELECT '{b.brief_id}' AS brief_id, s.creator_id, s.fit, CASE WHEN w.rn IS NULL THEN 'lower fit than the chosen pool' {tight}
      ELSE 'already {b.city_cap} from ' || s.city END AS why_not FROM (SELECT * FROM scored WHERE brief_id = '{b.brief_id}' AND excluded IS NULL) s
      LEFT JOIN w_{b.brief_id} w ON w.creator_id = s.creator_id LEFT JOIN w_{b.brief_id} prev ON prev.rn = w.rn - 1 WHERE NOT coalesce(w.taken, false)"""


@query("h15_alternates", pool_sql() + ", rest AS (" + " UNION ALL ".join(_why_sql(b) for b in BRIEFS) + """)
  SELECT brief_id, creator_id, why_not FROM rest QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY fit DESC, creator_id) <= 12""")
def alternates(spark, folder):
    return _pools(spark, folder).alternates.select("brief_id", "creator_id", "why_not")


@query("h15_unpriced_and_conflicts", over(scored_sql(), """
  SELECT 'unpriced' AS list, brief_id, creator_id FROM (SELECT * FROM scored WHERE excluded IS NULL AND cost IS NULL QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY fit DESC, creator_id) <= 6)
  UNION ALL SELECT 'conflicts', brief_id, creator_id FROM (SELECT * FROM scored WHERE excluded LIKE 'worked with%' QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY creator_id) <= 10)"""))
def unpriced_and_conflicts(spark, folder):
    pools = _pools(spark, folder)
    return pools.unpriced.select(F.lit("unpriced").alias("list"), "brief_id", "creator_id").unionByName(
        pools.conflicts.select(F.lit("conflicts").alias("list"), "brief_id", "creator_id"))


@query("h16_suggestions")
def suggestions(spark, folder):
    """Sixteen more creators for a campaign that has members already."""
    _, members = shortlist(spark, folder)
    found = match.suggestions(profiles(spark, folder), BRIEFS[0], members.where(F.col("campaign_id") == 1))
    return found.select("place", "creator_id", "fit")
