import random
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from rosterlake.operators import billing, explore, match
from rosterlake.operators.match import Brief
from rosterlake.plans import bindings

SMALL = "/root/testdata/sf0.001"


def greedy(rows, b):
    taken, spent, cities = [], 0.0, {}
    for cid, fit, cost, city in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(taken) >= b.count:
            break
        slots = b.count - len(taken)
        if b.budget and (spent + cost > b.budget or (slots > 1 and cost > 2.5 * (b.budget - spent) / slots)):
            continue
        if city and cities.get(city, 0) >= b.city_cap:
            continue
        taken.append(cid)
        spent += cost
        cities[city] = cities.get(city, 0) + 1
    return taken


def test_pool_equals_the_sequential_walk(spark):
    rnd = random.Random(2)
    briefs = [Brief("tight", budget=900.0, count=12), Brief("open", count=9), Brief("one_city", cities=("A",), budget=4000.0, count=7), Brief("poor", budget=3.0, count=4)]
    rows = [(b.brief_id, f"c{i:04d}", float(rnd.randint(0, 60)), float(rnd.choice([5, 20, 80, 300, 900])), rnd.choice(["A", "B", None]), None) for b in briefs for i in range(700)]
    df = spark.createDataFrame(rows, "brief_id string, creator_id string, fit double, cost double, city string, excluded string")
    keep, match.CHUNK = match.CHUNK, 5
    try:
        picks = match.choose_pool(df, briefs).orderBy("brief_id", "seq").collect()
    finally:
        match.CHUNK = keep
    for b in briefs:
        want = greedy([r[1:5] for r in rows if r[0] == b.brief_id], b)
        assert [p.creator_id for p in picks if p.brief_id == b.brief_id] == want
        assert not b.budget or sum(p.cost for p in picks if p.brief_id == b.brief_id) <= b.budget


def test_facets_of_an_open_filter_sum_to_the_total(spark):
    p = bindings.profiles(spark, SMALL)
    counts = explore.facet_counts(p, {"gender": ["Female"]})
    by_gender = counts.where("facet = 'gender'").agg(F.sum("count")).first()[0]
    assert by_gender == p.where("gender IS NOT NULL").count()
    tiers = counts.where("facet = 'size_tier'").agg(F.sum("count")).first()[0]
    assert tiers == p.where("gender = 'Female' AND size_tier IS NOT NULL").count()


def test_three_creators_cost_1766_46(spark):
    campaigns = spark.createDataFrame([(7, 3, "Spring", "active"), (8, 3, "Draft", "draft")], "id long, org_id long, name string, status string")
    creators = spark.createDataFrame([(1, 7, "live", False), (2, 7, "confirmed", False), (3, 7, "submitted", False), (4, 7, "live", True), (5, 7, "dropped", False), (6, 8, "live", False)],
                                     "id long, campaign_id long, status string, billed boolean")
    orgs = spark.createDataFrame([(3, None)], "org_id long, fee_per_creator long")
    old = spark.createDataFrame([(3, "CA-2024-003-0001"), (3, "CA-2023-003-0009")], "org_id long, number string")
    bills = billing.billing_run(campaigns, creators, orgs, old, F.lit(datetime(2024, 5, 1)))
    row = bills.first()
    assert bills.count() == 1 and float(row.total) == 1766.46 and row.number == "CA-2024-003-0002" and row.qty == 3
    assert row.due_at == datetime(2024, 5, 8)
    assert {r.id for r in billing.mark_billed(creators, bills).where("billed").collect()} == {1, 2, 3, 4}


def test_exclusion_reports_the_last_rule(spark):
    p = bindings.profiles(spark, SMALL)
    b = Brief("b", platforms=("threads",), gender="Female", exclude_brand_media=True)
    got = {r.excluded for r in match.score(p, [b]).select("excluded").distinct().collect()}
    assert got == {"platform not in brief", "gender preference (Female)", "brand / media account, not a creator"}


def test_segments_have_distinct_names(spark):
    from rosterlake.operators import segment
    p = bindings.profiles(spark, SMALL)
    df, cards = segment.segment(p, restarts=2)
    rows = cards.collect()
    assert sum(r["count"] for r in rows) == p.where("followers IS NOT NULL").count()
    named = [r["name"] for r in rows if r["name"] != "Solid all-rounders"]
    assert 3 <= len(rows) <= 6 and len(named) == len(set(named))
    few, none = segment.segment(p.limit(5))
    assert few.where("segment IS NOT NULL").count() == 0 and none.count() == 0
    assert segment.name_centroids({0: [2.0, 0, 0, 0, 0], 1: [1.0, 0.5, 0, 0, 0]}) == {
        0: ("Scale players", "Large audiences - the backbone of awareness campaigns."),
        1: ("Engagement stars", "Engagement well above creators of their size - audiences that respond.")}
    assert isinstance(df.limit(1).toPandas(), pd.DataFrame)
