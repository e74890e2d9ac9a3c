import random
import re

import pandas as pd
from pyspark.sql import functions as F

from rosterlake.operators import campaign, latest, merge, profile, scale
from rosterlake.plans import library_queries, source_queries
from rosterlake.sources.files import dense_index


def frame(spark, n=4000, seed=3):
    """A third of all rows share one key and one value."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        value = 5.0 if hot else (None if i % 11 == 0 else float(rnd.randint(0, 400)))
        rows.append((i, "hot" if hot else f"k{rnd.randint(0, 40)}", value))
    return pd.DataFrame(rows, columns=["id", "key", "value"]), spark.createDataFrame(rows, "id long, key string, value double")


def test_percent_ranks_average_ties_and_fill_nulls(spark):
    pdf, df = frame(spark)
    got = scale.percent_ranks(df, "id", {"up": (F.col("value"), True), "down": (F.col("value"), False)}).toPandas().sort_values("id")
    assert (got["up"].values - pdf["value"].rank(pct=True).fillna(0.3).values).max() < 1e-12
    assert (got["down"].values - pdf["value"].rank(pct=True, ascending=False).fillna(0.3).values).max() < 1e-12


def test_percent_ranks_shuffle_wide_rows_once(spark, capsys):
    """Four ranks, repeated and null ids, null values, both zeros; joins that are not broadcast move the wide column once."""
    rows = [(None if i % 7 == 0 else i // 2, f"wide {i}", None if i % 5 == 0 else float(i % 13), [0.0, -0.0, 2.5, None][i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, payload string, a double, b double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scale.percent_ranks(df, "id", {f"{c}_{way}": (F.col(c), way == "up") for c in "ab" for way in ("up", "down")})
        got.explain("formatted")
        pdf = got.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", capsys.readouterr().out)
    assert sum("payload#" in columns for columns in moved) == 1
    assert list(pdf.columns) == ["id", "payload", "a", "b", "a_up", "a_down", "b_up", "b_down"] and sorted(pdf.payload) == sorted(r[1] for r in rows)
    for c in "ab":
        for way in ("up", "down"):
            want = pdf[c].astype("float64").rank(pct=True, ascending=way == "up").fillna(0.3)
            assert (pdf[f"{c}_{way}"] - want).abs().max() < 1e-12


def test_medians_are_exact(spark):
    pdf, df = frame(spark)
    got = scale.exact_medians(df, ["key"], ["value"]).toPandas().set_index("key")["value"]
    want = pdf.groupby("key")["value"].median()
    assert (got.sort_index() - want.sort_index()).abs().max() == 0
    assert scale.exact_medians(df, [], ["value"]).first()["value"] == pdf["value"].median()


def test_hot_first_join_is_a_left_join(spark):
    pdf, df = frame(spark)
    right = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    some = right.where(F.col("key") != "k7")
    keep = scale.HOT_KEYS
    scale.HOT_KEYS = 2
    try:
        got = scale.hot_first_join(df, some, ["key"], "n", "id", ["top"]).toPandas()
    finally:
        scale.HOT_KEYS = keep
    want = pdf.groupby("key")["id"].max()
    assert len(got) == len(pdf)
    assert got[got.key == "k7"]["top"].isna().all()
    rest = got[got.key != "k7"]
    assert (rest["top"] == rest["key"].map(want)).all()


def test_dense_index_counts_in_order(spark):
    _, df = frame(spark)
    got = dense_index(df, [F.col("key"), F.col("id")], "n", 10).orderBy("key", "id").toPandas()
    assert list(got["n"]) == list(range(11, 11 + len(got)))


def test_history_matches_a_plain_lag(spark):
    rows = [(i, "a" if i % 3 else "b", f"2024-01-{1 + i // 40:02d} {i % 24:02d}:{i % 60:02d}:00", i * 7 % 50 if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    got = latest.history(df, "key", "at", "id", "v").toPandas().sort_values(["key", "at", "id"])
    want = got["v"] - got.groupby("key")["v"].shift()
    assert ((got["change"] == want) | (got["change"].isna() & want.isna())).all()


def test_merge_is_order_independent(spark):
    rows = [("a", 1, 1, "x", 5.0, ["p", "q"]), ("a", 1, 2, None, None, ["q", "r"]), ("a", 2, 1, None, 7.0, ["s", "p"]), ("b", 1, 3, "", None, [])]
    schema = "k string, b long, r long, name string, v double, tags array<string>"
    def run(order):
        df = spark.createDataFrame(order, schema)
        return sorted(map(tuple, merge.merge_latest(df, "k", ("b", "r"), (), ("name", "v"), ("tags",)).select("k", "name", "v", "tags", "n_source_rows").collect()))
    assert run(rows) == run(rows[::-1]) == [("a", "x", 7.0, ["s", "p", "q", "r"], 3), ("b", None, None, [], 1)]


def test_conflicting_followers(spark):
    df = spark.createDataFrame([("a", ["f"], 100), ("a", ["e"], 106), ("a", [], 0), ("b", [], 5)], "k string, flags array<string>, n long")
    got = {r.k: r.flags for r in merge.merged_flags(df, "k", "flags", "n").collect()}
    assert got == {"a": ["conflicting_follower_counts", "e", "exact_duplicate_rows_merged", "f"], "b": []}


def test_timeline_carries_the_last_value_forward(spark):
    rows = [(1, 10, "2024-01-01", 5), (1, 11, "2024-01-02", 3), (1, 10, "2024-01-03", None), (1, 11, "2024-01-04", 9)]
    df = spark.createDataFrame(rows, "campaign_id long, cc_id long, day string, views long").withColumn("recorded_at", F.col("day").cast("timestamp"))
    assert [r.views for r in campaign.view_timeline(df).orderBy("day").collect()] == [5, 8, 3, 9]


def star(spark, folder, n=60):
    """Customers and their orders of three nations, small enough that any table of them would be broadcast."""
    tables = {"customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                           [(i, f"Customer#{i}", i % 3, 10.0 * i, "HOUSEHOLD") for i in range(n)]),
              "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", [(i, i % n, "FOP"[i % 3]) for i in range(4 * n)]),
              "nation": ("n_nationkey int, n_name string", [(i, f"NATION {i}") for i in range(3)]),
              "events": ("event_id long, ts timestamp_ntz, user_id long", [])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_broadcast_no_account(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(profile, "against_peers", lambda built: seen.append(built) or built.withColumns({c: F.lit(None) for c in ("er_vs_tier", "engagement")}))
    built = library_queries.build_profiles(spark, star(spark, tmp_path))
    assert "Join" in plan(seen[0]) and "Broadcast" not in plan(seen[0])
    assert built.count() == 20


def test_layers_broadcast_no_account_and_no_customer(spark, tmp_path):
    for name, layer in source_queries._layers(spark, star(spark, tmp_path)).items():
        if name in ("accounts", "creators", "rejected", "review"):
            assert "Join" in plan(layer) and "Broadcast" not in plan(layer), name
        elif name == "staging":
            assert plan(layer).count("BroadcastExchange") == 1  # the sheets, one a nation
            assert layer.count() == 240
