from pyspark.sql import functions as F

from rosterlake.functions import names, refs, topics, values
from rosterlake.operators import clean


def test_counts(column):
    texts = ["267.1M", "845.2K", "12,00,000", "1,200,000", "1.2 lakh", "3 crore", "45k", "1.2B", "1.5M followers", "5000", "-", "", "N/A", "lots", "7 zillion", None]
    want = [267_100_000, 845_200, 1_200_000, 1_200_000, 120_000, 30_000_000, 45_000, 1_200_000_000, 1_500_000, 5000, None, None, None, None, None, None]
    assert column(texts, values.count_value) == want
    assert column(["lots", "-", "5"], lambda c: values.unreadable(c, values.count_value(c))) == [True, False, False]


def test_percents(column):
    assert column(["2.23%", "13%", "0.0223", "-", "1.5d", "1"], values.percent_value) == [2.23, 13.0, 2.23, None, None, 1.0]
    assert column(["0.1", "0.1%"], lambda c: values.percent_value(c, True)) == [0.1, 0.1]


def test_money(spark):
    texts = ["₹25,000", "Rs. 40000", "25k", "1.5L", "INR 2,00,000", "20k-30k", "20-30k", "DM for rates", "barter only", "garbage", "-", "500 to 900"]
    df = values.with_money(spark.createDataFrame(list(enumerate(texts)), "i int, v string"), {"v": "m"})
    got = [(r.m, r.m_note, r.m_unreadable) for r in df.orderBy("i").collect()]
    assert got == [(25000, None, False), (40000, None, False), (25000, None, False), (150000, None, False), (200000, None, False),
                   (25000, "range_midpoint", False), (25000, "range_midpoint", False), (None, "on_request", False), (None, "on_request", False),
                   (None, None, True), (None, None, False), (700, "range_midpoint", False)]


def test_ages_round_half_to_even(column):
    assert column(["24", "25-34", "28 yrs", "12", "young", ""], values.age_value) == [24, 30, 28, None, None, None]
    assert column(["young", "", "12"], values.age_unreadable) == [True, False, False]


def test_lists_keep_order(column):
    assert column(["a, b;a | c/ d", "-"], values.split_list) == [["a", "b", "c", "d"], []]


def test_name_and_handle(column):
    texts = ["Virat Kohli @virat.kohli", "@parineetichopra", "@alisha ray1 @rupapatra10", "T-Series @UCq-Fj5jknLsUf-MWSy4_brA", "No handle here"]
    pair = column(texts, lambda c: F.struct(*[p.alias(n) for p, n in zip(names.split_name_handle(c), ("name", "handle"))]))
    assert [tuple(p) for p in pair] == [("Virat Kohli", "virat.kohli"), ("", "parineetichopra"), ("@alisha ray1", "rupapatra10"),
                                        ("T-Series", "UCq-Fj5jknLsUf-MWSy4_brA"), ("No handle here", None)]


def test_display_names(spark):
    cases = {"𝑨𝒋𝒆𝒚 𝑵𝒂𝒈𝒂𝒓": "Ajey Nagar", "F I L M Y G Y A N": "Filmygyan", "Zareen Khan 🦄🌈✨👼🏻": "Zareen Khan", "DILJIT DOSANJH": "Diljit Dosanjh",
             "MC STΔN 💔": "MC STΔN", "SRK MUSIC": "SRK Music", "PRINCE YUVIKA NARULA ❤️❤️❤️": "Prince Yuvika Narula", "Angel Rai :)": "Angel Rai",
             "Tulsi Kumar 🧿 #TrulyKonnected #BoloNa": "Tulsi Kumar", "Gyan Gamingㅤ": "Gyan Gaming", "madhu_gowda": "Madhu Gowda",
             "दीपिका पादुकोण": "दीपिका पादुकोण", "༺ 𒆜 🇦 🇳 🇯 🇦 🇳 🇮𒆜 ༻": ""}
    df = names.with_display_name(spark.createDataFrame([(k,) for k in cases], "v string"), "v", "n", "f")
    got = {r.v: r.n for r in df.collect()}
    assert got == cases


def test_keys(spark, column):
    assert column(["_kajalbhardwaj_143", "rashmika_mandanna", None, "@real.Abc-official9"], names.handle_core) == ["kajalbhardwaj", "rashmikamandanna", "", "abc"]
    df = spark.createDataFrame([("The Réal Café Official",), ("दीपिका",)], "v string").withColumn("r", names.transliterate("v"))
    assert [r[0] for r in df.select(names.name_key(F.col("r"))).collect()] == ["cafe", "diipikaa"]


def test_profile_refs(spark):
    cases = [("https://www.instagram.com/Virat.Kohli/?igsh=abc123", None, ("instagram", "virat.kohli", None, None, None, None)),
             ("instagram.com/reels/xyz/", None, ("instagram", None, None, None, None, "post_url_not_profile")),
             ("https://m.youtube.com/@CarryMinati/videos?si=1", None, ("youtube", "CarryMinati", None, None, None, None)),
             ("https://www.youtube.com/channel/UCq-Fj5jknLsUf-MWSy4_brA", None, ("youtube", None, "UCq-Fj5jknLsUf-MWSy4_brA", None, None, None)),
             ("@nehakakkar", "instagram", ("instagram", "nehakakkar", None, None, None, None)),
             ("https://www.threads.net/@zareenkhan", None, ("threads", "zareenkhan", None, None, None, None)),
             ("https://www.tiktok.com/@kajol?lang=en", None, ("tiktok", "kajol", None, None, None, None)),
             ("youtube.com/user/tseries", None, ("youtube", None, None, "tseries", None, None)),
             ("youtube.com/c/NishaMadhulika", None, ("youtube", None, None, None, "NishaMadhulika", None)),
             ("https://youtu.be/abc", None, ("youtube", None, None, None, None, "video_url_not_channel")),
             ("https://example.com/x", "tiktok", ("tiktok", None, None, None, None, "unknown_host")),
             ("https://www.instagram.com/", None, ("instagram", None, None, None, None, "url_without_path")),
             ("", "tiktok", ("tiktok", None, None, None, None, None))]
    df = spark.createDataFrame([(i, v, h) for i, (v, h, _) in enumerate(cases)], "i int, v string, h string")
    got = [tuple(r.ref) for r in refs.with_profile_ref(df, "v", "h", "ref").orderBy("i").collect()]
    assert got == [want for _, _, want in cases]


def test_topics(spark):
    texts = ["Entertainment and Music Fashion and Accessories Actors Actor", "Fitness & Health Food", "Fitness and Health Modeling Film, Music & Books Celebrities"]
    rows = topics.with_topics(spark.createDataFrame(list(enumerate(texts)), "i int, v string"), "v").orderBy("i").collect()
    assert rows[0].topics == ["entertainment and music", "fashion and accessories", "actors", "actor"]
    assert rows[0].categories == ["Entertainment", "Music", "Fashion", "Film & TV"]
    assert rows[1].categories == ["Fitness & Health", "Food"]
    assert rows[2].unknown_topic_words == []


def test_cities(column):
    got = column(["Bombay", "Bangalore, India", "gurgaon", "New Delhi", "o'brien town", "-"], lambda c: topics.city_match(c, F.lower(c)))
    assert [tuple(g) for g in got] == [("Mumbai", "Maharashtra", True), ("Bengaluru", "Karnataka", True), ("Gurugram", "Haryana", True),
                                       ("Delhi", "Delhi", True), ("O'Brien Town", None, False), (None, None, True)]


def test_bands(column):
    assert column(["17", "24", "25", "45", None], lambda c: values.age_band(c.cast("int"))) == ["18-24", "18-24", "25-34", "45+", None]
    assert column(["0", "10000", "10000000"], lambda c: values.size_tier(c.cast("long"))) == ["Nano", "Micro", "Mega"]


def test_headers_first_alias_wins_and_later_header_replaces(spark):
    batches = spark.createDataFrame([(1, ["Name", "Creator Name", "Engagement %", "ER", "er!", "Junk"])], "batch_id long, columns array<string>")
    mapping = clean.map_headers(batches).first().mapping
    assert mapping == {"name": "Name", "er": "er!"}


def test_sheet_without_identity_column_is_rejected(spark):
    from datetime import datetime
    batches = spark.createDataFrame([(1, "instagram", ["Followers"], datetime(2024, 1, 1))], "batch_id long, platform_hint string, columns array<string>, ingested_at timestamp")
    staging = spark.createDataFrame([(1, 1, 1, {"Followers": "5K"})], "row_id long, batch_id long, row_number long, raw map<string,string>")
    cleaned = clean.clean_rows(staging, batches)
    assert cleaned.first().reject == "no_name_handle_or_url_column"
    assert [(r.severity, r.issue) for r in clean.row_issues(cleaned).collect()] == [("rejected", "no_name_handle_or_url_column")]
    assert clean.accepted(cleaned).count() == 0


def test_rows_of_one_partition_are_cleaned_in_many_tasks(spark):
    """Rows read from one row group, all of one sheet and some of them equal, are not cleaned by one task."""
    from datetime import datetime
    batches = spark.createDataFrame([(1, None, ["Name", "URL"], datetime(2024, 1, 1), 400)],
                                    "batch_id long, platform_hint string, columns array<string>, ingested_at timestamp, row_count long")
    rows = [(None if i % 9 == 0 else i // 2, 1, i // 2, {"Name": f"Ann {i // 2}", "URL": f"instagram.com/ann{i // 2}/"}) for i in range(400)]
    staging = spark.createDataFrame(rows, "row_id long, batch_id long, row_number long, raw map<string,string>").coalesce(1)
    got = clean.clean_rows(staging, batches).select("row_id", "account_id", F.spark_partition_id().alias("part")).toPandas()
    assert got.groupby("part").size().max() <= 100
    assert sorted(got.account_id) == sorted(f"instagram:ann{i // 2}" for i in range(400)) and got.row_id.isna().sum() == 45
