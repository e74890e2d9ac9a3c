"""Staging rows to one clean record per row, with the reasons for every rejection and fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names, refs, topics, values
from rosterlake.functions.steps import once, step
from rosterlake.operators.scale import hot_first_join, spread_evenly
from rosterlake.vocab import words

IDENTITY = ("handle", "channel_id", "legacy_username", "custom_url")
COUNT_FIELDS = ("followers", "reach", "avg_views")
RATE_FIELDS = ("rate_reel", "rate_story", "rate_video")


def map_headers(batches: DataFrame) -> DataFrame:
    """One row per batch with ``mapping``: canonical field -> header of that file.

    A field takes its first alias that is present; of two headers that read the same, the later one counts.
    """
    key = F.trim(F.regexp_replace(F.lower("header"), "[^a-z0-9% ]", ""))
    headers = (batches.select("batch_id", F.posexplode("columns").alias("position", "header"))
               .groupBy("batch_id", key.alias("alias")).agg(F.max_by("header", "position").alias("header")))
    rows = [(field, alias, rank) for field, aliases in words.HEADER_ALIASES.items() for rank, alias in enumerate(aliases)]
    table = F.broadcast(batches.sparkSession.createDataFrame(rows, "field string, alias string, rank int"))
    chosen = headers.join(table, "alias").groupBy("batch_id", "field").agg(F.min_by("header", "rank").alias("header"))
    found = chosen.groupBy("batch_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "header")))).alias("mapping"))
    return (batches.join(found, "batch_id", "left")
            .withColumn("mapping", F.coalesce("mapping", F.create_map().cast("map<string,string>"))))


def _usable(ref: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"{ref}.{part}"), F.lit("")) for part in IDENTITY]).isNotNull()


def clean_rows(staging: DataFrame, batches: DataFrame) -> DataFrame:
    """Clean every staging row.

    ``staging``: row_id, batch_id, row_number, raw; ``batches``: batch_id, platform_hint, columns, ingested_at.
    The result keeps rejected rows too, with ``reject`` set.
    """
    staging = spread_evenly(staging)  # the rules below cost far more than a shuffle of what they read
    take = ["platform_hint", "ingested_at", "mapping"]
    mapped = map_headers(batches).select("batch_id", *take, *[c for c in ("row_count",) if c in batches.columns])
    cells = {f"in_{field}": values.strip(F.coalesce(F.try_element_at("raw", F.try_element_at("mapping", F.lit(field))), F.lit("")))
             for field in words.HEADER_ALIASES}
    # one sheet may hold a large share of all rows; the registry knows its size
    rows = (hot_first_join(staging, mapped, ["batch_id"], "row_count", "row_id", take) if "row_count" in mapped.columns
            else staging.join(mapped, "batch_id"))
    return clean_fields(step(rows.where(F.col("mapping").isNotNull()), **cells).drop("raw", "row_count"))


def clean_fields(df: DataFrame) -> DataFrame:
    """The cleaning rules over ``in_<field>`` columns, next to row_id, batch_id, platform_hint, mapping."""
    mapping = F.col("mapping")
    no_identity = ~(F.map_contains_key(mapping, F.lit("name")) | F.map_contains_key(mapping, F.lit("handle"))
                    | F.map_contains_key(mapping, F.lit("url")))
    part, at_handle = names.split_name_handle(F.col("in_name"))
    df = step(df, name_part=part, name_handle=at_handle,
              stated=F.coalesce(refs.platform_from_text(F.col("in_platform")), F.col("platform_hint")))

    # identity: link first, then the handle column, then the @handle inside the name
    df = refs.with_profile_ref(df, "in_url", "stated", "by_url")
    df = refs.with_profile_ref(df, "in_handle", "stated", "by_handle")
    df = step(df, url_ok=_usable("by_url"), handle_ok=~_usable("by_url") & _usable("by_handle"))
    in_name = ~F.col("url_ok") & ~F.col("handle_ok") & F.col("name_handle").isNotNull()
    name_is_channel = in_name & names.is_channel_id(F.col("name_handle"))

    def chosen(field: str) -> Column:
        return F.when(F.col("url_ok"), F.col(f"by_url.{field}")).when(F.col("handle_ok"), F.col(f"by_handle.{field}"))

    df = step(df, platform=F.coalesce(chosen("platform"), F.col("stated"), F.when(name_is_channel, "youtube")),
              channel_id=F.coalesce(chosen("channel_id"), F.when(name_is_channel, F.col("name_handle"))),
              found_handle=F.nullif(F.coalesce(chosen("handle"), F.when(in_name & ~name_is_channel, F.col("name_handle"))), F.lit("")),
              legacy=F.nullif(chosen("legacy_username"), F.lit("")), custom=F.nullif(chosen("custom_url"), F.lit("")))
    youtube = F.col("platform") == "youtube"
    channel = F.nullif(F.col("channel_id"), F.lit(""))
    provisional = youtube & channel.isNull()
    by_at, by_user = provisional & F.col("found_handle").isNotNull(), provisional & F.col("legacy").isNotNull()
    low = F.lower("found_handle")
    df = step(df, handle=F.when(youtube & channel.isNotNull(), F.col("found_handle")).otherwise(low),
              platform_key=F.when(~youtube, low).when(channel.isNotNull(), channel).when(by_at, F.concat(F.lit("@"), low))
              .when(by_user, F.concat(F.lit("user:"), F.lower("legacy")))
              .when(F.col("custom").isNotNull(), F.concat(F.lit("c:"), F.lower("custom"))))
    df = once(df, account_id=F.concat_ws(":", "platform", "platform_key"),
              reject=F.when(no_identity, "no_name_handle_or_url_column").when(F.col("platform").isNull(), "platform_unknown")
              .when(F.col("platform_key").isNull(), "no_account_identifier"))
    identity_flags = [
        F.col("by_url.note"), F.when(~F.col("url_ok"), F.col("by_handle.note")),
        F.when(F.col("url_ok") & F.col("in_url").rlike("[?#]"), "url_params_stripped"),
        F.when(by_at, "yt_handle_needs_resolution"),
        F.when(by_user & ~by_at, "yt_username_needs_resolution"),
        F.when(F.col("platform_key").startswith("c:") & youtube, "yt_custom_url_unresolvable")]
    # name, falling back to the handle; the stem of a row with a name is blank, so it costs nothing
    df = step(df, identity_flags=F.array(*identity_flags),
              shown=F.when(F.col("name_handle").isNotNull(), F.col("name_part")).otherwise(F.col("in_name")))
    df = names.with_display_name(df, "shown", "clean_name", "name_flags")
    no_name = F.col("clean_name") == ""
    df = step(df, stem=F.when(no_name, F.coalesce(F.col("handle"), F.ltrim(F.element_at(F.split("platform_key", ":"), -1), F.lit("@")))))
    df = step(df, spaced_stem=F.regexp_replace("stem", "[._]+", " "))
    df = names.with_display_name(df, "spaced_stem", "stem_name", "stem_flags")
    df = once(df, name_clean=F.when(no_name, F.coalesce(F.nullif(F.col("stem_name"), F.lit("")), F.col("stem"))).otherwise(F.col("clean_name")))
    df = df.withColumns({"name_reading": names.transliterate("name_clean"), "city_reading": names.transliterate("in_city")})

    # numbers, topics and place
    says_percent = F.coalesce(F.try_element_at(mapping, F.lit("er")), F.lit(""))
    df = step(df, entity=names.entity_guess(F.col("name_clean")), **{f: values.count_value(F.col(f"in_{f}")) for f in COUNT_FIELDS},
              er_pct=values.percent_value(F.col("in_er"), says_percent.contains("%") | F.lower(says_percent).contains("percent")),
              age=values.age_value(F.col("in_age")), place=topics.city_match(F.col("in_city"), F.col("city_reading")),
              country_given=topics.country_code(F.col("in_country")))
    df = values.with_money(df, {f"in_{f}": f for f in RATE_FIELDS})
    df = topics.with_topics(df, "in_topics")
    city = F.nullif(F.col("place.city"), F.lit(""))
    df = step(df, state=F.coalesce(F.col("place.state"), F.nullif(topics.title_case(F.col("in_state")), F.lit(""))),
              country=F.coalesce(F.col("country_given"), F.when(city.isNotNull() & F.col("place.state").isNotNull(), "IN")))

    flags = [F.when(no_name, "name_from_handle")]
    flags += [F.when(values.unreadable(F.col(f"in_{f}"), F.col(f)), f"{f}_unparseable") for f in COUNT_FIELDS]
    for f in RATE_FIELDS:
        flags += [F.concat(F.lit(f + "_"), F.col(f"{f}_note")), F.when(F.col(f"{f}_unreadable"), f"{f}_unparseable")]
    flags += [
        F.when(F.col("followers").isNull(), "followers_missing"),
        F.when(values.age_unreadable(F.col("in_age")), "age_unparseable"),
        F.when(values.unreadable(F.col("in_er"), F.col("er_pct")), "er_unparseable"),
        F.when(F.col("er_pct").isNull(), "er_missing"), F.when(F.col("er_pct") > 15, "er_outlier_gt_15pct"),
        F.when(F.col("in_topics") == "", "topics_missing"),
        F.when(F.size("unknown_topic_words") > 0, "topics_unmapped_words"),
        F.when((F.col("in_city") != "") & ~F.col("place.known"), "city_not_in_reference_list")]
    every = F.concat(F.col("identity_flags"), F.col("name_flags"), F.array(*flags))
    df = step(df, all_flags=F.array_sort(F.array_distinct(F.array_compact(every))))
    return df.select(
        "row_id", "batch_id", "row_number", "ingested_at", "reject", "platform", "platform_key", "account_id", "handle",
        "channel_id", F.coalesce(F.nullif(F.col("shown"), F.lit("")), F.col("in_name")).alias("display_name_raw"),
        "name_clean", names.name_key(F.col("name_reading")).alias("name_key"),
        names.handle_core(F.col("handle")).alias("handle_core"), "followers", "er_pct",
        F.col("reach").alias("potential_reach"), F.col("avg_views").cast("double").alias("avg_views"),
        *[F.col(f).alias(f"{f}_inr") for f in RATE_FIELDS], "age",
        topics.gender_class(F.col("in_gender")).alias("gender"), topics.language_list(F.col("in_languages")).alias("languages"),
        values.split_list(F.col("in_brands")).alias("brands"), topics.region_of(F.col("state")).alias("region"),
        topics.city_tier(city).alias("city_tier"), "country", city.alias("city"), "state", "topics", "categories", "tags",
        "unknown_topic_words", F.col("entity.type").alias("entity_type"), F.col("entity.reason").alias("entity_reason"),
        F.col("all_flags").alias("flags"))


def row_issues(cleaned: DataFrame) -> DataFrame:
    """Rejections and warnings, one row each."""
    issue = F.when(F.col("reject").isNotNull(), F.array(F.struct(
        F.lit("rejected").alias("severity"), F.col("reject").alias("issue")))).otherwise(
        F.transform("flags", lambda f: F.struct(F.lit("warning").alias("severity"), f.alias("issue"))))
    return cleaned.select("row_id", "batch_id", "row_number", F.inline(issue))


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reject").isNull()).drop("reject")


def preview(staging: DataFrame, batches: DataFrame, n: int = 8) -> DataFrame:
    """First rows of a drop next to the columns that were recognised."""
    return staging.orderBy("batch_id", "row_number").limit(n).join(
        map_headers(batches).select("batch_id", "mapping"), "batch_id").select("row_number", "raw", "mapping")
