"""Topics, places, languages and gender against the controlled vocabularies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.steps import once, step
from rosterlake.functions.values import literal_map, strip
from rosterlake.vocab import places, topics, words


def _lists(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items()
                          for x in (F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))])


def with_topics(df: DataFrame, src: str, prefix: str = "", vocabulary: dict | None = None,
                fillers: tuple[str, ...] = topics.FILLER_WORDS) -> DataFrame:
    """Split glued topic text into known phrases, longest phrase first, and add ``topics``, ``categories``, ``tags``
    and ``unknown_topic_words``.

    One regular expression does the split: its alternatives are the phrases by falling word count, then any word.
    """
    vocabulary = vocabulary or topics.TOPICS
    phrases = sorted(vocabulary, key=lambda p: -len(p.split()))
    pattern = r"(?<!\S)(" + "|".join(re.escape(p) for p in phrases) + r"|\S+)(?!\S)"
    text = F.replace(F.replace(F.lower(F.coalesce(F.col(src), F.lit(""))), F.lit("’"), F.lit("'")), F.lit("&"),
                     F.lit(" and "))
    text = strip(F.regexp_replace(F.regexp_replace(text, "[,/;|]+", " "), r"\s+", " "))
    made = step(df, _parts=F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    made = step(made, _known=F.filter("_parts", lambda p: p.isin(*phrases)),
                **{prefix + "unknown_topic_words": F.filter("_parts", lambda p: ~p.isin(*phrases, *fillers))})
    cats, tags = (_lists({k: v[i] for k, v in vocabulary.items()}) for i in (0, 1))
    made = once(made, **{
        prefix + "topics": F.array_distinct("_known"),
        prefix + "categories": F.array_distinct(F.flatten(F.transform("_known", lambda p: F.try_element_at(cats, p)))),
        prefix + "tags": F.array_distinct(F.flatten(F.transform("_known", lambda p: F.try_element_at(tags, p))))})
    return made.drop("_parts", "_known")


def channel_categories(urls: Column) -> Column:
    """Categories behind a channel's topic links."""
    slugs = F.transform(urls, lambda u: F.try_element_at(literal_map(topics.CHANNEL_TOPICS),
                                                         F.element_at(F.split(u, "/"), -1)))
    return F.coalesce(F.array_distinct(F.filter(slugs, lambda c: c.isNotNull())), F.array().cast("array<string>"))


def title_case(c: Column) -> Column:
    """Capital after every non-letter."""
    runs = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(runs, F.initcap), "")


def city_match(raw: Column, reading: Column) -> Column:
    """Struct ``(city, state, known)`` from a typed place and its ASCII reading; an unknown place is kept as typed."""
    absent = F.coalesce(strip(raw).isin("", "-", "N/A"), F.lit(True))
    keys = F.transform(F.split(reading, "[,/|]"), lambda p: strip(F.regexp_replace(F.replace(p, F.lit("."), F.lit("")), r"\s+", " ")))
    found = F.filter(F.transform(keys, lambda k: F.try_element_at(literal_map(places.CITY_NAMES), k)),
                     lambda c: c.isNotNull())
    city = F.try_element_at(found, F.lit(1))
    typed = F.try_element_at(F.filter(F.transform(F.split(raw, "[,/|]"), strip), lambda p: p != ""), F.lit(1))
    return F.when(absent, F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"),
                                   F.lit(True).alias("known"))).otherwise(
        F.struct(F.coalesce(city, title_case(typed)).alias("city"),
                 F.try_element_at(literal_map(places.CITY_STATE), city).alias("state"),
                 city.isNotNull().alias("known")))


def region_of(state: Column) -> Column:
    return F.try_element_at(literal_map(places.STATE_REGION), state)


def city_tier(city: Column) -> Column:
    return F.when(F.nullif(city, F.lit("")).isNotNull(),
                  F.when(city.isin(*places.METRO_CITIES), "Metro").otherwise("Tier 2/3"))


def language_list(c: Column) -> Column:
    """Known languages in the order given."""
    known = {**{name.lower(): name for name in places.LANGUAGES}, **places.LANGUAGE_ALIASES}
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[,/;|&+]| and "),
                        lambda p: F.try_element_at(literal_map(known), strip(p)))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def gender_class(c: Column) -> Column:
    text = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for name, forms in words.GENDER_WORDS.items():
        out = F.when(text.isin(*forms), name).otherwise(out)
    return out


def country_code(c: Column) -> Column:
    text = F.nullif(c, F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(places.COUNTRY_CODES), F.lower(text)), F.upper(text))
