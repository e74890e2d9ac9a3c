"""Cleaning of numbers, money, ages and lists typed by hand (B2-B7, B29). Every function maps a column to a column.

A value that is present but unreadable comes back null; ``unreadable`` tells it apart from a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.steps import once, step
from rosterlake.vocab import words

WHITESPACE = " \t\n\r\f\u000b   　"
COUNT = r"^([0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)\s*([a-z]+)?\+?$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
MONEY_NOISE = r"(?i)₹|rs\.?|inr|rupees?|/-|per\s+\w+|approx\.?|~"
RANGE_MARK = r"\s*(?:-|–|to)\s*"


def literal_map(values: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*words.MISSING_TOKENS), F.lit(True))


def present(c: Column) -> Column:
    """The stripped text, null when it stands for a missing value."""
    return F.when(~is_missing(c), strip(c))


def _count(text: Column) -> Column:
    """Count from lower-cased text, null when it does not read as one."""
    plain = strip(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "followers|subscribers|subs", ""))
    scale = F.try_element_at(literal_map({"": 1.0, **words.COUNT_SUFFIXES}), F.regexp_extract(plain, COUNT, 2))
    digits = F.nullif(F.replace(F.regexp_extract(plain, COUNT, 1), F.lit(","), F.lit("")), F.lit(""))
    return F.bround(digits.try_cast("double") * scale, 0).try_cast("bigint")


def count_value(c: Column) -> Column:
    return _count(F.lower(present(c)))


def unreadable(c: Column, value: Column) -> Column:
    return ~is_missing(c) & value.isNull()


def percent_value(c: Column, header_says_percent: Column | bool = False) -> Column:
    """Percentage points; a bare fraction counts as a share unless its header already names percent."""
    header = header_says_percent if isinstance(header_says_percent, Column) else F.lit(header_says_percent)
    text = F.replace(present(c), F.lit(" "), F.lit(""))
    number = F.nullif(F.regexp_extract(F.rtrim(text, F.lit("%")), DECIMAL, 0), F.lit("")).try_cast("double")
    share = ~text.endswith("%") & ~header & (number > 0) & (number < 1)
    return F.bround(number * F.when(share, 100).otherwise(1), 4)


def with_money(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Read typed prices: for every ``source: name`` add ``name`` (whole rupees), ``name_note`` (a range, or on request)
    and ``name_unreadable``."""
    low = {n: F.lower(present(F.col(src))) for src, n in fields.items()}
    df = step(df, **{f"_low_{n}": c for n, c in low.items()})
    df = step(df, **{f"_text_{n}": strip(F.regexp_replace(f"_low_{n}", MONEY_NOISE, " ")) for n in low})
    df = step(df, **{f"_parts_{n}": F.filter(F.transform(F.split(f"_text_{n}", RANGE_MARK), strip), lambda p: p != "") for n in low})
    df = step(df, **{f"_counts_{n}": F.transform(f"_parts_{n}", count_value) for n in low})
    read = {}
    for n in low:
        text, parts, counts = F.col(f"_text_{n}"), F.col(f"_parts_{n}"), F.col(f"_counts_{n}")
        on_request = F.coalesce(F.col(f"_low_{n}").isin(*words.ON_REQUEST) | F.col(f"_low_{n}").contains("request")
                                | F.col(f"_low_{n}").contains("barter"), F.lit(False))
        bottom, top = F.try_element_at(counts, F.lit(1)), F.try_element_at(counts, F.lit(2))
        # a suffix typed once, at the upper end, stands for both ends
        typed = F.regexp_replace(F.try_element_at(parts, F.lit(2)), "[^0-9.]", "").try_cast("double")
        bare = (bottom < 1000) & (top >= 1000) & ~F.try_element_at(parts, F.lit(1)).rlike("[a-z]")
        start = F.when(bare, F.floor(F.try_divide(bottom * top, typed))).otherwise(bottom)
        ranged = F.coalesce((F.size(parts) == 2) & bottom.isNotNull() & top.isNotNull() & ~on_request, F.lit(False))
        single = F.when((F.size(parts) == 1) & (F.try_element_at(parts, F.lit(1)) == text), bottom)
        value = F.when(ranged, F.floor((start + top) / 2)).when(~on_request, single).cast("bigint")
        read[n] = value
        read[f"{n}_note"] = F.when(on_request, "on_request").when(ranged, "range_midpoint")
        read[f"{n}_unreadable"] = ~on_request & ~is_missing(text) & value.isNull()
    df = once(df, **read)
    return df.drop(*[f"_{k}_{n}" for k in ("low", "text", "parts", "counts") for n in low])


def age_value(c: Column) -> Column:
    """Mean of the first two whole numbers, rounded half to even; ages outside 13-90 are unknown."""
    numbers = F.slice(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), 1, 2)
    years = F.transform(numbers, lambda n: n.try_cast("int"))
    mean = F.try_divide(F.aggregate(years, F.lit(0), lambda a, b: a + b), F.size(years))
    age = F.bround(mean, 0).cast("int")
    return F.when(~is_missing(c) & age.between(13, 90), age)


def age_unreadable(c: Column) -> Column:
    return ~is_missing(c) & ~c.rlike(r"\d")


def split_list(c: Column) -> Column:
    """Ordered distinct items of a list separated by comma, semicolon, pipe or slash."""
    items = F.filter(F.transform(F.split(c, "[,;|/]"), strip), lambda x: x != "")
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.array_distinct(items))


def band(c: Column, table) -> Column:
    """Label of the half-open range ``[low, high)`` that holds the value."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(table):
        inside = (c >= low) if high is None else (c >= low) & (c < high)
        label = F.when(inside, name).otherwise(label)
    return label


def age_band(c: Column) -> Column:
    return band(c, words.AGE_BANDS)


def budget_tier(c: Column) -> Column:
    return band(c, words.BUDGET_TIERS)


def size_tier(c: Column) -> Column:
    return band(c, words.SIZE_TIERS)


def long_size_tier(c: Column) -> Column:
    return F.coalesce(band(c, words.LONG_SIZE_TIERS), F.lit("Unknown"))


def inr(c: Column) -> Column:
    """Short rupee text: ₹1.5Cr, ₹2.0L, ₹40K, ₹750."""
    return (F.when(c.isNull(), "—")
            .when(c >= 1e7, F.concat(F.lit("₹"), F.format_string("%.1f", c / 1e7), F.lit("Cr")))
            .when(c >= 1e5, F.concat(F.lit("₹"), F.format_string("%.1f", c / 1e5), F.lit("L")))
            .when(c >= 1e3, F.concat(F.lit("₹"), F.format_string("%.0f", c / 1e3), F.lit("K")))
            .otherwise(F.concat(F.lit("₹"), F.format_string("%.0f", c.cast("double")))))


def sorted_flags(*flags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))


def ago(at: Column, as_of: Column) -> Column:
    """Age of a moment in its largest whole unit: ``3d ago``, ``5h ago``, ``20m ago``, ``just now``, or ``never``."""
    passed = F.timestamp_diff("SECOND", at, as_of)
    text = F.lit("just now")
    for unit, size in (("m", 60), ("h", 3600), ("d", 86400)):
        text = F.when(passed >= size, F.concat(F.floor(passed / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(text)
    return F.when(at.isNull(), "never").otherwise(text)
