"""Names and handles.

Only compatibility folding and transliteration need Python's Unicode tables; they run as two small Arrow functions.
Every other rule is a Spark expression, applied in steps so that no expression is repeated.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rosterlake.functions.steps import once, step
from rosterlake.functions.values import sorted_flags, strip
from rosterlake.vocab import words

HANDLE_AT_END = r"(?:^|\s)@([A-Za-z0-9._\-]+)\s*$"
INVISIBLE = r"︎️ㅤᅟᅠﾠ​‌‍⁠"
WORD_CHAR = rf"[\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}&&[^{INVISIBLE}]]"
SYMBOL = rf"[^\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}} .'&\-()|:_]|[{INVISIBLE}]"
READABLE = (r"[\p{L}&&[\u0000-ɏ؀-ۿऀ-෿぀-ヿ一-鿿]]|\p{Nd}")
HASHTAG = r"#[\p{L}\p{N}_]+"
SPACED_LETTERS = r"^[^ _](?:[ _]+[^ _]){2,}$"
NAME_NOISE = r"\b(official|offl|offical|officiel|real|the|iam|im|channel)\b"
HANDLE_NOISE = "official|offl|offical|real|iam|tiktok"
CHANNEL_ID = r"^UC[A-Za-z0-9_\-]{22}$"
BRAND = r"(?iU)\b(" + "|".join(re.escape(w) for w in words.BRAND_WORDS) + r")\b"


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility folding of decorative letters."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@lru_cache(maxsize=65536)
def _ascii_letter(ch: str) -> str:
    """ASCII reading of one character: its base letter, or for Indic scripts the sound in its Unicode name."""
    base = "".join(c for c in unicodedata.normalize("NFKD", ch) if c.isascii())
    if base:
        return base
    name = unicodedata.name(ch, "")
    if unicodedata.decimal(ch, None) is not None:
        return str(unicodedata.decimal(ch))
    if " VOWEL SIGN " in name:
        return name.rsplit(" ", 1)[1].lower()
    if " LETTER " in name and 0x0900 <= ord(ch) <= 0x0DFF:
        sound = name.rsplit(" ", 1)[1].lower()
        return sound[:-1] if len(sound) > 1 and sound.endswith("a") and set(sound) != {"a"} else sound
    if name.endswith(("SIGN ANUSVARA", "SIGN CANDRABINDU", "TIPPI", "SIGN BINDI")):
        return "n"
    return "h" if name.endswith("SIGN VISARGA") else ""


@F.pandas_udf(StringType())
def transliterate(text: pd.Series) -> pd.Series:
    """Lower-case ASCII reading of a text."""
    def read(s):
        if s is None:
            return None
        return (s if s.isascii() else "".join(c if c.isascii() else _ascii_letter(c) for c in s)).lower()
    return text.map(read)


def split_name_handle(c: Column) -> tuple[Column, Column]:
    """``Name @handle`` as its name and the handle at the end (null when there is none)."""
    text = F.coalesce(strip(c), F.lit(""))
    handle = F.nullif(F.regexp_extract(text, HANDLE_AT_END, 1), F.lit(""))
    return strip(F.regexp_replace(text, HANDLE_AT_END, "")), handle


def is_channel_id(c: Column) -> Column:
    return F.coalesce(c.rlike(CHANNEL_ID), F.lit(False))


def _recase(word: Column) -> Column:
    short_upper = word.rlike("[A-Z]") & ~word.rlike("[a-z]") & (F.length(word) <= 3)
    recased = F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))
    return F.when(word.rlike(r"[^\x00-\x7F]") | short_upper, word).otherwise(recased)


def with_display_name(df: DataFrame, src: str, out: str, flags: str) -> DataFrame:
    """Add a readable display name and the list of what was changed."""
    c = F.col
    made = df.withColumn("_folded", F.coalesce(fold(c(src)), F.lit("")))
    unmarked = F.ltrim(F.regexp_replace("_folded", HASHTAG, " "), F.lit("@"))
    made = step(made, _marked=F.replace(unmarked, F.lit("’"), F.lit("'")), _tagged=c("_folded").rlike(HASHTAG),
                _refolded=c("_folded") != F.coalesce(c(src), F.lit("")))
    made = step(made, _bare=F.regexp_replace("_marked", SYMBOL, " "), _symbols=c("_marked").rlike(SYMBOL))
    made = step(made, _kept=F.btrim(F.regexp_replace("_bare", r"\s+", " "), F.lit(" .-|:_")))
    made = step(made, _spaced=c("_kept").rlike(SPACED_LETTERS))
    made = step(made, _joined=F.when(c("_spaced"), F.regexp_replace("_kept", "[ _]+", "")).otherwise(
        F.trim(F.regexp_replace("_kept", "_+", " "))))
    tokens = F.filter(F.split("_joined", " "), lambda t: t.isin("&", "|", "-") | t.rlike(WORD_CHAR))
    made = step(made, _tidy=F.btrim(F.regexp_replace(F.array_join(tokens, " "), r"\(\s*\)", ""), F.lit(" .-|:")))
    made = step(made, _unreadable=(c("_tidy") != "") & ~c("_tidy").rlike(READABLE), _latin=F.regexp_replace("_tidy", "[^A-Za-z]", ""))
    made = step(made, _one_case=~c("_unreadable") & (F.length("_latin") > 3) & (
        (c("_latin") == F.upper("_latin")) | (c("_latin") == F.lower("_latin"))))
    recased = F.array_join(F.transform(F.split("_tidy", " "), _recase), " ")
    changes = sorted_flags(
        F.when(c("_refolded"), "name_unicode_folded"), F.when(c("_tagged"), "name_hashtags_removed"),
        F.when(c("_symbols"), "name_symbols_removed"), F.when(c("_spaced"), "name_spaced_letters_joined"),
        F.when(c("_unreadable"), "name_unreadable"), F.when(c("_one_case"), "name_case_fixed"),
        F.when(~c("_unreadable") & c("_tidy").rlike(r"[\p{L}&&[^\x00-\x7F]]"), "name_non_latin_script"))
    made = once(made, **{out: F.when(c("_unreadable"), "").when(c("_one_case"), recased).otherwise(c("_tidy")), flags: changes})
    return made.drop("_folded", "_marked", "_tagged", "_refolded", "_bare", "_symbols", "_kept", "_spaced", "_joined", "_tidy",
                     "_unreadable", "_latin", "_one_case")


def name_key(reading: Column) -> Column:
    """Matching key from a transliterated name."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(reading, F.lit("")), NAME_NOISE, " "), "[^a-z0-9]", "")


def handle_core(c: Column) -> Column:
    """The part of a handle that identifies its owner."""
    text = F.ltrim(F.lower(F.coalesce(c, F.lit(""))), F.lit("@"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HANDLE_NOISE, ""), r"[._\-]", ""), r"\d+$", "")


def entity_guess(name: Column) -> Column:
    """Struct ``(type, reason)``: a person, or a brand, label, channel or team."""
    text = F.coalesce(name, F.lit(""))
    word = F.nullif(F.lower(F.regexp_extract(text, BRAND, 1)), F.lit(""))
    suffix = strip(text).rlike(r"(?iU)\b(india|official)$") & strip(text).rlike(r"\S\s+\S")
    reason = F.when(word.isNotNull(), F.concat(F.lit("name contains '"), word, F.lit("'"))).when(
        suffix, "name ends with 'India'/'Official'")
    return F.struct(F.when(reason.isNotNull(), "brand_media").otherwise("person").alias("type"), reason.alias("reason"))
