"""Indel similarity of string pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rosterlake.functions.letters import common_subsequences


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """``200 * LCS / (|a| + |b|)``."""
    if a == b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def _ratios(left: pd.Series, right: pd.Series, both_needed: bool) -> np.ndarray:
    """``ratio`` of every pair; two equal texts are worked out like any others, as they come to 100 as well."""
    a, b = left.fillna("").tolist(), right.fillna("").tolist()
    letters = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    found = 200.0 * common_subsequences(a, b, common_subsequence) / np.maximum(letters, 1)
    absent = np.fromiter((not (x and y) for x, y in zip(a, b)), bool, len(a))
    return np.where(absent, 0.0, found) if both_needed else np.where(letters == 0, 100.0, found)


SIMILARITIES = StructType([StructField(n, DoubleType()) for n in ("handle_sim", "name_sim", "cross_sim")])


@F.pandas_udf(SIMILARITIES)
def pair_similarity(core_a: pd.Series, core_b: pd.Series, key_a: pd.Series, key_b: pd.Series,
                    words_a: pd.Series, words_b: pd.Series) -> pd.DataFrame:
    """Similarities of two accounts: handles, names (sorted words or keys), and name against the other's handle."""
    name = np.maximum(_ratios(words_a, words_b, False), _ratios(key_a, key_b, True))
    cross = np.maximum(_ratios(key_a, core_b, True), _ratios(key_b, core_a, True))
    return pd.DataFrame({"handle_sim": _ratios(core_a, core_b, True), "name_sim": name, "cross_sim": cross})
