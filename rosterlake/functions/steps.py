"""Intermediate columns of long cleaning chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as one projection."""
    return df.withColumns(columns)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add the results of a chain so that later steps use them without evaluating the chain again.

    Between two Python functions Spark copies the expressions of every projection into each use, and a filter on a
    result is pushed back through the whole chain; a few steps later both grow exponentially. A one-row ``inline`` keeps
    the two sides apart. It also stops column pruning, so it belongs at the end of a chain, not between its steps.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
