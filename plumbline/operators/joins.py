"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    ways: int = 16,
) -> DataFrame:
    """Equi-join where ``big`` may have hot keys and ``small`` is one row (or few) per key.

    Each row of ``big`` gets one of ``ways`` salts from ``spread_by``; ``small`` is
    repeated once per salt. A hot key is therefore split over ``ways`` tasks and the
    result is the same as the plain join. Valid for inner, left, semi and anti.
    No side is broadcast by hand: Spark does so itself when its measured size allows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot run a {how} join")
    cols = list(spread_by) or [c for c in big.columns if c not in keys]
    left = big.withColumn(SALT, F.pmod(F.xxhash64(*cols), F.lit(ways)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [*keys, SALT], how).drop(SALT)


def distinct_keys(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Distinct projection; partial aggregation keeps a hot value to one row per task."""
    return df.select(*cols).distinct()
