"""Ordered look-back without putting a whole key into one task.

``lag`` and ``last(ignorenulls)`` over a key sort that key inside a single task.
Both are split here into blocks of the ordering column: the inner window runs per
(key, block) and the value that enters a block comes from a small table with one
row per (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def with_block(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn(BLOCK, block)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column, out: str
) -> DataFrame:
    """``out`` = ``value`` of the row before, in ``order``, within ``keys``.

    ``block`` must be monotone in the first ordering column. A block boundary is
    bridged with the last value of the nearest earlier block.
    """
    keys = list(keys)
    blocked = with_block(df, block)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = blocked.withColumn("__prev", F.lag(value).over(inner)).withColumn(
        "__first", F.row_number().over(inner) == 1
    )
    edge = F.max(F.struct(*[F.col(c) for c in order], F.col(value).alias("__v")))
    summary = blocked.groupBy(*keys, BLOCK).agg(edge.alias("__edge"))
    carried = summary.withColumn(
        "__carry", F.lag("__edge.__v").over(Window.partitionBy(*keys).orderBy(BLOCK))
    ).select(*keys, BLOCK, "__carry")
    joined = local.join(carried, [*keys, BLOCK], "left")
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))).drop(
        "__prev", "__first", "__carry", BLOCK
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, marks: dict[str, Column], block_rows: int = 100_000
) -> DataFrame:
    """For each ``out -> mark`` pair: the latest non-null mark at or before the row."""
    keys = list(keys)
    marked = df.select("*", *[m.alias(f"__m_{n}") for n, m in marks.items()])
    blocked = with_block(marked, F.floor(F.col(order) / F.lit(block_rows)))
    inner = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(
        "*", *[F.last(f"__m_{n}", ignorenulls=True).over(inner).alias(f"__l_{n}") for n in marks]
    )
    summary = blocked.groupBy(*keys, BLOCK).agg(
        *[
            F.max(F.when(F.col(f"__m_{n}").isNotNull(), F.struct(F.col(order), F.col(f"__m_{n}").alias("v")))).alias(
                f"__e_{n}"
            )
            for n in marks
        ]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, BLOCK, *[F.last(F.col(f"__e_{n}.v"), ignorenulls=True).over(before).alias(f"__c_{n}") for n in marks]
    )
    joined = local.join(carried, [*keys, BLOCK], "left")
    kept = [c for c in df.columns]
    return joined.select(
        *kept, *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in marks]
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per group.

    The ``row_number <= k`` shape lets Spark keep only k rows per group and map
    task before the shuffle (WindowGroupLimit), so a hot group stays small.
    """
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") <= k).drop("__rn")
