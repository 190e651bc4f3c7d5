"""Orphan rows: child keys without a parent row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "invariant string, relation string, severity string, orphans bigint"
MANY = 50


@dataclass(frozen=True)
class Relation:
    table: str
    column: str
    parent: str
    parent_column: str = "id"

    @property
    def label(self) -> str:
        return f"{self.table}.{self.column} -> {self.parent}.{self.parent_column}"


def orphan_count(child: DataFrame, parent: DataFrame, rel: Relation) -> DataFrame:
    """Orphans of one relation.

    The child is counted per key before the join, so a hot key is one row and the
    anti join moves distinct keys only.
    """
    keys = (
        child.where(F.col(rel.column).isNotNull())
        .groupBy(F.col(rel.column).alias("__key"))
        .agg(F.count("*").alias("__n"))
    )
    parents = parent.select(F.col(rel.parent_column).alias("__key"))
    return keys.join(parents, "__key", "left_anti").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("orphans")
    )


def orphan_invariants(
    spark: SparkSession, tables: Mapping[str, DataFrame | None], relations: Iterable[Relation]
) -> DataFrame:
    """One row per broken relation; one clean row when all were read and none is broken.

    A table that is missing is a finding of its own: nothing was measured there.
    """
    parts, missing, looked = [], [], 0
    for rel in relations:
        child, parent = tables.get(rel.table), tables.get(rel.parent)
        if child is None or parent is None:
            missing.append(("table-missing", rel.label, "high", None))
            continue
        looked += 1
        parts.append(orphan_count(child, parent, rel).select(F.lit(rel.label).alias("relation"), "orphans"))
    out = spark.createDataFrame(missing, SCHEMA) if missing else None
    if parts:
        counts = reduce(DataFrame.unionByName, parts)
        broken = counts.where(F.col("orphans") > 0).select(
            F.lit("orphan-rows").alias("invariant"),
            "relation",
            F.when(F.col("orphans") > MANY, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
            "orphans",
        )
        clean = (
            counts.agg(F.sum("orphans").alias("orphans"))
            .where(F.col("orphans") == 0)
            .select(
                F.lit("orphan-rows").alias("invariant"),
                F.lit(f"{looked} relations clean").alias("relation"),
                F.lit("low").alias("severity"),
                F.col("orphans").cast("bigint").alias("orphans"),
            )
        )
        found = broken.unionByName(clean)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)
