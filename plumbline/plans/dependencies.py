"""Deprecated and far outdated packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.history import major, majors_behind

# Packages whose maintainers have declared them deprecated; callers may pass their own.
DEPRECATED = ["request", "node-sass", "tslint", "moment", "querystring", "request-promise", "left-pad", "gulp-util"]
FAR_BEHIND = 2


def dependency_health(deps: DataFrame, deprecated: list[str] | None = None) -> DataFrame:
    """``deps(project, name, declared, current, latest, dev)`` to low/likely findings."""
    names = DEPRECATED if deprecated is None else deprecated
    behind = majors_behind(F.col("current"), F.col("declared"), F.col("latest"))
    reason = F.when(F.col("name").isin(names), F.lit("deprecated")).when(
        F.col("__behind") >= FAR_BEHIND, F.lit("majors-behind")
    )
    return (
        deps.withColumn("__behind", behind)
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(
            "project",
            "name",
            "reason",
            F.coalesce(major(F.col("current")), major(F.col("declared"))).alias("current_major"),
            F.col("__behind").alias("behind"),
            F.lit("low").alias("severity"),
            F.lit("likely").alias("confidence"),
        )
    )
