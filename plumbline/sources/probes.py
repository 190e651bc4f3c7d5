"""Stored HTTP responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_probes(raw: DataFrame) -> DataFrame:
    """Header names lower-cased, bodies whole, failed requests kept with ``ok=false``."""
    ok = F.coalesce(F.col("ok"), F.col("error").isNull())
    return raw.select(
        *[c for c in raw.columns if c not in ("headers", "body", "ok")],
        F.transform_keys(
            F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)
        ).alias("headers"),
        F.coalesce(F.col("body"), F.lit("")).alias("body"),
        ok.alias("ok"),
    )


def live_gate(probes: DataFrame, projects: DataFrame) -> DataFrame:
    """Only projects that are owned and have a url are looked at."""
    allowed = projects.where(F.col("owned") & F.col("url").isNotNull()).select(F.col("name").alias("project"))
    return probes.join(allowed.distinct(), "project", "left_semi")
