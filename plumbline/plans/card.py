"""Report card: one row per project from findings, beats and link health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import severity as S
from plumbline.operators.ordered import first_per_group
from plumbline.plans import heartbeats, scoring

HIGHLIGHTS = 8


def highlights(findings: DataFrame, k: int = HIGHLIGHTS) -> DataFrame:
    """The card's short list: first ``k`` of critical, high and medium."""
    return scoring.top_findings(findings, k, ["critical", "high", "medium"])


def report_card(
    findings: DataFrame, beats: DataFrame | None, links: DataFrame | None, now: Column, gaps: DataFrame | None = None
) -> DataFrame:
    """score, counts, leading findings, heartbeat and link health by project.

    ``links(project, url, pagerank, orphan)``. Every side is reduced to one row per
    project before it is joined.
    """
    card = scoring.banded(scoring.severity_counts(findings), gaps)
    lead = highlights(findings).groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct(S.order(F.col("severity")).alias("ord"), "rule_id", "file", "line"))).alias("__lead")
    )
    card = card.join(
        lead.select("project", F.transform("__lead", lambda x: x["rule_id"]).alias("highlights")), "project", "left"
    )
    if beats is not None:
        card = card.join(heartbeats.last_status(beats, now), "project", "left")
    if links is not None:
        health = links.groupBy("project").agg(
            F.count("*").alias("link_pages"), F.sum(F.col("orphan").cast("long")).alias("orphan_pages")
        )
        best = first_per_group(links, ["project"], [F.desc("pagerank"), "url"], 3)
        top = best.groupBy("project").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("pagerank")).alias("r"), F.col("url")))).alias("__top")
        )
        card = card.join(health, "project", "left").join(
            top.select("project", F.transform("__top", lambda x: x["url"]).alias("top_pages")), "project", "left"
        )
    return card
