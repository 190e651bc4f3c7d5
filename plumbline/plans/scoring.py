"""Counts, weighted scores, bands, totals and rankings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import severity as S
from plumbline.functions import text as T
from plumbline.operators.ordered import first_per_group


def severity_count(severity: str, when: Column | None = None) -> Column:
    hit = F.col("severity") == severity
    return F.count(F.when(hit if when is None else hit & when, F.lit(1)))


def severity_counts(findings: DataFrame, by: str = "project") -> DataFrame:
    """Zero-filled counts per severity plus the weighted raw score, one aggregation."""
    return findings.groupBy(by).agg(
        *[severity_count(s).alias(s) for s in S.SEVERITIES],
        F.coalesce(F.sum(S.weight(F.col("severity"))), F.lit(0)).alias("raw"),
    )


def confidence_counts(findings: DataFrame, by: str = "project") -> DataFrame:
    """Counts split into certain and everything else; both halves add up to the total."""
    certain = F.coalesce(F.col("confidence") == "certain", F.lit(False))
    return findings.groupBy(by).agg(
        *[severity_count(s, certain).alias(f"certain_{s}") for s in S.SEVERITIES],
        *[severity_count(s, ~certain).alias(f"likely_{s}") for s in S.SEVERITIES],
    )


def banded(counts: DataFrame, gaps: DataFrame | None = None, by: str = "project") -> DataFrame:
    """score, label and the partial mark; gaps lower the confidence, never the score."""
    if gaps is None:
        joined = counts.withColumn("gap_count", F.lit(0).cast("long"))
    else:
        per = gaps.groupBy(by).agg(F.count("*").alias("gap_count"))
        joined = counts.join(per, by, "left").withColumn("gap_count", F.coalesce("gap_count", F.lit(0)))
    score = S.banded_score(F.col("raw"))
    partial = F.col("gap_count") > 0
    return joined.select(
        *counts.columns,
        score.alias("score"),
        partial.alias("partial"),
        F.concat(S.band_label(score), F.when(partial, F.lit(S.PARTIAL_SUFFIX)).otherwise(F.lit(""))).alias("label"),
    )


def portfolio(findings: DataFrame, by: str = "project") -> DataFrame:
    """Per-project rows and one grand total (``project`` null) from a single rollup."""
    return findings.rollup(by).agg(
        *[severity_count(s).alias(s) for s in S.SEVERITIES],
        F.coalesce(F.sum(S.weight(F.col("severity"))), F.lit(0)).alias("raw"),
        F.count_distinct(by).alias("projects"),
    )


def by_category(findings: DataFrame) -> DataFrame:
    """Counts in display order: category, then severity."""
    grouped = findings.groupBy("owasp", "severity").agg(F.count("*").alias("findings"))
    return grouped.select(
        "owasp",
        "severity",
        "findings",
        S.category_order(F.col("owasp")).cast("int").alias("category_ord"),
        S.order(F.col("severity")).alias("severity_ord"),
    ).orderBy("category_ord", "severity_ord")


def critical_gate(findings: DataFrame) -> DataFrame:
    """One row: does any project have a critical finding?"""
    return findings.agg(
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("blocked"),
        F.count_distinct(F.when(F.col("severity") == "critical", F.col("project"))).alias("critical_projects"),
    )


def top_findings(findings: DataFrame, k: int = 8, severities: list[str] | None = None) -> DataFrame:
    """First ``k`` findings per project by severity; ties by rule, file and line."""
    rows = findings if severities is None else findings.where(F.col("severity").isin(severities))
    ranked = rows.withColumn("ord", S.order(F.col("severity")))
    return first_per_group(ranked, ["project"], ["ord", "rule_id", "file", "line"], k)


def projects_by_score(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("raw"), "project")


def with_confidence(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The finding's own confidence, else its rule's, else likely."""
    dim = F.broadcast(rules.select("rule_id", F.col("confidence").alias("__rule")))
    return findings.join(dim, "rule_id", "left").withColumn(
        "confidence", F.coalesce("confidence", "__rule", F.lit("likely"))
    ).drop("__rule")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint", T.fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet"), F.col("line"))
    )


def triage_merge(findings: DataFrame, verdicts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Verdicts on high and critical findings: a low score turns them into low/likely."""
    scored = findings.join(verdicts.select("fingerprint", "score"), "fingerprint", "left")
    rejected = F.coalesce(F.col("severity").isin("critical", "high") & (F.col("score") < threshold), F.lit(False))
    marked = scored.withColumn("__low", rejected)
    return marked.withColumns(
        {
            "severity": F.when(F.col("__low"), F.lit("low")).otherwise(F.col("severity")),
            "confidence": F.when(F.col("__low"), F.lit("likely")).otherwise(F.col("confidence")),
        }
    ).drop("__low")
