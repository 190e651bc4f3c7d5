"""Severity scale, weights, banded score and report levels as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity scale with weight, rank, report level and report score.
SEVERITY_ROWS = [
    ("critical", 10, 0, "error", "9.0"),
    ("high", 6, 1, "error", "7.5"),
    ("medium", 3, 2, "warning", "5.0"),
    ("low", 1, 3, "note", "2.5"),
    ("info", 0, 4, "note", "0.0"),
]
SEVERITIES = [row[0] for row in SEVERITY_ROWS]

# Lower edge of each score band and its label.
BANDS = [
    (0, "spotless"),
    (1, "dusty"),
    (10, "dirty"),
    (30, "filthy"),
    (60, "very dirty"),
    (100, "biohazard"),
]
PARTIAL_SUFFIX = " (partial measurement)"
SCORE_FACTOR = 2

# Report categories in display order.
CATEGORIES = [
    "A01:2021-Broken Access Control",
    "A02:2021-Cryptographic Failures",
    "A03:2021-Injection",
    "A04:2021-Insecure Design",
    "A05:2021-Security Misconfiguration",
    "A06:2021-Vulnerable & Outdated Components",
    "A07:2021-Identification & Authentication Failures",
    "A08:2021-Software & Data Integrity Failures",
    "A09:2021-Security Logging & Monitoring Failures",
    "A10:2021-Server-Side Request Forgery",
]


def severity_dim(spark: SparkSession) -> DataFrame:
    """Five rows, fixed by definition, hence safe to broadcast."""
    return spark.createDataFrame(
        SEVERITY_ROWS, "severity string, weight int, ord int, sarif_level string, security_severity string"
    )


def _lookup(severity: Column, position: int, kind: str) -> Column:
    expr = F.lit(None).cast(kind)
    for row in reversed(SEVERITY_ROWS):
        expr = F.when(severity == row[0], F.lit(row[position])).otherwise(expr)
    return expr


def weight(severity: Column) -> Column:
    return _lookup(severity, 1, "int")


def order(severity: Column) -> Column:
    return _lookup(severity, 2, "int")


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, 3, "string")


def security_severity(severity: Column) -> Column:
    return _lookup(severity, 4, "string")


def category_order(owasp: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), owasp)


def banded_score(raw: Column) -> Column:
    return F.least(F.lit(100), raw * SCORE_FACTOR)


def band_label(score: Column) -> Column:
    expr = F.lit(BANDS[0][1])
    for edge, label in BANDS[1:]:
        expr = F.when(score >= edge, F.lit(label)).otherwise(expr)
    return expr
