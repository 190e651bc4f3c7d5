"""Labels, recall manifests, snapshots, rank tables and interchange output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import severity as S

LABEL_SCHEMA = "fingerprint string, verdict string, rule string, file string, line int, snippet string, note string"
MANIFEST_SCHEMA = "file string, rule_id string, note string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Range-sorted by key: stable files without gathering rows in one task."""
    labels.orderBy("fingerprint").write.mode("overwrite").parquet(path)


def read_recall_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An empty manifest is an error: recall over nothing is not zero percent."""
    entries = spark.read.schema(MANIFEST_SCHEMA).json(path)
    if entries.limit(1).count() == 0:
        raise ValueError("the recall manifest is empty: recall cannot be measured")
    return entries


def write_snapshot(spark: SparkSession, path: str, snapshot_id: str, tables: dict[str, DataFrame]) -> None:
    """findings, digests, gaps and scores under ``path/<table>/snapshot_id=<id>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")


def read_snapshot(spark: SparkSession, path: str, table: str, snapshot_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}")
    return df if snapshot_id is None else df.where(F.col("snapshot_id") == snapshot_id)


def write_report_json(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def read_rank_csv(spark: SparkSession, path: str) -> DataFrame:
    """url, pagerank, in-links, orphan; a byte-order mark before the first name is dropped."""
    raw = spark.read.csv(path, header=True)
    clean = raw.toDF(*[c.replace("﻿", "") for c in raw.columns])
    links = "ic_giris" if "ic_giris" in clean.columns else "in_links"
    return clean.select(
        "url",
        F.col("pagerank").cast("double").alias("pagerank"),
        F.col(links).cast("long").alias("in_links"),
        (F.coalesce(F.col("orphan"), F.lit("")) == "EVET").alias("orphan"),
    )


def read_suggestion_csv(spark: SparkSession, path: str) -> DataFrame:
    """Link suggestions made elsewhere; the columns are renamed by position."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF("source_url", "target_url", "sentence", "anchor", "score", "similarity")


def sarif_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule that fired, once, as a SARIF rule object."""
    fired = findings.select("rule_id").distinct()
    dim = rules.join(fired, "rule_id", "left_semi")
    help_uri = F.concat(
        F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace("cwe", "CWE-", ""), F.lit(".html")
    )
    return dim.select(
        "rule_id",
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"),
                F.col("rule_id").alias("name"),
                F.struct(F.col("title").alias("text")).alias("shortDescription"),
                help_uri.alias("helpUri"),
                F.struct(
                    F.array("owasp").alias("tags"),
                    S.security_severity(F.col("severity")).alias("security-severity"),
                    F.col("confidence").alias("precision"),
                ).alias("properties"),
            )
        ).alias("rule"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding; findings without a file have no location."""
    region = F.when(F.coalesce(F.col("line"), F.lit(0)) > 0, F.struct(F.col("line").alias("startLine")))
    location = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")
        ).alias("physicalLocation")
    )
    shown = F.coalesce(F.col("snippet"), F.lit("")) != ""
    message = F.when(shown, F.concat_ws(" - ", "title", "snippet")).otherwise(F.col("title"))
    return findings.select(
        "project",
        "rule_id",
        F.col("file"),
        F.col("line"),
        S.sarif_level(F.col("severity")).alias("level"),
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                S.sarif_level(F.col("severity")).alias("level"),
                F.struct(message.alias("text")).alias("message"),
                F.when(F.col("file").isNotNull(), F.array(location)).otherwise(
                    F.array().cast(
                        "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
                        "region:struct<startLine:int>>>>"
                    )
                ).alias("locations"),
                F.struct("severity", "confidence", "project").alias("properties"),
            )
        ).alias("result"),
    )


def write_sarif(findings: DataFrame, rules: DataFrame, path: str) -> None:
    """Rules and results as JSON lines: one row each, so no run is gathered in one task."""
    sarif_rules(findings, rules).select("rule").write.mode("overwrite").text(f"{path}/rules")
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/results")
