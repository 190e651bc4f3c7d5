"""Findings in commit messages and in lines added by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import entropy as E
from plumbline.functions import text as T
from plumbline.operators.ordered import first_per_group
from plumbline.plans import crossfile as X
from plumbline.sources.history import added_lines

FEW = 3


def commit_addresses(commits: DataFrame) -> DataFrame:
    """(project, hash, address): distinct street addresses per commit body."""
    found = F.regexp_extract_all("body", F.lit(X.ADDRESS), F.lit(0))
    return commits.where(F.col("body").rlike(X.ADDRESS)).select(
        "project", "hash", F.explode(F.array_distinct(found)).alias("address")
    ).distinct()


def commit_message_findings(commits: DataFrame, few: int = FEW) -> DataFrame:
    """One finding per project with at least ``few`` distinct addresses over all commits."""
    addresses = commit_addresses(commits)
    per = addresses.groupBy("project").agg(F.count_distinct("address").alias("n")).where(F.col("n") >= few)
    first = first_per_group(addresses.select("project", "hash").distinct(), ["project"], ["hash"], 3)
    shown = first.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("hash")), ", ").alias("text"))
    rows = per.join(shown, "project").select(
        "project",
        F.concat(F.lit("commit "), F.substring_index("text", ",", 1)).alias("path"),
        F.lit(1).alias("line"),
        F.col("text"),
    )
    return X.finding(rows, "a02-pii-in-commit-messages")


HISTORY_SECRET = r"(?i)\b[\w.-]*(?:secret|token|password|api[_-]?key)[\w.-]*\s*[:=]\s*[\"'`]([A-Za-z0-9+/_=.-]{12,})[\"'`]"
ENV_VALUE = r"^[A-Z0-9_]+\s*=\s*[^\s#]{6,}"


def history_secrets(diff: DataFrame) -> DataFrame:
    """Secret literals and environment files among added lines; expressions do not count.

    ``line`` has the type of ``line_no``: places in a table of diffs can pass the range of an int.
    """
    added = added_lines(diff).where(F.col("file").isNotNull())
    production = added.where(
        ~T.is_test_path(F.col("file")) & ~F.col("file").rlike("(?i)[.](md|mdx|txt|rst)$|[.](example|sample|template)$")
    )
    env = F.col("file").rlike(r"(^|/)\.env[^/]*$")
    provider = F.col("added").rlike(X.PROVIDER_KEY)
    value = F.regexp_extract("added", HISTORY_SECRET, 1)
    mixed = (value != "") & value.rlike("[0-9]") & ~value.rlike(X.PLACEHOLDER) & (E.shannon_entropy(value) >= 3.0)
    name = (
        F.when(env & F.col("added").rlike(ENV_VALUE) & ~F.col("added").rlike("(?i)your-|example|changeme"), F.lit("committed environment file"))
        .when(provider, F.lit("provider key"))
        .when(mixed, F.lit("secret literal"))
    )
    return production.withColumn("name", name).where(F.col("name").isNotNull()).select(
        F.col("diff_id").alias("project"),
        F.lit("a02-secrets-git-history").alias("rule_id"),
        "file",
        F.col("line_no").alias("line"),
        F.concat_ws(" ", F.lit("commit"), F.substring("commit", 1, 8)).alias("snippet"),
        F.lit("high").alias("severity"),
        F.when(F.col("name") == "secret literal", F.lit("likely")).otherwise(F.lit("certain")).alias("confidence"),
        F.col("name").alias("note"),
    )
