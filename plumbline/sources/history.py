"""Commit logs, diffs and dependency manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import carry_forward


def read_commits(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(hash8, body) from a log whose entries start with ``separator`` and a hash line."""
    entries = spark.read.text(path, lineSep=separator)
    return split_commits(entries, "value")


def split_commits(entries: DataFrame, column: str) -> DataFrame:
    others = [c for c in entries.columns if c != column]
    return (
        entries.where(F.col(column).contains("\n"))
        .select(
            *others,
            F.substring(F.trim(F.substring_index(column, "\n", 1)), 1, 8).alias("hash"),
            F.expr(f"substring({column}, instr({column}, '\n') + 1)").alias("body"),
        )
        .where(F.col("hash") != "")
    )


def added_lines(diff: DataFrame) -> DataFrame:
    """Added lines of unified diffs with the commit and file they belong to.

    ``diff(diff_id, line_no, text)``. The headers are carried down block by block,
    so one huge diff does not end up in one task.
    """
    commit = F.when(F.col("text").rlike("^commit "), F.regexp_extract("text", "^commit (\\S+)", 1))
    file = F.when(F.col("text").startswith("+++ b/"), F.substring(F.col("text"), F.lit(7), F.char_length("text")))
    carried = carry_forward(diff, ["diff_id"], "line_no", {"commit": commit, "file": file})
    return carried.where(F.col("text").startswith("+") & ~F.col("text").startswith("+++")).select(
        "diff_id", "line_no", "commit", "file", F.expr("substring(text, 2)").alias("added")
    )


def manifest_deps(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies of every package.json as rows."""
    manifests = files.where(F.col("path") == "package.json")

    def section(name: str, dev: bool) -> DataFrame:
        deps = F.from_json(F.get_json_object("content", f"$.{name}"), "map<string,string>")
        return manifests.select("project", F.explode(deps).alias("name", "range")).withColumn("dev", F.lit(dev))

    return section("dependencies", False).unionByName(section("devDependencies", True))


def major(version: Column) -> Column:
    return F.regexp_extract(version, "(\\d+)", 1).try_cast("int")


def majors_behind(current: Column, declared: Column, latest: Column) -> Column:
    """Major versions behind; null when the latest version is not a number."""
    newest = F.when(latest.rlike("^[v=^~\\s]*\\d"), major(latest))
    return newest - F.coalesce(major(current), major(declared))
