"""Shared inputs of the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.lines import split_lines
from plumbline.plans.detect import rlike


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Detectors over prose: (rule, category, severity, confidence, pattern). The patterns
# read the same in Java and RE2.
PROSE_RULES = [
    ("doc-secret", "A02:2021-Cryptographic Failures", "critical", "certain", 'token = "[0-9a-f]{40}"'),
    ("doc-card", "A02:2021-Cryptographic Failures", "high", "certain", "(^|[^0-9])[0-9]{16}([^0-9]|$)"),
    ("doc-address", "A05:2021-Security Misconfiguration", "medium", "likely", "[0-9]{1,3}([.][0-9]{1,3}){3}"),
    ("doc-mail", "A02:2021-Cryptographic Failures", "low", "likely", "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][A-Za-z.]+"),
    ("doc-markup", "A09:2021-Security Logging & Monitoring Failures", "info", "likely", "[*#%$&]{3}"),
]


def spread(scan: DataFrame) -> DataFrame:
    """A test table is one file and would be one task; deal its rows to all cores.

    Only for tables as they come from the reader: counting their splits runs nothing. A
    table of cluster size has more splits than cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.col("source").alias("project"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
    )


def prose_findings(files: DataFrame, rules=PROSE_RULES) -> DataFrame:
    """All prose detectors in one pass: the file decides first, then its lines."""
    gate = F.expr(" or ".join(rlike("content", r[4]) for r in rules))
    # The gate sits inside the generator, so it runs after small inputs are spread out.
    # Outer generators keep Spark from testing for emptiness first, which doubles the work.
    lines = (
        files
        .select("project", "path", "doc_id", F.posexplode_outer(F.when(gate, split_lines(F.col("content")))).alias("__pos", "text"))
        .where(F.col("__pos").isNotNull())
        .withColumn("line_no", F.col("__pos") + 1)
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("text").rlike(pattern),
                    F.struct(
                        F.lit(rule).alias("rule_id"),
                        F.lit(owasp).alias("owasp"),
                        F.lit(severity).alias("severity"),
                        F.lit(confidence).alias("confidence"),
                    ),
                )
                for rule, owasp, severity, confidence, pattern in rules
            ]
        )
    )
    found = lines.select("project", "path", "doc_id", "line_no", "text", F.explode_outer(hits).alias("h"))
    return found.where(F.col("h").isNotNull()).select(
        "project",
        F.col("path").alias("file"),
        "doc_id",
        F.col("line_no").alias("line"),
        T.snippet(F.col("text")).alias("snippet"),
        "h.*",
        F.col("h.rule_id").alias("title"),
    )


def files_sql(text: str = "text") -> str:
    return f"SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, {text} AS content, doc_id FROM documents"


def lines_sql(source: str, columns: str) -> str:
    """Lines of ``content`` with a 1-based ``line_no``."""
    return (
        f"SELECT {columns}, unnest(l) AS text, generate_subscripts(l, 1) AS line_no FROM "
        f"(SELECT {columns}, string_split_regex(content, '\\r?\\n') AS l FROM ({source}))"
    )


def prose_findings_sql(source: str | None = None, rules=PROSE_RULES) -> str:
    lines = lines_sql(source or files_sql(), "project, path, doc_id")
    values = ", ".join("('%s', '%s', '%s', '%s', '%s')" % r for r in rules)
    return (
        "SELECT l.project, l.path AS file, l.doc_id, l.line_no AS line, substr(trim(l.text), 1, 240) AS snippet, "
        "r.rule_id, r.owasp, r.severity, r.confidence, r.rule_id AS title "
        f"FROM ({lines}) l JOIN (VALUES {values}) r(rule_id, owasp, severity, confidence, pattern) "
        "ON regexp_matches(l.text, r.pattern)"
    )


SHORT_SQL = "substr(trim(regexp_replace(coalesce(snippet, ''), '\\s+', ' ', 'g')), 1, 100)"
FINGERPRINT_SQL = (
    f"rule_id || '::' || coalesce(file, '(no file)') || '::' || "
    f"CASE WHEN {SHORT_SQL} <> '' THEN {SHORT_SQL} ELSE 'L' || coalesce(line, 0) END"
)
WEIGHT_SQL = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0 END"
ORDER_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def band_sql(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 100 THEN 'biohazard' WHEN {score} >= 60 THEN 'very dirty' WHEN {score} >= 30 THEN 'filthy' "
        f"WHEN {score} >= 10 THEN 'dirty' WHEN {score} >= 1 THEN 'dusty' ELSE 'spotless' END"
    )


def counts_sql() -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info")
    )
