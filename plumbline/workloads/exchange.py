"""Queries of what goes through files: registry, headers, ranks, snapshots, labels, manifests.

Each writes rows that Spark derives from the given tables into the shared folder in the format
of the reader under test, reads them back and returns what was read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans import audit, links, scoring
from plumbline.plans import rules as R
from plumbline.session import checkpoint_dir
from plumbline.sources import corpus, registry, reports
from plumbline.workloads import common as C
from plumbline.workloads import measure as M
from plumbline.workloads import operations as O
from plumbline.workloads.common import Query, table
from plumbline.workloads.seed import quote as q


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def registry_projects(spark: SparkSession, d: str) -> DataFrame:
    """A registry file for every thousand customers; owned is the word true, the text "true" or absent."""
    c = table(spark, d, "customer")
    kind = F.pmod("c_custkey", F.lit(3))
    owned = F.when(kind == 0, F.lit(',"owned": true')).when(kind == 1, F.lit(',"owned": "true"')).otherwise(F.lit(""))
    entry = F.concat(F.lit('{"name":"'), "c_name", F.lit('","path":"/srv/'), F.col("c_custkey").cast("string"), F.lit('"'), owned, F.lit("}"))
    files = c.groupBy(F.floor(F.col("c_custkey") / 1000).alias("file")).agg(F.concat_ws(",", F.collect_list(entry)).alias("entries"))  # a thousand at most
    path = _place(spark, "registry")
    whole = files.select("file", F.concat(F.lit('{"projects":['), "entries", F.lit("]}")).alias("value"))
    whole.repartition("file").write.partitionBy("file").text(path)
    found, _ = registry.read_registry(spark, path)
    return found.select("name", "path", "owned")


def header_columns(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tables: a header line of three kinds of file in front of the text."""
    kind = F.pmod("doc_id", F.lit(3))
    ident = F.col("doc_id").cast("string")
    head = (
        F.when(kind == 0, F.concat(F.lit('"id", "n'), ident, F.lit('",lang,')))
        .when(kind == 1, F.concat(F.lit("id\tn"), ident, F.lit("\t'lang'")))
        .otherwise(F.concat(F.lit('\n  {"id": 1, "n'), ident, F.lit('": {"lang": 2}}')))
    )
    files = table(spark, d, "documents").select(
        F.concat(ident, F.when(kind == 0, ".csv").when(kind == 1, ".tsv").otherwise(".jsonl")).alias("path"),
        F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"),
    )
    names = F.when(F.col("path").endswith(".jsonl"), corpus.jsonl_keys(F.col("content"))).otherwise(corpus.csv_header(F.col("content"), F.col("path")))
    return files.select("path", F.array_join(names, "|").alias("columns"))


HEADER_SQL = """
SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.tsv' ELSE '.jsonl' END AS path,
       CASE doc_id % 3 WHEN 2 THEN 'id|n' || doc_id ELSE 'id|n' || doc_id || '|lang' END AS columns FROM documents
"""


def rank_file(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all pages in the format of the exported table, byte-order mark included."""
    ranks = links.link_health(table(spark, d, "pages"), O.ROUNDS)
    path = _place(spark, "ranks")
    ranks.select(
        F.col("url").alias("﻿url"), F.round("pagerank", 9).alias("pagerank"), F.col("in_links").alias("ic_giris"),
        F.when(F.col("orphan"), F.lit("EVET")).otherwise(F.lit("")).alias("orphan"),
    ).write.csv(path, header=True, quoteAll=True, escape='"')
    return reports.read_rank_csv(spark, path).select("url", "pagerank", "in_links", "orphan")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the findings side by side; both are read, each by its id."""
    found = C.prose_findings(C.documents_as_files(spark, d)).select("project", "rule_id", "file", "line", "severity")
    path = _place(spark, "snapshots")
    for name, rows in (("first", found.where("severity <> 'low'")), ("second", found)):
        reports.write_snapshot(spark, path, name, {"findings": rows})
    read = [reports.read_snapshot(spark, path, "findings", name) for name in ("first", "second")]
    return read[0].unionByName(read[1]).groupBy("snapshot_id", "project", "rule_id").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


SNAPSHOT_SQL = f"""
WITH f AS ({M.FIND})
SELECT s.snapshot_id, project, rule_id, count(*) AS n, min(line) AS first_line
FROM f JOIN (VALUES ('first'), ('second')) s(snapshot_id) ON s.snapshot_id = 'second' OR severity <> 'low' GROUP BY ALL
"""


def label_file(spark: SparkSession, d: str) -> DataFrame:
    """A label per finding, written in order and read back with its schema."""
    found = scoring.with_fingerprint(C.prose_findings(C.documents_as_files(spark, d)))
    labels = found.groupBy("fingerprint").agg(F.min("rule_id").alias("rule"), F.min("file").alias("file"), F.min("line").cast("int").alias("line"), F.min("snippet").alias("snippet"))
    verdict = F.when(F.pmod(F.length("fingerprint"), F.lit(2)) == 0, "tp").otherwise("fp")
    path = _place(spark, "labels")
    reports.write_labels(labels.select("fingerprint", verdict.alias("verdict"), "rule", "file", "line", "snippet", F.lit("").alias("note")), path)
    return reports.read_labels(spark, path).select("fingerprint", "verdict", "rule", "file", "line", "snippet")


LABEL_FILE_SQL = f"""
WITH f AS (SELECT *, {C.FINGERPRINT_SQL} AS fingerprint FROM ({M.FIND}))
SELECT fingerprint, CASE WHEN length(fingerprint) % 2 = 0 THEN 'tp' ELSE 'fp' END AS verdict, min(rule_id) AS rule, min(file) AS file,
       CAST(min(line) AS INTEGER) AS line, min(snippet) AS snippet FROM f GROUP BY fingerprint
"""


def recall_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of what is known to be in each document, as lines of JSON."""
    known = table(spark, d, "labels").where("quality = 0")
    path = _place(spark, "manifest")
    known.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.when(F.col("toxic") == 1, "toxic").otherwise("poor").alias("rule_id"), F.lit("labelled").alias("note")).write.json(path)
    return reports.read_recall_manifest(spark, path)


MANIFEST_SQL = "SELECT 'doc/' || doc_id AS file, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS rule_id, 'labelled' AS note FROM labels WHERE quality = 0"

_PAGE_PATH = "(CASE page_id % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'src/app' WHEN 2 THEN 'pages/api' WHEN 3 THEN 'lib/app' ELSE 'src/pages/api' END)"
_PAGE_FILE = "(CASE WHEN page_id % 2 = 0 THEN '/route.ts' WHEN page_id % 3 = 0 THEN '.js' ELSE '/page.tsx' END)"


def route_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages as source files: which of them are routes."""
    path = F.expr(f"concat({_PAGE_PATH}, '/p', page_id, {_PAGE_FILE})")
    return table(spark, d, "pages").select(path.alias("path")).select("path", T.is_route_path(F.col("path")).alias("route"))


ROUTE_SQL = f"""
SELECT path, regexp_matches(path, {q(T.ROUTE_ROOT)}) AND regexp_matches(path, {q(T.ROUTE_FILE)}) AS route
FROM (SELECT {_PAGE_PATH} || '/p' || page_id || {_PAGE_FILE} AS path FROM pages)
"""


def finding_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings: with a confidence of their own, of their rule, or of neither."""
    names = [r.rule_id for r in R.RULES]
    rule = F.element_at(F.array(*[F.lit(n) for n in names], F.lit("no-such-rule")), (F.pmod("o_orderkey", F.lit(len(names) + 1)) + 1).cast("int"))
    found = table(spark, d, "orders").select("o_orderkey", rule.alias("rule_id"), F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "measured").alias("confidence"))
    return scoring.with_confidence(found, R.rule_table(spark)).select("o_orderkey", "rule_id", "confidence")


_RULES = ", ".join(f"({i}, {q(r.rule_id)}, {q(r.confidence)})" for i, r in enumerate(R.RULES))
CONFIDENCE_OF_SQL = f"""
SELECT o_orderkey, coalesce(r.rule_id, 'no-such-rule') AS rule_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'measured' ELSE coalesce(r.confidence, 'likely') END AS confidence
FROM orders LEFT JOIN (VALUES {_RULES}) r(i, rule_id, confidence) ON i = o_orderkey % {len(R.RULES) + 1}
"""


def scan_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects: those without urgent orders have no files, some of them no path."""
    projects = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("path"), "c_custkey")
    seen = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")).distinct().join(projects, "c_custkey").select(F.col("name").alias("project"))
    there = projects.where("c_custkey % 2 = 0").select(F.col("name").alias("project"))
    return audit.target_findings(projects.drop("c_custkey"), seen, there).select("project", "rule_id", "severity", "snippet")


TARGET_SQL = """
SELECT c_name AS project, CASE WHEN c_custkey % 2 = 0 THEN 'int-scan-target-empty' ELSE 'int-scan-target-missing' END AS rule_id,
       'high' AS severity, 'path: ' || c_mktsegment AS snippet FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
"""

QUERIES = {
    "registry_projects": Query(registry_projects, "SELECT c_name AS name, '/srv/' || c_custkey AS path, c_custkey % 3 = 0 AS owned FROM customer"),
    "header_columns": Query(header_columns, HEADER_SQL),
    "rank_file": Query(rank_file, O.RANK_SQL),
    "snapshot_files": Query(snapshots, SNAPSHOT_SQL),
    "label_file": Query(label_file, LABEL_FILE_SQL),
    "recall_manifest_file": Query(recall_manifest, MANIFEST_SQL),
    "route_paths": Query(route_paths, ROUTE_SQL),
    "finding_confidence": Query(finding_confidence, CONFIDENCE_OF_SQL),
    "scan_targets": Query(scan_targets, TARGET_SQL),
}
