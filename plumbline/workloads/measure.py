"""Queries over findings in the documents table: scan, score, precision, recall, diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import entropy as E
from plumbline.functions import text as T
from plumbline.operators import lines as L
from plumbline.plans import invariants, profiles, quality, scoring
from plumbline.session import cut_lineage
from plumbline.sources import corpus, reports
from plumbline.workloads import common as C
from plumbline.workloads.common import Query, table

SECRET = 'token = "([0-9a-f]{40})"'
ENTROPY_FLOOR = 3.0


def secret_findings(spark: SparkSession, d: str) -> DataFrame:
    """Quoted token literals whose entropy is above the floor."""
    files = C.documents_as_files(spark, d).where(F.col("content").rlike(SECRET))
    lines = L.explode_lines(files).where(F.col("text").rlike(SECRET))
    value = F.regexp_extract("text", SECRET, 1)
    return (
        lines.select("project", F.col("path").alias("file"), F.col("line_no").alias("line"), value.alias("value"))
        .withColumn("entropy", E.shannon_entropy(F.col("value")))
        .where(F.col("entropy") >= ENTROPY_FLOOR)
        .select(
            "project",
            "file",
            "line",
            F.round("entropy", 6).alias("entropy"),
            F.lit("critical").alias("severity"),
            F.char_length("value").alias("length"),
        )
    )


ENTROPY_SQL = (
    "list_sum(list_transform(list_distinct(string_split({v}, '')), "
    "lambda c: -(len({v}) - len(replace({v}, c, ''))) / len({v})::DOUBLE "
    "* log2((len({v}) - len(replace({v}, c, ''))) / len({v})::DOUBLE)))"
)
SECRET_SQL = f"""
WITH lines AS ({C.lines_sql(C.files_sql(), "project, path")}),
hits AS (SELECT project, path AS file, CAST(line_no AS INTEGER) AS line,
                regexp_extract(text, '{SECRET}', 1) AS value
         FROM lines WHERE regexp_matches(text, '{SECRET}')),
scored AS (SELECT *, {ENTROPY_SQL.format(v="value")} AS h FROM hits)
SELECT project, file, line, round(h, 6) AS entropy, 'critical' AS severity,
       CAST(length(value) AS INTEGER) AS length
FROM scored WHERE h >= {ENTROPY_FLOOR}
"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    return C.prose_findings(C.documents_as_files(spark, d))


FIND = C.prose_findings_sql()
BASE = ["project", "file", "line", "rule_id", "severity", "confidence"]


def fused_scan(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_fingerprint(findings(spark, d)).select(*BASE, "snippet", "fingerprint")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.explode_lines(C.documents_as_files(spark, d)).select(
        "project", "path", "line_no", F.char_length("text").alias("length"), T.indent(F.col("text")).alias("indent")
    )


GREP = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


def grep_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.grep_lines(C.documents_as_files(spark, d), GREP).select("project", "path", "line_no", "column_no", "value")


GREP_SQL = f"""
WITH lines AS ({C.lines_sql(C.files_sql(), "project, path")}),
m AS (SELECT project, path, CAST(line_no AS INTEGER) AS line_no, regexp_extract_all(text, '{GREP}') AS v,
             string_split_regex(text, '{GREP}') AS p FROM lines WHERE regexp_matches(text, '{GREP}')),
k AS (SELECT *, unnest(generate_series(1, len(v))) AS i FROM m)
SELECT project, path, line_no, v[i] AS value,
       CAST(1 + list_sum(list_transform(p[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS column_no
FROM k
"""


def line_context_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = L.context_hits(
        C.documents_as_files(spark, d), GREP, 2, 3, exclude='token = "', first_only=True
    )
    return hits.select("project", "path", "line_no", F.md5("context").alias("context_md5"))


CONTEXT_SQL = f"""
WITH lines AS ({C.lines_sql(C.files_sql(), "project, path")}),
w AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY project, path ORDER BY line_no
                                                ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS ctx FROM lines),
h AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY line_no) AS rn FROM w
      WHERE regexp_matches(text, '{GREP}') AND NOT contains(ctx, 'token = "'))
SELECT project, path, CAST(line_no AS INTEGER) AS line_no, md5(ctx) AS context_md5 FROM h WHERE rn = 1
"""


def severity_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return scoring.banded(scoring.severity_counts(findings(spark, d)))


SCORE_SQL = f"""
WITH f AS ({FIND}),
c AS (SELECT project, {C.counts_sql()}, CAST(sum({C.WEIGHT_SQL}) AS BIGINT) AS raw FROM f GROUP BY project)
SELECT *, least(100, 2 * raw) AS score, false AS partial, {C.band_sql("least(100, 2 * raw)")} AS label FROM c
"""


def portfolio_totals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.portfolio(findings(spark, d))


PORTFOLIO_SQL = f"""
WITH f AS ({FIND})
SELECT project, {C.counts_sql()}, CAST(sum({C.WEIGHT_SQL}) AS BIGINT) AS raw, count(DISTINCT project) AS projects
FROM f GROUP BY ROLLUP (project)
"""


def confidence_split(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confidence_counts(findings(spark, d))


_SEV = ("critical", "high", "medium", "low", "info")
CONFIDENCE_SQL = f"WITH f AS ({FIND}) SELECT project, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}' AND confidence {op} 'certain') AS {name}_{s}"
    for name, op in (("certain", "="), ("likely", "<>"))
    for s in _SEV
) + " FROM f GROUP BY project"


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_category(findings(spark, d))


CATEGORY_SQL = f"""
WITH f AS ({FIND})
SELECT owasp, severity, count(*) AS findings, CAST(substr(owasp, 2, 2) AS INTEGER) AS category_ord,
       {C.ORDER_SQL} AS severity_ord FROM f GROUP BY owasp, severity
"""


def critical_gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.critical_gate(findings(spark, d))


GATE_SQL = f"""
WITH f AS ({FIND})
SELECT coalesce(bool_or(severity = 'critical'), false) AS blocked,
       count(DISTINCT project) FILTER (WHERE severity = 'critical') AS critical_projects FROM f
"""


def top_findings(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_findings(findings(spark, d), 8).select(*BASE)


TOP_SQL = f"""
WITH f AS ({FIND}), r AS (SELECT *, row_number() OVER (PARTITION BY project
    ORDER BY {C.ORDER_SQL}, rule_id, file, line) AS rn FROM f)
SELECT project, file, CAST(line AS INTEGER) AS line, rule_id, severity, confidence FROM r WHERE rn <= 8
"""


def projects_ranked(spark: SparkSession, d: str) -> DataFrame:
    return scoring.projects_by_score(severity_scorecard(spark, d)).select("project", "raw", "score", "label")


RANKED_SQL = f"SELECT project, raw, score, label FROM ({SCORE_SQL})"


def stored_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings with fingerprints, scanned once and shared by all branches of a job."""
    return cut_lineage(scoring.with_fingerprint(findings(spark, d)))


def derived_labels(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Verdicts for findings in labelled documents, plus labels that no longer fire."""
    lab = table(spark, d, "labels")
    verdict = F.when(F.col("toxic") == 1, F.lit("tp")).when(F.col("quality") == 0, F.lit("fp")).otherwise(F.lit("?"))
    note = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.lit("resolved")).when(
        (F.col("toxic") == 0) & (F.col("quality") == 0), F.lit("stale")
    )
    fired = found.join(lab, "doc_id").select(
        "fingerprint",
        verdict.alias("verdict"),
        F.col("rule_id").alias("rule"),
        "file",
        "line",
        "snippet",
        note.alias("note"),
    )
    gone = C.documents_as_files(spark, d).join(lab, "doc_id").select(
        F.concat_ws("::", F.lit("doc-gone"), "path", F.lit("L0")).alias("fingerprint"),
        verdict.alias("verdict"),
        F.lit("doc-gone").alias("rule"),
        F.col("path").alias("file"),
        F.lit(0).alias("line"),
        F.lit("").alias("snippet"),
        note.alias("note"),
    )
    return (
        fired.unionByName(gone)
        .groupBy("fingerprint")
        .agg(F.min(F.struct("verdict", "rule", "file", "line", "snippet", "note")).alias("r"))
        .select("fingerprint", "r.*")
    )


_VERDICT = "CASE WHEN toxic = 1 THEN 'tp' WHEN quality = 0 THEN 'fp' ELSE '?' END"
_NOTE = "CASE WHEN toxic = 1 AND quality = 1 THEN 'resolved' WHEN toxic = 0 AND quality = 0 THEN 'stale' END"
LABEL_CTES = f"""
f AS (SELECT *, {C.FINGERPRINT_SQL} AS fingerprint FROM ({FIND})),
lab_all AS (
  SELECT fingerprint, {_VERDICT} AS verdict, rule_id AS rule, file, line, snippet, {_NOTE} AS note
  FROM f JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'doc-gone::' || path || '::L0', {_VERDICT}, 'doc-gone', path, 0, '', {_NOTE}
  FROM ({C.files_sql()}) JOIN labels USING (doc_id)),
lab AS (SELECT fingerprint, verdict, rule, file, line, snippet, note FROM (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY verdict, rule, file, line, snippet, note NULLS FIRST) AS rn
  FROM lab_all) WHERE rn = 1)
"""


def detector_precision(spark: SparkSession, d: str) -> DataFrame:
    found = stored_findings(spark, d)
    out = quality.rule_precision(quality.precision_input(found), derived_labels(spark, d, found))
    return out.withColumn("precision", F.round("precision", 6))


PRECISION_SQL = f"""
WITH {LABEL_CTES}
SELECT rule_id, CAST(count(*) FILTER (WHERE verdict = 'tp') AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE verdict = 'fp') AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE verdict IS NULL OR verdict NOT IN ('tp', 'fp')) AS BIGINT) AS unlabeled,
       round(count(*) FILTER (WHERE verdict = 'tp')
             / nullif(count(*) FILTER (WHERE verdict IN ('tp', 'fp')), 0)::DOUBLE, 6) AS precision
FROM f LEFT JOIN lab USING (fingerprint) WHERE severity <> 'info' GROUP BY ROLLUP (rule_id)
"""


def derived_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every rule is expected on every labelled document; half the entries are bare file names."""
    lab = table(spark, d, "labels").where("quality = 1")
    files = C.documents_as_files(spark, d).join(lab, "doc_id")
    named = F.when(F.col("toxic") == 1, T.base_name(F.col("path"))).otherwise(
        F.concat(F.col("path"))
    )
    rules = F.array(*[F.lit(r[0]) for r in C.PROSE_RULES])
    return files.select(named.alias("file"), F.explode(rules).alias("rule_id"), F.lit("").alias("note"))


def detector_recall(spark: SparkSession, d: str) -> DataFrame:
    hits = quality.recall_hits(stored_findings(spark, d), derived_manifest(spark, d))
    return quality.rule_recall(hits).withColumn("recall", F.round("recall", 6))


_RULES = ", ".join(f"('{r[0]}')" for r in C.PROSE_RULES)
RECALL_SQL = f"""
WITH f AS (SELECT DISTINCT rule_id, file FROM ({FIND})),
m AS (SELECT r.rule_id, CASE WHEN toxic = 1 THEN doc_id || '.txt' ELSE path END AS wanted
      FROM ({C.files_sql()}) JOIN labels USING (doc_id), (VALUES {_RULES}) r(rule_id) WHERE quality = 1),
h AS (SELECT m.rule_id, EXISTS (SELECT 1 FROM f WHERE f.rule_id = m.rule_id AND ends_with(f.file, m.wanted)) AS hit FROM m)
SELECT rule_id, count(*) AS total, count(*) FILTER (WHERE hit) AS hits,
       round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 6) AS recall
FROM h GROUP BY ROLLUP (rule_id)
"""

AFTER_TEXT = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'token = ', 'tok = ') ELSE text END"
AFTER_RULES = [r for r in C.PROSE_RULES if r[0] != "doc-mail"]


def _after_files(spark: SparkSession, d: str) -> DataFrame:
    changed = F.when(
        F.col("doc_id") % 3 == 0, F.replace(F.col("content"), F.lit("token = "), F.lit("tok = "))
    ).otherwise(F.col("content"))
    return C.documents_as_files(spark, d).withColumn("content", changed)


def _digests(files: DataFrame) -> DataFrame:
    return files.select(
        "project", F.col("path").alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("digest")
    )


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Before: the documents. After: some texts edited, and one detector lost."""
    before, after = C.documents_as_files(spark, d), _after_files(spark, d)
    return quality.snapshot_diff(
        cut_lineage(C.prose_findings(before).withColumn("ordinal", F.col("line"))),
        cut_lineage(C.prose_findings(after, AFTER_RULES).withColumn("ordinal", F.col("line"))),
        _digests(before),
        _digests(after),
    ).select("identity", "project", "rule_id", "file", "line", "change", "reason", "suspicious")


DIFF_SQL = f"""
WITH a0 AS ({FIND}), b0 AS ({C.prose_findings_sql(C.files_sql(AFTER_TEXT), AFTER_RULES)}),
a AS (SELECT * FROM (SELECT *, project || '::' || {C.FINGERPRINT_SQL} AS identity FROM a0)
      QUALIFY row_number() OVER (PARTITION BY identity ORDER BY line DESC) = 1),
b AS (SELECT * FROM (SELECT *, project || '::' || {C.FINGERPRINT_SQL} AS identity FROM b0)
      QUALIFY row_number() OVER (PARTITION BY identity ORDER BY line DESC) = 1),
d AS (SELECT project, path AS file, substr(sha256(o), 1, 16) AS od, substr(sha256(n), 1, 16) AS nd FROM (
      SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, text AS o, {AFTER_TEXT} AS n FROM documents))
SELECT identity, project, rule_id, file, CAST(line AS INTEGER) AS line, 'new' AS change, NULL AS reason, false AS suspicious
FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.identity = b.identity)
UNION ALL
SELECT identity, project, rule_id, file, CAST(line AS INTEGER), 'vanished',
       CASE WHEN od = nd THEN 'file-identical' ELSE 'file-changed' END, coalesce(od = nd, false)
FROM a LEFT JOIN d USING (project, file) WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.identity = b.identity)
"""


def label_sync(spark: SparkSession, d: str) -> DataFrame:
    f = stored_findings(spark, d)
    return quality.label_states(f, derived_labels(spark, d, f)).select("fingerprint", "verdict", "rule", "note", "state")


SYNC_SQL = f"""
WITH {LABEL_CTES}, c AS (SELECT fingerprint, min(rule_id) AS rule_id FROM f GROUP BY fingerprint)
SELECT coalesce(lab.fingerprint, c.fingerprint) AS fingerprint, coalesce(verdict, '?') AS verdict,
       coalesce(rule, rule_id) AS rule,
       CASE WHEN lab.fingerprint IS NOT NULL AND c.fingerprint IS NULL AND coalesce(note, '') = '' THEN 'stale' ELSE note END AS note,
       CASE WHEN lab.fingerprint IS NULL THEN 'added' WHEN c.fingerprint IS NOT NULL THEN 'kept'
            WHEN coalesce(note, '') <> 'stale' THEN 'stale' ELSE 'noted' END AS state
FROM lab FULL JOIN c ON lab.fingerprint = c.fingerprint
"""


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.label_summary(label_sync(spark, d))


SUMMARY_SQL = f"SELECT state, count(*) AS labels FROM ({SYNC_SQL}) GROUP BY state"


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    f = stored_findings(spark, d)
    return quality.regressions(f, derived_labels(spark, d, f)).select("fingerprint", "rule", "verdict", "reason")


REGRESSION_SQL = f"""
WITH {LABEL_CTES}, j AS (SELECT lab.*, fingerprint IN (SELECT fingerprint FROM f) AS fires FROM lab),
r AS (SELECT *, CASE
   WHEN verdict = 'tp' AND regexp_matches(coalesce(note, ''), 'resolved|fixed') AND fires THEN 'lost-tp: returned hole'
   WHEN verdict = 'tp' AND NOT regexp_matches(coalesce(note, ''), 'resolved|fixed') AND NOT fires THEN 'lost-tp'
   WHEN verdict = 'fp' AND fires AND contains(coalesce(note, ''), 'stale') THEN 'returned-fp' END AS reason FROM j)
SELECT fingerprint, rule, verdict, reason FROM r WHERE reason IS NOT NULL
"""

RELATIONS = [
    invariants.Relation("lineitem", "l_orderkey", "orders", "o_orderkey"),
    invariants.Relation("lineitem", "l_partkey", "part", "p_partkey"),
    invariants.Relation("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    invariants.Relation("orders", "o_custkey", "customer", "c_custkey"),
    invariants.Relation("customer", "c_nationkey", "nation", "n_nationkey"),
    invariants.Relation("nation", "n_regionkey", "region", "r_regionkey"),
    invariants.Relation("labels", "doc_id", "documents", "doc_id"),
    # The other way round, so that some relations are broken.
    invariants.Relation("orders", "o_orderkey", "lineitem", "l_orderkey"),
    invariants.Relation("documents", "doc_id", "labels", "doc_id"),
    invariants.Relation("customer", "c_custkey", "orders", "o_custkey"),
]


def _orphans(relations):
    def run(spark: SparkSession, d: str) -> DataFrame:
        names = {r.table for r in relations} | {r.parent for r in relations}
        return invariants.orphan_invariants(spark, {n: table(spark, d, n) for n in names}, relations)

    return run


def _orphans_sql(relations) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{r.label}' AS relation, count(*) AS orphans FROM {r.table} c WHERE c.{r.column} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {r.parent} p WHERE p.{r.parent_column} = c.{r.column})"
        for r in relations
    )
    return f"""
WITH c AS ({parts})
SELECT 'orphan-rows' AS invariant, relation, CASE WHEN orphans > 50 THEN 'high' ELSE 'medium' END AS severity, orphans
FROM c WHERE orphans > 0
UNION ALL
SELECT 'orphan-rows', '{len(relations)} relations clean', 'low', 0 WHERE (SELECT sum(orphans) FROM c) = 0
"""


LANGS = (["en", "de", "fr"], {"es": "Spanish"})


def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.coverage(table(spark, d, "documents"), "source", F.col("lang"), *LANGS)
    return out.select(
        F.col("source"), "readable", "unreadable", "percent", F.to_json("languages").alias("languages")
    )


COVERAGE_SQL = """
SELECT source, count(*) FILTER (WHERE lang IN ('en', 'de', 'fr')) AS readable,
       count(*) FILTER (WHERE lang = 'es') AS unreadable,
       CAST(round(100.0 * count(*) FILTER (WHERE lang IN ('en', 'de', 'fr'))
            / count(*) FILTER (WHERE lang IN ('en', 'de', 'fr', 'es'))) AS INTEGER) AS percent,
       CASE WHEN count(*) FILTER (WHERE lang = 'es') = 0 THEN '[]'
            ELSE '[{"language":"Spanish","n":' || count(*) FILTER (WHERE lang = 'es') || '}]' END AS languages
FROM documents GROUP BY source
"""


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    return corpus.file_digests(C.documents_as_files(spark, d), findings(spark, d))


DIGEST_SQL = f"""
SELECT source AS project, lang || '/' || doc_id || '.txt' AS file, substr(sha256(text), 1, 16) AS digest
FROM documents WHERE doc_id IN (SELECT doc_id FROM ({FIND}))
"""


def token_entropy_profile(spark: SparkSession, d: str) -> DataFrame:
    tokens = profiles.candidate_tokens(table(spark, d, "documents"))
    p = profiles.token_profile(tokens)
    return p.select(
        "source",
        "token",
        "uses",
        "length",
        "distinct_chars",
        F.round("entropy", 6).alias("entropy"),
        "klass",
        "max_run",
        F.round("normalized", 6).alias("normalized"),
        F.round("keyspace_bits", 6).alias("keyspace_bits"),
        "strength",
    )


# RE2 has no back-reference, so the longest run is searched by length and character.
_CEIL = (
    "CASE klass WHEN 'hex' THEN 4.0 WHEN 'base32' THEN 5.0 WHEN 'base64' THEN 6.0 "
    "WHEN 'alnum' THEN log2(62.0::DOUBLE) WHEN 'printable' THEN log2(94.0::DOUBLE) END"
)
TOKENS_SQL = rf"""
WITH t AS (SELECT source, token, count(*) AS uses FROM (
    SELECT source, unnest(regexp_extract_all(text, '{profiles.TOKEN}')) AS token FROM documents) GROUP BY ALL),
b AS (SELECT *, CAST(length(token) AS INTEGER) AS length,
    CAST(len(list_distinct(string_split(token, ''))) AS INTEGER) AS distinct_chars, {ENTROPY_SQL.format(v="token")} AS h,
    CASE WHEN regexp_matches(token, '^[0-9a-fA-F]+$') THEN 'hex' WHEN regexp_matches(token, '^[A-Z2-7]+=*$') THEN 'base32'
         WHEN regexp_matches(token, '^[A-Za-z0-9]+$') THEN 'alnum'
         WHEN (regexp_matches(token, '^[A-Za-z0-9+/]+={{0,2}}$') OR regexp_matches(token, '^[A-Za-z0-9_-]+={{0,2}}$'))
              AND (length(token) % 4 = 0 OR ends_with(token, '=')) THEN 'base64'
         WHEN regexp_matches(token, '^[!-~]+$') THEN 'printable' ELSE 'text' END AS klass,
    CAST((SELECT max(n) FROM (SELECT unnest(generate_series(1, length(token))) AS n)
          WHERE EXISTS (SELECT 1 FROM (SELECT unnest(list_distinct(string_split(token, ''))) AS c) WHERE contains(token, repeat(c, n))))
         AS INTEGER) AS max_run
  FROM t)
SELECT source, token, uses, length, distinct_chars, round(h, 6) AS entropy, klass, max_run,
       round(h / {_CEIL}, 6) AS normalized, round(length * {_CEIL}, 6) AS keyspace_bits,
       CASE WHEN length * {_CEIL} < 64 THEN 'weak' WHEN length * {_CEIL} < 112 THEN 'marginal' ELSE 'strong' END AS strength
FROM b
"""


def strength_histogram(spark: SparkSession, d: str) -> DataFrame:
    tokens = profiles.candidate_tokens(table(spark, d, "documents"))
    return profiles.strength_histogram(profiles.token_profile(tokens))


HISTOGRAM_SQL = f"""
SELECT source, klass, strength, count(*) AS tokens, CAST(sum(uses) AS BIGINT) AS uses
FROM ({TOKENS_SQL}) GROUP BY source, klass, strength
"""


def triage(spark: SparkSession, d: str) -> DataFrame:
    """Verdict scores come from the labels: good documents clear their findings."""
    f = stored_findings(spark, d)
    verdicts = (
        f.join(table(spark, d, "labels"), "doc_id")
        .groupBy("fingerprint")
        .agg((F.lit(1.0) - F.max("quality") * 0.75).alias("score"))
    )
    return scoring.triage_merge(f, verdicts).select("project", "file", "line", "rule_id", "severity", "confidence", "score")


TRIAGE_SQL = f"""
WITH f AS (SELECT *, {C.FINGERPRINT_SQL} AS fingerprint FROM ({FIND})),
v AS (SELECT fingerprint, 1.0 - max(quality) * 0.75::DOUBLE AS score FROM f JOIN labels USING (doc_id) GROUP BY fingerprint)
SELECT project, file, CAST(line AS INTEGER) AS line, rule_id, score,
       CASE WHEN severity IN ('critical', 'high') AND score < 0.5 THEN 'low' ELSE severity END AS severity,
       CASE WHEN severity IN ('critical', 'high') AND score < 0.5 THEN 'likely' ELSE confidence END AS confidence
FROM f LEFT JOIN v USING (fingerprint)
"""


def sarif_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.sarif_results(findings(spark, d))
    return rows.select(
        "project",
        "rule_id",
        "file",
        "line",
        "level",
        F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        F.get_json_object("result", "$.message.text").alias("message"),
    )


SARIF_SQL = f"""
SELECT project, rule_id, file, CAST(line AS INTEGER) AS line,
       CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
       file AS uri, CASE WHEN coalesce(snippet, '') <> '' THEN title || ' - ' || snippet ELSE title END AS message
FROM ({FIND})
"""

QUERIES = {
    "secret_findings": Query(secret_findings, SECRET_SQL),
    "fused_scan": Query(
        fused_scan,
        f"SELECT project, file, CAST(line AS INTEGER) AS line, rule_id, severity, confidence, snippet, {C.FINGERPRINT_SQL} AS fingerprint FROM ({FIND})",
    ),
    "document_lines": Query(
        document_lines,
        f"SELECT project, path, CAST(line_no AS INTEGER) AS line_no, CAST(length(text) AS INTEGER) AS length, "
        f"CAST(length(regexp_extract(text, '^[ \\t]*')) AS INTEGER) AS indent FROM ({C.lines_sql(C.files_sql(), 'project, path')})",
    ),
    "grep_matches": Query(grep_matches, GREP_SQL),
    "line_context_hits": Query(line_context_hits, CONTEXT_SQL),
    "severity_scorecard": Query(severity_scorecard, SCORE_SQL),
    "portfolio_totals": Query(portfolio_totals, PORTFOLIO_SQL),
    "confidence_split": Query(confidence_split, CONFIDENCE_SQL),
    "category_counts": Query(category_counts, CATEGORY_SQL),
    "critical_gate": Query(critical_gate, GATE_SQL),
    "top_findings": Query(top_findings, TOP_SQL),
    "projects_ranked": Query(projects_ranked, RANKED_SQL),
    "detector_precision": Query(detector_precision, PRECISION_SQL),
    "detector_recall": Query(detector_recall, RECALL_SQL),
    "snapshot_diff": Query(snapshot_diff, DIFF_SQL),
    "label_sync": Query(label_sync, SYNC_SQL),
    "label_summary": Query(label_summary, SUMMARY_SQL),
    "regression_gate": Query(regression_gate, REGRESSION_SQL),
    "orphan_invariants": Query(_orphans(RELATIONS), _orphans_sql(RELATIONS)),
    "orphan_invariants_clean": Query(_orphans(RELATIONS[:7]), _orphans_sql(RELATIONS[:7])),
    "coverage_by_source": Query(coverage_by_source, COVERAGE_SQL),
    "file_digests": Query(file_digests, DIGEST_SQL),
    "token_entropy_profile": Query(token_entropy_profile, TOKENS_SQL),
    "token_strength_histogram": Query(strength_histogram, HISTOGRAM_SQL),
    "triage_merge": Query(triage, TRIAGE_SQL),
    "sarif_rows": Query(sarif_rows, SARIF_SQL),
}
