"""Detector queries over the seeded corpus.

The SQL twins are written against the same pattern rows, but run in another engine
with other means: unnested lines, window frames and correlated subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.plans import patterns as P
from plumbline.plans import rules as R
from plumbline.session import cut_lineage
from plumbline.workloads import seed
from plumbline.workloads.common import Query
from plumbline.workloads.enclosing import rx, scope_sql

q = seed.quote


def category_clauses(category: int) -> list[P.Clause]:
    return [c for c in P.CLAUSES if R.BY_ID[c.rule_id].category == category]


def run_category(category: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        clauses = category_clauses(category)
        scopes = {t.scope for c in clauses for t in c.where}
        facts = cut_lineage(
            D.scan_facts(
                seed.seeded_files(spark, d), clauses, with_flags=True, with_helpers="helper" in scopes
            )
        )
        flags = D.project_flags(facts)
        helpers = D.helper_names(facts) if "helper" in scopes else None
        calling = (
            D.files_calling(facts, helpers)
            if helpers is not None
            else spark.createDataFrame([], "project string, path string, specs array<string>")
        )
        found = D.clause_findings(facts, flags, calling)
        rules = [c.rule_id for c in P.PROJECT_CLAUSES if R.BY_ID[c.rule_id].category == category]
        return found.unionByName(D.project_findings(flags).where(F.col("rule_id").isin(rules)))

    return run


def flag_sql(names: Sequence[str]) -> str:
    parts = []
    for n in sorted(set(names)):
        on_path, off_path, on_text = P.FLAGS[n]
        conds = []
        if on_path:
            conds.append(rx("path", on_path))
        if off_path:
            conds.append("NOT " + rx("path", off_path))
        if on_text:
            conds += ["NOT is_test", rx("clean", on_text)]
        parts.append(f"SELECT DISTINCT project, '{n}' AS flag FROM files WHERE {' AND '.join(conds)}")
    return "fl AS (" + "\nUNION ALL\n".join(parts) + ")" if parts else "fl AS (SELECT '' AS project, '' AS flag WHERE false)"


def helpers_sql() -> str:
    """Helper names by three rounds over call edges, and the files that call them."""
    name = "regexp_extract({}, '(?:function|const)\\s+(\\w+)', 1)"
    specs = " UNION ALL ".join(
        f"SELECT '{s}' AS spec, {q(gate)} AS gate, {q(signal)} AS signal" for s, (gate, signal) in D.HELPER_SPECS.items()
    )
    rounds = ""
    for i in range(1, 4):
        rounds += (
            f", h{i} AS (SELECT * FROM h{i - 1} UNION SELECT e.project, e.spec, e.caller FROM edges e "
            f"JOIN h{i - 1} h ON h.project = e.project AND h.spec = e.spec AND h.name = e.callee)"
        )
    return f"""
specs AS ({specs}),
{scope_sql(f"{rx('path', P.CODE)} AND NOT {rx('path', P.TESTISH)} AND {rx('clean', D.DEFINITION)}", "h_", "true")},
defs AS (SELECT project, {name.format('head')} AS name, body FROM h_fb WHERE func > 0 AND {rx('head', D.DEFINITION)}
         UNION ALL
         SELECT project, {name.format('text')} AS name, split_part((SELECT string_agg(x.text, chr(10) ORDER BY x.line_no) FROM cl x WHERE x.project = p.project AND x.path = p.path
           AND x.line_no BETWEEN p.line AND p.line + 19), ';', 1) AS body FROM h_pc p WHERE {rx('text', D.DEFINITION)}),
gated AS (SELECT d.project, s.spec, d.name, d.body, s.signal FROM defs d JOIN specs s ON regexp_matches(d.name, s.gate)),
edges AS (SELECT DISTINCT project, spec, name AS caller, callee FROM (
          SELECT project, spec, name, unnest(regexp_extract_all(body, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM gated) WHERE callee <> name),
h0 AS (SELECT DISTINCT project, spec, name FROM gated WHERE regexp_matches(body, signal)){rounds},
calls AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(clean, '\\b(\\w+)\\s*\\(', 1)) AS name
          FROM files WHERE {rx('path', P.CODE)} AND NOT is_test),
calling AS (SELECT DISTINCT c.project, c.path, h.spec FROM calls c JOIN h3 h ON h.project = c.project AND h.name = c.name)
"""


def clause_sql(clause: P.Clause) -> str:
    """One clause in SQL: (project, file, line, text, severity, confidence, note, per, redact)."""
    surface = R.BY_ID[clause.rule_id].surface
    file_conds, line_conds, windows = [], [], {}

    def window(t: P.Test) -> str:
        name = f"w_{t.before}_{t.after}"
        windows[name] = (
            f"string_agg(text, chr(10)) OVER (PARTITION BY project, path ORDER BY line_no "
            f"ROWS BETWEEN {t.before} PRECEDING AND {t.after} FOLLOWING) AS {name}"
        )
        return name

    def cond(t: P.Test) -> tuple[str, str]:
        no = "NOT " if t.negate else ""
        if t.scope == "path":
            return "file", no + rx("path", t.regex)
        if t.scope == "file":
            return "file", no + rx("clean", t.regex)
        if t.scope == "tracked":
            return "file", {"yes": "coalesce(tracked, false)", "no": "coalesce(NOT tracked, false)", "known": "tracked IS NOT NULL"}[t.regex]
        if t.scope == "flag":
            return "file", f"{no}EXISTS (SELECT 1 FROM fl WHERE fl.project = files.project AND fl.flag = '{t.regex}')"
        if t.scope == "helper":
            return "file", f"{no}EXISTS (SELECT 1 FROM calling c WHERE c.project = files.project AND c.path = files.path AND c.spec = '{t.regex}')"
        if t.scope == "line":
            return "line", no + rx("text", t.regex)
        if t.scope == "window":
            return "line", no + rx(window(t), t.regex)
        if t.scope == "func":
            windows["head"] = (
                f"max(CASE WHEN {rx('text', P.FUNC_HEAD)} THEN line_no END) OVER (PARTITION BY project, path ORDER BY line_no "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head"
            )
            ctx = (
                "(SELECT string_agg(x.text, chr(10) ORDER BY x.line_no) FROM cl x WHERE x.project = w.project AND x.path = w.path "
                f"AND x.line_no BETWEEN coalesce(w.head, w.line_no - {t.before}) AND w.line_no + {t.after})"
            )
            return "line", no + rx(ctx, t.regex)
        return "line", f"{no}list_contains(regexp_extract_all(clean, {q(t.regex)}, 1), regexp_extract(text, {q(t.arg)}, 1))"

    for t in clause.where:
        where, text = cond(t)
        (file_conds if where == "file" else line_conds).append(text)
    if surface != "all":
        file_conds.append("NOT is_test")
    levels = ""
    for i, level in enumerate(clause.levels):
        conds = " AND ".join(cond(t)[1] for t in level.when)
        levels += f"WHEN {conds} THEN {i} " if conds else f"ELSE {i} "
    level_sql = f"CASE {levels}END" if "WHEN" in levels else "0"
    chosen = f"SELECT project, path FROM files WHERE {' AND '.join(file_conds)}"
    if clause.hit is None:
        at = f"min(CASE WHEN {rx('text', clause.at)} THEN line_no END)" if clause.at else "NULL"
        body = (
            f"SELECT f.project, f.path, coalesce(a.at, 1) AS line_no, "
            + ("(SELECT x.text FROM cl x WHERE x.project = f.project AND x.path = f.path AND x.line_no = coalesce(a.at, 1))" if clause.at else "f.path")
            + f" AS text, f.level FROM (SELECT project, path, {level_sql} AS level FROM files WHERE {' AND '.join(file_conds)}) f "
            f"LEFT JOIN (SELECT project, path, {at} AS at FROM cl GROUP BY ALL) a USING (project, path)"
        )
    else:
        extra = ", ".join(["cl.*", *windows.values()])
        rows = (
            f"SELECT w.project, w.path, w.line_no, w.text, {level_sql} AS level FROM (SELECT {extra} FROM cl SEMI JOIN ({chosen}) USING (project, path)) w "
            f"WHERE {' AND '.join([rx('text', clause.hit), *line_conds])}"
        )
        body = f"SELECT * FROM ({rows}) WHERE level IS NOT NULL"
        if clause.per != "line":
            body += " QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY line_no) = 1"
    sev = "CASE level " + " ".join(f"WHEN {i} THEN '{lv.severity}'" for i, lv in enumerate(clause.levels)) + " END"
    conf = "CASE level " + " ".join(f"WHEN {i} THEN '{lv.confidence}'" for i, lv in enumerate(clause.levels)) + " END"
    shown = "regexp_replace(text, '[\"''`][^\"''`\\n]{4,}[\"''`]', '\"[redacted]\"', 'g')" if clause.redact else "text"
    return (
        f"SELECT project, '{clause.rule_id}' AS rule_id, path AS file, CAST(line_no AS INTEGER) AS line, "
        f"substr(trim({shown}), 1, 240) AS snippet, {sev} AS severity, {conf} AS confidence, '{clause.note}' AS note, '{clause.per}' AS per FROM ({body})"
    )


def project_clause_sql(c: P.ProjectClause) -> str:
    conds = " AND ".join(
        f"{'NOT ' if t.negate else ''}EXISTS (SELECT 1 FROM fl WHERE fl.project = p.project AND fl.flag = '{t.regex}')" for t in c.where
    )
    return (
        f"SELECT project, '{c.rule_id}' AS rule_id, '{c.file}' AS file, 1 AS line, '{c.note}' AS snippet, '{c.level.severity}' AS severity, "
        f"'{c.level.confidence}' AS confidence, '{c.note}' AS note, 'line' AS per FROM (SELECT DISTINCT project FROM files) p WHERE {conds}"
    )


def category_sql(category: int) -> str:
    clauses = category_clauses(category)
    projects = [c for c in P.PROJECT_CLAUSES if R.BY_ID[c.rule_id].category == category]
    tests = [t for c in [*clauses, *projects] for t in c.where]
    helpers = helpers_sql() + "," if any(t.scope == "helper" for t in tests) else ""
    parts = [f"({clause_sql(c)})" for c in clauses] + [f"({project_clause_sql(c)})" for c in projects]
    return f"""
WITH {seed.seeded_sql()}, {helpers} {flag_sql([t.regex for t in tests if t.scope == 'flag'])},
u AS ({' UNION ALL '.join(parts)}),
k AS (SELECT * FROM u QUALIFY per <> 'project'
      OR row_number() OVER (PARTITION BY project, rule_id, per ORDER BY note <> 'tracked', note, file, line) = 1)
SELECT DISTINCT project, rule_id, file, line, snippet, severity, confidence, note FROM k
"""


CATEGORY_NAMES = {
    1: "access_control",
    2: "secrets",
    3: "injection",
    4: "design",
    5: "misconfiguration",
    7: "authentication",
    8: "integrity",
    9: "monitoring",
    10: "request_forgery",
}

QUERIES = {
    f"detect_{name}": Query(run_category(n), category_sql(n)) for n, name in CATEGORY_NAMES.items()
}
