"""Cross-file rules over the seeded corpus, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.operators import scopes as S
from plumbline.plans import patterns as P
from plumbline.plans import scoped
from plumbline.session import cut_lineage
from plumbline.workloads import enclosing as E
from plumbline.workloads import seed
from plumbline.workloads.common import Query
from plumbline.workloads.detection import flag_sql, helpers_sql, q, rx
from plumbline.workloads.measure import ENTROPY_SQL

COLS = ["project", "file", "line", "snippet", "severity"]


def run(extractors: list, build: Callable, helpers: bool = False, flags: bool = True):
    """Scan with the given extractors only, then build the findings; ``flags`` where a rule asks for them."""

    def go(spark: SparkSession, d: str) -> DataFrame:
        facts = cut_lineage(
            D.scan_facts(seed.seeded_files(spark, d), [], [e() for e in extractors], with_flags=flags, with_helpers=helpers)
        )
        held = cut_lineage(D.project_flags(facts)) if flags else None
        if not helpers:
            return build(facts, held).select(*COLS)
        known = D.helper_names(facts)
        return build(facts, held, known, D.files_calling(facts, known)).select(*COLS)

    return go


def own(extractor):
    return run([extractor], lambda facts, flags: X.own_findings(facts, flags))


def within(*rules):
    return lambda: scoped.scoped_facts(*rules)


def scoped_own(rule):
    return own(within(rule))


def pos(text: str, pattern: str) -> str:
    """1-based start of the first match, 0 when absent."""
    lead = q("^([\\s\\S]*?)(?:" + pattern.replace("(?i)", "(?i:", 1) + (")" if pattern.startswith("(?i)") else "") + ")")
    return f"CASE WHEN {rx(text, pattern)} THEN length(regexp_extract({text}, {lead}, 1)) + 1 ELSE 0 END"


def lines_before(text: str, at: str) -> str:
    return f"CAST(len(string_split(substr({text}, 1, CAST({at} - 1 AS BIGINT)), chr(10))) AS INTEGER)"


def pos_of_part(p: str, v: str, i: str) -> str:
    """Start of match i from the pieces between matches and the matches."""
    return (
        f"CAST(1 + list_sum(list_transform({p}[1:{i}], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform({v}[1:{i}-1], lambda x: length(x))), 0) AS BIGINT)"
    )


def finding(file="path", line="line", snippet="snippet", severity="'high'", source="r") -> str:
    return f"SELECT DISTINCT project, {file} AS file, CAST({line} AS INTEGER) AS line, substr(trim({snippet}), 1, 240) AS snippet, {severity} AS severity FROM {source}"


BASE = f"WITH {seed.seeded_sql()}"
TSJS = rx("path", r"\.(ts|js|mjs)$")
CODE = rx("path", P.CODE)
ROUTE = rx("path", r"(^|/)app/.*/route\.(ts|js)$|(^|/)pages/api/.*\.(ts|js)$")
MODULE = "regexp_replace(split_part(path, '/', -1), '[.][^.]+$', '')"
PERMISSION = f"""{BASE}, s AS (SELECT project, path, clean, list_filter(string_split(clean, 'export async function ')[2:],
   lambda b: regexp_matches(b, '^(POST|PATCH|PUT|DELETE)') AND {pos('b', X.VALIDATES)} > 0 AND {pos('b', X.AUTHORISES)} > {pos('b', X.VALIDATES)}) AS late
   FROM files WHERE NOT is_test AND {ROUTE}),
r AS (SELECT project, path, split_part(late[1], chr(10), 1) AS snippet,
      {lines_before('clean', "strpos(clean, 'export async function ' || split_part(late[1], chr(10), 1))")} AS line FROM s WHERE len(late) > 0)
{finding(severity="'low'")}"""

SCAN = f"""{BASE}, r AS (SELECT project, path, {lines_before('clean', 'w')} AS line, 'write precedes scan' AS snippet FROM
  (SELECT *, {pos('clean', X.WRITES)} AS w, {pos('clean', X.SCANS)} AS s FROM files WHERE NOT is_test AND {TSJS}) WHERE w > 0 AND s >= w)
{finding()}"""

GUARD = f"""{BASE}, t AS (SELECT project, path, unnest(regexp_extract_all(clean, {q(X.TRIGGER)}, 1)) AS n, unnest(regexp_extract_all(clean, {q(X.TRIGGER)}, 2)) AS ev,
   unnest(regexp_extract_all(clean, {q(X.TRIGGER)}, 3)) AS tb FROM files WHERE NOT is_test AND regexp_matches(path, '[.]sql$')),
g AS (SELECT project, path, tb, bool_or(contains(upper(ev), 'UPDATE')) AS u, bool_or(contains(upper(ev), 'DELETE')) AS dl FROM t
      WHERE {rx('n', X.REJECTS)} GROUP BY ALL),
r AS (SELECT project, path, 1 AS line, string_agg(tb, ', ' ORDER BY tb) AS snippet FROM g WHERE u AND NOT dl GROUP BY ALL)
{finding()}"""

REVOKE = f"""{BASE}, {E.revoke_sql()}
{finding()}"""

VALUE = f"regexp_extract(text, {q(X.ASSIGNED)}, 1)"
SECRETS = f"""{BASE}, l AS (SELECT *, {VALUE} AS v FROM cl WHERE NOT is_test AND NOT regexp_matches(path, '(?i)[.](html?|md|mdx)$')
   AND (NOT regexp_matches(path, '(^|/)[.]env') OR coalesce(tracked, false)) AND NOT {rx('text', X.PLACEHOLDER)}),
r AS (SELECT project, path, line_no AS line, 'provider key' AS snippet, 'critical' AS severity FROM l WHERE {rx('text', X.PROVIDER_KEY)}
   UNION ALL
   SELECT project, path, line_no, 'high-entropy literal', 'high' FROM l WHERE v <> '' AND NOT {rx('text', X.PROVIDER_KEY)}
   AND NOT {rx('v', X.ENV_NAME)} AND regexp_matches(v, '[0-9]') AND {ENTROPY_SQL.format(v='v')} >= {X.ENTROPY_FLOOR})
{finding(severity='severity')}"""

SRI = f"""{BASE}, s0 AS (SELECT project, path, clean, regexp_extract_all(clean, {q(X.SCRIPT_TAG)}) AS v, string_split_regex(clean, {q(X.SCRIPT_TAG)}) AS p
   FROM files WHERE NOT is_test AND regexp_matches(path, '[.](html?|tsx|jsx)$') AND NOT {rx('path', P.TESTISH)} AND {rx('clean', X.SCRIPT_TAG)}
   AND NOT {rx('clean', X.CANONICAL)}),
s1 AS (SELECT *, unnest(generate_series(1, len(v))) AS i FROM s0),
r AS (SELECT project, path, {lines_before('clean', pos_of_part('p', 'v', 'i'))} AS line, substr(regexp_replace(v[i], '\\s+', ' ', 'g'), 1, 200) AS snippet FROM s1
   WHERE NOT regexp_matches(v[i], '(?i)\\bintegrity\\s*=') AND NOT regexp_matches(v[i], '(?i)https?://(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0)'))
{finding(severity="'medium'")}"""

PARSE = f"""{BASE}, {E.parse_sql()}
{finding(severity="'low'")}"""
UPSERT = f"""{BASE}, {E.upsert_sql()}
{finding(severity="'low'")}"""


def parts(name: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


_FAMILY = " ".join(f"WHEN list_has_any(w, {words(ws)}) THEN '{f}'" for f, ws in X.PII_FAMILIES.items() if f != "name")
_HEAD = "string_split_regex(substr(content, 1, 32768), '\\r?\\n')"
PII_REPO = f"""{BASE}, f0 AS (SELECT *, {_HEAD} AS ls, regexp_matches(lower(path), '[.](jsonl|ndjson)$') AS j FROM files
   WHERE NOT is_test AND coalesce(tracked, false) AND regexp_matches(path, '(?i)[.](csv|tsv|jsonl|ndjson)$')),
f1 AS (SELECT *, CASE WHEN j THEN json_keys(list_filter(ls, lambda l: starts_with(ltrim(l), '{{'))[1])
   ELSE list_filter(list_transform(string_split(ls[1], ','), lambda k: trim(k)), lambda k: k <> '') END AS h,
   len(list_filter(ls, lambda l: trim(l) <> '')) - CASE WHEN j THEN 0 ELSE 1 END AS n FROM f0),
h AS (SELECT project, path, h AS hs, unnest(h) AS k FROM f1 WHERE n >= 1),
p AS (SELECT *, {parts('k')} AS w FROM h),
fam AS (SELECT project, path, hs, CASE WHEN list_has_any(w, {words(X.PII_FAMILIES['name'])}) OR (list_contains(w, 'name') AND list_has_any(w, {words(X.NAME_OWNERS)})) THEN 'name' END AS f FROM p
   UNION ALL SELECT project, path, hs, CASE {_FAMILY} END FROM p),
r AS (SELECT project, path, 1 AS line, array_to_string(hs[1:8], ', ') AS snippet FROM fam GROUP BY project, path, hs HAVING count(DISTINCT f) >= 2)
{finding()}"""


def logs_sql() -> str:
    arms = []
    for ext, call in X.LOG_CALLS:
        arms.append(
            f"SELECT project, path, line_no, text, regexp_extract(text, {q('(?:' + call + ')(.*)$')}, {X.call_groups(call) + 1}) AS a "
            f"FROM cl WHERE NOT is_test AND {rx('path', ext)} AND {rx('text', call)}"
        )
    code = (
        f"regexp_replace(regexp_replace(regexp_replace(a, {q(X.MASKED)}, ' ', 'g'), '\"[^\"]*\"|''[^'']*''', ' ', 'g'), '`[^`$]*|[^`{{}}]*`', ' ', 'g')"
    )
    w = parts("n")
    return f"""{BASE}, {flag_sql(['collector'])}, a AS ({' UNION ALL '.join(arms)}),
n AS (SELECT *, unnest(list_transform(regexp_extract_all({code}, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: split_part(x, '.', -1))) AS n FROM a),
p AS (SELECT *, {w} AS w FROM n WHERE NOT {rx('n', X.ID_NAME)}),
r AS (SELECT DISTINCT project, path, line_no AS line, text AS snippet,
   CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.project = p.project) THEN 'high' ELSE 'medium' END AS severity FROM p
   WHERE NOT list_has_any(w, {words(X.AGGREGATES)}) AND (list_has_any(w, {words(X.PERSONAL)}) OR (list_contains(w, 'name') AND list_has_any(w, {words(X.PERSONS)}))))
{finding(severity='severity')}"""


def ref(name: str) -> str:
    c = f"lower(regexp_replace({name}, '[\"`]', '', 'g'))"
    return f"CASE WHEN contains({c}, '.') THEN split_part({c}, '.', 1) || '.' || split_part({c}, '.', 2) ELSE 'public.' || {c} END"


_MANAGED = ", ".join(f"'{m}'" for m in X.MANAGED)
RLS = f"""{BASE}, {flag_sql(['supabase_client', 'supabase_dep'])},
u AS (SELECT project FROM fl GROUP BY project HAVING count(DISTINCT flag) = 2),
s AS (SELECT * FROM cl WHERE NOT is_test AND regexp_matches(path, '(?i)[.]sql$') AND project IN (SELECT project FROM u)),
t0 AS (SELECT project, path, line_no, unnest(regexp_extract_all(text, {q(X.CREATE_TABLE)}, 1)) AS n FROM s),
t AS (SELECT project, path, line_no, {ref('n')} AS k FROM t0),
e AS (SELECT DISTINCT project, {ref('n')} AS k FROM (SELECT project, unnest(regexp_extract_all(clean, {q(X.ENABLE_RLS)}, 1)) AS n FROM files
      WHERE NOT is_test AND regexp_matches(path, '(?i)[.]sql$'))),
r AS (SELECT project, path, line_no AS line, 'create table ' || k AS snippet FROM t WHERE split_part(k, '.', 1) NOT IN ({_MANAGED})
      AND NOT EXISTS (SELECT 1 FROM e WHERE e.project = t.project AND e.k = t.k)
      QUALIFY row_number() OVER (PARTITION BY project, k ORDER BY path, line_no) = 1)
{finding()}"""

_WRITES = f"""wr AS (SELECT DISTINCT project, path AS writer, {rx('content', X.WRITER_EXTRA)} AS extra, unnest(regexp_extract_all(text, {q(X.PATH_WORD)})) AS m
   FROM cl JOIN (SELECT project, path, content FROM files) USING (project, path)
   WHERE NOT is_test AND regexp_matches(path, '[.](ts|js|mjs|cjs|py|sh|rb|go)$') AND {rx('text', X.WRITE_CALL)})"""
OUTPUT = f"""{BASE}, {_WRITES},
a AS (SELECT project, path, list_distinct(regexp_extract_all(content, {q(X.ADDRESS)})) AS ad FROM files
   WHERE NOT is_test AND coalesce(tracked, false) AND regexp_matches(path, '(?i)[.](html?|md|txt|rst)$')),
r AS (SELECT project, path, 1 AS line, x.s AS snippet FROM a, LATERAL (SELECT string_agg(z, ', ' ORDER BY i) AS s FROM
      (SELECT unnest(regexp_extract_all(f.content, {q(X.ADDRESS)})) AS z, generate_subscripts(regexp_extract_all(f.content, {q(X.ADDRESS)}), 1) AS i
       FROM files f WHERE f.project = a.project AND f.path = a.path) WHERE i <= 3) x
   WHERE len(ad) >= CASE WHEN EXISTS (SELECT 1 FROM wr WHERE wr.project = a.project AND wr.writer <> a.path AND (wr.m = a.path OR ends_with(wr.m, '/' || a.path))) THEN 3 ELSE 8 END)
{finding()}"""

HAND = f"""{BASE}, {_WRITES},
r AS (SELECT project, path, 1 AS line, trim(split_part(content, chr(10), 1)) AS snippet FROM files f WHERE NOT is_test
   AND {rx('substr(content, 1, 800)', X.BANNER)}
   AND EXISTS (SELECT 1 FROM wr WHERE wr.project = f.project AND wr.writer <> f.path AND (wr.m = f.path OR ends_with(wr.m, '/' || f.path)))
   AND NOT EXISTS (SELECT 1 FROM wr WHERE wr.project = f.project AND wr.writer <> f.path AND extra AND (wr.m = f.path OR ends_with(wr.m, '/' || f.path))))
{finding()}"""

_ENGINES = [
    ("path = 'package.json'", r'"(pg|postgres|@neondatabase/serverless|drizzle-orm|@supabase/supabase-js|@prisma/client)"', "postgres", 0),
    ("path = 'package.json'", r'"mysql2?"', "mysql", 1),
    ("path = 'package.json'", r'"better-sqlite3"', "sqlite", 2),
    ("regexp_matches(path, '[.]py$') AND NOT is_test", r"(?m)^\s*import\s+(psycopg2?|asyncpg)\b", "postgres", 10),
    ("regexp_matches(path, '[.]py$') AND NOT is_test", r"(?m)^\s*import\s+(pymysql|MySQLdb)\b", "mysql", 11),
    ("regexp_matches(path, '[.]py$') AND NOT is_test", r"(?m)^\s*import\s+(sqlite3|aiosqlite)\b", "sqlite", 12),
]
_DIALECT = ", ".join(f"('{e}', '{f}')" for e, fs in X.DIALECT.items() for f in fs.split())
DIALECT = f"""{BASE}, en AS ({' UNION ALL '.join(f"SELECT project, {o} AS o, '{n}' AS engine FROM files WHERE {w} AND {rx('content', p)}" for w, p, n, o in _ENGINES)}),
eg AS (SELECT project, arg_min(engine, o) AS engine FROM en GROUP BY project),
c AS (SELECT project, path, line_no, text, lower(unnest(regexp_extract_all(text, {q(X.DIALECT_CALL)}, 1))) AS fn FROM cl
   WHERE NOT is_test AND regexp_matches(path, '[.](ts|tsx|js|jsx|mjs|cjs|sql)$') AND {rx('text', X.DIALECT_CALL)} AND (ends_with(path, '.sql') OR {rx('text', X.SQL_CONTEXT)})),
r AS (SELECT c.project, path, line_no AS line, text AS snippet FROM c JOIN eg USING (project) JOIN (VALUES {_DIALECT}) d(engine, fn) ON d.engine = eg.engine AND d.fn = c.fn)
{finding()}"""

_BUILTIN = ", ".join(f"'{k}'" for k in X.BUILTIN_ENV)
CONFIG = f"""{BASE}, {flag_sql(['env_example'])},
rf AS (SELECT project, unnest(regexp_extract_all(text, {q(X.ENV_REF)}, 1)) AS k FROM cl WHERE NOT is_test AND {CODE}),
dfn AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, {q(X.ENV_DEF)}, 1)) AS k FROM files WHERE regexp_matches(path, '(^|/)[.]env[^/]*$')),
lo AS (SELECT project, count(DISTINCT k) AS n FROM rf WHERE k NOT IN ({_BUILTIN}) AND NOT EXISTS (SELECT 1 FROM dfn WHERE dfn.project = rf.project AND dfn.k = rf.k) GROUP BY project),
en AS (SELECT lo.*, EXISTS (SELECT 1 FROM fl WHERE fl.project = lo.project) AS ex FROM lo),
im0 AS (SELECT project, path, line_no, regexp_replace(regexp_extract(text, {q(X.REL_IMPORT)}, 1) || regexp_extract(text, {q(X.REL_IMPORT)}, 2), '[?#].*$', '') AS spec
   FROM cl WHERE NOT is_test AND {CODE} AND {rx('text', X.REL_IMPORT)}),
im1 AS (SELECT *, list_filter(string_split(path, '/')[:-2] || string_split(spec, '/'), lambda s: s NOT IN ('', '.')) AS st FROM im0 WHERE NOT {rx('spec', X.ASSET)}),
im AS (SELECT *, array_to_string(list_reduce(st, lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END), '/') AS dummy,
       list_reduce(list_prepend('', st), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END) AS base FROM im1),
tails(t) AS (VALUES (''), ('.ts'), ('.tsx'), ('.js'), ('.jsx'), ('.mjs'), ('.cjs'), ('.json'), ('/index.ts'), ('/index.tsx'), ('/index.js'), ('/index.jsx')),
br AS (SELECT project, path, spec, min(line_no) AS line_no FROM im WHERE base <> '' AND NOT EXISTS (SELECT 1 FROM files f, tails WHERE f.project = im.project
       AND (f.path = base || t OR f.path = regexp_replace(base, '[.]jsx?$', '.ts') || t OR f.path = regexp_replace(base, '[.]jsx?$', '.tsx') || t)) GROUP BY project, path, spec
       QUALIFY row_number() OVER (PARTITION BY project ORDER BY path, min(line_no), spec) <= 8),
r AS (SELECT project, CASE WHEN ex THEN '.env.example' ELSE 'package.json' END AS path, 1 AS line, n || ' undocumented keys' AS snippet, CASE WHEN ex THEN 'low' ELSE 'info' END AS severity FROM en WHERE ex OR n >= 5
   UNION ALL SELECT project, path, line_no, spec, 'low' FROM br
   UNION ALL SELECT project, path, 1, 'strict off', 'info' FROM files WHERE path = 'tsconfig.json' AND regexp_matches(content, '"strict"\\s*:\\s*false'))
{finding(severity='severity')}""".replace(
    "array_to_string(list_reduce(st, lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END), '/') AS dummy,\n       ", ""
)

ALERT = f"""{BASE}, m AS (SELECT * FROM files WHERE NOT is_test AND regexp_matches(path, '[.](ts|js|mjs|sh)$') AND {rx('path', X.MONITOR_PATH)}),
v AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(clean, {q(X.ALERT_VAR)}, 1)) AS k FROM m),
ex AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, {q(X.ENV_DEF)}, 1)) AS k FROM files WHERE regexp_matches(path, '(^|/)[.]env[^/]*[.](example|sample|template)$')),
r AS (SELECT project, path, 1 AS line, 'no alert channel' AS snippet FROM m WHERE NOT {rx('clean', X.ALERT_VAR)} AND NOT {rx('clean', X.ALERT_MODULE)}
   UNION ALL SELECT project, path, 1, string_agg(k, ', ' ORDER BY k) FROM v WHERE project IN (SELECT project FROM ex)
   AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.project = v.project AND ex.k = v.k) GROUP BY project, path)
{finding(severity="'medium'")}"""

TESTS = f"""{BASE}, s AS (SELECT project, path, unnest(map_entries(CAST(json_extract(content, '$.scripts') AS MAP(VARCHAR, VARCHAR)))) AS e FROM files
   WHERE path = 'package.json' AND json_extract(content, '$.scripts') IS NOT NULL),
c AS (SELECT project, path, e.key AS k, e.value AS v, len(regexp_extract_all(e.value, {q(X.TEST_PATH)})) AS n FROM s),
td AS (SELECT project, path FROM files WHERE regexp_matches(path, '[.](test|spec)[.](ts|tsx|js|mjs|cjs)$')),
r AS (SELECT project, path, 1 AS line, k || ': ' || n || ' files' AS snippet,
   CASE WHEN EXISTS (SELECT 1 FROM td WHERE td.project = c.project AND NOT contains(c.v, td.path)) THEN 'high' ELSE 'medium' END AS severity FROM c WHERE n >= 3)
{finding(severity='severity')}"""

_COMMON = ", ".join(f"'{k}'" for k in X.COMMON_IDENT.split())
CONTRACT = f"""{BASE}, w AS (SELECT project, path, regexp_matches(path, '[.]tsx?$') AS typed, unnest(list_distinct(regexp_extract_all(clean, '\\b([A-Za-z_]\\w{{4,}})\\b', 1))) AS k
   FROM files WHERE NOT is_test AND regexp_matches(path, '[.](tsx?|mjs|cjs|js)$') AND {rx('clean', X.JSON_WRITE)}),
r AS (SELECT a.project, min(a.path) AS path, 1 AS line, 'untyped writer' AS snippet FROM
   (SELECT project, k, min(path) AS path FROM w WHERE NOT typed AND k NOT IN ({_COMMON}) GROUP BY ALL) a
   JOIN (SELECT DISTINCT project, k FROM w WHERE typed) b USING (project, k) GROUP BY a.project)
{finding(severity="'medium'")}"""

_AUD = "CASE " + " ".join(f"WHEN {rx('path', p)} THEN '{n}'" for n, p, _ in X.AUDIENCES) + " END"
_AUDH = " UNION ALL ".join(f"SELECT '{n}' AS audience, {q(h)} AS names" for n, _, h in X.AUDIENCES)
DIVERGE = f"""{BASE}, {helpers_sql()}, au AS ({_AUDH}),
hc AS (SELECT DISTINCT c.project, c.path, h.name FROM calls c JOIN h3 h ON h.project = c.project AND h.name = c.name AND h.spec = 'identity'),
oc AS (SELECT DISTINCT hc.project, hc.path, au.audience FROM hc JOIN au ON regexp_matches(hc.name, au.names)),
pg AS (SELECT project, path, {_AUD} AS audience FROM files WHERE NOT is_test AND regexp_matches(path, '(^|/)(app|src/app)/(?:.*/)?(page|layout)[.](tsx|jsx)$')
   AND (NOT regexp_matches(clean, '\\b(getUserRole|isPatron|isYonetim|requireRole|hasRole|yetkiKontrol)\\s*\\(') OR {_AUD} = 'portal user')),
r AS (SELECT project, path, 1 AS line, 'audience ' || audience AS snippet FROM pg WHERE audience IS NOT NULL
   AND EXISTS (SELECT 1 FROM hc WHERE hc.project = pg.project AND hc.path = pg.path)
   AND NOT EXISTS (SELECT 1 FROM oc WHERE oc.project = pg.project AND oc.path = pg.path AND oc.audience = pg.audience)
   AND EXISTS (SELECT 1 FROM oc JOIN files f ON f.project = oc.project AND f.path = oc.path WHERE oc.project = pg.project AND oc.audience = pg.audience AND NOT f.is_test AND {rx('f.path', X.API_ROUTE_PATH)}))
{finding()}"""

_IMPORTS = f"""im AS (SELECT DISTINCT project, path, regexp_replace(split_part(m, '/', -1), '[.][jt]sx?$', '') AS k, m FROM
   (SELECT project, path, unnest(regexp_extract_all(clean, {q(X.IMPORT)}, 1)) AS m FROM files WHERE {CODE})
   UNION SELECT DISTINCT project, path, split_part(m, '.', -1), m FROM (SELECT project, path, unnest(regexp_extract_all(clean, {q(X.PY_IMPORT)}, 1)) AS m FROM files WHERE regexp_matches(path, '[.]py$')))"""
ACTIONS = f"""{BASE}, {helpers_sql()}, {_IMPORTS},
gt AS (SELECT DISTINCT project, path FROM calling WHERE spec = 'identity'), {E.action_sql()},
r AS (SELECT project, path, line, d AS snippet, CASE WHEN {rx('clean', scoped.BYPASS)} THEN 'high' ELSE 'medium' END AS severity FROM a2
   WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.project = a2.project AND gt.path = a2.path)
   AND NOT EXISTS (SELECT 1 FROM im JOIN gt ON gt.project = im.project AND regexp_replace(split_part(gt.path, '/', -1), '[.][^.]+$', '') = im.k
                   WHERE im.project = a2.project AND im.path = a2.path AND regexp_matches(im.m, '^([.]|@/)')))
{finding(severity='severity')}"""

UNBOUND = f"""{BASE}, {helpers_sql()}, {E.unbound_sql()},
r AS (SELECT u.project, path, line, m AS snippet FROM u JOIN h3 h ON h.project = u.project AND h.name = u.n AND h.spec = 'identity'
   QUALIFY row_number() OVER (PARTITION BY u.project, path ORDER BY line) = 1)
{finding()}"""

BROAD = f"""{BASE}, {flag_sql(['record_kinds'])},
w AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS near FROM cl
   WHERE NOT is_test AND regexp_matches(path, '[.](ts|js|mjs|cjs)$')),
b AS (SELECT *, regexp_extract(text, {q(X.BROAD)}, 1) AS fn FROM w WHERE {rx('text', X.BROAD)} AND NOT {rx('text', scoped.KIND_WORD)} AND NOT contains(text, 'function ')
   AND ({rx('path', X.GATE_WORD)} OR {rx('near', X.GATE_WORD)})),
{E.kind_sql()},
r AS (SELECT project, path, line_no AS line, text AS snippet FROM b WHERE EXISTS (SELECT 1 FROM fl WHERE fl.project = b.project)
   AND NOT EXISTS (SELECT 1 FROM k WHERE k.project = b.project AND k.fn = b.fn) QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY line_no) = 1)
{finding()}"""

TRAVERSAL = f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, {_IMPORTS}, {E.flow_sql()},
su AS (SELECT project, path FROM files WHERE NOT is_test AND {CODE} AND ({rx('clean', X.SURFACE_TEXT)} OR {rx('path', X.SURFACE_PATH)})),
r AS (SELECT project, path, line, snippet FROM sk WHERE EXISTS (SELECT 1 FROM su WHERE su.project = sk.project AND su.path = sk.path)
      OR EXISTS (SELECT 1 FROM im JOIN su ON su.project = im.project AND su.path = im.path WHERE im.project = sk.project AND im.k = {MODULE.replace("path", "sk.path")}))
{finding()}"""

_RL = ["serverless", "own_server", "cluster", "vercel_json", "vercel_hint"]
MEMORY = f"""{BASE}, {flag_sql(_RL)}, {_IMPORTS},
pf AS (SELECT project, list(flag) AS fs FROM fl GROUP BY project),
ok AS (SELECT project FROM pf WHERE list_contains(fs, 'serverless') AND NOT (list_contains(fs, 'own_server') AND NOT list_contains(fs, 'vercel_json')
       AND NOT list_contains(fs, 'vercel_hint') AND NOT list_contains(fs, 'cluster'))),
lm AS (SELECT * FROM files WHERE NOT is_test AND {CODE} AND NOT regexp_matches(path, '(test|spec|[.]d[.]ts$)') AND {rx('clean', X.LIMIT_WORDS)}),
r AS (SELECT cl.project, cl.path, line_no AS line, text AS snippet FROM cl JOIN lm USING (project, path) WHERE NOT {rx('lm.clean', X.DURABLE)} AND {rx('text', X.MEMORY_STORE)}
   AND cl.project IN (SELECT project FROM ok)
   AND NOT EXISTS (SELECT 1 FROM im JOIN lm l2 ON l2.project = im.project AND l2.path = im.path WHERE {rx('l2.clean', X.DURABLE)} AND im.project = cl.project
       AND im.k = regexp_replace(split_part(cl.path, '/', -1), '[.][^.]+$', ''))
   QUALIFY row_number() OVER (PARTITION BY cl.project, cl.path ORDER BY line_no) = 1)
{finding(severity="'medium'")}"""

PAID = f"""{BASE}, {_IMPORTS}, {E.paid_sql()},
r AS (SELECT project, path, line, lt AS snippet FROM f WHERE {rx('clean', scoped.ENTRY)}
   OR EXISTS (SELECT 1 FROM im WHERE im.project = f.project AND im.k = f.md AND NOT regexp_matches(im.path, '(?i)(test|spec|conftest|[.]md$)')))
{finding(severity="'medium'")}"""


def run_intervals(spark: SparkSession, d: str) -> DataFrame:
    files = D.prepare(seed.seeded_files(spark, d)).where("not is_test and path rlike '[.](py|ts|tsx|js|jsx|mjs|cjs)$'")
    return S.scopes(files.select("project", "path", "clean")).where("kind <> 'block'").select("project", "path", "kind", "start")


QUERIES = {
    "rule_permission_after_validation": Query(own(X.permission_after_validation), PERMISSION),
    "rule_scan_after_write": Query(own(X.scan_after_write), SCAN),
    "rule_update_guard_without_delete": Query(own(X.update_guard_without_delete), GUARD),
    "rule_session_revoke_missing": Query(scoped_own(scoped.session_revoke_missing), REVOKE),
    "rule_hardcoded_secret": Query(own(X.hardcoded_secret), SECRETS),
    "rule_external_script_no_sri": Query(own(X.external_script), SRI),
    "rule_unguarded_json_parse": Query(scoped_own(scoped.unguarded_parse), PARSE),
    "scope_intervals": Query(run_intervals, f"{BASE}, {E.interval_sql()}"),
    "rule_check_then_act_upsert": Query(run([within(scoped.check_then_act)], lambda f, g: X.check_then_act_findings(f)), UPSERT),
    "rule_pii_in_repo": Query(own(X.pii_in_repo), PII_REPO),
    "rule_pii_in_logs": Query(own(X.pii_in_logs), logs_sql()),
    "rule_missing_rls": Query(run([X.tables], lambda f, g: X.missing_rls(f, g)), RLS),
    "rule_pii_in_generated_output": Query(run([X.address_count, X.write_mentions], lambda f, g: X.generated_output(f)), OUTPUT),
    "rule_generated_file_hand_edited": Query(run([X.generated_banner, X.write_mentions], lambda f, g: X.hand_edited(f)), HAND),
    "rule_sql_dialect_leftover": Query(run([X.dialect_calls], lambda f, g: X.dialect_leftovers(f)), DIALECT),
    "rule_build_config_health": Query(
        run(
            [X.env_keys, X.relative_imports],
            lambda f, g: X.env_undocumented(f, g).unionByName(X.broken_imports(f)).unionByName(X.own_findings(f, g)),
        ),
        CONFIG,
    ),
    "rule_alert_target_missing": Query(
        run([X.alerts, X.env_keys], lambda f, g: X.alert_variables(f).unionByName(X.own_findings(f, g))), ALERT
    ),
    "rule_hand_enumerated_test_list": Query(run([X.test_lists], lambda f, g: X.test_list_findings(f)), TESTS),
    "rule_contract_two_writers": Query(run([X.json_writers], lambda f, g: X.two_writers(f)), CONTRACT),
    "rule_page_api_auth_divergence": Query(
        run([X.audience_pages], lambda f, g, h, c: X.page_api_divergence(f, h), helpers=True), DIVERGE
    ),
    "rule_server_action_auth_missing": Query(
        run([within(scoped.server_actions), X.imports], lambda f, g, h, c: X.server_action_findings(f, c), helpers=True), ACTIONS
    ),
    "rule_unbound_session_fallthrough": Query(
        run([within(scoped.unbound_sessions)], lambda f, g, h, c: X.unbound_findings(f, h), helpers=True), UNBOUND
    ),
    "rule_gate_condition_too_broad": Query(run([X.broad_gates, within(scoped.kind_aware)], lambda f, g: X.broad_gate_findings(f, g)), BROAD),
    "rule_path_traversal": Query(run([X.surfaces, within(scoped.value_flow), X.imports], lambda f, g: X.path_traversal(f), flags=False), TRAVERSAL),
    "rule_inmemory_ratelimit": Query(
        run([X.memory_limiters, X.imports], lambda f, g: X.memory_limiter_findings(f, g)), MEMORY
    ),
    "rule_unbounded_paid_loop": Query(run([within(scoped.paid_loops), X.imports], lambda f, g: X.paid_loop_findings(f)), PAID),
}
