"""SQL twins of the rules about enclosing scopes, by window functions and interval containment.

Braces are numbered in order; one that opens at a depth is closed by the next one of that
depth. In Python a header reaches to the next line that is not further in. A piece of code
belongs to every interval that holds it, and what counts is the innermost function's.
"""

from __future__ import annotations

import re

from plumbline.operators import scopes as S
from plumbline.plans import scoped as X
from plumbline.workloads import seed

q = seed.quote


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"

_TOKEN = "(?:[^{}\\n\"'`]|\"(?:[^\"\\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\\n]|\\\\.)*'|`(?:[^`\\\\]|\\\\[\\s\\S])*`)+|[{}\\n\"'`]"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def scope_sql(where: str, prefix: str = "", on: str = "NOT is_test") -> str:
    """iv(project, path, a, b, start, stop, head, kind), pc(project, path, tok, line, text, func, guarded, loop), fb: functions with bodies.

    ``a`` and ``b`` are positions that pieces are compared with: tokens, or lines in Python.
    """
    head = "h"
    out = f"""
src AS (SELECT * FROM files WHERE {on} AND {where}),
t0 AS (SELECT project, path, unnest(t) AS t, generate_subscripts(t, 1) AS i
       FROM (SELECT project, path, regexp_extract_all(clean, {q(_TOKEN)}) AS t FROM src WHERE NOT regexp_matches(path, '[.]py$'))),
t1 AS (SELECT *, CAST(1 + coalesce(sum(length(t) - length(replace(t, chr(10), ''))) OVER (PARTITION BY project, path ORDER BY i {_BEFORE}), 0) AS INTEGER) AS line,
              sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY project, path ORDER BY i) AS depth FROM t0),
t2 AS (SELECT *, coalesce(string_agg(t, '') OVER (PARTITION BY project, path, line ORDER BY i {_BEFORE}), '') AS h FROM t1),
br AS (SELECT *, CASE t WHEN '{{' THEN depth ELSE depth + 1 END AS lvl FROM t2 WHERE t IN ('{{', '}}')),
b1 AS (SELECT *, lead(i) OVER w AS b, lead(line) OVER w AS stop FROM br WINDOW w AS (PARTITION BY project, path, lvl ORDER BY i)),
ls AS (SELECT cl.*, length(regexp_extract(text, '^[ \t]*')) AS ind FROM cl JOIN (SELECT project, path FROM src WHERE regexp_matches(path, '[.]py$')) USING (project, path)
       WHERE trim(text) <> ''),
iv AS (
  SELECT project, path, i AS a, b, line AS start, stop, h AS head,
    CASE WHEN {rx(head, S.TRY)} THEN 'try' WHEN {rx(head, S.RESCUE)} THEN 'rescue' WHEN {rx(head, S.ARROW)} THEN 'function'
         WHEN {rx(head, S.PARAMETERS)} AND NOT {rx(head, S.CONTROL)} THEN 'function' WHEN {rx(head, S.LOOP)} THEN 'loop'
         WHEN {rx(head, S.CLASS)} THEN 'class' ELSE 'block' END AS kind
  FROM b1 WHERE t = '{{'
  UNION ALL
  SELECT h.project, h.path, h.line_no, coalesce(min(n.line_no), 1000000), h.line_no, coalesce(min(n.line_no) - 1, 1000000), h.text,
    CASE WHEN {rx('h.text', S.PY_DEF)} THEN 'function' WHEN {rx('h.text', S.PY_CLASS)} THEN 'class' WHEN {rx('h.text', S.PY_TRY)} THEN 'try'
         WHEN {rx('h.text', S.PY_LOOP)} THEN 'loop' ELSE 'block' END
  FROM ls h LEFT JOIN ls n ON n.project = h.project AND n.path = h.path AND n.line_no > h.line_no AND n.ind <= h.ind
  WHERE {rx('h.text', S.PY_HEADER)} GROUP BY ALL),
p0 AS (SELECT project, path, i AS tok, line, t AS text, false AS py FROM t1 WHERE t NOT IN ('{{', '}}', chr(10)) AND trim(t) <> ''
       UNION ALL SELECT project, path, line_no, line_no, text, true FROM ls),
p1 AS (SELECT p.*, coalesce(max(v.a) FILTER (WHERE v.kind = 'function'), 0) AS func, coalesce(max(v.a) FILTER (WHERE v.kind IN ('function', 'class')), 0) AS wall
       FROM p0 p LEFT JOIN iv v ON v.project = p.project AND v.path = p.path AND v.b > p.tok AND (v.a < p.tok OR p.py AND v.a = p.tok AND v.kind IN ('function', 'class', 'try')) GROUP BY ALL),
pc AS (SELECT p.*, count(v.a) FILTER (WHERE v.kind IN ('try', 'rescue') AND v.a > p.wall) > 0 AS guarded,
              coalesce(max(v.start) FILTER (WHERE v.kind = 'loop' AND v.a > p.func OR v.kind = 'function' AND v.a = p.func AND {rx('v.head', S.EACH)}), 0) AS loop
       FROM p1 p LEFT JOIN iv v ON v.project = p.project AND v.path = p.path AND v.b > p.tok AND (v.a < p.tok OR p.py AND v.a = p.tok AND v.kind IN ('function', 'class', 'try')) GROUP BY ALL),
fb AS (SELECT f.project, f.path, f.a AS func, f.start, f.stop, f.head,
              (SELECT string_agg(x.text, chr(10) ORDER BY x.line_no) FROM cl x WHERE x.project = f.project AND x.path = f.path AND x.line_no BETWEEN f.start AND f.stop) AS body
       FROM iv f WHERE kind = 'function'
       UNION ALL SELECT project, path, 0, 1, 1, '', string_agg(text, chr(10) ORDER BY tok) FROM pc WHERE func = 0 GROUP BY project, path)
"""
    # Two of these in one statement need names of their own.
    return re.sub(r"\b(src|t0|t1|t2|br|b1|ls|iv|p0|p1|pc|fb)\b(?= AS \(| WHERE|\)| [a-z] |,| USING| ON| JOIN| LEFT| GROUP| WINDOW)", prefix + r"\1", out) if prefix else out


LINE_TEXT = "(SELECT x.text FROM cl x WHERE x.project = p.project AND x.path = p.path AND x.line_no = p.line)"


def parse_sql() -> str:
    """r(project, path, line, snippet) of calls that parse without a guard."""
    where = f"regexp_matches(path, '[.](py|js|ts|mjs|cjs)$') AND NOT regexp_matches(path, '(test|spec|conftest|[.]min[.])|(^|/)(generated|[.]prisma|node_modules)/') AND {rx('clean', X.P.PARSE)} AND NOT regexp_matches(clean, 'def +loads *[(]')"
    return f"""{scope_sql(where)},
r AS (SELECT project, path, line, {LINE_TEXT} AS snippet FROM pc p WHERE {rx('text', X.P.PARSE)} AND (NOT guarded OR {rx('text', X.IN_ARROW)})
      AND NOT {rx(LINE_TEXT, X.LITERAL_PARSE)} AND NOT {rx('text', X.FIELD_IN_TEXT)}
      QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY tok) = 1)"""


def upsert_sql() -> str:
    insert = X.INSERT.replace("(?i)INSERT\\s+INTO", "[Ii][Nn][Ss][Ee][Rr][Tt]\\s+[Ii][Nn][Tt][Oo]")
    ahead = f"regexp_extract(text, {q('^([\\s\\S]*?)(?:' + insert + ')')}, 1)"
    where = f"{rx('path', X.SOURCE)} AND NOT {rx('path', X.NOT_OWN)} AND ({rx('clean', X.INSERT)} OR {rx('clean', X.FIND)})"
    return f"""{scope_sql(where)},
k AS (SELECT p.project, p.path, p.tok, p.text, p.func, b.body, regexp_extract(text, {q(X.INSERT)}, 1) AS t, regexp_extract(text, {q(X.FIND)}, 1) AS a,
             line + length({ahead}) - length(replace({ahead}, chr(10), '')) AS li, line AS line, {LINE_TEXT} AS lt FROM pc p JOIN fb b USING (project, path, func)),
r AS (SELECT DISTINCT project, path, li AS line, 'INSERT INTO ' || t AS snippet FROM k WHERE t <> '' AND NOT {rx('body', X.SETTLED)}
   AND regexp_matches(body, '(?i)SELECT[^;]{{1,200}}FROM +["`]?' || t || '\\b[^;]{{0,160}}\\bWHERE\\b')
   AND regexp_matches(body, '(?i)UPDATE +["`]?' || t || '\\b[^;]{{0,80}}\\bSET\\b')
   UNION ALL
   SELECT DISTINCT project, path, line, lt FROM k WHERE a <> '' AND regexp_matches(body, '\\bif\\s*[(]')
   AND NOT regexp_matches(body, '[.]' || a || '\\s*[.]\\s*upsert\\s*[(]') AND NOT regexp_matches(body, '[$]\\s*transaction\\s*[(]')
   AND regexp_matches(body, '[.]' || a || '\\s*[.]\\s*(create|update)\\s*[(]'))"""


def revoke_sql() -> str:
    where = f"regexp_matches(path, '[.](ts|js|mjs)$') AND regexp_matches(clean, '(?i)session|oturum')"
    name = f"regexp_extract(head, {q(X.EXPORTED_FUNCTION)}, 1)"
    return f"""{scope_sql(where)},
r AS (SELECT project, path, start AS line, {name} AS snippet FROM fb WHERE func > 0 AND {rx('head', X.EXPORTED_FUNCTION)} AND {rx(name, X.TAKES_ACCESS)}
      AND NOT {rx('body', X.ENDS_SESSION)})"""


def action_sql() -> str:
    """a2(project, path, clean, d, line): exported actions of server modules."""
    where = f"regexp_matches(path, '[.](ts|tsx|js|jsx|mjs)$') AND {rx('clean', X.USE_SERVER)} AND {rx('clean', X.P.DB_ACCESS)} AND NOT {rx('path', X.PRE_AUTH_PATH)}"
    shown = f"regexp_extract(head, {q(X.EXPORTED)})"
    return f"""{scope_sql(where)},
a2 AS (SELECT fb.project, fb.path, s.clean, {shown} AS d, start AS line FROM fb JOIN src s USING (project, path) WHERE func > 0 AND {rx('head', X.EXPORTED)}
   AND NOT {rx(f"regexp_extract({shown}, '(?:function|const)" + chr(92) + "s+(" + chr(92) + "w+)', 1)", X.PRE_AUTH_NAME)} AND NOT {rx('body', X.ONE_TIME)})"""


def unbound_sql() -> str:
    """u(project, path, n, line, m): functions in which a session without an account goes on."""
    lead = q("^([\\s\\S]*?)(?:" + X.BINDING + ")")
    return f"""{scope_sql(f"regexp_matches(path, '[.](ts|js|mjs|cjs)$') AND {rx('clean', X.BINDING)}")},
u0 AS (SELECT *, regexp_extract(head, {q(X.NAMED_FUNCTION)}, 1) AS n, regexp_extract(body, {q(X.BINDING)}) AS m, regexp_extract(body, {lead}, 1) AS ahead FROM fb
       WHERE func > 0 AND {rx('head', X.NAMED_FUNCTION)} AND {rx('body', X.BINDING)}),
u AS (SELECT project, path, n, start + length(ahead) - length(replace(ahead, chr(10), '')) AS line, m FROM u0
      WHERE NOT {rx('body', X.REJECTED)} AND {rx('substr(body, CAST(length(ahead) + length(m) + 1 AS BIGINT))', X.IDENTITY_OUT)})"""


def kind_sql() -> str:
    """k(project, fn): functions that count or look for records and know of their kind."""
    return f"""{scope_sql(f"regexp_matches(path, '[.](ts|js|mjs|cjs)$') AND {rx('clean', X.COUNTS)}")},
k AS (SELECT DISTINCT project, regexp_extract(head, {q(X.NAMED_FUNCTION)}, 1) AS fn FROM fb WHERE func > 0 AND {rx('head', X.COUNTS)} AND {rx('body', X.KIND_WORD)})"""


def paid_sql() -> str:
    """f(project, path, line, text, clean, md): first paid call under a loop without a bound."""
    where = f"regexp_matches(path, '[.](py|js|ts|mjs|cjs|rb|go)$') AND NOT {rx('path', X.NOT_OWN)} AND {rx('clean', X.P.PAID_API)}"
    return f"""{scope_sql(where)},
h AS (SELECT p.*, {LINE_TEXT} AS lt, CASE WHEN loop > 0 THEN loop WHEN {rx('text', S.EACH)} THEN line ELSE 0 END AS lp FROM pc p WHERE {rx('text', X.P.PAID_API)}),
g AS (SELECT h.project, h.path, h.tok, h.line, h.lt, (SELECT string_agg(x.text, chr(10) ORDER BY x.line_no) FROM cl x WHERE x.project = h.project AND x.path = h.path
        AND x.line_no BETWEEN greatest(h.lp - 7, 1) AND h.line + 7) AS win FROM h WHERE lp > 0),
f AS (SELECT g.*, s.clean, regexp_replace(split_part(g.path, '/', -1), '[.][^.]+$', '') AS md FROM g JOIN src s USING (project, path) WHERE NOT {rx('win', X.P.C.BOUNDED)}
      QUALIFY row_number() OVER (PARTITION BY g.project, g.path ORDER BY tok) = 1)"""


def interval_sql() -> str:
    """The interval table itself, of all script and Python files."""
    return f"""{scope_sql("regexp_matches(path, '[.](py|ts|tsx|js|jsx|mjs|cjs)$')")}
SELECT iv.project, iv.path, iv.kind, CAST(iv.start AS INTEGER) AS start FROM iv WHERE kind <> 'block'"""


def flow_sql() -> str:
    """sk(project, path, line, snippet): file sinks that the caller's data reaches; needs im(project, path, k)."""
    where = (
        f"{rx('path', X.P.CODE)} AND NOT regexp_matches(path, '(test|spec|fixtures?)') "
        f"AND ({rx('clean', X.P.C.FROM_CALLER)} OR {rx('clean', X.P.FS_CALL)} AND {rx('clean', X.P.FS_IMPORT)})"
    )
    strings, members = q("\"[^\"]*\"|'[^']*'"), q(r"\.\s*[A-Za-z_$][\w$]*")
    names = lambda text: f"unnest(list_distinct(regexp_extract_all(regexp_replace(regexp_replace({text}, {strings}, ' ', 'g'), {members}, ' ', 'g'), {q(X.NAME)})))"
    module = "regexp_replace(split_part({0}, '/', -1), '[.][^.]+$', '')"
    callee, parameter, argument = q(rf"({X.NAME})\s*\("), q(rf"^\s*({X.NAME})"), q(rf"^\s*({X.NAME})\s*$")
    return f"""{scope_sql(where)},
ch AS (SELECT project, path, tok, 0 AS func FROM p0
       UNION ALL SELECT p.project, p.path, p.tok, v.a FROM p0 p JOIN iv v ON v.project = p.project AND v.path = p.path AND v.kind = 'function' AND v.a < p.tok AND v.b > p.tok),
fa AS (SELECT project, path, tok, func, regexp_extract(text, {q(X.ASSIGN)}, 1) AS dst, regexp_extract(text, {q(X.ASSIGN)}, 2) AS val FROM pc WHERE {rx('text', X.ASSIGN)}),
fk AS (SELECT * FROM fa WHERE NOT {rx('val', X.KILLED)}),
fn AS (SELECT *, {names('val')} AS name FROM fk),
rd AS (SELECT DISTINCT project, regexp_extract(head, {q(X.FUNCTION_NAME)}, 1) AS callee FROM fb WHERE func > 0 AND {rx('head', X.FUNCTION_NAME)} AND {rx('body', X.P.C.FROM_CALLER)}),
fc AS (SELECT project, path, func, dst, unnest(regexp_extract_all(val, {callee}, 1)) AS callee FROM fk),
pm0 AS (SELECT project, path, func, regexp_extract(head, {q(X.FUNCTION_NAME)}, 1) AS callee, string_split(regexp_extract(head, {q(X.PARAMETER_LIST)}, 1), ',') AS l
        FROM fb WHERE func > 0 AND {rx('head', X.FUNCTION_NAME)}),
pm1 AS (SELECT project, path, func, callee, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM pm0),
pm AS (SELECT project, path, func, callee, pos, regexp_extract(x, {parameter}, 1) AS param FROM pm1),
ps0 AS (SELECT project, path, tok, unnest(regexp_extract_all(text, {q(X.CALL_WITH)}, 1)) AS callee, unnest(regexp_extract_all(text, {q(X.CALL_WITH)}, 2)) AS args FROM pc),
ps1 AS (SELECT project, path, tok, callee, unnest(string_split(args, ',')) AS arg, generate_subscripts(string_split(args, ','), 1) AS pos FROM ps0),
mt AS (SELECT s.project, s.path, s.tok, s.arg, m.path AS tp, m.func AS tf, m.param AS tn FROM ps1 s JOIN pm m ON m.project = s.project AND m.callee = s.callee AND m.pos = s.pos
       WHERE m.param <> '' AND (m.path = s.path OR EXISTS (SELECT 1 FROM im WHERE im.project = s.project AND im.path = s.path AND im.k = {module.format('m.path')}))),
ed AS (SELECT DISTINCT n.project, n.path, ch.func, n.name, n.path AS tp, n.func AS tf, n.dst AS tn FROM fn n JOIN ch USING (project, path, tok)
       UNION SELECT mt.project, mt.path, ch.func, regexp_extract(arg, {argument}, 1), tp, tf, tn FROM mt JOIN ch USING (project, path, tok)),
tt AS (SELECT project, path, func, dst AS name FROM fk WHERE {rx('val', X.P.C.FROM_CALLER)}
       UNION SELECT fc.project, fc.path, fc.func, fc.dst FROM fc JOIN rd USING (project, callee)
       UNION SELECT project, tp, tf, tn FROM mt WHERE {rx('arg', X.P.C.FROM_CALLER)} AND NOT {rx('arg', X.P.C.MADE_SAFE)}
       UNION SELECT ed.project, ed.tp, ed.tf, ed.tn FROM tt JOIN ed ON ed.project = tt.project AND ed.path = tt.path AND ed.func = tt.func AND ed.name = tt.name AND ed.name <> ''),
s0 AS (SELECT p.project, p.path, p.tok, p.line, {LINE_TEXT} AS snippet, regexp_extract(text, {q(X.SINK_ARGUMENT)}, 2) AS arg FROM pc p WHERE {rx('text', X.P.FS_CALL)}),
s1 AS (SELECT * FROM s0 WHERE NOT {rx('arg', X.P.C.MADE_SAFE)}),
s2 AS (SELECT *, {names('arg')} AS name FROM s1),
sk AS (SELECT project, path, line, snippet FROM s1 WHERE {rx('arg', X.P.C.FROM_CALLER)}
       UNION SELECT s2.project, s2.path, s2.line, s2.snippet FROM s2 JOIN ch USING (project, path, tok)
             JOIN tt ON tt.project = s2.project AND tt.path = s2.path AND tt.func = ch.func AND tt.name = s2.name)"""
