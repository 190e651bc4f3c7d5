"""Rules about what encloses a line: functions, try blocks and loops, as far as they reach.

All of them read the rows of :mod:`plumbline.operators.scopes`, which are bound once per file
and only in files that one of the rules could concern. A function's body is its interval of
lines, however long; a guard counts only if it encloses the call inside the same function.
"""

from __future__ import annotations

from plumbline.functions import severity as S
from plumbline.operators.scopes import EACH
from plumbline.plans import patterns as P
from plumbline.plans import rules as R
from plumbline.plans import vocabulary as V
from plumbline.plans.detect import fact, let, lit, rlike

SEV = {name: i for i, name in enumerate(S.SEVERITIES)}
MODULE = "regexp_replace(substring_index(path, '/', -1), '[.][^.]+$', '')"
SCRIPT = r"\.(ts|js|mjs|cjs)$"
SOURCE = r"\.(py|js|ts|tsx|jsx|mjs|cjs|rb|go)$"
NOT_OWN = r"(test|spec|conftest|fixtures?)"


def _own(rule: str, line: str, text: str) -> str:
    return fact("own", lit(rule), line, text, str(SEV[R.BY_ID[rule].severity]))


def _gate(gates: list[str], rows: str) -> tuple[str, str]:
    """(condition for a file, its rows under that condition)."""
    condition = "(" + " and ".join(gates) + ")"
    return condition, f"case when {condition} then {rows} end"


#: Lines of a scope, and the pieces outside all functions.
BODY = "array_join(slice(lines, s.start, s.stop - s.start + 1), '\\n')"
TOP_LEVEL = "array_join(transform(filter(ps, p -> p.func = 0), p -> p.text), '\\n')"
LINE = "element_at(lines, p.start)"


def line_in(pattern: str) -> str:
    """The line of the first match in a piece, which may hold a template over several lines."""
    head = f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else f"(?:{pattern})"
    before = f"regexp_extract(p.text, {lit(r'^([\s\S]*?)' + head)}, 1)"
    return f"(p.start + char_length({before}) - char_length(replace({before}, '\\n', '')))"


# Parsing without a guard. A call in an arrow without a body has left the try it stands in.
LITERAL_PARSE = P.PARSE + r"\s*" + V.QUOTE
IN_ARROW = r"=>[^\n]*" + P.PARSE
FIELD_IN_TEXT = r"^\s*:(?:meth|func|class|mod)"


def unguarded_parse() -> tuple[str, str]:
    hit = (
        f"{rlike('p.text', P.PARSE)} and not {rlike(LINE, LITERAL_PARSE)} and not {rlike('p.text', FIELD_IN_TEXT)} "
        f"and (not p.guarded or {rlike('p.text', IN_ARROW)})"
    )
    return _gate(
        [
            rlike("path", r"\.(py|js|ts|mjs|cjs)$"),
            f"not {rlike('path', r'(test|spec|conftest|[.]min[.])|(^|/)(generated|[.]prisma|node_modules)/')}",
            rlike("dense", P.PARSE),
            f"not {rlike('dense', r'def +loads *[(]')}",
        ],
        f"slice(transform(filter(ps, p -> {hit}), p -> {_own('a04-unguarded-json-parse', 'p.start', LINE)}), 1, 1)",
    )


# Look first, then write: the row is looked up and written in one function.
INSERT = r"(?i)INSERT\s+INTO\s+[\"'`]?(\w+)"
FIND = r"\.(\w+)\s*\.\s*(?:findUnique|findFirst)\s*\("
SETTLED = "(?i)ON ?CONFLICT|ON ?DUPLICATE ?KEY|except[^:]*IntegrityError"


def check_then_act() -> tuple[str, str]:
    """Hits by function and table, and the functions whose body races on a table; joined later."""
    quote = "[\"`]?"
    raced = (
        f"not {rlike('body', SETTLED)} and body rlike concat('(?i)SELECT[^;]{{1,200}}FROM +{quote}', t, '\\\\b[^;]{{0,160}}\\\\bWHERE\\\\b') "
        f"and body rlike concat('(?i)UPDATE +{quote}', t, '\\\\b[^;]{{0,80}}\\\\bSET\\\\b')"
    )
    found = (
        "body rlike '\\\\bif\\\\s*[(]' and not body rlike concat('[.]', t, '\\\\s*[.]\\\\s*upsert\\\\s*[(]') "
        "and not body rlike '[$]\\\\s*transaction\\\\s*[(]' and body rlike concat('[.]', t, '\\\\s*[.]\\\\s*(create|update)\\\\s*[(]')"
    )
    parts = []
    for kind, pattern, test in (("sql", INSERT, raced), ("orm", FIND, found)):
        table = f"regexp_extract(p.text, {lit(pattern)}, 1)"
        key = lambda func, t: f"concat('{kind}:', {func}, ':', {t})"  # noqa: E731, B023
        shown = f"concat('INSERT INTO ', {table})" if kind == "sql" else LINE
        line = line_in(pattern)
        parts.append(f"transform(filter(ps, p -> {rlike('p.text', pattern)}), p -> {fact('act', key('p.func', table), line, shown)})")
        tables = f"filter(array_distinct(regexp_extract_all(body, {lit(pattern)}, 1)), t -> {test})"
        races = f"transform({tables}, t -> {fact('race', key('f', 't'))})"
        parts.append(f"flatten(transform(filter(fs, s -> s.kind = 'function'), s -> {let('body', BODY, let('f', 's.id', races))}))")
        parts.append(let("body", TOP_LEVEL, let("f", "0", races)))
    return _gate(
        [rlike("path", SOURCE), f"not {rlike('path', NOT_OWN)}", f"({rlike('dense', INSERT)} or {rlike('dense', FIND)})"],
        f"concat({', '.join(parts)})",
    )


# Access is taken away, but the sessions that have it go on.
TAKES_ACCESS = (
    r"(?i)^\w*(?:change|reset|replace|rotate)\w*password\w*$|^(?:disable|deactivate|suspend|ban)\w*$"
    r"|^\w*(?:revoke|withdraw|remove)\w*access\w*$|^\w*lock\w*account\w*$"
)
ENDS_SESSION = V.either(
    V.named_call("revoke destroy invalidate kill end expire delete clear drop", "session cookie token"),
    V.named_call("sign log", "out everywhere all"),
    V.part("session-epoch session-version token-version"),
    r"\.\s*delete\s*\(\s*\w*(?i:cookie|session)\w*\s*[,)]",
)
EXPORTED_FUNCTION = r"\bexport\s+(?:async\s+)?function\s+(\w+)\s*\("


def session_revoke_missing() -> tuple[str, str]:
    name = f"regexp_extract(s.text, {lit(EXPORTED_FUNCTION)}, 1)"
    hit = f"s.kind = 'function' and {rlike('s.text', EXPORTED_FUNCTION)} and {rlike(name, TAKES_ACCESS)} and not {rlike(BODY, ENDS_SESSION)}"
    return _gate(
        [rlike("path", r"\.(ts|js|mjs)$"), rlike("dense", "(?i)session|oturum"), rlike("dense", EXPORTED_FUNCTION)],
        f"transform(filter(fs, s -> {hit}), s -> {_own('int-session-revoke-missing', 's.start', name)})",
    )


# Server actions.
USE_SERVER = r"(?m)^\s*[\"']use server[\"']\s*;?"
PRE_AUTH_PATH = (
    "(?i)(?:^|/)(?:"
    + V.listed("signin signup login logout logoff register kayit giris cikis verify confirm invite davet accept onboarding password").replace("sign", "sign-?").replace("log", "log-?")
    + r"|(?:forgot|reset|new)-password|verify-email|magic-link)(?:[/.-]|$)"
)
PRE_AUTH_NAME = (
    rf"^(?:(?:sign|log)(?:In|Up|Out)|{V.listed('register request reset forgot verify confirm accept resend')})"
    r"|(?:Password(?:Reset|Forgot)|(?:Reset|Forgot)Password|VerifyEmail|Invite|(?:Sign|Log)(?:in|up|out))\w*$"
)
ONE_TIME = r"(?i:\btoken\b[^;]{0,80}(?:hash|compare|equal|find(?:unique|first))|\b(?:used|expires)_?at\b)"
BYPASS = V.part("service-role bypassrls neondb-owner security-definer supabase-service")
EXPORTED = r"\bexport\s+(?:async\s+function\s+\w+|const\s+\w+\s*=\s*async\s*\()"


def server_actions() -> tuple[str, str]:
    shown = f"regexp_extract(s.text, {lit(EXPORTED)}, 0)"
    name = f"regexp_extract({shown}, '(?:function|const)\\\\s+(\\\\w+)', 1)"
    level = f"case when {rlike('clean', BYPASS)} then {SEV['high']} else {SEV['medium']} end"
    hit = f"s.kind = 'function' and {rlike('s.text', EXPORTED)} and not {rlike(name, PRE_AUTH_NAME)} and not {rlike(BODY, ONE_TIME)}"
    return _gate(
        [rlike("path", r"\.(ts|tsx|js|jsx|mjs)$"), rlike("dense", USE_SERVER), rlike("dense", P.DB_ACCESS), f"not {rlike('path', PRE_AUTH_PATH)}"],
        f"transform(filter(fs, s -> {hit}), s -> {fact('action', name, 's.start', shown, level)})",
    )


# A session without a bound account falls through to a default identity.
BINDING = r"(?i:\bif\s*\(\s*\w+\?\.\s*\w*(?:account|binding|kind|role|subject|type)\w*)"
_IDENTITY = V.listed("id email role actor user")
IDENTITY_OUT = V.either(rf"\breturn\s*\{{[^}}]*\b(?:{_IDENTITY})\b", rf"\bprocess\s*\.\s*env\b[^}}]*\b(?:{_IDENTITY})\b")
REJECTED = V.either(
    r"(?i:!\s*\w+\??\.\s*\w*(?:account|binding|kind|role|subject|type)\w*)[^;}]*\breturn\s+(?:null|undefined|false)\b",
    rf"\breturn\s+{V.QUOTE}(?i:viewer|guest|anonymous|anon|public|none|nobody|unauthenticated|read[-_]?only){V.QUOTE}",
)
NAMED_FUNCTION = r"\bfunction\s+(\w+)"


def unbound_sessions() -> tuple[str, str]:
    at = f"regexp_instr(body, {lit(BINDING)})"
    shown = f"regexp_extract(body, {lit(BINDING)}, 0)"
    rest = f"substring(body, {at} + char_length({shown}))"
    line = f"(s.start + size(split(substring(body, 1, {at} - 1), '\\n')) - 1)"
    hit = f"{rlike('body', BINDING)} and not {rlike('body', REJECTED)} and {rlike(rest, IDENTITY_OUT)}"
    row = f"case when {hit} then array({fact('unbound', f'regexp_extract(s.text, {lit(NAMED_FUNCTION)}, 1)', line, shown)}) end"
    named = f"filter(fs, s -> s.kind = 'function' and {rlike('s.text', NAMED_FUNCTION)})"
    return _gate(
        [rlike("path", SCRIPT), rlike("dense", BINDING)],
        f"flatten(array_compact(transform({named}, s -> {let('body', BODY, row)})))",
    )


# Functions that count or look for records, and know of their kind.
COUNTS = r"\bfunction\s+(?:(?:has(?:Any|Some)|count)\w*|\w*Exists)\b"
KIND_WORD = r"\b(?:subject_?[kK]ind|kind|type|category|role|rol|tur)\b"


def kind_aware() -> tuple[str, str]:
    hit = f"s.kind = 'function' and {rlike('s.text', COUNTS)} and {rlike(BODY, KIND_WORD)}"
    return _gate(
        [rlike("path", SCRIPT), rlike("dense", COUNTS)],
        f"transform(filter(fs, s -> {hit}), s -> {fact('kind_aware', f'regexp_extract(s.text, {lit(NAMED_FUNCTION)}, 1)')})",
    )


# Calls that cost money, in a loop of their function.
ENTRY = r"\b__name__\s*==\s*['\"]__main__['\"]|(?m:^\s*(?:def|func)\s+main\s*\()"


def paid_loops() -> tuple[str, str]:
    """With no bound from 7 lines above the loop to 7 lines below the call."""
    loop = f"case when p.loop > 0 then p.loop when {rlike('p.text', EACH)} then p.start else 0 end"
    start = f"greatest({loop} - 7, 1)"
    window = f"array_join(slice(lines, {start}, p.start + 8 - {start}), '\\n')"
    hit = f"{rlike('p.text', P.PAID_API)} and {loop} > 0 and not {rlike(window, P.C.BOUNDED)}"
    entry = f"case when {rlike('clean', ENTRY)} then 1 else 0 end"
    return _gate(
        [rlike("path", r"\.(py|js|ts|mjs|cjs|rb|go)$"), f"not {rlike('path', NOT_OWN)}", rlike("dense", P.PAID_API)],
        f"slice(transform(filter(ps, p -> {hit}), p -> {fact('paid_loop', MODULE, 'p.start', LINE, entry)}), 1, 1)",
    )


# Values from assignment to assignment, into calls and to file sinks.
NAME = r"[A-Za-z_$][\w$]*"
ASSIGN = rf"(?:\b(?:const|let|var)\s+|^\s*)({NAME})\s*(?::[^=\n]+)?=\s*([^=>\s][^\n]*)"
KILLED = rf"^(?:await\s+)?(?:{NAME}\s*\.\s*)*" + P.C.MADE_SAFE
CALL_WITH = rf"({NAME})\s*\(([^()]*)\)"
FUNCTION_NAME = rf"\b(?:function|const|let|var)\s+({NAME})"
PARAMETER_LIST = r"\(([^()]*)\)"
SINK_ARGUMENT = P.FS_CALL + r"\s*([^,)\n]*)"


def value_flow() -> tuple[str, str]:
    """Assignments, parameters, calls, functions that read the caller's data, and file sinks.

    Keys begin with the chain of functions around the piece, since a name may be any of theirs.
    """
    target, value = f"regexp_extract(p.text, {lit(ASSIGN)}, 1)", f"regexp_extract(p.text, {lit(ASSIGN)}, 2)"
    level = f"case when {rlike(value, KILLED)} then 2 when {rlike(value, P.C.FROM_CALLER)} then 1 else 0 end"
    name = f"regexp_extract(s.text, {lit(FUNCTION_NAME)}, 1)"
    named = f"s.kind = 'function' and {rlike('s.text', FUNCTION_NAME)}"
    calls = f"arrays_zip(regexp_extract_all(p.text, {lit(CALL_WITH)}, 1), regexp_extract_all(p.text, {lit(CALL_WITH)}, 2))"
    argument = f"regexp_extract(p.text, {lit(SINK_ARGUMENT)}, 2)"
    parts = [
        f"transform(filter(ps, p -> {rlike('p.text', ASSIGN)}), p -> {fact('flow', f'concat(p.chain, {lit("|")}, {target})', 'p.start', value, level)})",
        f"flatten(transform(filter(ps, p -> {rlike('p.text', CALL_WITH)}), p -> transform({calls}, z -> {fact('pass', f'concat(p.chain, {lit("|")}, z[{lit("0")}])', 'p.start', 'z[' + lit('1') + ']')})))",
        f"transform(filter(fs, s -> {named}), s -> {fact('param', name, 's.start', f'regexp_extract(s.text, {lit(PARAMETER_LIST)}, 1)', 's.id')})",
        f"transform(filter(fs, s -> {named} and {rlike(BODY, P.C.FROM_CALLER)}), s -> {fact('reads_caller', name)})",
        f"transform(filter(ps, p -> {rlike('p.text', P.FS_CALL)} and not {rlike(argument, P.C.MADE_SAFE)}), p -> {fact('sink', f'concat(p.chain, {lit("|")}, {argument})', 'p.start', LINE)})",
    ]
    return _gate(
        [rlike("path", P.CODE), f"not {rlike('path', '(test|spec|fixtures?)')}", f"({rlike('dense', P.C.FROM_CALLER)} or {rlike('dense', P.FS_CALL)} and {rlike('dense', P.FS_IMPORT)})"],
        f"concat({', '.join(parts)})",
    )


RULES = [unguarded_parse, check_then_act, session_revoke_missing, server_actions, unbound_sessions, kind_aware, paid_loops, value_flow]


def concerned() -> str:
    """Whether one of the rules could concern a file."""
    return " or ".join(condition for condition, _ in (rule() for rule in RULES))


def scoped_facts(*rules) -> str:
    """Facts of the rules (all by default) from the file's scopes, the column ``sc``."""
    made = [rule() for rule in rules or RULES]
    rows = "flatten(array_compact(array(" + ", ".join(r for _, r in made) + ")))"
    bound = let("ps", "filter(sc, r -> not r.scope)", let("fs", "filter(sc, r -> r.scope)", rows))
    return f"case when not is_test and ({' or '.join(c for c, _ in made)}) then {bound} end"
