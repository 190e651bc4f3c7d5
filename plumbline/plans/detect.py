"""One pass over the corpus that turns files into facts, and the joins that follow.

``scan_facts`` reads every file once and emits small rows: hits of clauses, project
flags, helper definitions and calls, and the facts the cross-file rules need. All
later work (flags per project, helper closure, cross-file joins, scores) reads the
facts, never the corpus again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.literals import needs
from plumbline.operators.clean import clean_corpus
from plumbline.operators.graph import DEFINITION
from plumbline.operators.joins import spread_join
from plumbline.operators.lines import numbered, split_lines
from plumbline.operators.ordered import first_per_group
from plumbline.operators.scopes import scope_rows
from plumbline.plans import patterns as P
from plumbline.plans import rules as R
from plumbline.plans import vocabulary as V
from plumbline.session import cut_lineage

FINDING_COLUMNS = ["project", "rule_id", "file", "line", "snippet", "severity", "confidence", "note"]

# Helpers by kind: what their names speak of, and what their bodies do.
HELPER_SPECS = {
    "identity": (
        "(?i)" + V.listed("account actor admin auth caller client gate guard identity member org owner principal role session subject tenant user viewer workspace yonetici"),
        V.either(
            V.call("cookies headers getToken getServerSession currentUser"),
            V.member("req request", "cookies"),
            V.member("cookies", "get"),
            V.named_call("verify decode", "token jwt session"),
            V.member("jwt", "verify"),
            V.word("session authorization bearer clerk"),
            r"(?i:supabase)[^;]{0,40}\.\s*auth\s*\.",
        ),
    ),
    "gate": (
        rf"(?i)^(?:{V.listed('is has check verify validate assert ensure authorize kontrol')})\w*(?:{V.listed('auth hmac secret signature token verify webhook yetki')})",
        V.either(
            V.part("create-hmac timing-safe-equal verify-signature verify-sns"),
            V.member("crypto jwt", "verify"),
            V.word("jose"),
            V.method("compare"),
            r"={3}\s*",
            r"\bprocess\s*\.\s*env\s*\.\s*\w*(?:SECRET|TOKEN|KEY)\b",
            rf"\bheaders\s*\.\s*get\s*\(\s*{V.QUOTE}[^'\"`]*(?i:signature|secret|token)",
        ),
    ),
}
SPECS = list(HELPER_SPECS)

def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rlike(column: str, pattern: str) -> str:
    """Whether the column matches; of a whole file only if it holds a literal the pattern needs."""
    test = f"({column} rlike {lit(pattern)})"
    held = needs(pattern) if column == "dense" else None
    if held is None:
        return test
    return f"(({' or '.join(f'contains(low, {lit(h)})' for h in held)}) and {test})"


def fact(kind: str, key: str, line: str = "1", text: str = "null", level: str = "null") -> str:
    return (
        f"named_struct('kind', '{kind}', 'key', string({key}), 'line', int({line}), "
        f"'text', string({text}), 'level', int({level}))"
    )


def prepare(files: DataFrame) -> DataFrame:
    """project, path, content, clean, lines and numbered lines of each file."""
    path = T.posix(F.col("path"))
    tracked = F.col("tracked") if "tracked" in files.columns else F.lit(None).cast("boolean")
    base = files.select(
        "project", path.alias("path"), F.coalesce("content", F.lit("")).alias("content"), tracked.alias("tracked")
    )
    cleaned = clean_corpus(base).withColumn("is_test", T.is_test_path(F.col("path")))
    from plumbline.plans.scoped import concerned

    # Scopes are found once per file, and only where a rule or a helper could need them.
    needed = f"({HELPER_FILE}) or not is_test and ({concerned()})"
    return (
        cleaned.withColumn("dense", cut_tail(squeeze(F.col("clean"))))
        .withColumn("low", F.lower("dense"))
        .withColumn("lines", split_lines(F.col("clean")))
        .withColumn("nl", numbered(F.col("lines")))
        .withColumn("sc", F.expr(f"case when {needed} then {scope_rows('clean')} end"))
    )


# Longer than any bounded gap in a pattern, so a squeezed run still cannot be jumped.
LONGEST_GAP = 310


def squeeze(text: Column) -> Column:
    """Long whitespace runs cut down, with a line break kept where there was one.

    Blanked comments are most of many files. No pattern can tell a run of 310 blanks
    from a longer one, and whole-file tests then skip them.
    """
    # A run is looked at from its start only, so the work is linear in its length.
    inner = F.regexp_replace(text, f"(?<![ \\t])([ \\t]{{{LONGEST_GAP}}})[ \\t]++", "$1")
    return F.regexp_replace(inner, f"(?<!\\s)(\\s{{{LONGEST_GAP}}})\\s*\\n", "$1\n")


# More blanks than any pattern asks for at the end of a file.
TAIL = 64
BLANKS = " \t\n\x0b\f\r"


def cut_tail(text: Column) -> Column:
    """The blanks behind the last character cut down, with a line break kept where there was one.

    Nothing follows them, so no gap can end there and only their first few can be matched.
    """
    bare = F.rtrim(text, F.lit(BLANKS))
    tail = F.substring(text, F.char_length(bare) + 1, F.char_length(text))
    short = F.concat(bare, F.left(tail, F.lit(TAIL)), F.when(tail.contains("\n"), F.lit("\n")).otherwise(F.lit("")))
    return F.when(F.char_length(tail) > TAIL, short).otherwise(text)


def _surface_text(surface: str) -> str:
    return "content" if surface == "raw" else "dense"


def _file_test(t: P.Test, text: str) -> str | None:
    """Condition for tests decided by the file alone; None for others."""
    if t.scope == "path":
        cond = rlike("path", t.regex)
    elif t.scope == "file":
        cond = rlike(text, t.regex)
    elif t.scope == "tracked":
        return {"yes": "coalesce(tracked, false)", "no": "coalesce(not tracked, false)", "known": "(tracked is not null)"}[t.regex]
    else:
        return None
    return f"not {cond}" if t.negate else cond


def window_sql(before: int, after: int) -> str:
    start = f"greatest(e.line_no - {before}, 1)"
    return f"array_join(slice(lines, {start}, e.line_no + {after} - {start} + 1), '\\n')"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def heads_sql(pattern: str) -> str:
    """For each line of a file the nearest line at or above it that matches, else 0.

    Matching lines are found once; runs of the result are repeats of their numbers, so the
    work is linear in the length of the file.
    """
    marks = f"transform(filter(nl, h -> {rlike('h.text', pattern)}), h -> h.line_no)"
    runs = "transform(concat(array(0), m), (h, i) -> array_repeat(h, coalesce(try_element_at(m, i + 1), size(lines) + 1) - greatest(h, 1)))"
    return let("m", marks, f"flatten({runs})")


def function_sql(fallback: int, after: int) -> str:
    """From the nearest function head at or above the line, else ``fallback`` lines above."""
    head = "element_at(heads, e.line_no)"
    start = f"case when {head} > 0 then {head} else greatest(e.line_no - {fallback}, 1) end"
    return f"array_join(slice(lines, {start}, e.line_no + {after} - {start} + 1), '\\n')"


def once_per_file(tests: Sequence[P.Test], text: str, rows: str) -> str:
    """Bind what the line tests look up in the whole file: function heads and tainted names."""
    for name, regex in _taints(tests).items():
        rows = let(name, f"array_distinct(regexp_extract_all({text}, {lit(regex)}, 1))", rows)
    if any(t.scope == "func" for t in tests):
        rows = let("heads", heads_sql(P.FUNC_HEAD), rows)
    return rows


def _taints(tests: Sequence[P.Test]) -> dict[str, str]:
    return {f"taint{i}": rx for i, rx in enumerate(dict.fromkeys(t.regex for t in tests if t.scope == "taint"))}


def _line_test(t: P.Test, tests: Sequence[P.Test]) -> str:
    if t.scope == "line":
        cond = rlike("e.text", t.regex)
    elif t.scope == "window":
        cond = rlike(window_sql(t.before, t.after), t.regex)
    elif t.scope == "func":
        cond = rlike(function_sql(t.before, t.after), t.regex)
    elif t.scope == "taint":
        names = next(name for name, rx in _taints(tests).items() if rx == t.regex)
        cond = f"array_contains({names}, regexp_extract(e.text, {lit(t.arg)}, 1))"
    else:
        raise ValueError(t.scope)
    return f"not {cond}" if t.negate else cond


def _all(conds: Sequence[str]) -> str:
    return "(" + " and ".join(conds) + ")" if conds else "true"


LATE = ("flag", "helper")
LINE_COST = {"line": 0, "taint": 1, "window": 2, "func": 3}


def clause_facts(index: int, clause: P.Clause) -> str:
    """Hits of one clause in one file as an array of facts; null when the file is out.

    Path tests come first, then whole-file regexes (among them the hit pattern
    itself), so lines are looked at in the few files that can have a hit. Built as
    SQL text: one parse instead of thousands of calls into the JVM.
    """
    surface = R.BY_ID[clause.rule_id].surface
    text = _surface_text(surface)
    tests = [t for t in clause.where if t.scope not in LATE]
    early = [c for c in (_file_test(t, text) for t in sorted(tests, key=lambda t: t.scope != "path")) if c is not None]
    if surface != "all":
        early.insert(0, "not is_test")
    late = sorted((t for t in tests if t.scope in LINE_COST), key=lambda t: LINE_COST[t.scope])
    every = [*tests, *(t for level in clause.levels for t in level.when)]

    def level() -> str:
        expr = "null"
        for i in range(len(clause.levels) - 1, -1, -1):
            conds = [_file_test(t, text) or _line_test(t, every) for t in clause.levels[i].when]
            expr = f"case when {_all(conds)} then {i} else {expr} end" if conds else str(i)
        return expr

    if clause.hit is None:
        at, shown = "1", "path"
        if clause.at:
            at = f"coalesce(try_element_at(filter(nl, e -> {rlike('e.text', clause.at)}), 1).line_no, 1)"
            shown = f"try_element_at(lines, {at})"
        return f"case when {_all(early)} then array({fact('hit', str(index), at, shown, level())}) end"
    gate = [*early, rlike(text, "(?m)" + clause.hit)]
    keep = _all([rlike("e.text", clause.hit), *[_line_test(t, every) for t in late]])
    rows = f"transform(filter(nl, e -> {keep}), e -> {fact('hit', str(index), 'e.line_no', 'e.text', level())})"
    if any(lv.when for lv in clause.levels[-1:]):
        rows = f"filter({rows}, f -> f.level is not null)"
    if clause.per != "line":
        rows = f"slice({rows}, 1, 1)"
    return f"case when {_all(gate)} then {once_per_file(every, text, rows)} end"


def flag_facts() -> str:
    """Project flags this file raises."""
    raised = []
    for name, (on_path, off_path, on_text) in P.FLAGS.items():
        conds = []
        if on_path:
            conds.append(rlike("path", on_path))
        if off_path:
            conds.append("not " + rlike("path", off_path))
        # Test files count only for facts about the project's shape, never about its code.
        if on_text:
            conds += ["not is_test", rlike("dense", on_text)]
        raised.append(f"case when {_all(conds)} then {fact('flag', lit(name))} end")
    raised.append(f"case when tracked is not null then {fact('flag', lit('git'))} end")
    return "array_compact(array(" + ", ".join(raised) + "))"


CALLS = "array_distinct(regexp_extract_all({text}, '\\\\b(\\\\w+)\\\\s*\\\\(', 1))"


HELPER_FILE = f"{rlike('path', P.CODE)} and not {rlike('path', P.TESTISH)} and {rlike('dense', DEFINITION)}"


def helper_facts() -> str:
    """Definitions with gated names (level = signal bits) and calls of gated names.

    A definition is the header of a function scope, whose body is the scope, or a statement
    without one, such as an arrow or a wrapped function, whose body is the statement.
    """
    gated = lambda n: "(" + " or ".join(rlike(n, HELPER_SPECS[s][0]) for s in SPECS) + ")"
    named = lambda v: f"regexp_extract({v}, '(?:function|const)\\\\s+(\\\\w+)', 1)"

    def defined(rows: str, body: str) -> str:
        bits = " + ".join(f"case when {rlike('body', HELPER_SPECS[s][1])} then {1 << i} else 0 end" for i, s in enumerate(SPECS))
        called = f"array_join(filter({CALLS.format(text='body')}, n -> {gated('n')}), ' ')"
        of_one = let("body", body, fact("def", named("d.text"), "d.start", called, bits))
        return f"transform(filter(sc, d -> {rows} and {rlike('d.text', DEFINITION)} and {gated(named('d.text'))}), d -> {of_one})"

    scope = "array_join(slice(lines, d.start, d.stop - d.start + 1), '\\n')"
    # A statement may go on below; its end is the next semicolon.
    statement = "substring_index(array_join(slice(lines, d.start, 20), '\\n'), ';', 1)"
    functions, statements = defined("d.scope and d.kind = 'function'", scope), defined("not d.scope", statement)
    defs = f"case when {HELPER_FILE} then concat({functions}, {statements}) end"
    calls = (
        f"case when {rlike('path', P.CODE)} and not is_test then "
        f"transform(filter({CALLS.format(text='dense')}, n -> {gated('n')}), n -> {fact('call', 'n')}) end"
    )
    return f"flatten(array_compact(array({defs}, {calls})))"


def matches_sql(text: str, pattern: str) -> str:
    """SQL form of :func:`plumbline.operators.lines.matches_on`."""
    pat = lit(pattern)
    at = "(a.pos + char_length(z.piece))"
    return (
        f"aggregate(arrays_zip(split({text}, {pat}, -1) as piece, regexp_extract_all({text}, {pat}, 0) as value), "
        "named_struct('pos', 1, 'found', cast(array() as array<struct<column_no:int,value:string>>)), "
        f"(a, z) -> named_struct('pos', {at} + coalesce(char_length(z.value), 0), 'found', "
        f"case when z.value is null then a.found else array_append(a.found, named_struct('column_no', {at}, 'value', z.value)) end)).found"
    ).replace(" as piece", "").replace(" as value", "").replace("z.piece", "z['0']").replace("z.value", "z['1']")


def scan_facts(
    files: DataFrame,
    clauses: Sequence[P.Clause] | None = None,
    extractors: Sequence[str] = (),
    with_flags: bool = True,
    with_helpers: bool = True,
) -> DataFrame:
    """All facts of all files in one narrow pass: each file is read once.

    ``extractors`` are further SQL expressions giving arrays of facts.
    """
    chosen = list(enumerate(P.CLAUSES)) if clauses is None else [(P.CLAUSES.index(c), c) for c in clauses]
    parts = [clause_facts(i, c) for i, c in chosen]
    if with_flags:
        parts.append(flag_facts())
    if with_helpers:
        parts.append(helper_facts())
    parts += list(extractors)
    # Bounded groups keep each generated method small.
    chunks = [parts[i : i + 24] for i in range(0, len(parts), 24)]
    columns = [F.expr("flatten(array_compact(array(" + ", ".join(c) + ")))").alias(f"__f{n}") for n, c in enumerate(chunks)]
    packed = prepare(files).select("project", "path", *columns)
    every = F.expr("concat(" + ", ".join(f"__f{n}" for n in range(len(chunks))) + ")")
    # Outer, then filtered: a plain explode makes Spark test the arrays for emptiness
    # below, which would compute every expression twice.
    exploded = packed.select("project", "path", F.explode_outer(every).alias("f")).where(F.col("f").isNotNull())
    return exploded.select("project", "path", "f.*")


def project_flags(facts: DataFrame) -> DataFrame:
    """One row per project with its flags; at most one value per known flag."""
    return (
        facts.where(F.col("kind") == "flag").groupBy("project").agg(F.collect_set("key").alias("flags"))
    )


def helper_names(facts: DataFrame) -> DataFrame:
    """(project, spec, name) closed over calls, starting from definitions with a signal.

    Rounds go on until none adds a name; each looks at the calls of the newest names only.
    """
    defs = facts.where(F.col("kind") == "def")
    bits = F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(1 << i).alias("bit"), F.lit(HELPER_SPECS[s][0]).alias("gate")) for i, s in enumerate(SPECS)])
    per = defs.select("project", F.col("key").alias("name"), "text", "level", F.explode(bits).alias("s")).where(
        F.expr("name rlike s.gate")
    )
    known = cut_lineage(
        per.where(F.col("level").bitwiseAND(F.col("s.bit")) > 0)
        .select("project", F.col("s.spec").alias("spec"), "name")
        .distinct()
    )
    edges = cut_lineage(
        per.select("project", F.col("s.spec").alias("spec"), F.col("name").alias("caller"), F.explode(F.split("text", " ")).alias("name"))
        .where((F.col("name") != "") & (F.col("name") != F.col("caller")))
        .distinct()
    )
    fresh = known
    while not fresh.isEmpty():
        reached = spread_join(edges, fresh, ["project", "spec", "name"], "left_semi", spread_by=["caller"])
        callers = reached.select("project", "spec", F.col("caller").alias("name")).distinct()
        fresh = cut_lineage(callers.join(known, ["project", "spec", "name"], "left_anti"))
        known = known.unionByName(fresh)
    return known


def files_calling(facts: DataFrame, helpers: DataFrame) -> DataFrame:
    """(project, path, specs): which kinds of helper each file calls."""
    calls = facts.where(F.col("kind") == "call").select("project", "path", F.col("key").alias("name"))
    hit = spread_join(calls, helpers, ["project", "name"], "inner", spread_by=["path"])
    return hit.groupBy("project", "path").agg(F.collect_set("spec").alias("specs"))


def clause_dim(spark: SparkSession) -> DataFrame:
    """Severity, confidence and note per clause and level: static, a few hundred rows."""
    rows = [
        (str(i), n, c.rule_id, level.severity, level.confidence, c.note, c.per, c.redact)
        for i, c in enumerate(P.CLAUSES)
        for n, level in enumerate(c.levels)
    ]
    return spark.createDataFrame(
        rows, "key string, level int, rule_id string, severity string, confidence string, note string, per string, redact boolean"
    )


def _flag_sql(tests: Sequence[P.Test]) -> list[str]:
    out = []
    for t in tests:
        if t.scope in LATE:
            has = f"array_contains({'flags' if t.scope == 'flag' else 'specs'}, '{t.regex}')"
            out.append(f"not {has}" if t.negate else has)
    return out


def _late_filter() -> str:
    """Per clause: its flag and helper tests over the joined columns."""
    branches = [(i, _flag_sql(c.where)) for i, c in enumerate(P.CLAUSES)]
    cases = " ".join(f"when '{i}' then {_all(conds)}" for i, conds in branches if conds)
    return f"case key {cases} else true end"


def clause_findings(facts: DataFrame, flags: DataFrame, calling: DataFrame) -> DataFrame:
    """Hits that pass their project and helper tests, with severity and note."""
    spark = facts.sparkSession
    none = F.array().cast("array<string>")
    hits = facts.where(F.col("kind") == "hit")
    joined = spread_join(hits, flags, ["project"], "left", spread_by=["path", "line"])
    joined = joined.join(calling, ["project", "path"], "left").select(
        *hits.columns, F.coalesce("flags", none).alias("flags"), F.coalesce("specs", none).alias("specs")
    )
    kept = joined.where(_late_filter()).drop("flags", "specs")
    graded = kept.join(F.broadcast(clause_dim(spark)), ["key", "level"])
    shaped = graded.select(
        "project",
        "rule_id",
        F.col("path").alias("file"),
        "line",
        T.snippet(F.when(F.col("redact"), T.redact_literal(F.col("text"))).otherwise(F.col("text"))).alias("snippet"),
        "severity",
        "confidence",
        "note",
        "per",
    )
    # Tracked leftovers win over unignored ones; otherwise path order decides.
    order = [F.col("note") != "tracked", "note", "file", "line"]
    per_project = first_per_group(shaped.where(F.col("per") == "project"), ["project", "rule_id"], order)
    return shaped.where(F.col("per") != "project").unionByName(per_project).select(*FINDING_COLUMNS).distinct()


def project_findings(flags: DataFrame) -> DataFrame:
    """Findings about the project as a whole."""
    made = []
    for c in P.PROJECT_CLAUSES:
        row = (
            f"named_struct('rule_id', {lit(c.rule_id)}, 'file', {lit(c.file)}, 'line', 1, 'snippet', {lit(c.note)}, "
            f"'severity', '{c.level.severity}', 'confidence', '{c.level.confidence}', 'note', {lit(c.note)})"
        )
        made.append(f"case when {_all(_flag_sql(c.where))} then {row} end")
    found = F.expr("array_compact(array(" + ", ".join(made) + "))")
    return flags.select("project", F.explode(found).alias("f")).select("project", "f.*").select(
        *FINDING_COLUMNS
    )


def capabilities(flags: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(project, requirement) facts that hold."""
    known = ["js", "sql", "prisma", "npm", "python", "git"]
    have = flags.select("project", F.explode("flags").alias("requirement")).where(F.col("requirement").isin(known))
    if projects is None:
        return have
    live = projects.where(F.col("owned") & F.col("url").isNotNull()).select(
        F.col("name").alias("project"), F.lit("live").alias("requirement")
    )
    return have.unionByName(live)


def requirement_gaps(rules: DataFrame, projects: DataFrame, have: DataFrame) -> DataFrame:
    """First unmet requirement per rule and project: such a rule did not measure anything.

    Rules are a fixed table, so pairing them with projects is an array per project
    row rather than a cross join.
    """
    spark = rules.sparkSession
    needing = [(r.rule_id, list(r.requires)) for r in R.RULES if r.requires]
    if rules is not None and "requires" in rules.columns:
        needing = [(row.rule_id, list(row.requires)) for row in rules.where(F.size("requires") > 0).select("rule_id", "requires").collect()]
    if not needing:
        return spark.createDataFrame([], "project string, rule_id string, requirement string, reason string")
    held = have.groupBy("project").agg(F.collect_set("requirement").alias("held"))
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rule_id"), F.array(*[F.lit(x) for x in req]).alias("requires")) for r, req in needing]
    )
    joined = projects.select("project").distinct().join(held, "project", "left").select(
        "project", F.coalesce("held", F.array().cast("array<string>")).alias("held"), F.explode(pairs).alias("r")
    )
    unmet = F.try_element_at(F.filter("r.requires", lambda x: ~F.array_contains("held", x)), F.lit(1))
    reason = F.lit(None).cast("string")
    for key, why in R.REQUIREMENT_REASON.items():
        reason = F.when(F.col("requirement") == key, F.lit(why)).otherwise(reason)
    return (
        joined.select("project", F.col("r.rule_id").alias("rule_id"), unmet.alias("requirement"))
        .where(F.col("requirement").isNotNull())
        .withColumn("reason", reason)
    )


def gaps_by_reason(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("project", "reason").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rules"), F.count("*").alias("gap_count")
    )
