"""Scopes of source files: who encloses a line, from brackets or from indentation.

``scope_rows`` turns a file into rows of two kinds in one pass: *pieces* of code with what
encloses them (innermost function and the chain of functions around it, whether a try of that
function does, the line of the innermost loop), and *scopes* as intervals of lines with their parent and header. Braces open
scopes in most languages, indentation does in Python; strings, templates and continuation
lines do neither.

The pass is a fold with a stack, all inside Catalyst. A fold copies what it has gathered at
each step, so rows are gathered in short runs only: a first fold keeps the state in front of
each block, a second one that in front of each run of a block, and runs and blocks are joined
by ``flatten``; neither looks at its last part, so a short file is folded once. The work stays
in proportion to the file's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a block and of a run.
BLOCK, RUN = 1024, 16

ROW = "struct<scope:boolean,id:int,parent:int,kind:string,func:int,guarded:boolean,loop:int,start:int,stop:int,text:string,chain:string>"
_FRAME = "struct<id:int,parent:int,kind:string,func:int,guarded:boolean,loop:int,start:int,head:string,mark:int,chain:string>"

# A piece of code without braces or line breaks outside strings and templates, or one of these;
# lines of spaces go with the line break in front of them.
TOKEN = (
    r"(?s)(?:[^{}\n\"'`]++|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|[\"'`])++|[{}]|\n(?: *\n)*+"
)
_QUOTED = r"(?s)\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"

# Headers in front of a brace.
TRY = r"\btry\s*$"
RESCUE = r"\b(?:catch\s*(?:\([^)]*\))?|finally)\s*$"
ARROW = r"=>\s*$"
PARAMETERS = r"\)\s*(?::[^{}();=]*)?$"
CONTROL = r"^[\s}]*(?:else\s+)?(?:if|for|while|switch|catch|with)\b"
LOOP = r"^[\s}]*(?:for|while)\b|\bdo\s*$"
#: A function that is called for each element.
EACH = r"(?:\.\s*(?:map|forEach)|\bPromise\s*\.\s*all)\s*\("
CLASS = r"\b(?:class|interface|enum|namespace)\s+\w"

# Python: text that is neither structure nor brackets, and headers.
PY_TOKEN = (
    r"(?s)\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|#[^\n]*|[^\"'#]++"
)
PY_HEADER = r"^\s*(?:(?:async\s+)?(?:def|for|with)|class|while|if|elif|else|try|except|finally|match|case)\b"
PY_DEF = r"^\s*(?:async\s+)?def\s"
PY_CLASS = r"^\s*class\s"
PY_TRY = r"^\s*try\s*:"
PY_LOOP = r"^\s*(?:(?:async\s+)?for|while)\b"
PYTHON = r"\.py$"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(text: str, pattern: str) -> str:
    return f"({text} rlike {_lit(pattern)})"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _surplus(text: str, more: str, less: str) -> str:
    """How many of the characters ``more`` there are beyond those of ``less``."""
    return f"(char_length(translate({text}, '{less}', '')) - char_length(translate({text}, '{more}', '')))"


def blocked_fold(items: str, start: str, step: str) -> str:
    """``step`` over (a, x): a.s is the state, a.out the rows of this run; all rows in order.

    ``step`` gives named_struct('s', state, 'out', rows). After the last item the state stays
    in ``s`` of the result, the rows in ``out``.
    """
    none = f"cast(array() as array<{ROW}>)"

    def fold(values: str, state: str) -> str:
        return f"aggregate({values}, named_struct('s', {state}, 'out', {none}), (a, x) -> {step})"

    def quiet(values: str, state: str) -> str:
        """The state behind ``values``; rows are dropped at each step."""
        return f"aggregate({values}, named_struct('s', {state}, 'out', {none}), (b, y) -> named_struct('s', element_at(transform(array(y), x -> element_at(transform(array(b), a -> ({step}).s), 1)), 1), 'out', {none})).s"

    def states(values: str, state: str, size: int, name: str) -> str:
        """The states in front of each ``size`` of the values; the last part is not looked at."""
        part = f"slice({values}, ({name} - 1) * {size} + 1, {size})"
        later = f"slice(sequence(0, greatest(size({values}) - 1, 0) div {size}), 2, size({values}))"
        return (
            f"aggregate({later}, array({state}), ({name}o, {name}) -> "
            f"array_append({name}o, {quiet(part, f'element_at({name}o, -1)')}))"
        )

    leaf = fold(f"slice(block, k * {RUN} + 1, {RUN})", "m")
    runs = f"transform({states('block', 'top', RUN, 'r')}, (m, k) -> {leaf})"
    of_block = _let("runs", runs, "named_struct('s', element_at(runs, -1).s, 'out', flatten(runs.out))")
    blocks = f"transform({states(items, start, BLOCK, 't')}, (top, j) -> {_let('block', f'slice({items}, j * {BLOCK} + 1, {BLOCK})', of_block)})"
    return _let("blocks", blocks, "named_struct('s', element_at(blocks, -1).s, 'out', flatten(blocks.out))")


def _piece(top: str, line: str, text: str) -> str:
    return (
        f"named_struct('scope', false, 'id', {top}.id, 'parent', {top}.parent, 'kind', {top}.kind, 'func', {top}.func, "
        f"'guarded', {top}.guarded, 'loop', {top}.loop, 'start', {line}, 'stop', {line}, 'text', {text}, 'chain', {top}.chain)"
    )


def _closed(frames: str, stop: str) -> str:
    return (
        f"transform({frames}, f -> named_struct('scope', true, 'id', f.id, 'parent', f.parent, 'kind', f.kind, 'func', f.func, "
        f"'guarded', f.guarded, 'loop', f.loop, 'start', f.start, 'stop', {stop}, 'text', f.head, 'chain', f.chain))"
    )


def _frame(kind: str, ident: str, top: str, start: str, head: str, mark: str) -> str:
    """A new frame under ``top``: a function ends loops and guards, a try begins a guard."""
    return (
        f"named_struct('id', {ident}, 'parent', {top}.id, 'kind', {kind}, "
        f"'func', case when {kind} = 'function' then {ident} else {top}.func end, "
        f"'guarded', case when {kind} in ('function', 'class') then false else {kind} in ('try', 'rescue') or {top}.guarded end, "
        f"'loop', case when {kind} = 'loop' or {kind} = 'function' and {_is(head, EACH)} then {start} when {kind} = 'function' then 0 else {top}.loop end, "
        f"'start', {start}, 'head', {head}, 'mark', {mark}, "
        f"'chain', case when {kind} = 'function' then concat({top}.chain, ',', string({ident})) else {top}.chain end)"
    )


#: What lies outside all scopes: id 0, no function.
_ROOT = "named_struct('id', 0, 'parent', -1, 'kind', 'file', 'func', 0, 'guarded', false, 'loop', 0, 'start', 1, 'head', '', 'mark', -1, 'chain', '0')"
_NONE = f"cast(array() as array<{ROW}>)"


def _braces(text: str) -> str:
    # State: line, next id, stack, the statement so far with its first line, its open
    # parentheses, and whether a line break may have ended it.
    top = "element_at(a.s.stack, -1)"
    s = lambda **new: "named_struct(" + ", ".join(f"'{k}', {new.get(k, 'a.s.' + k)}" for k in ("line", "next", "stack", "head", "first", "open", "soft")) + ")"
    keep = lambda state, rows: f"named_struct('s', {state}, 'out', {rows})"
    kind = (
        f"case when {_is('a.s.head', TRY)} then 'try' when {_is('a.s.head', RESCUE)} then 'rescue' when {_is('a.s.head', ARROW)} then 'function' "
        f"when {_is('a.s.head', PARAMETERS)} and (a.s.open <= 0 and not {_is('a.s.head', CONTROL)} or {_is('a.s.head', 'function[^;]*' + PARAMETERS)}) then 'function' "
        f"when a.s.open <= 0 and {_is('a.s.head', LOOP)} then 'loop' when {_is('a.s.head', CLASS)} then 'class' else 'block' end"
    )
    opened = _let("k", kind, _let("f", _frame("k", "a.s.next", top, "a.s.first", "a.s.head", "a.s.open"), keep(s(next="a.s.next + 1", stack="array_append(a.s.stack, f)", head="''", first="a.s.line", open="0", soft="false"), "a.out")))
    # An object or a pattern inside a statement goes on with it; a body ends it.
    goes_on = "t.kind = 'block'"
    closed = _let(
        "t",
        top,
        keep(
            s(
                stack="slice(a.s.stack, 1, size(a.s.stack) - 1)",
                head=f"case when {goes_on} then concat(t.head, '{{}}') when t.mark > 0 then t.head else '' end",
                first=f"case when {goes_on} or t.mark > 0 then t.start else a.s.line end",
                open="greatest(t.mark, 0)",
                soft=f"not ({goes_on} or t.mark > 0)",
            ),
            f"concat(a.out, {_closed('array(t)', 'a.s.line')})",
        ),
    )
    # The statement is what follows the last semicolon; of a very long one both ends are kept.
    plain = f"regexp_replace(x, {_lit(_QUOTED)}, '_')"
    fresh = "a.s.soft or a.s.head = '' or instr(p, ';') > 0"
    tail = "substring_index(p, ';', -1)"
    head = f"case when {fresh} then {tail} else concat(a.s.head, p) end"
    short = "case when char_length(h) > 800 then concat(left(h, 400), right(h, 400)) else h end"
    opens = f"(case when a.s.soft or instr(p, ';') > 0 then 0 else a.s.open end + {_surplus(tail, '(', ')')})"
    told = _let("p", plain, _let("h", head, keep(s(head=short, first=f"case when {fresh} then a.s.line else a.s.first end", open=opens, soft="false"), f"array_append(a.out, {_piece(top, 'a.s.line', 'x')})")))
    breaks = "(char_length(x) - char_length(replace(x, '\\n', '')))"
    line = keep(s(line=f"a.s.line + {breaks}", soft="a.s.open <= 0"), "a.out")
    # A template may hold line breaks: what follows it is further down.
    told = told.replace("'line', a.s.line,", f"'line', a.s.line + {breaks},", 1)
    step = (
        f"case when startswith(x, '\\n') then {line} when x = '{{' then {opened} "
        f"when x = '}}' then case when size(a.s.stack) > 1 then {closed} else {keep(s(), 'a.out')} end "
        f"when trim(x) = '' then {keep(s(), 'a.out')} else {told} end"
    )
    start = f"named_struct('line', 1, 'next', 1, 'stack', cast(array({_ROOT}) as array<{_FRAME}>), 'head', '', 'first', 1, 'open', 0, 'soft', false)"
    fold = blocked_fold("tokens", start, step)
    rows = _let("d", fold, f"concat(d.out, {_closed('slice(d.s.stack, 2, size(d.s.stack))', 'd.s.line')})")
    return _let("tokens", f"regexp_extract_all({text}, {_lit(TOKEN)}, 0)", rows)


def _indents(text: str) -> str:
    # Strings and comments out of the way, line breaks inside them kept.
    quiet = (
        f"array_join(transform(regexp_extract_all({text}, {_lit(PY_TOKEN)}, 0), t -> case when left(t, 1) in ('#', '\"', '\\'') "
        "then regexp_replace(t, '[^\\\\n]', '_') else t end), '')"
    )
    pairs = f"arrays_zip(split({text}, '\\\\r?\\\\n'), split({quiet}, '\\\\r?\\\\n'))"
    items = f"transform({pairs}, (z, i) -> named_struct('line', i + 1, 'text', z['0'], 'quiet', coalesce(z['1'], '')))"
    top = "element_at({}, -1)"
    s = lambda **new: "named_struct(" + ", ".join(f"'{k}', {new.get(k, 'a.s.' + k)}" for k in ("next", "stack", "open", "line")) + ")"
    keep = lambda state, rows: f"named_struct('s', {state}, 'out', {rows})"
    depth = f"greatest(a.s.open + {_surplus('x.quiet', '([{', ')]}')}, 0)"
    piece = lambda stack: f"array_append({{}}, {_piece(top.format(stack), 'x.line', 'x.text')})"
    inside = keep(s(open=depth), piece("a.s.stack").format("a.out"))
    kind = (
        f"case when {_is('x.quiet', PY_DEF)} then 'function' when {_is('x.quiet', PY_CLASS)} then 'class' when {_is('x.quiet', PY_TRY)} then 'try' "
        f"when {_is('x.quiet', PY_LOOP)} then 'loop' else 'block' end"
    )
    # Scopes that begin at this indentation or further in have ended on the line before the
    # blank lines in front of this one.
    left = "filter(a.s.stack, f -> f.mark < w)"
    gone = _closed("reverse(filter(a.s.stack, f -> f.mark >= w))", "a.s.line")
    pushed = _let("f", _frame("k", "a.s.next", top.format("st"), "x.line", "x.text", "w"), "array_append(st, f)")
    # One line may hold header and body; conditions and iterables are evaluated outside.
    shown = "case when k in ('function', 'class', 'try') then ns else st end"
    header = _let("k", kind, _let("ns", pushed, keep(s(next="a.s.next + 1", stack="ns", open=depth, line="x.line"), f"array_append(concat(a.out, {gone}), {_piece(top.format(f'({shown})'), 'x.line', 'x.text')})")))
    other = keep(s(stack="st", open=depth, line="x.line"), piece("st").format(f"concat(a.out, {gone})"))
    width = "char_length(regexp_extract(x.text, '^[ \\\\t]*', 0))"
    moved = _let("w", width, _let("st", left, f"case when {_is('x.quiet', PY_HEADER)} then {header} else {other} end"))
    step = f"case when trim(x.text) = '' then a when a.s.open > 0 or trim(replace(x.quiet, '_', '')) = '' then {inside} else {moved} end"
    start = f"named_struct('next', 1, 'stack', cast(array({_ROOT}) as array<{_FRAME}>), 'open', 0, 'line', 1)"
    rows = _let("d", blocked_fold("items", start, step), f"concat(d.out, {_closed('slice(d.s.stack, 2, size(d.s.stack))', 'd.s.line')})")
    return _let("items", items, rows)


def scope_rows(text: str = "clean", path: str = "path") -> str:
    """SQL text: all rows of a file (array of ROW), pieces in order and scopes where they end."""
    return f"case when {_is(path, PYTHON)} then {_indents(text)} else {_braces(text)} end"


def scopes(files: DataFrame, text: str = "clean") -> DataFrame:
    """The interval table: a row a scope with id, parent, kind, func, guarded, loop, start, stop, head."""
    others = [c for c in files.columns if c not in (text, "content")]
    rows = files.select(*others, F.explode_outer(F.expr(f"filter({scope_rows(text)}, r -> r.scope)")).alias("r")).where("r is not null")
    return rows.select(*others, *[f"r.{c}" for c in ("id", "parent", "kind", "func", "guarded", "loop", "start", "stop")], F.col("r.text").alias("head"))


def pieces(files: DataFrame, text: str = "clean") -> DataFrame:
    """A row a piece of code with its line, innermost scope and function, guard and loop."""
    others = [c for c in files.columns if c not in (text, "content")]
    rows = files.select(*others, F.explode_outer(F.expr(f"filter({scope_rows(text)}, r -> not r.scope)")).alias("r")).where("r is not null")
    return rows.select(*others, F.col("r.start").alias("line"), F.col("r.id").alias("scope_id"), *[f"r.{c}" for c in ("func", "guarded", "loop", "text")])
