"""Scopes by braces and by indentation: what encloses a piece of code."""

import re
import time

import pytest

from plumbline.operators import scopes as S

JS = """import x from 'y';
export async function save({ a, b }, key = "{") {
  try {
    const v = JSON.parse(a);
    items.forEach((i) => {
      use(JSON.parse(i));
    });
  } catch (e) {
    log(JSON.parse(b));
  }
  for (const k of key) {
    call(k, { deep: { er: 1 } });
  }
  return { where: { id: b } };
}
class Store {
  get(name) { return this.rows[name]; }
  async put(
    name,
    value,
  ) {
    if (name) { this.rows[name] = `${value} {`; }
    while (value)
    {
      value -= 1
    }
  }
}
const pick = async (row) => {
  return row
}
const f = wrap(async function (x) {
  done(x)
})
last()
"""

PY = '''import json

def first(x):
    try:
        y = go(x)
    except ValueError:
        y = None

    return json.loads(x)


class Box:
    def load(self, raw, other=(1,
  2)):
        """Text
at the margin: def no():
        """
        try:
            for r in raw:

                self.a = json.loads(r)
        finally:
            close()
        if other: self.b = json.loads(other)

def one(): return json.loads("try:")
try: json.loads(top)
except Exception: pass
after = 1
'''


def rows(spark, path, text):
    frame = spark.createDataFrame([("p", path, text)], "project string, path string, clean string")
    return S.scopes(frame).collect(), S.pieces(frame).collect()


def by_head(scopes, word):
    return next(s for s in scopes if word in s.head and s.kind == "function")


def at(pieces, word, nth=0):
    return [p for p in pieces if word in p.text][nth]


def test_braces(spark):
    scopes, pieces = rows(spark, "a.ts", JS)
    lines = JS.split("\n")
    spans = {(s.kind, s.start, s.stop) for s in scopes if s.kind != "block"}
    assert spans == {
        ("function", 2, 15), ("try", 3, 8), ("function", 5, 7), ("rescue", 8, 10), ("loop", 11, 13), ("class", 16, 28),
        ("function", 17, 17), ("function", 18, 27), ("loop", 23, 26), ("function", 29, 31), ("function", 32, 34),
    }
    save = by_head(scopes, "function save")
    assert at(pieces, "JSON.parse(a)").func == save.id and at(pieces, "JSON.parse(a)").guarded
    inner = at(pieces, "JSON.parse(i)")
    assert not inner.guarded and inner.func not in (0, save.id)
    assert at(pieces, "JSON.parse(b)").guarded
    assert at(pieces, "deep").loop == 11 and at(pieces, "return row").loop == 0
    assert at(pieces, "last()").func == 0 and at(pieces, "last()").line == lines.index("last()") + 1
    assert at(pieces, "value -= 1").loop == 23
    ids = {s.id for s in scopes}
    assert all(s.parent in ids or s.parent == 0 for s in scopes)


def test_indentation(spark):
    scopes, pieces = rows(spark, "a.py", PY)
    spans = {(s.kind, s.start, s.stop) for s in scopes}
    assert {("function", 3, 9), ("try", 4, 5), ("class", 12, 24), ("function", 13, 24), ("try", 18, 21), ("loop", 19, 21), ("function", 26, 26), ("try", 27, 27)} <= spans
    assert len([s for s in scopes if s.kind == "function"]) == 3
    found = [(p.line, p.guarded, p.loop) for p in pieces if "json.loads(" in p.text]
    assert found == [(9, False, 0), (21, True, 19), (24, False, 0), (26, False, 0), (27, True, 0)]
    assert at(pieces, "after").func == 0


@pytest.mark.parametrize("path", ["a.js", "b.py"])
@pytest.mark.parametrize("text", ["", "\n\n", "}}}}", "{{{", "(((\n)", "'unclosed {\n}", "def f(\nif x:\n", '"""', "`a\n{"])
def test_broken_files_do_not_stop_the_scan(spark, path, text):
    scopes, _ = rows(spark, path, text)
    assert all(1 <= s.start <= s.stop <= text.count("\n") + 1 for s in scopes)


@pytest.mark.parametrize("kind", ["js", "py"])
def test_time_per_doubling(spark, kind):
    one = {
        "js": "export function f{i}(a) {{\n  try {{\n    go(a, {{ k: 1 }});\n  }} catch (e) {{\n    log(e);\n  }}\n}}\n",
        "py": "def f{i}(a):\n    try:\n        go(a)\n    except ValueError:\n        log(a)\n\n",
    }[kind]

    def seconds(n):
        text = "".join(one.format(i=i) for i in range(n))
        frame = spark.createDataFrame([("p", f"a.{kind}", text)], "project string, path string, clean string").cache()
        frame.count()
        start = time.time()
        assert S.scopes(frame).where("kind = 'function'").count() == n
        return time.time() - start

    seconds(200)
    seconds(2000)
    small, large = min(seconds(4000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert large < 2.2**2 * small, (small, large)


def test_a_blanked_comment_is_one_piece_of_lines():
    """Lines of spaces once made two steps of the fold each; code behind them keeps its line."""
    assert len(re.findall(S.TOKEN, "a\n" + "    \n" * 1000 + "b")) == 3


def test_lines_behind_a_blanked_comment(spark):
    text = "function f() {\n" + "   \n" * 2500 + "  g();\n\n}\n" + "\n" * 40 + "h();\n"
    rows = S.pieces(spark.createDataFrame([(text, "a.ts")], "clean string, path string")).collect()
    assert [(r.line, r.text.strip()) for r in rows if r.text.strip()] == [(1, "function f()"), (2502, "g();"), (2545, "h();")]
