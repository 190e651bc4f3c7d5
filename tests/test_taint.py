"""Values from the caller: two steps, across functions and imports, and made safe on the way."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.plans import taint

IMPORT = "import fs from 'fs';\n"
CASES = {
    "direct": (True, [("a.ts", "export function GET(req) {\n  return fs.readFile(req.query.f);\n}")]),
    "one step": (True, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  return fs.readFile(f);\n}")]),
    "two steps": (True, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  const full = join(base, f);\n  let again = full;\n  return fs.readFile(again);\n}")]),
    "into a callback": (True, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  rows.forEach((row) => {\n    fs.readFile(f);\n  });\n}")]),
    "into a parameter": (True, [("a.ts", "function open(base, place) {\n  return fs.readFile(place);\n}\nexport function GET(req) {\n  const f = req.query.f;\n  return open(root, f);\n}")]),
    "into an imported module": (True, [("lib/store.ts", "export function open(place) {\n  const p = place;\n  return fs.readFile(p);\n}"), ("a.ts", "import { open } from './lib/store';\nexport function GET(req) {\n  const f = req.query.f;\n  return open(f);\n}")]),
    "from a function that reads": (True, [("a.ts", "function wanted(req) {\n  return req.query.f;\n}\nexport function GET(x) {\n  const f = wanted(x);\n  return fs.readFile(f);\n}")]),
    "made safe": (False, [("a.ts", "export function GET(req) {\n  const f = sanitizePath(req.query.f);\n  const g = f;\n  return fs.readFile(g);\n}")]),
    "made safe at the sink": (False, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  return fs.readFile(basename(f));\n}")]),
    "another name": (False, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  const g = 'fixed';\n  return fs.readFile(g);\n}")]),
    "another function's name": (False, [("a.ts", "function other(req) {\n  const f = req.query.f;\n  return f;\n}\nexport function GET() {\n  const f = 'fixed';\n  return fs.readFile(f);\n}")]),
    "not imported": (False, [("lib/store.ts", "export function open(place) {\n  return fs.readFile(place);\n}"), ("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  return open(f);\n}")]),
    "a member of that name": (False, [("a.ts", "export function GET(req) {\n  const f = req.query.f;\n  return fs.readFile(config.f);\n}")]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(case, path, IMPORT + text, True) for case, (_, files) in CASES.items() for path, text in files]
    files = spark.createDataFrame(rows, "project string, path string, content string, tracked boolean")
    facts = D.scan_facts(files, extractors=X.extractors()).cache()
    return {r.project for r in taint.tainted_sinks(facts).select("project").distinct().collect()}


@pytest.mark.parametrize("case", CASES)
def test_canary(found, case):
    assert (case in found) == CASES[case][0]


def test_no_facts(spark):
    none = spark.createDataFrame([], "project string, path string, kind string, key string, line int, text string, level int")
    assert taint.tainted_sinks(none).count() == 0
    assert taint.tainted(none.where(F.lit(True))).count() == 0
