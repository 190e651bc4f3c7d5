import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit as A
from plumbline.plans import dependencies, heartbeats, invariants, past, quality, responses, scoring, standards
from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.plans import rules as R
from plumbline.sources import corpus, history, probes, registry, reports

FINDING = "project string, rule_id string, file string, line int, snippet string, severity string, confidence string, title string"


def findings(spark, rows):
    return scoring.with_fingerprint(spark.createDataFrame(rows, FINDING))


def f(rule="r1", file="a.ts", line=1, snippet="x = 1", severity="high", project="p", confidence="likely"):
    return (project, rule, file, line, snippet, severity, confidence, "t")


def labels(spark, rows):
    return spark.createDataFrame(rows, reports.LABEL_SCHEMA)


def test_scores_and_partial(spark):
    df = findings(spark, [f(severity="critical"), f(severity="high"), f(severity="info", confidence="certain")])
    gaps = spark.createDataFrame([("p", "r9")], "project string, rule_id string")
    row = scoring.banded(scoring.severity_counts(df), gaps).first()
    assert (row.raw, row.score, row.partial, row.label) == (16, 32, True, "filthy (partial measurement)")
    split = scoring.confidence_counts(df).first()
    assert split.certain_info == 1 and split.likely_critical == 1 and split.certain_critical == 0


def test_precision_is_null_without_labels(spark):
    df = findings(spark, [f(), f(rule="r2", snippet="y"), f(rule="r2", snippet="z")])
    key = [r.fingerprint for r in df.orderBy("snippet").collect()]
    lab = labels(spark, [(key[1], "tp", "r2", "a.ts", 1, "y", None), (key[2], "fp", "r2", "a.ts", 1, "z", None)])
    got = {r.rule_id: r for r in quality.rule_precision(df, lab).collect()}
    assert got["r1"].precision is None and got["r1"].unlabeled == 1
    assert got["r2"].precision == 0.5 and got[None].tp == 1


def test_recall_by_suffix_long_and_short(spark):
    df = findings(spark, [f(file="very/long/path/to/src/route.ts"), f(rule="r2", file="b/x.py")])
    entries = spark.createDataFrame(
        [("path/to/src/route.ts", "r1", ""), ("route.ts", "r1", ""), ("ute.ts", "r1", ""), ("other.ts", "r1", ""), ("x.py", "r2", ""), ("x.py", "r1", "")],
        "file string, rule_id string, note string",
    )
    got = {(r.file, r.rule_id): r.hit for r in quality.recall_hits(df, entries).collect()}
    assert got == {("path/to/src/route.ts", "r1"): True, ("route.ts", "r1"): True, ("ute.ts", "r1"): True, ("other.ts", "r1"): False, ("x.py", "r2"): True, ("x.py", "r1"): False}
    total = quality.rule_recall(quality.recall_hits(df, entries)).where("rule_id is null").first()
    assert (total.total, total.hits) == (6, 4)


def test_label_ladder(spark):
    df = findings(spark, [f(snippet="now"), f(snippet="fresh")])
    key = lambda s: f"r1::a.ts::{s}"
    lab = labels(
        spark,
        [
            (key("now"), "tp", "r1", "a.ts", 1, "now", None),
            (key("gone"), "fp", "r1", "a.ts", 1, "gone", None),
            (key("old"), "tp", "r1", "a.ts", 1, "old", "stale"),
        ],
    )
    states = {r.fingerprint: r for r in quality.label_states(df, lab).collect()}
    assert states[key("now")].state == "kept" and states[key("now")].verdict == "tp"
    assert states[key("fresh")].state == "added" and states[key("fresh")].verdict == "?"
    assert states[key("gone")].state == "stale" and states[key("gone")].note == "stale"
    assert states[key("old")].state == "noted"
    gate = labels(
        spark,
        [
            (key("now"), "tp", "r1", "a.ts", 1, "", "resolved in March"),
            (key("lost"), "tp", "r1", "a.ts", 1, "", None),
            (key("fixed"), "tp", "r1", "a.ts", 1, "", "fixed"),
            (key("fresh"), "fp", "r1", "a.ts", 1, "", "stale"),
        ],
    )
    got = {r.fingerprint: r.reason for r in quality.regressions(df, gate).collect()}
    assert got == {key("now"): "lost-tp: returned hole", key("lost"): "lost-tp", key("fresh"): "returned-fp"}


def test_snapshot_diff_reasons(spark):
    cols = FINDING + ", ordinal int"
    before = spark.createDataFrame([(*f(snippet=s, file=s + ".ts"), 1) for s in ("same", "edit", "lost", "stay")], cols)
    after = spark.createDataFrame([(*f(snippet="stay", file="stay.ts", line=9), 1), (*f(snippet="new"), 2)], cols)
    dig = "project string, file string, digest string"
    old = spark.createDataFrame([("p", "same.ts", "1"), ("p", "edit.ts", "1"), ("p", "lost.ts", "1")], dig)
    new = spark.createDataFrame([("p", "same.ts", "1"), ("p", "edit.ts", "2")], dig)
    got = {(r.change, r.snippet): (r.reason, r.suspicious) for r in quality.snapshot_diff(before, after, old, new).collect()}
    assert got == {
        ("new", "new"): (None, False),
        ("vanished", "same"): ("file-identical", True),
        ("vanished", "edit"): ("file-changed", False),
        ("vanished", "lost"): ("file-changed", False),
    }


def test_duplicate_identity_last_wins(spark):
    df = spark.createDataFrame([(*f(severity="low"), 1), (*f(severity="high"), 2)], FINDING + ", ordinal int")
    assert [r.severity for r in quality.flatten_snapshot(df).collect()] == ["high"]


def test_invariants(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (None,), (9,)], "pid int")
    rel = invariants.Relation("child", "pid", "parent")
    got = invariants.orphan_invariants(spark, {"parent": parent, "child": child}, [rel]).collect()
    assert [(r.severity, r.orphans) for r in got] == [("medium", 1)]
    many = spark.range(100, 160).select(F.col("id").cast("int").alias("pid"))
    assert invariants.orphan_invariants(spark, {"parent": parent, "child": many}, [rel]).first().severity == "high"
    clean = invariants.orphan_invariants(spark, {"parent": parent, "child": child.where("pid = 1 or pid is null")}, [rel]).collect()
    assert [(r.severity, r.orphans) for r in clean] == [("low", 0)]
    lost = invariants.orphan_invariants(spark, {"child": child}, [rel]).first()
    assert lost.invariant == "table-missing" and lost.severity == "high"


def test_triage(spark):
    df = findings(spark, [f(confidence="certain"), f(snippet="b", severity="medium", confidence="certain")])
    verdicts = df.select("fingerprint", F.lit(0.1).alias("score"))
    got = {r.snippet: (r.severity, r.confidence) for r in scoring.triage_merge(df, verdicts).collect()}
    assert got == {"x = 1": ("low", "likely"), "b": ("medium", "certain")}


def test_dependency_rules(spark):
    rows = [
        ("p", "foo", "^2.1.0", "2.1.0", "5.0.0", False),
        ("p", "near", "^4.0.0", "4.0.0", "5.2.0", False),
        ("p", "range", "^2.0.0", None, "6.0.0", False),
        ("p", "odd", "^1.0.0", "1.0.0", "git", False),
        ("p", "request", "^2.88.0", None, None, False),
    ]
    df = spark.createDataFrame(rows, "project string, name string, declared string, current string, latest string, dev boolean")
    got = {r.name: (r.reason, r.behind) for r in dependencies.dependency_health(df).collect()}
    assert got == {"foo": ("majors-behind", 3), "range": ("majors-behind", 4), "request": ("deprecated", None)}


def test_commit_messages(spark):
    rows = [("a", "h1", "fix 12 Maple Street"), ("a", "h2", "12 Maple Street again, 4 Cedar Road"), ("b", "h3", "1 Birch Lane"), ("b", "h4", "2 Birch Lane and 3 Birch Lane")]
    df = spark.createDataFrame(rows, "project string, hash string, body string")
    assert {r.project for r in past.commit_message_findings(df).collect()} == {"b"}


def test_history_secrets(spark):
    key = "sk_" + "test_ABCDEFGH12345678"
    text = [
        "commit a1b2c3d4e5f6", "+++ b/.env", f"+STRIPE_KEY={key}", "+++ b/src/config.ts", f'+const stripe = "{key}";',
        "+++ b/.env.example", "+STRIPE_KEY=your-key-here", "+++ b/server.ts", "+  const token = decrypt(row.token);",
        "+  const token = data.someLongPropertyName;", "+++ b/tests/m.test.ts", "+const SECRET = 'meta-app-secret-9-very';",
        "+++ b/README.md", "+webhook?token=abc123def456ghi789", "+++ b/src/c.ts", "+const secret = 'meta-app-secret-cok-gizli';",
    ]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "diff_id string, line_no int, text string")
    got = {(r.file, r.note) for r in past.history_secrets(df).collect()}
    assert got == {(".env", "committed environment file"), ("src/config.ts", "provider key")}


def test_history_secrets_far_down_a_diff(spark, tmp_path):
    """Lines past the range of an int keep their number; below it the query keeps the twin's type."""
    from plumbline.workloads import operations

    def run(doc):
        text = 'api_key = "a1b2c3d4e5f6g7h8"'
        spark.createDataFrame([(1, "x", "s"), (doc, text, "s")], "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return operations.history_secrets(spark, str(tmp_path))

    assert [(r.file, r.line) for r in run(51_281).collect()] == [("src/51281.ts", 51_281_000_002)]
    small = run(2_001)
    assert small.schema["line"].dataType.simpleString() == "int" and [r.line for r in small.collect()] == [2_001_000_002]


def test_gaps_missing_targets_and_custom_rules(spark):
    files = spark.createDataFrame([("a", "README.md", "hello", None)], "project string, path string, content string, tracked boolean")
    projects = spark.createDataFrame([("a", "/a", False, None), ("b", "/b", False, None), ("c", "/c", False, None)], "name string, path string, owned boolean, url string")
    existing = spark.createDataFrame([("a",), ("b",)], "project string")

    def broken(ctx):
        return ctx.facts.select(F.col("no_such_column"))

    def works(ctx):
        return ctx.flags.select(
            "project", F.lit("x-custom").alias("rule_id"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("s").alias("snippet"),
            F.lit("low").alias("severity"), F.lit("certain").alias("confidence"), F.lit("").alias("note"),
        )

    files2 = files.unionByName(spark.createDataFrame([("a", "x.py", "pass", None)], files.schema))
    out = A.audit(files2, projects, existing, custom={"bad": broken, "good": works})
    got = {(r.project, r.rule_id) for r in out.findings.collect()}
    assert ("b", "int-scan-target-empty") in got and ("c", "int-scan-target-missing") in got
    assert [r.rule_id for r in out.notes.collect()] == ["bad"]
    gaps = {(r.project, r.rule_id): r.requirement for r in out.gaps.collect()}
    assert gaps[("a", "a02-env-file-committed")] == "git" and gaps[("a", "a01-missing-rls")] == "sql" and gaps[("a", "a05-live-http-methods")] == "live"
    assert all(r.partial for r in out.scores.collect())
    assert {r.project: r.percent for r in out.coverage.collect()} == {"a": 100}


def test_a_failed_rule_never_looks_like_a_result(spark, monkeypatch):
    """A custom rule that fails is a gap of each project; a built-in one ends the audit."""
    files = spark.createDataFrame([("a", "x.py", "pass", None)], "project string, path string, content string, tracked boolean")
    projects = spark.createDataFrame([("a", "/a", False, None), ("b", "/b", False, None)], "name string, path string, owned boolean, url string")

    def broken(*_):
        raise ValueError("this rule is broken")

    out = A.audit(files, projects, custom={"bad": broken})
    gaps = {(r.project, r.requirement, r.reason) for r in out.gaps.where("rule_id = 'bad'").collect()}
    assert gaps == {(p, "rule", "rule failed: this rule is broken") for p in ("a", "b")}
    assert all(r.partial for r in out.scores.collect())
    monkeypatch.setattr(X, "two_writers", broken)
    with pytest.raises(ValueError, match="this rule is broken"):
        A.audit(files, projects)


def test_first_unmet_requirement_counts(spark):
    rules = R.rule_table(spark, [R.Rule("x", "t", 1, "low", requires=("js", "sql"))])
    projects = spark.createDataFrame([("a",), ("b",)], "project string")
    have = spark.createDataFrame([("a", "js")], "project string, requirement string")
    got = {r.project: r.requirement for r in D.requirement_gaps(rules, projects, have).collect()}
    assert got == {"a": "sql", "b": "js"}


PROBE = (
    "project string, url string, path string, method string, status int, headers map<string,string>, body string, ok boolean, "
    "error string, cert_valid_to timestamp, attempt int, origin string"
)


def probe(project="p", path="/", status=200, headers=None, body="", method="GET", ok=True, url=None, attempt=1, origin=None, error=None, cert=None):
    return (project, url or f"https://{project}.example/", path, method, status, headers or {}, body, ok, error, cert, attempt, origin)


def respond(spark, rows):
    df = probes.read_probes(spark.createDataFrame(rows, PROBE))
    out = responses.response_findings(df, F.lit("2024-01-01").cast("timestamp")).collect()
    return {(r.project, r.rule_id, r.severity, r.note) for r in out}


def test_response_checks(spark):
    good = {"Content-Security-Policy": "frame-ancestors 'none'", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "x", "Strict-Transport-Security": "y"}
    late = dt.datetime(2024, 1, 4)
    rows = [
        probe("clean", headers=good),
        probe("bare", headers={"Set-Cookie": "a=1"}),
        probe("env", "/.env", body="KEY=1"), probe("env", headers=good),
        probe("spa", "/.env", body="<html></html>"), probe("spa", headers=good), probe("spa", "/admin"), probe("spa", responses.ABSENT_PATH),
        probe("adm", "/admin", body="users"), probe("adm", "/api/users", body="Please authenticate"), probe("adm", headers=good),
        probe("login", "/api/login", 401, method="POST"), probe("login", "/api/login", 401, method="POST", attempt=2),
        probe("limited", "/api/login", 401, method="POST"), probe("limited", "/api/login", 429, method="POST", attempt=2),
        probe("gate", "/api/login", 403, body="invalid origin", method="POST"),
        probe("health", "/api/health", 500), probe("down", "/api/health", 503, body="maintenance"),
        probe("waf", headers={}), probe("waf", "/x", 403, {"cf-mitigated": "challenge"}),
        probe("cert", headers=good, cert=late),
        probe("list", "/files", body="Index of /files"), probe("list", "/logs", body="Index of /logs"),
        probe("map", "/a.js.map", body='{"mappings":"A"}'), probe("cfg", "/config.json", body='{"theme":"dark"}'),
        probe("nonce", headers={**good, "Content-Security-Policy": "script-src 'strict-dynamic'; frame-ancestors 'none'"}, body="<script>1</script>"),
        probe("cors", "/", headers={"Access-Control-Allow-Origin": responses.FOREIGN_ORIGIN}, origin=responses.FOREIGN_ORIGIN),
    ] + [probe("chain", path, 301, {"Location": f"https://chain.example/{i + 1}", **good}, url=f"https://chain.example/{i}") for i, path in enumerate(["/", "/1", "/2", "/3"])]
    got = respond(spark, rows)
    by = lambda p: {(r, s, n) for q, r, s, n in got if q == p}
    assert by("clean") == set() and by("down") == set() and by("waf") == set() and by("cfg") == set() and by("limited") == set()
    assert ("a05-live-security-headers", "medium", "content-security-policy") in by("bare") and ("a02-live-transport-and-cookies", "medium", "HttpOnly,Secure,SameSite") in by("bare")
    assert by("env") == {("a05-live-exposed-files", "critical", "/.env")}
    assert by("spa") == {("a01-live-open-admin-endpoints", "info", "cannot measure")}
    assert by("adm") == {("a01-live-open-admin-endpoints", "high", "/admin")}
    assert by("login") == {("a07-live-login-hardening", "medium", "/api/login")} and by("gate") == {("a07-live-login-hardening", "info", "origin gate")}
    assert by("health") == {("int-live-health-endpoints", "high", "/api/health")}
    assert by("cert") == {("a05-live-ssl-domain", "critical", "certificate expiring")}
    assert by("list") == {("a05-live-directory-listing", "medium", "/files")}
    assert by("map") == {("a05-live-exposed-secrets", "medium", "source map")}
    assert by("nonce") == {("int-live-page-nonce-coverage", "medium", "scripts=1")}
    assert by("cors") == {("a05-live-cors-misconfig", "high", "foreign origin")}
    assert ("a05-live-ssl-domain", "low", "redirects=4") in by("chain")


def test_live_gate(spark):
    p = spark.createDataFrame([("a", True, "u"), ("b", False, "u"), ("c", True, None)], "name string, owned boolean, url string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    assert [r.project for r in probes.live_gate(rows, p).collect()] == ["a"]


def test_standards(spark):
    flags = spark.createDataFrame([("p", ["npm", "api_routes", "gitignore_env", "limiter"])], "project string, flags array<string>")
    found = spark.createDataFrame(
        [("p", "int-session-revoke-missing", "high", "likely", ""), ("p", "a02-hardcoded-secret", "critical", "certain", "")],
        "project string, rule_id string, severity string, confidence string, note string",
    )
    stack = spark.createDataFrame([("p", "node", "unknown", "unknown")], "project string, framework string, db string, auth string")
    rows = standards.standards_profile(flags, found, stack)
    got = {r.check_id: (r.status, r.level) for r in rows.collect()}
    assert len(got) == 28
    assert got["std-sec-rate-limit"][0] == "pass" and got["std-sec-hardcoded-secret"] == ("open", "critical")
    assert got["integrity-revoke-ends-session"] == ("open", "critical") and got["integrity-delete-guard"][0] == "na"
    assert got["integrity-negative-test"][0] == "manual" and got["std-sec-rls"][0] == "na" and got["std-sec-headers"] == ("manual", "info")
    scores = {r.category: r.score for r in standards.standards_scores(rows).collect()}
    assert scores["security"] == 75 and scores["integrity"] == 75 and scores[None] == 50


def beats(spark, rows):
    data = [(p, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), st, d) for p, s, st, d in rows]
    return spark.createDataFrame(data, "project string, ts timestamp, status string, ssl_days int")


def test_deadman_threshold_is_strict(spark):
    df = beats(spark, [("a", 0, "good", 90), ("a", 1800, "good", 90), ("a", 3601, "good", 90), ("b", 0, "good", 90)])
    got = heartbeats.deadman(df, F.lit("2024-01-01 01:00:10").cast("timestamp")).collect()
    assert sorted((r.project, r.last_beat.minute, r.cleared_at is None) for r in got) == [("a", 30, False), ("b", 0, True)]


def test_alarm_pause(spark):
    hours = [0, 1, 5.9, 6, 6.1, 13]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours], "project string, silent_from timestamp")
    got = sorted(r.alarm_ts for r in heartbeats.alarm_dedup(df).collect())
    assert [(t - dt.datetime(2024, 1, 1)).total_seconds() / 3600 for t in got] == [0, 6.1, 13]


def test_breakage_edges(spark):
    df = beats(spark, [("a", 0, "good", d) for d in (0, 1, 13, 14)] + [("b", 0, "broken", 0)])
    assert sorted((r.project, r.ssl_days) for r in heartbeats.breakage(df).collect()) == [("a", 1), ("a", 13), ("b", 0)]


def test_registry_and_stack(spark, tmp_path):
    path = tmp_path / "targets.json"
    path.write_text('{"projects":[{"name":"a","path":"/a","urls":"x","owned":"true"},{"name":"b","path":"/b","owned":true,"stack":{"db":"mysql"},"$note":1}]}')
    projects, unknown = registry.read_registry(spark, str(path))
    assert {r.name: r.owned for r in projects.collect()} == {"a": False, "b": True}
    assert [(r.name, r.key, r.suggested) for r in unknown.collect()] == [("a", "urls", "url")]
    files = spark.createDataFrame(
        [("a", "package.json", '{"dependencies":{"next":"1","@clerk/nextjs":"1"}}'), ("b", "package.json", '{"devDependencies":{"vite":"1","pg":"8"}}'), ("c", "main.py", "")],
        "project string, path string, content string",
    )
    got = {r.project: (r.framework, r.db, r.auth) for r in registry.infer_stack(files, projects).collect()}
    assert got == {"a": ("next", "unknown", "clerk"), "b": ("vite", "mysql", "unknown"), "c": ("unknown", "unknown", "unknown")}


def test_scan_corpus_from_disk(spark, tmp_path):
    def put(rel, data):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("p/src/a.ts", b"const a = 1;")
    put("p/node_modules/x.js", b"x")
    put("p/app/api/report/route.ts", b"x")
    put("p/report/out.json", b"{}")
    put("p/big.ts", b"x" * (2 * 1024 * 1024 + 1))
    put("p/vendor.min.js", b"x")
    put("p/packed.js", b"x" * 1200)
    put("p/data/rows.csv", b"a,b\n" + b"1,2\n" * 40_000)
    put("p/latin.py", "s = 'é'".encode("latin-1"))
    hidden = spark.createDataFrame([("p", ".env.local", "A=1", 3), ("p", ".cache/x.env", "A=1", 3)], "project string, path string, content string, size long")
    got = {r.path: r for r in corpus.scan_corpus(spark, str(tmp_path), hidden).collect()}
    assert set(got) == {"src/a.ts", "app/api/report/route.ts", "data/rows.csv", "latin.py", ".env.local", "big.ts"}
    assert len(got["data/rows.csv"].content) == 4 + 4 * 40_000 and len(got["big.ts"].content) == 2 * 1024 * 1024 + 1
    limited = {r.path for r in corpus.scan_corpus(spark, str(tmp_path), hidden, size_limit=1_000_000).collect()}
    assert limited == set(got) - {"big.ts"}
    assert [(r.path, r.size) for r in corpus.oversized(spark, str(tmp_path), 1_000_000).collect()] == [("big.ts", 2 * 1024 * 1024 + 1)]


def test_headers_keys_and_commits(spark, tmp_path):
    df = spark.createDataFrame([("x.tsv", "a\t'b'\n1\t2"), ("x.csv", '"n", m ,\n'), ("x.jsonl", '\n{"k":1,"cut'), ("y.jsonl", '{"k":1,"v":2}')], "path string, content string")
    rows = {r.path: (r.h, r.k) for r in df.select("path", corpus.csv_header(F.col("content"), F.col("path")).alias("h"), corpus.jsonl_keys(F.col("content")).alias("k")).collect()}
    assert rows["x.tsv"][0] == ["a", "b"] and rows["x.csv"][0] == ["n", "m"] and rows["x.jsonl"][1] == ["k"] and rows["y.jsonl"][1] == ["k", "v"]
    log = tmp_path / "log.txt"
    log.write_text("<<C>>0123456789ab\nfirst\nbody\n<<C>>ffffffffff\nsecond\n")
    got = [(r.hash, r.body.strip()) for r in history.read_commits(spark, str(log), "<<C>>").collect()]
    assert sorted(got) == [("01234567", "first\nbody"), ("ffffffff", "second")]


def test_reports_round_trip(spark, tmp_path):
    df = findings(spark, [f(), f(rule="r2", file=None, line=None, snippet=None, severity="low")])
    rules = R.rule_table(spark, [R.Rule("r1", "t", 1, "high", cwe="CWE-1"), R.Rule("r2", "t", 1, "low"), R.Rule("r3", "t", 1, "low")])
    reports.write_sarif(df.unionByName(df), rules, str(tmp_path / "sarif"))
    assert spark.read.json(str(tmp_path / "sarif/rules")).count() == 2
    res = {r.ruleId: r for r in spark.read.json(str(tmp_path / "sarif/results")).collect()}
    assert res["r1"].level == "error" and res["r1"].locations[0].physicalLocation.region.startLine == 1
    assert res["r2"].level == "note" and list(res["r2"].locations) == []
    reports.write_snapshot(spark, str(tmp_path / "snap"), "s1", {"findings": df})
    assert reports.read_snapshot(spark, str(tmp_path / "snap"), "findings", "s1").count() == 2
    lab = labels(spark, [("b", "tp", "r", "f", 1, "", ""), ("a", "fp", "r", "f", 1, "", "")])
    reports.write_labels(lab, str(tmp_path / "labels"))
    assert reports.read_labels(spark, str(tmp_path / "labels")).count() == 2
    empty = tmp_path / "manifest.json"
    empty.write_text("")
    with pytest.raises(ValueError):
        reports.read_recall_manifest(spark, str(empty))
    rank = tmp_path / "rank.csv"
    rank.write_text("﻿url,pagerank,ic_giris,orphan\nhttps://a,0.5,3,\nhttps://b,0.1,0,EVET\n", encoding="utf-8")
    got = {r.url: (r.pagerank, r.in_links, r.orphan) for r in reports.read_rank_csv(spark, str(rank)).collect()}
    assert got == {"https://a": (0.5, 3, False), "https://b": (0.1, 0, True)}
