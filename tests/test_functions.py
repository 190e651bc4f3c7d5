import math
import random

from pyspark.sql import functions as F

from plumbline.functions import entropy as E
from plumbline.functions import hosts, severity, text, web


def one(spark, value, build, schema="v string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(build(F.col("v")).alias("x")).first()[0]


def test_entropy_closed_forms(spark):
    assert one(spark, "", E.shannon_entropy) == 0
    assert one(spark, "aaaa", E.shannon_entropy) == 0
    assert abs(one(spark, "abab", E.shannon_entropy) - 1) < 1e-9
    assert abs(one(spark, "abcd", E.shannon_entropy) - 2) < 1e-9
    assert abs(one(spark, "çğçğ", E.shannon_entropy) - 1) < 1e-9


def test_entropy_against_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcXYZ019+/é") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    got = spark.createDataFrame([(w,) for w in words], "v string").select(
        "v", E.shannon_entropy(F.col("v")).alias("h"), E.max_run(F.col("v")).alias("r")
    ).collect()
    for row in got:
        w = row.v
        want = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
        best = run = 0
        for i, c in enumerate(w):
            run = run + 1 if i and w[i - 1] == c else 1
            best = max(best, run)
        assert abs(row.h - want) < 1e-9 and row.r == best


def test_character_classes_in_order(spark):
    cases = {"": "text", "00ff": "hex", "MFRGG===": "base32", "abc1Z": "alnum", "ab+/": "base64", "a-b_cd==": "base64", "a$b": "printable", "a b": "text"}
    for value, want in cases.items():
        assert one(spark, value, E.char_class) == want, value


def test_keyspace_and_strength(spark):
    df = spark.createDataFrame([("0123456789abcdef",), ("0123456789abcde",), ("0123456789abcdef" * 2,)], "v string")
    rows = df.select(E.strength(E.keyspace_bits(F.col("v"), E.char_class(F.col("v")))).alias("s")).collect()
    assert [r.s for r in rows] == ["marginal", "weak", "strong"]


def test_dga(spark):
    assert one(spark, "xjqkzvwphtrnbl.com", hosts.dga_likeness) >= hosts.DGA_THRESHOLD
    assert one(spark, "www.bananabread.com", hosts.dga_likeness) < hosts.DGA_THRESHOLD
    assert one(spark, "api.com", hosts.dga_likeness) == 0


def test_bands_and_levels(spark):
    for raw, label in [(0, "spotless"), (1, "dusty"), (5, "dirty"), (15, "filthy"), (30, "very dirty"), (50, "biohazard"), (900, "biohazard")]:
        score = min(100, raw * 2)
        assert one(spark, score, severity.band_label, "v int") == label
    assert one(spark, "medium", severity.sarif_level) == "warning"
    assert one(spark, "info", severity.security_severity) == "0.0"


def test_paths(spark):
    assert one(spark, "src/__tests__/a.ts", text.is_test_path)
    assert one(spark, "src/a.spec.tsx", text.is_test_path)
    assert not one(spark, "src/contest/a.ts", text.is_test_path)
    assert one(spark, "src/app/api/x/route.ts", text.is_route_path)
    assert not one(spark, "docs/app/api/x/route.ts", text.is_route_path)
    assert one(spark, "a/B.TSX", text.extension) == ".tsx"


def test_fingerprint_survives_line_shift_and_spaces(spark):
    df = spark.createDataFrame([("r", "f", " a   b ", 3), ("r", "f", "a b", 9), ("r", "f", "", 4), ("r", None, None, 4)], "r string, f string, s string, l int")
    got = [x[0] for x in df.select(text.fingerprint(F.col("r"), F.col("f"), F.col("s"), F.col("l"))).collect()]
    assert got == ["r::f::a b", "r::f::a b", "r::f::L4", "r::(no file)::L4"]


def test_days_until_rounds_down(spark):
    df = spark.sql("SELECT timestamp'2024-01-10 00:00:00' AS now, timestamp'2024-01-09 23:59:59' AS a, timestamp'2024-01-16 23:00:00' AS b")
    row = df.select(text.days_until(F.col("a"), F.col("now")).alias("a"), text.days_until(F.col("b"), F.col("now")).alias("b")).first()
    assert (row.a, row.b) == (-1, 6)


def test_challenge_and_redirect(spark):
    df = spark.createDataFrame(
        [(403, {"cf-mitigated": "challenge"}, ""), (503, {}, "Just a moment..."), (200, {}, "just a moment"), (403, {}, "forbidden")],
        "s int, h map<string,string>, b string",
    )
    got = [r[0] for r in df.select(web.challenge_kind(F.col("s"), F.col("h"), F.col("b"))).collect()]
    assert got == ["Cloudflare challenge", "Cloudflare bot protection", None, None]
    cases = [
        ("http://a.example", 308, "https://a.example/", "https://a.example"),
        ("https://a.example", 302, "/login", None),
        ("https://a.example", 301, "https://b.example/", None),
        ("http://a.example", 200, "https://a.example/", None),
    ]
    df = spark.createDataFrame(cases, "base string, s int, l string, want string")
    for r in df.select("want", web.redirect_target(F.col("base"), F.col("s"), F.col("l")).alias("got")).collect():
        assert r.got == r.want


def test_redaction_and_parts(spark):
    assert "hunter22" not in one(spark, "const k = 'hunter22x';", text.redact_literal)
    assert one(spark, "ownerFullName_2", text.name_parts) == ["owner", "full", "name", "2"]
