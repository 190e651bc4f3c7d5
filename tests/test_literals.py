"""Literals that patterns need: a text without them never matches, and the scan looks for them first."""

import random
import re

from pyspark.sql import functions as F

from plumbline.functions.literals import needs
from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.plans import patterns as P
from plumbline.plans import scoped


def scan_patterns():
    text = "|".join([*(D.clause_facts(i, c) for i, c in enumerate(P.CLAUSES)), D.flag_facts(), D.helper_facts(), *(m() for m in X.OWN + X.EDGES), scoped.scoped_facts()])
    found = re.findall(r"\(dense rlike '((?:[^'\\]|\\.)*)'", text)
    return sorted({p.replace("\\'", "'").replace("\\\\", "\\") for p in found})


def test_needs_by_hand():
    assert needs(r"(?i)Rate[-_ ]?LIMIT") == ("limit",) or needs(r"(?i)Rate[-_ ]?LIMIT") == ("rate",)
    assert needs(r"\b(?:create|createMany|insert)\s*\(") == ("create", "insert")
    assert needs(r"foo(?:bar)?") == ("foo",) and needs(r"(?:foo)?bar\w+") == ("bar",)
    assert needs(r"(?:foo|\w+)") is None and needs(r"(?:foo)*") is None and needs(r"ab") is None
    assert needs(r"h[eE]llo|wor(?=l)ld") == ("hello", "world") and needs("[^a]ğüş") is None
    assert needs(r"(?:abc){2}") == ("abc",) and needs(r"(unclosed") is None


def test_no_match_lacks_its_literals():
    """Texts made from the patterns' own pieces; wherever one matches, the lower-cased text holds a literal."""
    rng = random.Random(3)
    patterns = scan_patterns()
    assert len(patterns) > 150 and sum(needs(p) is not None for p in patterns) > 0.9 * len(patterns)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z_@/]{2,}", p)}) + list(" .('\"`=:;{},\n[]<>-1") * 60
    compiled = [(re.compile(p, re.ASCII), needs(p)) for p in patterns if needs(p)]
    hits = 0
    for _ in range(1500):
        text = "".join(rng.choice(words) for _ in range(60))
        text = "".join(c.upper() if rng.random() < 0.05 else c for c in text)
        for pattern, held in compiled:
            if pattern.search(text):
                hits += 1
                assert any(h in text.lower() for h in held), (pattern.pattern, held, text)
    assert hits > 1000


def test_the_scan_looks_for_literals_before_patterns():
    assert D.rlike("dense", r"\bjwt\s*\.\s*verify") == "((contains(low, 'verify')) and (dense rlike '\\\\bjwt\\\\s*\\\\.\\\\s*verify'))"
    assert D.rlike("path", "verify") == "(path rlike 'verify')"
    # Of a mention only the key is its own; what the file says by hand is asked once.
    assert X.write_mentions().count("content rlike") == 1 and "'level', int(extra)" in X.write_mentions()


def test_blanks_at_the_end_of_a_file(spark):
    texts = ["", "a", "a \n", " " * 200, "a" + " " * 500, "a" + " \n" * 300 + "  ", "a\n" + " " * 300 + "b" + "\t" * 63 + "\n", "\n" * 400]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.cut_tail(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.t.rstrip(D.BLANKS) == r.s.rstrip(D.BLANKS) and len(r.s) <= len(r.t.rstrip(D.BLANKS)) + D.TAIL + 1
        assert r.t.startswith(r.s.rstrip("\n")) and ("\n" in r.t) == ("\n" in r.s)
