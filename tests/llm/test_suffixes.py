"""Suffix arrays and repeated strings next to brute force."""

import collections
import hashlib
import random
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import suffixes as S


@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode), st.integers(1, 30).map(lambda n: b"abaab" * n)))
@settings(max_examples=300, deadline=None)
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    order = S.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    if len(data):
        prefix, before = S.permuted_prefixes(text, order)
        for a, b in zip(order.tolist(), order.tolist()[1:], strict=False):
            n = 0
            while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert (prefix[b], before[b]) == (n, a)


@given(st.lists(st.text("ab", max_size=40).map(str.encode), max_size=8))
@settings(max_examples=150, deadline=None)
def test_repeated_starts(contexts):
    count = collections.Counter(c[i : i + 5] for c in contexts for i in range(len(c) - 4))
    got = [f.tolist() for f in S.repeated_starts(contexts, 5)] if contexts else []
    assert got == [[count[c[i : i + 5]] > 1 for i in range(len(c) - 4)] for c in contexts]


def brute(texts):
    span, at = S.SPAN, collections.Counter()
    for t in texts:
        at.update(t[i : i + span] for i in range(len(t) - span + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - span + 1):
            if at[t[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()


def planted():
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefgh äö\n") for _ in range(n))
    passage, short, long = made(450), made(380), made(2500)
    texts = [made(200) + passage + made(rng.randint(0, 300)) for _ in range(12)]
    texts += [made(50) + short + made(50) for _ in range(3)]
    texts += [long, long, long[:900] + "X" + long[900:], long[700:1900], made(300) + long[1000:1500] + made(20)]
    texts += [made(100) * 9, "a" * 1000, "a" * 399, "a" * 400, "漢" * 200, passage[:399], passage[:400], "", None]
    return texts


def rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return frame.withColumn("digest", F.lit(1)).withColumn("h", F.lit(2))


def test_dedup(spark, docs, no_docs, monkeypatch):
    texts = planted()
    want = list(brute([(t or "").encode() for t in texts]))
    assert sum(w[1] > 0 for w in want) > 15
    for hot, size in ((2000, 4 << 20), (3, 4 << 20), (2000, 1)):
        monkeypatch.setattr(S, "HOT_ANCHOR", hot)
        monkeypatch.setattr(S, "SHARD_BYTES", size)
        got = {r.doc_id: tuple(r)[1:] for r in S.dedup(rows(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert S.dedup(no_docs).count() == 0


def test_dedup_of_documents(docs):
    own = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(own, brute([(r.text or "").encode() for r in own]), strict=True))
    assert collections.Counter(tuple(r) for r in S.dedup(docs).collect()) == want


def test_sweeps_take_few_calls():
    """240 kB took 65,002 calls when each stretch made its ranks and keys anew, then 22,302."""
    words = [bytes(random.Random(i).choices(b"abcdefghijklmnop ", k=7)) for i in range(2000)]
    text = np.frombuffer(b" ".join(random.Random(1).choices(words, k=30_000)), np.uint8)
    calls = collections.Counter()

    def count(frame, event, arg):
        calls[event] += 1

    sys.setprofile(count)
    try:
        order = S.suffix_array(text)
    finally:
        sys.setprofile(None)
    assert sorted(order.tolist()) == list(range(len(text)))
    assert calls["call"] + calls["c_call"] < 40_000
