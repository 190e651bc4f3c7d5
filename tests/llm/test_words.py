"""Operators on words next to plain Python over whole texts."""

import collections
import hashlib
import re

import numpy as np
import pytest
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.llm import decontaminate as D
from plumbline.llm import quality_rules as Q
from plumbline.llm import simhash as S

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def base_stats(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@given(st.lists(st.text(st.sampled_from("ab \n\t#é漢|"), max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_text_stats(texts):
    got = Q.text_stats(*C.text_buffer(pa.array(texts, pa.string())))
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [base_stats(t) for t in texts]


def test_quality_rules(docs, no_docs):
    rows = Q.quality_rules(docs).collect()
    want = collections.Counter((r.doc_id, *base_stats(r.text)) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Q.quality_rules(no_docs).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choice(words, rng.integers(40, 400))), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "***" for w in rng.choice(words, 100)), "en", "s") for i in range(60)]
    frame = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.quality_rules(frame).where("kept").collect()}
    assert not [i for i in kept if i >= 1000]
    assert len(kept) == 400
    assert {r.doc_id for r in Q.keep_clean(frame.withColumn("k0", F.lit(1)).withColumn("bin", F.lit(2))).collect()} == kept


def test_each_rate_rejects_in_a_tight_group(spark):
    """Symbols, repeated lines and repeated windows that the base rules pass, one at a time."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    draw = lambda n: list(rng.choice(words, n))
    texts = [" ".join(draw(rng.integers(80, 300))) for _ in range(300)]
    symbols = draw(200)
    symbols[::5] = [w + "*" for w in symbols[::5]]
    lines = "\n".join([" ".join(draw(160))] + ["again"] * 40)
    window = draw(20)
    far = [" ".join(symbols), lines, " ".join(draw(75) + window + draw(75) + window + draw(10))]
    one = [" ".join(draw(150)) + "*", " ".join(draw(150)) + "\nx\nx"]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + one + far)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in Q.quality_rules(frame).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert not any(rows[302 + i].kept for i in range(3))
    assert all(rows[300 + i].kept for i in range(2))
    assert sum(rows[i].kept for i in range(300)) >= 298


def brute_hits(texts, items):
    windows, lengths = collections.defaultdict(set), set()
    for item_id, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item_id)
            lengths.add(n)
    for text in texts:
        words, hit, ids = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        yield len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, docs, no_docs):
    source = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(6).collect()]
    items = [(f"i{n}", " ".join(t.split()[5 : 5 + 12 * (n + 1)])) for n, t in enumerate(source)]
    items += [("short", "two THREE"), ("one", "eleven"), ("again", items[0][1]), ("none", None), ("empty", " ,.")]
    items += [("loop", "one two three four five six seven eight nine ten eleven one two three")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = collections.Counter(tuple(r) for r in D.decontaminate(docs, bench).collect())
    own = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *h) for r, h in zip(own, brute_hits([r.text for r in own], items), strict=True))
    assert rows == want
    assert sum(k[-1] for k in rows) > 5
    assert D.decontaminate(no_docs, bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    left = D.drop_contaminated(docs.withColumn("h", F.lit(1)), bench)
    assert left.count() == sum(n for k, n in want.items() if not k[-1])


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(1, 10))
@settings(max_examples=200, deadline=None)
def test_winnowing_keeps_a_common_gram_of_every_shared_span(a, b, span):
    """Any two equal spans have an equal fingerprint at the same place in the span."""

    def prints(ids):
        text = " ".join("wxyz"[i] * 3 for i in ids).encode()
        found = C.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), C.ALNUM_LOWER)
        return set(zip(*(x.tolist() for x in D.picked(found, found.hashes(), span)), strict=True))

    mine, theirs = prints(a), prints(b)
    for i in range(len(a) - span + 1):
        for j in range(len(b) - span + 1):
            if a[i : i + span] == b[j : j + span]:
                room = range(span - D.gram_length(span) + 1)
                assert any({h for p, h in mine if p == i + k} & {h for p, h in theirs if p == j + k} for k in room)


def plain_print(text):
    words = (text or "").translate(LOWER).encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    spans = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    prints, group = sorted(prints), {}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[i + 1 :]:
            if bin(x ^ y).count("1") <= 2:
                parent[root(y)] = root(x)
    for p in prints:
        group.setdefault(root(p), []).append(p)
    return list(group.values())


def test_simhash(docs, no_docs):
    own = [(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = {}
    for group in brute_groups({p for _, p in own}):
        ids = [d for d, p in own if p in group and d is not None]
        least.update((p, min(ids, default=None)) for p in group)
    want = collections.Counter((d, f"{p:016x}", least[p]) for d, p in own)
    assert collections.Counter(tuple(r) for r in S.near_duplicates(docs).collect()) == want
    assert S.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_keep_one(spark, docs, no_docs, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    base = [["w%d" % n for n in rng.integers(0, 5000, rng.integers(30, 200))] for _ in range(12)]
    made = []
    for i in range(300):
        words = list(base[i % 12] if i % 3 else base[0])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = "x%d" % rng.integers(0, 9999)
        made.append((i, " ".join(words)))
    frame = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("fp", F.lit(1)).withColumn("grp", F.lit(2))
    rows = [(r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).digest(), r.text or "") for r in frame.collect()]
    sets = {r[3]: frozenset(S.shingle_hashes(r[3].encode()).tolist()) for r in rows}
    texts, parent = sorted(sets), {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(sets[a]) <= 1.25 * len(sets[b]) and len(sets[b]) <= 1.25 * len(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    want = {}
    for r in rows:
        want[root(r[3])] = min(want.get(root(r[3]), r), r)
    kept = S.keep_one(frame).collect()
    assert collections.Counter((r.doc_id, r.text or "") for r in kept) == collections.Counter((None if w[0] else w[1], w[3]) for w in want.values())
    assert S.keep_one(no_docs).count() == 0


def test_dense_and_large_buckets(spark, monkeypatch):
    """Many fingerprints in one neighbourhood, cut again and not cut, against all pairs."""
    rng = np.random.default_rng(1)
    near = {int(0xABCDEF) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(500)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in near)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {frozenset(p - (1 << 64) if p >> 63 else p for p in g) for g in brute_groups(near)}
    for large in (20, 100_000):
        monkeypatch.setattr(S, "LARGE_BUCKET", large)
        root = {r.fp: r.root for r in S.fingerprint_groups(frame).collect()}
        got = collections.defaultdict(set)
        for p in prints:
            got[root.get(p, p)].add(p)
        assert {frozenset(g) for g in got.values()} == want


def test_a_bucket_of_thousands_of_near_copies(spark):
    """Variants of one text in one bucket: tiles find the groups of the brute-force comparison."""
    rng = np.random.default_rng(9)
    base = ["w%d" % n for n in range(60)]
    made = []
    for i in range(5000):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            words[at] = "x%d" % rng.integers(0, 99999)
        made.append((i, " ".join(words)))
    sets = [S.shingle_hashes(t.encode()) for _, t in made]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    holds = np.zeros((len(sets), code.max() + 1), np.float32)
    holds[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), code] = 1
    size, label = holds.sum(axis=1), np.arange(len(sets))
    shared = np.concatenate([holds[i : i + 500] @ holds.T for i in range(0, len(sets), 500)])
    near = 5 * shared >= 4 * (size[:, None] + size[None, :] - shared)
    while True:
        low = np.array([label[n].min() for n in near])
        low = low[low]
        if (low == label).all():
            break
        label = low
    kept = S.keep_one(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist()))
