"""Line deduplication next to all pairs of lines."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import line_dedup as L


def words_of(line):
    return frozenset(line.encode().lower().split())


def brute(rows):
    """(doc_id, n_lines, n_removed, kept text) per row of (doc_id, text)."""
    keyed = {}
    for doc_id, text in rows:
        keyed[(doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).digest())] = text or ""
    before, out = [], {}
    for key in sorted(keyed):
        kept, taking, gone, mine = [], 0, 0, []
        for line in keyed[key].split("\n"):
            s = words_of(line)
            if len(s) >= 5:
                taking += 1
                if any(5 * len(s & t) >= 4 * len(s | t) for t in before):
                    gone += 1
                    before.append(s)
                    continue
                before.append(s)
            kept.append(line)
        out[key] = (taking, gone, "\n".join(kept))
    for doc_id, text in rows:
        taking, gone, left = out[doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).digest()]
        yield doc_id, taking, gone, left


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("xyzuvw") * 3
    return words


def made():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(30)]
    rows = []
    for i in range(120):
        lines = [" ".join(edited(rng, rng.choice(base), rng.randint(0, 4))) for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice([i, i, None, i // 2]), "\n".join(lines + [""] * rng.randint(0, 2))))
    return rows + [(3, None), (5, ""), (7, "A b c d e\n\te D C b a \nb c"), (8, "a b c d E f"), (9, "one\x00 two\x0bthree\x0cfour five")]


@pytest.mark.parametrize("large", [32, 2])
def test_line_dedup(spark, docs, no_docs, monkeypatch, large):
    monkeypatch.setattr(L, "LARGE_GROUP", large)
    small = spark.createDataFrame(made(), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("line", F.lit(2))
    for frame in (small, docs):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        want = list(brute(rows))
        got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in L.dedup_lines(frame).collect())
        assert got == collections.Counter((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in want)
        assert sum(k[2] for k in got) > 20
        out = L.cut_documents(frame)
        assert out.columns == frame.columns
        assert collections.Counter(r.text or "" for r in out.collect()) == collections.Counter(w[3] for w in want)
    assert L.dedup_lines(no_docs).count() == 0


def test_links_are_all_pairs(spark):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {words_of(x) for _, t in rows for x in (t or "").split("\n")}
    sets = [s for s in sets if len(s) >= 5]
    want = sum(5 * len(s & t) >= 4 * len(s | t) for i, s in enumerate(sets) for t in sets[i + 1 :])
    classes, links = L.similar_classes(frame, every=True)
    assert classes.count() == len(sets)
    assert links.count() == want > 50


@pytest.mark.parametrize(("large", "dense"), [(512, 16), (3, 0)])
def test_classes_report_all_their_links(spark, monkeypatch, large, dense):
    monkeypatch.setattr(L, "LARGE_GROUP", large)
    monkeypatch.setattr(L, "DENSE", dense)
    rng = random.Random(5)
    copy = [f"w{i}" for i in range(30)]
    rows = made() + [(1000 + i, " ".join(edited(rng, copy, rng.randint(0, 3)))) for i in range(60)]
    rows += [rows[-1]] * 20
    firsts = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        for line in (text or "").split("\n"):
            if len(s := words_of(line)) >= 5:
                firsts.setdefault(s, (doc_id, text))
    want = collections.defaultdict(list)
    for s, row in firsts.items():
        want[row].append(sum(s != t and 5 * len(s & t) >= 4 * len(s | t) for t in firsts))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expect = collections.Counter((d, tuple(want.get((d, t), ()))) for d, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.class_links)) for r in got) == expect
    assert all(r.n_links == sum(r.class_links) for r in got)
    assert len({i for r in got for i in r.class_ids}) == len(firsts)
    _, links = L.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), every=True)
    assert links.distinct().count() == links.count() == sum(map(sum, want.values())) // 2 > 800


def test_short_lines_take_part(spark, tmp_path):
    texts = ["All rights reserved\nShare\n\na b c d", "ALL rights reserved reserved\nshare it\na b c d e", "a a a a a a\nShare\n \na b c", "A"]
    want = [(3, 0, texts[0]), (3, 2, "share it"), (3, 1, "a a a a a a\n \na b c"), (1, 1, "")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in enumerate(want)}


@given(st.text(st.sampled_from("aB \t\r\x0b\x0c\x00\x1c\x1f\x85\xa0\u2003\u3000")), st.integers(1, 3))
def test_has_words_equals_taking_the_line_apart(line, many):
    assert L.has_words(line, many) == (len(words_of(line)) >= many)


def test_postings_travel_in_blocks_and_all_classes_of_a_word_meet_once():
    n, words, buckets = 60, np.arange(1, 4) << 57, 7
    prefix = L._packed(np.tile(words, n), np.full(n, 3))
    ids = np.arange(n)
    columns = [pa.array(ids), pa.array(np.full(n, 9, np.int32)), pa.array(ids), pa.array(ids), prefix]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "size", "s0", "s1", "prefix"])
    hot = L._hot_cell(words[:1]), np.array([4], np.int32)  # the first word goes into four blocks
    out = list(L._postings(hot, buckets)([batch]))
    assert sum(b.num_rows for b in out) <= buckets
    met = collections.Counter()
    for row in (r for b in out for r in b.to_pylist()):
        word, tile, own, shape = (np.frombuffer(row[c], np.int64).tolist() for c in ("word", "tile", "id", "shape"))
        rows = sorted(zip(word, tile, own, (x & 1 for x in shape), strict=True))
        for (w, t, a, p), (v, u, b, q) in itertools.combinations(rows, 2):
            if (w, t) == (v, u) and (t >> 32 == t & 0xFFFFFFFF or p != q):
                met[w, min(a, b), max(a, b)] += 1
    assert met == collections.Counter((w, a, b) for w in words.tolist() for a, b in itertools.combinations(range(n), 2))


def test_candidates_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    base = [rng.choice(200, 20, replace=False) for _ in range(12)]
    sets = sorted({tuple(sorted({*rng.choice(base[i % 12], 19, replace=False).tolist(), int(rng.integers(200))})) for i in range(120)})
    size = np.array([len(s) for s in sets])
    words = np.concatenate([np.array(s, np.uint64) << np.uint64(50) | np.array(s, np.uint64) for s in sets])
    first, many = np.cumsum(size) - size, L.prefix_length(size)
    of = np.repeat(np.arange(len(sets)), many)
    shape = size[of] << 32 | L._take_runs(np.zeros(len(sets), np.int64), many) << 1
    sketch = [s.view(np.int64)[of] for s in L.sketches(words, size)]
    prefix = words[L._take_runs(first, many)].view(np.int64)
    found = [r for b in L._candidates(10**6)(prefix, np.zeros(len(of), np.int64), of, shape, *sketch) for r in b.to_pylist()]
    want = {(i, k) for i, k in itertools.combinations(range(len(sets)), 2) if 5 * len({*sets[i]} & {*sets[k]}) >= 4 * len({*sets[i]} | {*sets[k]})}
    assert want <= {(r["a"], r["b"]) for r in found} and len(want) > 20
