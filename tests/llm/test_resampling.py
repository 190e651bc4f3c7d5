import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from plumbline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(rows, target):
    own = [(key, *features(text)) for key, text in rows]
    s, t = Counter(), Counter()
    for _, _, found in own:
        s.update(found)
    for text in target:
        t.update(features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0)))) for b in s}
    out = []
    for key, n_words, found in own:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(*r[:4], i + 1 if i < len(able) * 5 // 100 else None) for i, r in enumerate(able)]
    return sorted(ranks + [(*r[:4], None) for r in out if r[4] < 20], key=repr)


def result(docs, target):
    rows = resampling.ranked(resampling.weighted(docs, target)).collect()
    return sorted([(r.key, r.n_features, r.weight, r.score, r["rank"]) for r in rows], key=repr)


def test_against_brute_force(spark, docs):
    target = spark.createDataFrame([("one two three four",), (None,), ("The of same words",), ("é" * 500 + " x",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs, target) == brute(rows, [r.text for r in target.collect()])


def test_ties_and_repeated_rows_have_ranks_in_order(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(i // 2, text) for i in range(400)] + [(None, text)] * 9, "doc_id long, text string")
    target = spark.createDataFrame([(text,)], "text string")
    found = result(docs, target)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 409 * 5 // 100 + 1))
    by_rank = sorted((r for r in found if r[4]), key=lambda r: r[4])
    assert [r[3] for r in by_rank] == sorted((r[3] for r in by_rank), reverse=True)


def test_no_rows_no_target_and_clashing_names(spark, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.ranked(resampling.weighted(no_docs, none)).count() == 0
    odd = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, row int, key string")
    assert result(odd, none) == brute([(1, "a b c")], [])


def test_resample_keeps_columns(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i < 10 else 'bad'} word " * 15, i) for i in range(100)], "doc_id long, text string, key int")
    target = spark.createDataFrame([("good word " * 50,)], "text string")
    drawn = resampling.resample(docs, target)
    assert drawn.columns == docs.columns
    assert drawn.count() == 5 and all(r.doc_id < 10 for r in drawn.collect())


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    lengths = np.concatenate([np.arange(1, 700), [1280, 1281, 4000]])
    starts = rng.integers(0, 5000 - lengths + 1)
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]
    assert resampling.crc32_spans(data, starts, lengths).tolist() == want


def test_a_very_long_word_takes_few_steps():
    text = "x" * 3_000_000 + " y " + "".join(random.Random(1).choices("abc", k=1_000_000))
    found = resampling.Features(pa.array([text, None, "a"]))
    assert found.n_features.tolist() == [6, 0, 1]
    assert sorted(found.bucket.tolist()) == sorted({zlib.crc32(f.encode()) % 10000 for f in [" ".join(text.split()[i : i + k]) for k in (1, 2, 3) for i in range(4 - k)] + ["a"]})
