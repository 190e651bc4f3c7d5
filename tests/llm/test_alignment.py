import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plumbline.llm import alignment

TEXTS = ["Hello world", "", None, "<|endoftext|> and </s> <s>", "a▁b", "ünï 漢字 👍", "x" * 3000, "  two  spaces\n\n", "Hello world", "\x00nul"]


@pytest.fixture(scope="module")
def vocabs():
    return alignment.vocabularies(alignment.default_vocabularies())


def one(text, vocabs):
    """Links and groups of a text, found token by token."""
    a, b = (v.encode([text])[0] if text else [] for v in vocabs)
    spans = []
    for ids, v in zip((a, b), vocabs, strict=True):
        pieces = [v.joined(np.array([i])).tobytes() for i in ids]
        if text and b"".join(pieces) != b" " + text.encode():
            return [], [], []
        edges = np.cumsum([0, *map(len, pieces)]).tolist()
        spans.append(list(zip(ids, edges, edges[1:])))
    if not text:
        return [], [], []
    links = [(x, y) for x, s, e in spans[0] for y, f, g in spans[1] if s < g and f < e]
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, at = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if s >= at and e <= cut) for side in spans))
        at = cut
    return spans, links, groups


def brute(rows, vocabs):
    found = [(key, *one(text, vocabs)) for key, text in rows]
    count = Counter(pair for _, _, links, _ in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for key, spans, links, groups in found:
        n_a, n_b = (len(spans[0]), len(spans[1])) if spans else (0, 0)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


def result(df):
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def test_against_brute_force(spark, docs, vocabs, monkeypatch):
    few = docs.orderBy("doc_id").limit(40).unionByName(docs.where("doc_id is null or doc_id > 900000 and doc_id <> 900006"))
    few = few.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], docs.schema)).cache()
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    assert result(alignment.align(few)) == brute(rows, vocabs)


def test_small_blocks_give_the_same(spark, vocabs, monkeypatch):
    rows = [(i, f"word{i % 7} and some Text{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(4)
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 5)
    assert result(alignment.align(docs, key="key")) == brute(rows, vocabs)


def test_no_rows_only_empty_rows_and_clashing_names(spark, no_docs):
    assert alignment.align(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, 5, "x"), (2, "", 6, "y")], "doc_id long, text string, block int, codes string")
    assert result(alignment.align(empty)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_lanes_do_not_change_links(vocabs):
    text = "The quick brown fox, naïve façade; 12345 " * 200
    whole = alignment.Alignment([text, "short", text], vocabs)
    a, b, cut_a, cut_b = alignment.lockstep(whole.a, whole.b, lane=10**9)
    assert sorted(zip(a, b)) == sorted(zip(whole.link_a, whole.link_b))
    assert (cut_a == whole.cut_a).all() and (cut_b == whole.cut_b).all()


def test_joined_tokens_give_back_the_text(spark, vocabs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.aligned(docs).collect():
        text = TEXTS[r.key] or ""
        if not r.a_ids:
            assert text == "" or "▁" in text
            continue
        for ids, ends, v in ((r.a_ids, r.a_ends, vocabs[0]), (r.b_ids, r.b_ends, vocabs[1])):
            assert v.joined(np.array(ids)).tobytes() == b" " + text.encode()
            assert ends[-1] == len(text.encode()) + 1
        assert r.cuts == sorted(set(r.a_ends) & set(r.b_ends))
        assert len(r.link_a) == len(r.link_b) >= max(len(r.a_ids), len(r.b_ids))


def test_ranks_give_the_ids_of_the_file(docs, vocabs):
    assert vocabs[0].by_rank is not None
    texts = [r.text for r in docs.select("text").collect() if r.text] + [t for t in TEXTS if t]
    texts += [" " * 500_000, "\n" * 300_000 + "x", "9" * 5000, "it's we'LL don't", "\u00a0\u2003 \t\r\n", "e\u0301" * 50, "\ud7ff\ue000\ufffd"]
    want = [e.ids for e in vocabs[0].tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert vocabs[0].encode(texts) == want
