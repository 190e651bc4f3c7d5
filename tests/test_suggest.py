"""Link suggestions against scoring of all pairs."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from plumbline.operators import suggest as S
from plumbline.operators.graph import page_links, page_rank
from plumbline.plans import links


def site(n, seed):
    """Pages of two hosts: topics of their own, words that many or all pages have, links."""
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = []
    for i in range(n):
        host = "a.example" if i % 3 else "b.example"
        topic = names[(i % 7) * 8 : (i % 7) * 8 + 8]
        words = rng.choices(topic, k=12) + rng.choices(names, k=rng.randrange(6)) + ["everywhere"] + (["often"] if rng.random() < 0.7 else [])
        rng.shuffle(words)
        links = "".join(f'<a href="/p{rng.randrange(n)}">x</a>' for _ in range(3))
        rows.append((f"https://{host}/p{i}?q={i}", f"<nav>navigation</nav><p>{' '.join(words[:6])}. {' '.join(words[6:])}!</p>{links}"))
    return rows + [("https://a.example/none", None), ("https://a.example/empty", ""), ("https://a.example/p1", "<p>zzzz second row of one page</p>"), (None, "<p>lost</p>")]


def brute(rows, k):
    pages = {}
    for url, html in rows:
        m = re.match(r"[a-zA-Z]+://([^/?#]+)([^?#]*)", url or "")
        if m:
            node = m[1] + (m[2] or "/")
            pages[node] = min(pages.get(node, html or ""), html or "")
    words = {n: set(re.findall(r"[a-z]{4,}", re.sub("<[^>]*>", " ", re.sub("<nav>.*?</nav>", " ", h)))) for n, h in pages.items()}
    host = lambda n: n.split("/")[0]
    size = Counter(host(n) for n in pages)
    df = Counter((host(n), w) for n, ws in words.items() for w in ws)
    weight = {key: math.floor(1000 * math.log(size[key[0]] / c)) for key, c in df.items()}
    links = {(n, host(n) + t) for n, h in pages.items() for t in re.findall(r'href="(/[^"]*)"', h)}
    total = {n: sum(weight[host(n), w] for w in ws) for n, ws in words.items()}
    out = defaultdict(list)
    for a in pages:
        for b in pages:
            if a != b and host(a) == host(b) and (a, b) not in links:
                score = sum(weight[host(a), w] for w in words[a] & words[b])
                if score:
                    out[a].append((-score / (total[a] + total[b] - score), b, score))
    return {a: [(b, score) for _, b, score in sorted(rows)[:k]] for a, rows in out.items()}


@pytest.mark.parametrize("few,k", [(32, 3), (2, 3), (4, 1)])
def test_against_all_pairs(spark, monkeypatch, few, k):
    monkeypatch.setattr(S, "FEW", few)
    rows = site(90, few)
    got = defaultdict(list)
    for r in S.link_suggestions(spark.createDataFrame(rows, "url string, html string"), k).where("source like '%.example%'").orderBy("source", "rank").collect():
        got[r.source].append((r.target, r.score))
        assert r.anchor in r.sentence and 0 < r.similarity <= 1
    assert got == brute(rows, k)


def test_no_pages_and_one_page(spark):
    assert S.link_suggestions(spark.createDataFrame([], "url string, html string")).count() == 0
    assert S.link_suggestions(spark.createDataFrame([("http://a/x", "<p>word</p>")], "url string, html string")).count() == 0


def test_common_words_make_no_pairs(spark):
    """Two hundred pages in pairs, with three words that most have: the second round stays near the pairs."""
    rows = [(f"http://h/{i}", f"<p>topic{'abcdefghijklmnopqrstuvwxyz'[i // 2 % 26]}{'abcdefgh'[i // 52]} same{'abcdefghijklmnopqrstuvwxyz'[i // 2 % 26]}{'abcdefgh'[i // 52]} {'common' if i % 10 else ''} {'shared' if i % 11 else ''}</p>") for i in range(200)]
    words = S.page_words(spark.createDataFrame(rows, "url string, html string"))
    none = spark.createDataFrame([], "src string, dst string")
    seen = []
    scored = S._scored
    S._scored = lambda pairs, w: seen.append(pairs.count()) or scored(pairs, w)
    try:
        assert S.similar_pages(words, none, 1).count() == 200
    finally:
        S._scored = scored
    assert sum(seen) < 1000 < 200 * 199


@pytest.mark.parametrize("dense,at_once", [(0.07, 4_000_000), (0.5, 40), (2, 500)])
def test_blocks_of_a_host_against_all_pairs(spark, monkeypatch, dense, at_once):
    """A host in many blocks, few sums at a time; Python workers get what is set here."""
    for name, value in (("LEAST", 5), ("BLOCK", 7), ("FEW", 2)):
        monkeypatch.setattr(S, name, value)
    tile = S._tile
    monkeypatch.setattr(S, "_tile", lambda k, few: tile(k, few, dense, at_once))
    rows = site(80, 5)
    got = defaultdict(list)
    for r in S.link_suggestions(spark.createDataFrame(rows, "url string, html string"), 2).where("source like '%.example%'").orderBy("source", "rank").collect():
        got[r.source].append((r.target, r.score))
    assert got == brute(rows, 2)


def test_long_pages_are_scored_in_proportion_to_their_words(spark):
    """300 pages of 400 common words: comparing each word with each took 14 thousand million steps."""
    names = ["w" + "".join("abcdefghij"[int(c)] for c in f"{i:03}") for i in range(1000)]
    rows = [(f"http://h/{i}", f"<p>{' '.join(random.Random(i).sample(names, 400))}</p>") for i in range(300)]
    start = time.monotonic()
    assert S.link_suggestions(spark.createDataFrame(rows, "url string, html string")).count() == 900
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("witnesses,k", [(64, 3), (1, 3), (1, 40)])
def test_counts_are_those_of_the_suggestions(spark, monkeypatch, witnesses, k):
    """Without witnesses, with many links and with more wanted than a word has pages, the counts stay exact."""
    monkeypatch.setattr(S, "WITNESSES", witnesses)
    rows = site(90, 11)
    everything = "".join(f'<a href="/p{i}">x</a>' for i in range(88))
    rows += [("https://a.example/map", f"<p>{rows[1][1]}</p>{everything}"), ("https://c.example/1", "<p>alone together</p>"), ("https://c.example/2", "<p>alone apart</p>")]
    rows += [("https://c.example/3", "<p>together nothing</p>"), ("https://c.example/4", "<p>different</p>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r.source: r.n for r in S.suggestion_counts(pages, page_links(pages)[1], k).collect()}
    assert got == {a: len(found) for a, found in brute(rows, k).items()}
    assert got["c.example/1"] == 2 and "c.example/4" not in got


def test_counting_scores_no_pair(spark, monkeypatch):
    """The summary needs the number alone; scoring all pairs for it took 85 s on 12,820 pages."""
    monkeypatch.setattr(S, "_scored", lambda *_: pytest.fail("pairs were scored"))
    pages = spark.createDataFrame(site(90, 3), "url string, html string")
    nodes, edges = page_links(pages)
    row = links.link_summary(page_rank(nodes, edges, 2), S.suggestion_counts(pages, edges)).first()
    assert row.suggestions == sum(len(x) for x in brute(site(90, 3), 3).values())


def test_summary_of_no_pages(spark):
    pages = spark.createDataFrame([], "url string, html string")
    nodes, edges = page_links(pages)
    assert links.link_summary(page_rank(nodes, edges, 2), S.suggestion_counts(pages, edges)).first().suggestions == 0
