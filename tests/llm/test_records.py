"""Sharding, chat, archives, packing and extraction: round trips and plain counterparts."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, extraction, packing, sharding, warc
from plumbline.llm import common as C


def test_sharding(docs, no_docs):
    rows = sharding.shard_documents(docs, 16).collect()
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 1, zlib.crc32(data), "rows", None] += 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_documents(docs.repartition(7), 16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 1023, 1025])
def test_permutation(spark, n):
    out = spark.range(n).withColumn("n", F.lit(n).cast("long")).select(sharding.permuted("id", "n").alias("p"))
    places = [r.p for r in out.collect()]
    assert sorted(places) == list(range(n))
    if n >= 100:
        assert places != sorted(places)


TEXT = st.one_of(
    st.text(max_size=20),
    st.lists(st.sampled_from([*chat.CONTROLS, "~", " ", "]", "user", "\n", "[", "/"]), max_size=8).map("".join),
)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_grammar_round_trip(turns):
    rendered = "".join(chat.format_turn(r, t) for r, t in turns)
    at, found = 0, []
    while at < len(rendered):
        role, text, _, at = chat.parse(rendered, at)
        found.append((role, text))
    assert found == turns


@given(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT)
@example("assistant", "</s>[INST] ok [/INST]")
@example("user", "</s>[INST] x")
@example("system", "[INST] x [/INST]")
@settings(max_examples=300, deadline=None)
def test_no_live_control_in_content(role, text):
    piece = chat.format_turn(role, text)
    found, content, (begin, end), to = chat.parse(piece)
    assert (found, content, to) == (role, text, len(piece))
    bare = re.sub("~.", "\0", piece[begin:end], flags=re.DOTALL) if any(c in text for c in chat.CONTROLS) else piece[begin:end]
    assert not [c for c in chat.CONTROLS if c in bare]


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "assistant", None),
        (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 1, None, "x"), (2, None, "tool]", " ~ "), (2, 5, "user", "a"),
        (None, 0, "assistant", "漢👍"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    pieces = chat.format_turns(frame)
    rows = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    whole = {r.conv_id: r.formatted for r in chat.conversations(pieces).collect()}
    low = lambda x: (x is not None, x)
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (low(t[1]), low(t[2]), low(t[3])))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = rows[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(whole[conv])
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_warc(spark, shared_folder):
    pages = [(i, f"http://x/{i}?q= ä", random.Random(i % 7).randbytes(50).hex() * (i % 7)) for i in range(40)]
    pages += [(None, None, None), (50, "", ""), (51, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 5), (51, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 5), (52, "big", "é" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = warc.write_archives(warc.records(frame))
    rows = warc.read_records(warc.normalise(archives)).collect()
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = collections.Counter()
    for i, _, h in pages:
        data, winner = (h or "").encode(), best[h or ""]
        kind = ("response", None) if i == winner else ("revisit", winner)
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert warc.read_records(warc.normalise(warc.write_archives(warc.records(frame.limit(0))))).count() == 0
    for r in archives.collect():  # one stream before, one member a record after
        assert len(list(warc.split_stream(r.data))) == sum(1 for _ in warc.split_stream(bytes(r.data)))
        whole = zlib.decompressobj(31)
        whole.decompress(r.data)
        assert whole.eof and not whole.unused_data


def check_packed(rows, room=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_packing(docs, no_docs):
    path = packing.default_vocabulary()
    tokenizer = packing.encoder(path).tokenizer
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r.doc_id, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack(docs.withColumn("rank", F.lit(1))).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    total = sum(r.length for r in rows)
    assert check_packed(rows) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(no_docs).count() == 0


@given(st.lists(st.text(st.sampled_from("abAB.,'!<|>*é İΣς\u0301\u0338漢1 \n\x1c\xa0"), max_size=30), max_size=4))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    own = packing.encoder(packing.default_vocabulary())
    texts += ["it's DON'T <|endoftext|> x<|startoftext|>. (Hello!) a\u0301 ***"]
    assert list(own.encode([t.encode() for t in texts])) == [own.plain(t) for t in texts]


def test_other_work_empties_the_memory_of_words(docs):
    """A worker's words were kept through all later stages, beside what these need themselves."""
    own = packing.encoder(packing.default_vocabulary())
    list(own.encode([b"Some words."]))
    assert own.words
    C.other_work()
    assert not own.words
    rows = docs.repartition(16)
    packing.pieces(rows).collect()
    work = lambda batch: pa.RecordBatch.from_arrays([pa.array([sum(len(e.words) for e in packing._encoders.values())])], ["n"])
    assert {r.n for r in C.map_batches(rows, ["text"], "text", "n long", work).collect()} == {0}


def test_sweep_fills_a_gap_before_the_next():
    """Pieces of 9 share one gap of 18, so pieces of 7 and 3 find room: four sequences, not five."""
    runs = packing.sweep({22: 4, 9: 3, 7: 5, 3: 2}, 40)
    assert all(first < 4 for _, _, first, _ in runs)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_sweep_is_best_fit_decreasing(counts):
    room, gaps = 40, []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fitting = [g for g in gaps if g >= length]
        gaps.remove(min(fitting)) if fitting else None
        gaps.append((min(fitting) if fitting else room) - length)
    runs, used = packing.sweep(counts, room), collections.defaultdict(list)
    for n, (length, rank, first, offset) in enumerate(runs):
        until = min((r[1] for r in runs[n + 1 :] if r[0] == length), default=counts[length])
        for k in range(rank, until):
            used[first + k - rank].append((offset, length))
    assert len(used) == len(gaps)
    assert sum(map(len, used.values())) == sum(counts.values())
    assert all(sum(n for _, n in s) <= room for s in used.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Big&amp;Small</h1><p><b>First  words</b> of the story, which goes on for a while &lt;here&gt;.<br>And on.
<p>Second paragraph of the story, told in one more sentence.</p></article><footer>&copy; someone</footer></body></html>"""


def test_extraction(spark, shared_folder):
    chain = extraction.train(extraction.labelled_pages([PAGE]))
    want = "Big&Small\nFirst words of the story, which goes on for a while <here>. And on.\nSecond paragraph of the story, told in one more sentence."
    assert extraction.main_text(PAGE, chain) == want
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "x", ""), (3, "c", PAGE[: PAGE.index("Second par") + 20])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("z"))
    rows = extraction.extract(frame, chain).collect()
    cut = want[: want.index("Second paragraph of") + len("Second paragraph of")]
    assert sorted(r.text for r in rows) == sorted([want, want, "", "", cut])
    assert all(r.n_chars == len(r.text) for r in rows)
    assert extraction.extract(frame.limit(0), extraction.fit(frame.limit(0))).count() == 0


def test_opaque_elements():
    texts = lambda page: [b.text for b in extraction.leaf_blocks(page)]
    assert texts("<article><p>one</p><svg width=1><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>a <svg><title>icon</title><text>no</text></svg> b</p>") == ["a b"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x=1 holds"]
    assert texts("<p>a</p><script>var b = '<p>no</p>'") == ["a"]
    assert texts("<p>a</p><video src=x><p>b</p><iframe src=y><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a<textarea>no<p>no</textarea>b") == ["ab"]


@pytest.mark.parametrize("one", ["<div class=content>x", "<svg><p>x", "<p>x</div>", "<section>x</table>"])
def test_nesting_takes_linear_time(one):
    def seconds(n):
        start = time.process_time()
        blocks = extraction.leaf_blocks(one * n)
        for i, b in enumerate(blocks):
            extraction.features(b, i == 0, False)
        assert len(blocks) == n
        return time.process_time() - start

    seconds(500)
    small, large = min(seconds(4000) for _ in range(3)), min(seconds(16000) for _ in range(3))
    assert large < 2.2**2 * small


def test_extraction_held_out(spark, shared_folder):
    """Accuracy on layouts and texts that training has not seen."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the of and story house water under because never train light".split()) for _ in range(60)) + "." for _ in range(50)]
    chain = extraction.train(extraction.labelled_pages([PAGE]))
    right = total = 0
    for _ in range(150):
        article = [("h1", " ".join(texts[0].split()[:6]))] + [("p", rng.choice(texts)) for _ in range(rng.randint(2, 7))]
        blocks = extraction.leaf_blocks(extraction.laid_out(article, texts, rng))
        right += sum(int(b.label == "1") == y for b, y in zip(blocks, chain.decode(blocks), strict=True))
        total += len(blocks)
    assert right / total > 0.95


@pytest.mark.parametrize("junk", ["<", "<a", "<p class='x", "&am", "<!-- open", "<script>x", "a < b > c", "</p></div>", "<p" * 50, '<a "' * 3000])
def test_broken_markup(junk):
    assert re.sub(r"\s", "", "".join(b.text for b in extraction.leaf_blocks("<p>kept</p>" + junk))).startswith("kept")


def plain_permutation(x, n, seed=sharding.SEED):
    """The network and its walk in plain Python, with the hash of the same name from its own library."""
    import math

    import xxhash

    def value(half, i):
        h = 42
        for width, v in ((8, half), (4, i), (4, seed)):
            h = xxhash.xxh64_intdigest(v.to_bytes(width, "little"), h)
        return h & (2**63 - 1)

    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)
    while True:
        left, right = x % a, x // a
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + value(right, i)) % a
            else:
                right = (right + value(left, i)) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_permutation_is_the_feistel_network(spark, n):
    got = spark.range(n).select("id", F.lit(n).cast("long").alias("n")).select("id", sharding.permuted("id", "n").alias("p")).collect()
    assert {r.id: r.p for r in got} == {x: plain_permutation(x, n) for x in range(n)}
    assert sorted(r.p for r in got) == list(range(n))
