"""Suffix-array deduplication of long repeated byte strings.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else.

Which texts have to meet: a text is taken once, with a count, for all rows that share it. Of
every SPAN bytes the gram with the smallest hash is the anchor; equal
strings have equal anchors at equal places, so strings are dealt out by their anchor's hash.
Strings whose anchor occurs once in the corpus cannot repeat and are left where they are.
Neighbouring strings of one anchor form a context. Contexts that occur more than once as a
whole repeat in all their strings; one of them, and the others, travel to the anchor's shard.

In a shard the contexts are put one after the other, each closed by a separator of its own,
and their suffixes are sorted by induced sorting: suffixes are classified as smaller or
larger than their right neighbour, leftmost-smaller substrings are sorted and named, the
string of names is sorted recursively, and the order of all suffixes is induced from it in
two linear sweeps. Common prefixes come in text order (permuted): only positions whose
predecessor differs are compared, the rest follow by counting down. A suffix that shares
SPAN bytes with a neighbour in the order starts a repeated string.

The sweeps work on stretches: all entries up to the first slot that is still to be filled
are handled at once, which is about the square root of the length at a time.

A shard takes the contexts of whole anchors up to SHARD_BYTES. An anchor with more than
HOT_ANCHOR different contexts (at the edges of a notice that a third of all rows carry)
would not fit: its strings are compared by 128-bit digests, counted with partial sums before the shuffle.

Defined results: null is the empty text; texts under SPAN bytes lose nothing; repeated rows
are other places for their strings, so all copies lose the whole text; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.session import checkpoint_dir

SPAN = 400
GRAM = 32
SHARD_BYTES = 4 << 20
HOT_ANCHOR = 2000
_PLACE_BITS = 30


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, each element's rank inside its key, and the keys with counts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    many = np.diff(np.append(first, len(keys)))
    return order, np.arange(len(keys)) - np.repeat(first, many), ordered[first], many


class _Sorter:
    """Classes and buckets of one string, and the two inducing sweeps over it."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        self.text, self.n = text, n
        right = np.zeros(n, np.int8)
        right[:-1] = (text[1:] < text[:-1]).astype(np.int8) - (text[1:] > text[:-1])
        right[-1] = 1  # whatever stands before the end is larger than the end
        turns = np.flatnonzero(right)
        self.small = np.repeat(right[turns] < 0, np.diff(turns, prepend=-1))
        leftmost = self.small.copy()
        leftmost[0] = False
        leftmost[1:] &= ~self.small[:-1]
        self.is_leftmost, self.leftmost = leftmost, np.flatnonzero(leftmost)
        counts = np.bincount(text, minlength=size)
        self.tails = np.cumsum(counts)
        self.heads = self.tails - counts
        larger = np.bincount(text[~self.small], minlength=size)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.heads, 1)
        np.add.at(edge, self.heads + larger, -1)
        self.large_slot = np.cumsum(edge[:-1]) > 0
        # The letter before each place, turned if its suffix is a small one; the last entry is for slots without a suffix.
        self.bytes = size == 256
        self.before = np.empty(n + 1, np.int16 if self.bytes else np.int32)
        self.before[1:] = text
        self.before[1:][self.small] ^= -1
        self.count = np.arange(1 << 16)

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """Order of all suffixes that follows from the order of the leftmost-smaller ones."""
        text, n, small = self.text, self.n, self.small
        out = np.full(n, -1, np.int32)
        if len(seeds):
            order, rank, keys, many = _ranks(text[seeds])
            out[np.repeat(self.tails[keys] - many, many) + rank] = seeds[order]
        heads = self.heads.copy()
        out[heads[text[-1]]] = n - 1
        heads[text[-1]] += 1
        before = self.before
        before[[0, n]] = -1
        at, width = 0, 256
        while at < n:
            stretch = out[at : at + width]
            holes = (stretch < 0) & self.large_slot[at : at + width]
            stop = int(holes.argmax())
            if not holes[stop]:
                stop = len(stretch)
            stretch = stretch[:stop]
            found = before.take(stretch)
            live = (found >= 0).nonzero()[0]
            if len(live):
                order, keys, many, first = self._grouped(found[live])
                place = (heads[keys] - first).repeat(many)
                place += self.count[: len(live)]
                out[place] = stretch[live][order] - 1
                heads[keys] += many
            at += stop
            width = max(256, min(2 * stop, 1 << 16))
        out[~self.large_slot] = -1
        before[[0, n]] = 0
        tails = self.tails.copy()
        at, width = n, 256
        while at > 0:
            stretch = out[max(0, at - width) : at][::-1]
            holes = (stretch < 0) & ~self.large_slot[max(0, at - width) : at][::-1]
            stop = int(holes.argmax())
            if not holes[stop]:
                stop = len(stretch)
            stretch = stretch[:stop]
            found = before.take(stretch)
            live = (found < 0).nonzero()[0]
            if len(live):
                order, keys, many, first = self._grouped(~found[live])
                place = (tails[keys] + (first - 1)).repeat(many)
                place -= self.count[: len(live)]
                out[place] = stretch[live][order] - 1
                tails[keys] -= many
            at -= stop
            width = max(256, min(2 * stop, 1 << 16))
        return out

    def _grouped(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice, np.ndarray, np.ndarray]:
        """Stable order by letter, the letters, how many have each, and where each begins in the order."""
        if self.bytes:
            letters = letters.astype(np.uint8)
            many = np.bincount(letters, minlength=256)
            return letters.argsort(kind="stable"), slice(None), many, many.cumsum() - many
        order = letters.argsort(kind="stable")
        ordered = letters[order]
        new = np.ones(len(ordered), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        first = new.nonzero()[0]
        many = np.empty_like(first)
        many[-1] = len(ordered) - first[-1]
        np.subtract(first[1:], first[:-1], out=many[:-1])
        return order, ordered[first], many, first

    def names(self, ordered: np.ndarray) -> np.ndarray:
        """Numbers for sorted leftmost-smaller substrings: equal ones share theirs."""
        length = np.zeros(self.n, np.int64)
        length[self.leftmost] = np.diff(np.append(self.leftmost, self.n + 1)) + 1
        a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
        same = length[a] == length[b]
        live = np.flatnonzero(same)
        step = 0
        while len(live):
            live = live[step < length[a[live]]]
            ends = (a[live] + step >= self.n) | (b[live] + step >= self.n)
            same[live[ends]] = False  # the last substring runs into the end and equals no other
            live = live[~ends]
            differ = self.text[a[live] + step] != self.text[b[live] + step]
            same[live[differ]] = False
            live = live[~differ]
            step += 1
        return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray, size: int = 256) -> np.ndarray:
    """Start positions of all suffixes in their order, by induced sorting."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    sorter = _Sorter(text, size)
    seeds = sorter.leftmost
    if len(seeds) > 1:
        order = sorter.induce(seeds)
        ordered = order[sorter.is_leftmost[order]]
        names = sorter.names(ordered)
        if names[-1] + 1 < len(ordered):
            of = np.zeros(len(text), np.int32)
            of[ordered] = names
            seeds = seeds[suffix_array(of[seeds], int(names[-1]) + 1)]
        else:
            seeds = ordered
    return sorter.induce(seeds)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the common prefix with the suffix before it in the order, and that suffix."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = (before <= 0) | (np.arange(n) == 0)
    at = np.flatnonzero(~head)
    head[at] = text[at - 1] != text[before[at] - 1]
    starts = np.flatnonzero(head)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    prefix = np.zeros(n, np.int64)
    live = starts[before[starts] >= 0]
    room = n - np.maximum(live, before[live])
    step = 0
    while len(live):
        differ = words[live + step] ^ words[before[live] + step]
        done = (differ != 0) | (step + 8 >= room)
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        prefix[live[done]] = np.minimum(step + equal[done], room[done])
        live, room = live[~done], room[~done]
        step += 8
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    return prefix[starts][run] + starts[run] - np.arange(n), before


def repeated_starts(contexts: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each context a flag per start: are its next ``span`` bytes elsewhere in the contexts?"""
    parts = []
    for i, context in enumerate(contexts):
        # 0xFF is in no UTF-8 text; digits to the base 254 make each separator differ.
        parts += [context, bytes([255, *(1 + (i // 254**d) % 254 for d in range(4))])]
    text = np.frombuffer(b"".join(parts), np.uint8)
    prefix, before = permuted_prefixes(text, suffix_array(text))
    long = prefix >= span
    flags = long.copy()
    flags[before[long]] = True
    out, at = [], 0
    for context in contexts:
        out.append(flags[at : at + max(0, len(context) - span + 1)])
        at += len(context) + 5
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def anchors(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor hash, first and last start of each stretch of strings with one anchor."""
    n, width = len(buffer), SPAN - GRAM + 1
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - GRAM + 1)
    hashes = C.span_hashes(buffer.astype(np.uint16) + np.uint16(1), at, at + GRAM)
    keyed = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    size = -(-len(keyed) // width) * width
    blocks = np.full(size, np.iinfo(np.uint64).max)
    blocks[: len(keyed)] = keyed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(keyed) - width + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << _PLACE_BITS) - 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    whole = np.flatnonzero(np.arange(starts) + SPAN <= offsets[row + 1])
    place = least[whole].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[whole][1:] != row[whole][:-1])])) if len(whole) else whole
    last = np.append(first[1:], len(whole)) - 1
    low, high, rows = whole[first], whole[last] if len(whole) else whole, row[whole[first]]
    return rows, hashes[place[first]].view(np.int64), low - offsets[rows], high - offsets[rows]


def text_classes(docs: DataFrame, text: str) -> DataFrame:
    """(digest, copies, text) of texts of SPAN bytes or more, bucketed by digest.

    Both later joins with the texts find them where they lie and do not shuffle them.
    """
    spark = docs.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    rows = docs.where(F.octet_length(text) >= SPAN).select(C.digest_of(F.col(text)).alias("digest"), F.col(text).alias("text"))
    # Row counts before the shuffle: many copies of one text leave a task as one row.
    classes = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    buckets = C.shuffle_parts(spark)
    C.save(classes, lambda writer: writer.option("path", path).bucketBy(buckets, "digest").saveAsTable(name))
    table = spark.table(name)
    table.schema  # noqa: B018  the relation is resolved; its files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def _anchor_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    buffer, offsets = C.text_buffer(batch.column(2))
    rows, hashes, low, high = anchors(buffer, offsets)
    begin = offsets[rows]
    whole = C.span_hashes(buffer.astype(np.uint16) + np.uint16(1), begin + low, begin + high + SPAN)
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes), pa.array(whole.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
        ["digest", "copies", "h", "k", "low", "high"],
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the contexts that are to be compared out of each text."""
    for batch in batches:
        digest, h, low, data, single = [], [], [], [], []
        for d, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text.encode()
            for a in found:
                digest.append(d)
                h.append(a["h"])
                low.append(a["low"])
                data.append(text[a["low"] : a["high"] + SPAN])
                single.append(a["single"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(h, pa.int64()), pa.array(low, pa.int32()), pa.array(data, pa.binary()), pa.array(single, pa.bool_())],
            ["digest", "h", "low", "context", "single"],
        )


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors up to SHARD_BYTES share a suffix array."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_BYTES and row[1] != rows[-1][1]:
                yield _repeats(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield _repeats(rows)


_RANGE = "digest binary, start int, end int"


def _repeats(rows: list[tuple]) -> pa.RecordBatch:
    digest, start, end = [], [], []
    for (d, _, low, _, single), flags in zip(rows, repeated_starts([r[3] for r in rows]), strict=True):
        if single:
            for a, b in zip(*(x.tolist() for x in _runs(flags)), strict=True):
                digest.append(d)
                start.append(low + a)
                end.append(low + b - 1 + SPAN)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["digest", "start", "end"])


def _string_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of every string in the contexts."""
    for batch in batches:
        for part in C.steps(batch, "context", C.STEP_BYTES // 8):
            buffer, offsets = C.text_buffer(part.column(3))
            many = np.maximum(np.diff(offsets) - SPAN + 1, 0)
            row = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = offsets[row] + at
            values = buffer.astype(np.uint16) + np.uint16(1)
            one = C.span_hashes(values, begin, begin + SPAN)
            two = C.span_hashes(C.mix(values.astype(np.uint64)), begin, begin + SPAN)
            take = pa.array(row)
            low = np.asarray(part.column(2))[row] + at
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(4).take(take), pa.array(low.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["digest", "single", "start", "one", "two"],
            )


def repeated_ranges(classes: DataFrame) -> DataFrame:
    """(digest, ranges): byte ranges of each text that are covered by repeated strings.

    Contexts equal as a whole are told by (anchor hash, context hash), 128 bits, before any
    text moves: all of their strings repeat. One of each such group, and the contexts that
    occur once under a shared anchor, are what the suffix arrays sort.
    """
    spark = classes.sparkSession
    places = C.store(C.map_batches(classes, ["digest", "copies", "text"], "text", "digest binary, copies long, h long, k long, low int, high int", _anchor_rows))
    equal = places.groupBy("h", "k").agg(F.sum("copies").alias("n"), F.min(F.struct("digest", "low", "high")).alias("first"))
    anchored = equal.groupBy("h").agg(F.count("*").alias("contexts"), F.max("n").alias("most"), F.min("n").alias("least"))
    shared = C.store(equal.join(anchored.where("contexts > 1 OR most > 1"), "h"))
    whole = places.join(shared.where("n > 1").select("h", "k"), ["h", "k"], "left_semi").select("digest", F.col("low").alias("start"), (F.col("high") + SPAN).alias("end"))
    wanted = shared.where("contexts > 1 AND least = 1").select(
        "first.digest", F.struct("h", "first.low", "first.high", (F.col("n") == 1).alias("single"), (F.col("contexts") > HOT_ANCHOR).alias("hot")).alias("a")
    )
    found = C.store(wanted.groupBy("digest").agg(F.collect_list("a").alias("found")))

    def cut(which: str) -> DataFrame:
        own = found.select("digest", F.expr(f"filter(found, a -> {which})").alias("found")).where(F.size("found") > 0)
        rows = classes.join(own, "digest").select("digest", "text", "found")
        return rows.mapInArrow(_contexts, "digest binary, h long, low int, context binary, single boolean")

    dealt = cut("NOT a.hot").repartition(C.shuffle_parts(spark), "h").sortWithinPartitions("h")
    sorted_out = dealt.mapInArrow(_sort_shards, _RANGE)
    strings = C.store(cut("a.hot").mapInArrow(_string_digests, "digest binary, single boolean, start int, one long, two long"))
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("places")).where("places > 1")
    hot = strings.where("single").join(twice, ["one", "two"], "left_semi").select("digest", "start", (F.col("start") + SPAN).alias("end"))
    ranges = whole.unionAll(sorted_out).unionAll(hot)
    return ranges.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def cut_out(text: bytes, ranges: list) -> tuple[bytes, int]:
    """What is left of a text without sorted ranges, and how many runs went."""
    kept, at, runs = [], 0, 0
    for start, end in ranges:
        if start > at or not runs:
            runs += 1
            kept.append(text[at:start])
        at = max(at, end)
    return b"".join([*kept, text[at:]]), runs


def _cut_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    removed, runs, sha, texts = [], [], [], []
    for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        data = text.encode()
        kept, n = cut_out(data, [(r["start"], r["end"]) for r in ranges])
        removed.append(len(data) - len(kept))
        runs.append(n)
        sha.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(texts, pa.binary())],
        ["digest", "removed", "runs", "sha", "kept"],
    )


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, removed, runs, sha, kept) of each distinct text that loses bytes.

    ``kept`` are the bytes left; a cut may fall inside a character.
    """
    classes = text_classes(docs, text)
    rows = classes.join(repeated_ranges(classes), "digest").select("digest", "text", "ranges")
    return C.map_batches(rows, ["digest", "text", "ranges"], "text", "digest binary, removed long, runs long, sha string, kept binary", _cut_texts)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", C.digest_of(F.col("text")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return rows.join(without_repeats(docs).drop("kept"), "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"))
