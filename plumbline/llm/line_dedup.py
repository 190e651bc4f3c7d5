"""Line deduplication by an exact set-similarity join.

A line is the set of its words (lower-cased A-Z, split at white space). A line of
``min_words`` or more different words (1 in the query and the pipeline) goes if a similar one (Jaccard 0.8 or more) comes before it in the
order (doc_id, digest of the text, line number); the first of each kind stays.

Words are ordered by rarity: a table of COUNT_CELLS hashed counts over all words of the
corpus ranks them (any fixed order gives right results; a better one fewer candidates).
Lines with equal sets are one class. Two sets with a Jaccard of 0.8 share a word among the
first n - ceil(0.8 n) + 1 of each, so only these are indexed. Under each word, classes are
paired if their sizes allow it (length filter), if what follows the word can still make up
the overlap (positional filter), and if 128-bit sketches of the sets leave room for it (a
bit that only one set has is a word that is not shared); all pairs are then verified on the
whole sets, and the links of each class counted.

The classes of a hot word are dealt into blocks, and pairs of blocks (tiles) over tasks. In
a tile where most pairs are candidates (a group of near copies) pairs are never rows: the
whole sets meet there as 0/1 matrices, whose products are the overlaps. A pair counts only
under its first common word. Comparing a group is still quadratic in its classes; what is
stored and shuffled grows with classes times blocks.

A line that a third of all documents carry is one row a step of text before the shuffle. The
words of prefixes travel in blocks of a hashed bucket, and a task takes a bucket at a time, so
they are not rows one by one. Only hashed counts reach the driver: COUNT_CELLS numbers, and of
HOT_CELLS those that have a hot word; another word in such a cell is dealt like it, which costs
some copies and changes no result.

Defined results: null and empty texts stay as they are; lines with fewer words, and blank
lines in any case, always stay;
rows equal in doc_id and text are one document and keep the same lines; null ids come last
in the order; other columns pass through unchanged whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C

#: Least number of different words of a line that takes part, where the caller names none.
MIN_WORDS = 5
#: What the query and the pipeline name: every line that has a word.
ANY_LINE = 1
#: Sets of fewer words are similar to their equals only (3 of 4 words is under 0.8).
_LEAST_JOINED = 4
COUNT_CELLS = 1 << 16
#: Parts that the hashed counts are added up in.
_SLICES = 16
_SIGN = -(1 << 63)
#: A document: whether its id is null, the id (0 if null), and the digest of its text in two halves whose order is that of its bytes.
_DOCUMENT = ("none", "doc", "d0", "d1")
#: Where a class begins.
_FIRST = (*_DOCUMENT, "line")
_FIRST_TYPE = "none boolean, doc long, d0 long, d1 long, line int"


def _half(digest: F.Column, at: int) -> F.Column:
    """Eight bytes of a digest as a long in their order."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def _document(doc_id: str, text: str) -> list[F.Column]:
    digest = F.hex(C.digest_of(F.col(text)))
    number = F.col(doc_id).cast("long")
    return [F.col(doc_id).isNull().alias("none"), F.coalesce(number, F.lit(0)).cast("long").alias("doc"), _half(digest, 1).alias("d0"), _half(digest, 17).alias("d1")]


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Hashed counts of all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for part in C.steps(batch, "__text"):
                hashes = C.words(*C.text_buffer(part.column(0)), C.SPACED_LOWER).hashes()
                total += np.bincount((hashes & np.uint64(COUNT_CELLS - 1)).astype(np.int64), minlength=COUNT_CELLS)
        yield _slices(total, range(_SLICES))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(COUNT_CELLS, np.int64), set()
        for batch in batches:
            for n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.reshape(_SLICES, -1)[n] += np.frombuffer(counts, np.int64)
                seen.add(n)
        yield _slices(total, sorted(seen))

    schema = "slice int, counts binary"
    parts = docs.select(F.col(text).alias("__text")).mapInArrow(run, schema)
    counts = np.zeros(COUNT_CELLS, np.int64)
    for r in parts.repartition(_SLICES, "slice").mapInArrow(add, schema).collect():
        counts.reshape(_SLICES, -1)[r["slice"]] += np.frombuffer(r.counts, np.int64)
    return counts


def _slices(counts: np.ndarray, chosen) -> pa.RecordBatch:
    rows = counts.reshape(_SLICES, -1)
    return pa.RecordBatch.from_arrays([pa.array(list(chosen), pa.int32()), pa.array([rows[n].tobytes() for n in chosen], pa.binary())], ["slice", "counts"])


def _ordered(own: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The order by owner (under n) and word."""
    # One sort by owner and the upper bits of the words; should words of an owner differ in the lower bits alone, by both in full.
    bits = np.uint64(n.bit_length())
    upper = own.astype(np.uint64) << (np.uint64(64) - bits) | words >> bits
    order = np.argsort(upper)
    upper, found = upper[order], words[order]
    if ((upper[1:] == upper[:-1]) & (found[1:] != found[:-1])).any():
        order = np.lexsort((words, own))
    return order


def line_sets(buffer: np.ndarray, offsets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number in the row and set size of each line with words, and all sets one after the other.

    Words stand for themselves as 64-bit numbers whose order is that of rarity: the level of
    their count, then their hash.
    """
    found = C.words(buffer, offsets, C.SPACED_LOWER)
    hashes = found.hashes()
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buffer == 10) + 1]))
    line = np.searchsorted(begins, found.start, side="right") - 1
    words = (level[(hashes & np.uint64(COUNT_CELLS - 1)).astype(np.int64)] << np.uint64(57)) | (hashes >> np.uint64(7))
    order = _ordered(line, words, len(begins))
    words, line = words[order], line[order]
    new = np.concatenate([[True], (words[1:] != words[:-1]) | (line[1:] != line[:-1])]) if len(words) else np.zeros(0, bool)
    words, line = words[new], line[new]
    lines, first = np.unique(line, return_index=True)
    size = np.diff(np.append(first, len(line)))
    row = np.searchsorted(offsets, begins[lines], side="right") - 1
    number = lines - np.searchsorted(begins, offsets[row])
    return row, number, size, words


def signatures(words: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128-bit digests of the sets, in two words."""
    first = np.cumsum(size) - size
    return [np.add.reduceat(C.mix(words ^ np.uint64(salt)), first).view(np.int64) if len(size) else words.view(np.int64) for salt in (0, 0x5851F42D4C957F2D)]


def _names(h0: np.ndarray, h1: np.ndarray) -> list[str]:
    """The digests in hexadecimal digits."""
    digits = np.stack([h0, h1], axis=1).astype("<i8").tobytes().hex()
    return [digits[i : i + 32] for i in range(0, len(digits), 32)]


def least_overlap(a, b):
    """ceil(0.8 / 1.8 * (a + b)): what two sets of these sizes share at a Jaccard of 0.8."""
    return (4 * (a + b) + 8) // 9


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def _take_runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


def sketches(words: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set, in two words: the bits that its members' low seven bits name."""
    first = np.cumsum(size) - size
    place, bit = words & np.uint64(127), np.uint64(1) << (words & np.uint64(63))
    halves = [np.where((place >> np.uint64(6)) == half, bit, np.uint64(0)) for half in (0, 1)]
    return [np.bitwise_or.reduceat(h, first) if len(size) else h for h in halves]


_CLASS = f"h0 long, h1 long, {_FIRST_TYPE}, size int, s0 long, s1 long, prefix binary"


def _packed(words: np.ndarray, many: np.ndarray) -> pa.Array:
    """Runs of words as bytes."""
    ends = np.concatenate([[0], np.cumsum(8 * many)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])


def _first_of_each(rows: pa.Table) -> pa.Table:
    """Of rows with equal digests, the first line."""
    h0 = rows.column("h0").to_numpy()
    order = np.argsort(h0, kind="stable")
    again = h0[order[1:]] == h0[order[:-1]]
    if not again.any():
        return rows
    shared = order[np.append(again, False) | np.append(False, again)]
    h0, h1, *place = (rows.column(c).to_numpy()[shared] for c in ("h0", "h1", *_FIRST))
    order = np.lexsort((*place[::-1], h1, h0))
    new = np.append(True, (h0[order[1:]] != h0[order[:-1]]) | (h1[order[1:]] != h1[order[:-1]]))
    keep = np.ones(rows.num_rows, bool)
    keep[shared[order[~new]]] = False
    return rows.filter(pa.array(keep))


def lines(docs: DataFrame, text: str, doc_id: str, level: np.ndarray, min_words: int = MIN_WORDS) -> DataFrame:
    """(h0, h1, first line, size, s0, s1, prefix) of the sets of lines that take part, once in each step."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, number, size, words = line_sets(*C.text_buffer(batch.column(4)), level)
        first = np.cumsum(size) - size
        use = size >= min_words
        whole = [pa.array(x.view(np.int64)[use]) for x in (*signatures(words, size), *sketches(words, size))]
        row, number, size, first = row[use], number[use], size[use], first[use]
        many = prefix_length(size)
        prefix = _packed(words[_take_runs(first, many)], many)
        take = pa.array(row)
        columns = [*whole[:2], *(c.take(take) for c in batch.columns[:4]), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), *whole[2:], prefix]
        rows = pa.Table.from_arrays(columns, ["h0", "h1", *_FIRST, "size", "s0", "s1", "prefix"])
        return _first_of_each(rows).combine_chunks().to_batches(max_chunksize=None)[0] if len(size) else None

    columns = [*_document(doc_id, text), F.col(text).alias("__text")]
    return C.map_batches(docs, columns, "__text", _CLASS, work)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each digest; rows come sorted by h0."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = _first_of_each(rows if rest is None else pa.concat_tables([rest, rows]))
        last = int(np.searchsorted(rows.column("h0").to_numpy(), rows.column("h0")[-1].as_py())) if rows.num_rows else 0
        yield from rows.slice(0, last).to_batches()
        rest = rows.slice(last).combine_chunks()
    if rest is not None:
        yield from rest.to_batches()


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, level: np.ndarray) -> DataFrame:
    """(id, first, words) of wanted classes (id and first line), from the texts themselves."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buffer, offsets = C.text_buffer(batch.column(0))
        lists = batch.column(1)
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        line, ids = (c.to_numpy() for c in lists.flatten().flatten())
        breaks = np.flatnonzero(buffer == 10)
        before, after = (np.searchsorted(breaks, x) for x in (offsets[:-1][of], offsets[1:][of]))
        bounds = np.concatenate([[0], breaks, [len(buffer)]])
        start = np.where(line > 0, bounds[before + line] + 1, offsets[:-1][of])
        stop = np.where(before + line < after, bounds[before + line + 1], offsets[1:][of])
        # The wanted lines alone, each as a text of its own.
        only = buffer[_take_runs(start, stop - start)]
        _, _, size, words = line_sets(only, np.append(0, np.cumsum(stop - start)), level)
        return pa.RecordBatch.from_arrays([pa.array(ids), *(c.take(pa.array(of)) for c in batch.columns[2:]), pa.array(line), _packed(words, size)], ["id", *_FIRST, "words"])

    chosen = wanted.groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("line", "id")).alias("__lines"))
    # Rows that are equal in id and text are one document: one of them is enough.
    rows = docs.select(*_document(doc_id, text), F.col(text).alias("__text")).join(chosen, list(_DOCUMENT))
    schema = f"id long, {_FIRST_TYPE}, words binary"
    return C.map_batches(rows, ["__text", "__lines", *_DOCUMENT], "__text", schema, work).dropDuplicates(["id"])


#: Classes under one word beyond which they are dealt into blocks of about this size.
LARGE_GROUP = 512
#: Candidates for each class of a tile beyond which the tile is verified in place.
DENSE = 16
#: Rows of a tile are paired with those so far behind, step by step; a tile that is verified in place takes no further step.
_STEPS = (1, 5, 17, 65, 257, 1 << 40)
#: Columns of a tile's word matrix that are multiplied at a time.
_COLUMNS = 2048


#: Rows that are looked at together, so that steps over them are worth their cost.
_TOGETHER = 1 << 16


def _tiles(work):
    """Run ``work`` on whole tiles; rows come sorted by ``key``, a tile may go across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(p.num_rows for p in parts) < _TOGETHER:
                continue
            rows = pa.Table.from_batches(parts).combine_chunks()
            keys = rows.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            yield from work(rows.slice(0, last))
            parts = rows.slice(last).to_batches()
        if parts:
            yield from work(pa.Table.from_batches(parts).combine_chunks())

    return run


def _begins(words: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (tiles[1:] != tiles[:-1])]))


#: Postings that a task holds at a time, about: those of a bucket (many buckets even out over tasks), and those that are dealt together.
_BUCKET, _DEALT = 1 << 15, 1 << 19
#: Cells that keep into how many blocks the words of each are dealt.
HOT_CELLS = 1 << 20


def _bucket(words: np.ndarray, tiles: np.ndarray | int, buckets: int) -> np.ndarray:
    return (C.mix(words.view(np.uint64) ^ C.mix(np.uint64(1) + np.asarray(tiles).astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def _hot_cell(words: np.ndarray) -> np.ndarray:
    return (C.mix(words.view(np.uint64)) >> np.uint64(44)).astype(np.int64)


def _blocks(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its values, one after the other."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    known, many = np.unique(bucket, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(known), *(_packed(c[order], many) for c in columns.values())], ["bucket", *columns])


def _by_bucket(work):
    """Run ``work`` on the values of a bucket at a time; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != at and parts:
                    yield from work(*map(np.concatenate, zip(*parts, strict=True)))
                    parts = []
                at = bucket
                parts.append([np.frombuffer(c[i].as_py(), np.int64) for c in batch.columns[1:]])
        if parts:
            yield from work(*map(np.concatenate, zip(*parts, strict=True)))

    return run


def _counted(buckets: int):
    """Blocks (bucket, word, n) of the words of prefixes, added up over many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def blocks() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            parts.clear()
            return _blocks(_bucket(word, 0, buckets), word=word, n=n)

        for batch in batches:
            parts.append(C.text_buffer(batch.column(0))[0].view(np.int64))
            if sum(map(len, parts)) > _DEALT:
                yield blocks()
        yield blocks()

    return run


def _hot(large: int):
    """(cell, k) of words with more than ``large`` postings, which are dealt into k blocks."""

    def work(word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(word)
        word, n = word[order], n[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        total = np.add.reduceat(n, first) if len(first) else n
        word, total = word[first][total > large], total[total > large]
        yield pa.RecordBatch.from_arrays([pa.array(_hot_cell(word)), pa.array(-(-total // large))], ["cell", "k"])

    return work


def _postings(hot: tuple[np.ndarray, np.ndarray], buckets: int):
    """Blocks (bucket, word, tile, id, shape, s0, s1) of the words of prefixes.

    A word of a hot cell is dealt into blocks by class: a tile is a pair of blocks (low, high),
    and a class is in the tiles of its block. shape is the size, the place, and whether the
    class is in the high block of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.ones(HOT_CELLS, np.int32)
        blocks[hot[0]] = hot[1]
        for batch in batches:
            buffer, offsets = C.text_buffer(batch.column(4))
            words, many = buffer.view(np.int64), np.diff(offsets) // 8
            of = np.repeat(np.arange(len(many)), many)
            ids, size, s0, s1 = (c.to_numpy() for c in batch.columns[:4])
            shape = (size.astype(np.int64) << 32)[of] | (np.arange(len(of)) - offsets[:-1][of] // 8) << 1
            k = blocks[_hot_cell(words)].astype(np.int64)
            side = (C.mix(ids.view(np.uint64))[of] % k.astype(np.uint64)).astype(np.int64)
            ends = np.cumsum(k)
            cuts = np.searchsorted(ends, np.arange(_DEALT, ends[-1] if len(ends) else 0, _DEALT))
            for begin, stop in zip([0, *cuts], [*cuts, len(k)], strict=True):
                chosen = np.repeat(np.arange(begin, stop), k[begin:stop])
                other = _take_runs(np.zeros(stop - begin, np.int64), k[begin:stop])
                own = side[chosen]
                tile = np.minimum(own, other) << 32 | np.maximum(own, other)
                row = of[chosen]
                yield _blocks(_bucket(words[chosen], tile, buckets), word=words[chosen], tile=tile, id=ids[row], shape=shape[chosen] | (own > other), s0=s0[row], s1=s1[row])

    return run


def _candidates(dense: int):
    """Pairs (word, tile, a, b) of each tile.

    A tile of more than ``dense`` candidates a row gives its own rows instead: the class as a, -1 - side as b.
    """

    def work(words: np.ndarray, tiles: np.ndarray, ids: np.ndarray, shape: np.ndarray, *sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, dealt = len(words), tiles.any()
        order = np.lexsort((shape >> 32, tiles, words) if dealt else (shape >> 32, words))
        words, tiles, ids, shape = (x[order] for x in (words, tiles, ids, shape))
        size, side = (shape >> 32).astype(np.int32), shape & 1
        rest = size - ((shape & 0xFFFFFFFF) >> 1).astype(np.int32)
        sketch = [x.view(np.uint64)[order] for x in sketch]
        begins = _begins(words, tiles)
        many = np.diff(np.append(begins, n))
        group = np.repeat(np.arange(len(begins)), many)
        inner = tiles >> 32 == tiles & 0xFFFFFFFF
        reached, full = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool)
        pairs = []
        # Sizes ascend: rows beyond a quarter more do not fit.
        reach = np.searchsorted(group << 32 | size, group << 32 | 5 * size.astype(np.int64) // 4, side="right") - 1
        for low, high in zip(_STEPS[:-1], _STEPS[1:], strict=True):
            live = np.flatnonzero((np.arange(low, n + low) <= reach) & ~full[group])
            far_off = np.minimum(reach[live], live + high - 1) - live - low + 1
            ends = np.cumsum(far_off)
            cuts = np.searchsorted(ends, np.arange(_DEALT, ends[-1] if len(ends) else 0, _DEALT))
            for begin, stop in zip([0, *cuts], [*cuts, len(live)], strict=True):
                near = np.repeat(live[begin:stop], far_off[begin:stop])
                far = _take_runs(live[begin:stop] + low, far_off[begin:stop])
                # What can still be shared from here on, against least_overlap; words before are met under themselves.
                good = 9 * np.minimum(rest[near], rest[far]) >= 4 * (size[near] + size[far])
                if dealt:
                    good &= inner[near] | (side[near] != side[far])
                near, far = near[good], far[good]
                wanted = 4 * (size[near] + size[far])
                # A bit that one sketch has and the other lacks stands for a word that is not shared.
                lost = [sum(np.bitwise_count(h[i] & ~h[k]).astype(np.int32) for h in sketch) for i, k in ((near, far), (far, near))]
                good = (9 * (size[near] - lost[0]) >= wanted) & (9 * (size[far] - lost[1]) >= wanted)
                near, far = near[good], far[good]
                if len(near):
                    pairs.append((near, far))
                    reached += np.bincount(group[near], minlength=len(begins))
            full = reached > dense * many
        if not pairs:
            return
        near, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
        use = ~full[group[near]]
        near, far, whole = near[use], far[use], np.flatnonzero(full[group])
        a, b = np.minimum(ids[near], ids[far]), np.maximum(ids[near], ids[far])
        at = np.concatenate([near, whole])
        columns = [words[at], tiles[at], np.concatenate([a, ids[whole]]), np.concatenate([b, -1 - side[whole]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "tile", "a", "b"])

    return work


def _similar_in(words: np.ndarray, size: np.ndarray, side: np.ndarray, inner: bool, word: np.uint64) -> tuple[np.ndarray, ...]:
    """Rows of the two sides of a tile, and which of them are similar with ``word`` as their first common word."""
    row = np.repeat(np.arange(len(size)), size)
    x = np.arange(len(size)) if inner else np.flatnonzero(side == side[0])
    y = x if inner else np.flatnonzero(side != side[0])
    place = np.zeros(len(size), np.int64)
    for rows in (x, y):
        place[rows] = np.arange(len(rows))
    known, column, seen = np.unique(words, return_inverse=True, return_counts=True)
    use = seen[column] > 1
    known, column = np.unique(words[use], return_inverse=True)
    row, first = row[use], int(np.searchsorted(known, word))
    in_x, in_y = (np.isin(row, rows) for rows in (x, y))
    shared, before = np.zeros((len(x), len(y)), np.float32), None
    cuts = sorted({*range(0, len(known), _COLUMNS), first, len(known)})
    for begin, stop in zip(cuts[:-1], cuts[1:], strict=True):
        if begin == first:
            before = shared > 0
        chosen = (column >= begin) & (column < stop)
        sides = []
        for rows, own in ((x, in_x),) if inner else ((x, in_x), (y, in_y)):
            flags = np.zeros((len(rows), stop - begin), np.float32)
            flags[place[row[chosen & own]], column[chosen & own] - begin] = 1
            sides.append(flags)
        shared += sides[0] @ sides[-1].T
    whole = size[x][:, None] + size[y][None, :]
    found = 9 * shared >= 4 * whole  # 5 shared >= 4 (whole - shared)
    if before is not None:
        found &= ~before
    if inner:
        np.fill_diagonal(found, False)
    return x, y, found


def _links_in(every: bool):
    """Links of tiles whose rows carry the whole sets: pairs (a, b), or (id, n, earlier) of each class."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.take(pa.array(np.lexsort(tuple(rows.column(c).to_numpy() for c in ("id", "tile", "word"))))).combine_chunks()
        begins = _begins(*(rows.column(c).to_numpy() for c in ("word", "tile")))
        for begin, stop in zip(begins, [*begins[1:], rows.num_rows], strict=True):
            part = rows.slice(begin, stop - begin).combine_chunks()
            ids, side = (part.column(c).to_numpy() for c in ("id", "side"))
            place = np.empty(len(ids), np.int64)
            place[np.lexsort([part.column(c).to_numpy() for c in _FIRST[::-1]])] = np.arange(len(ids))
            sets, ends = C.text_buffer(part.column("words").chunk(0))
            size = np.diff(ends) // 8
            tile, word = part.column("tile")[0].as_py(), np.array([part.column("word")[0].as_py()], np.int64).view(np.uint64)[0]
            inner = tile >> 32 == tile & 0xFFFFFFFF
            if not inner and (side == side[0]).all():
                continue
            x, y, found = _similar_in(sets.view(np.uint64), size, side, inner, word)
            later = place[x][:, None] > place[y][None, :]
            if every:
                i, k = np.nonzero(found & ~later if inner else found)
                turned = place[x[i]] > place[y[k]]
                a, b = np.where(turned, y[k], x[i]), np.where(turned, x[i], y[k])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
                continue
            n, earlier = found.sum(1), (found & later).sum(1)
            if not inner:
                n, earlier = np.append(n, found.sum(0)), np.append(earlier, (found & ~later).sum(0))
            ends = ids[x] if inner else ids[np.append(x, y)]
            columns = [c[n > 0] for c in (ends, n, earlier)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "n", "earlier"])

    return work


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets x and y are similar and first share the word ``least``; a ``turned`` one is swapped."""
    for batch in batches:
        a, b, least, turned = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        sets, ends = zip(*(C.text_buffer(c) for c in batch.columns[4:]), strict=True)
        many = [np.diff(e) // 8 for e in ends]
        words = np.concatenate([s.view(np.uint64) for s in sets])
        pair = np.concatenate([np.repeat(np.arange(len(a)), m) for m in many])
        order = _ordered(pair, words, len(a))
        words, pair = words[order], pair[order]
        # Words of a set differ, so a word that is there twice is shared.
        common = np.flatnonzero((words[1:] == words[:-1]) & (pair[1:] == pair[:-1]))
        own, first, shared = np.unique(pair[common], return_index=True, return_counts=True)
        good = 5 * shared >= 4 * (many[0][own] + many[1][own] - shared)
        good &= words[common[first]] == least[own].view(np.uint64) ^ np.uint64(1 << 63)
        own = own[good]
        ends = [pa.array(np.where(turned[own], *c)) for c in ((b[own], a[own]), (a[own], b[own]))]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def similar_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: bool = False, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes (id, digest h0 and h1, first line) and their verified links.

    With ``every`` each link is a row (a, b) from a later class b to an earlier a (by their
    first lines); otherwise each class with links is a row (first line, n, earlier): how many
    it has and how many of them go to earlier classes. Both rest on all links.
    """
    spark = docs.sparkSession
    parts = C.shuffle_parts(spark)
    level = np.minimum(127, 4 * np.log2(1.0 + word_counts(docs, text))).astype(np.uint64)
    own = lines(docs, text, doc_id, level, min_words)
    # One long to sort by; stored with their ids at once, so these are the ids for good.
    grouped = own.repartition(parts, "h0").sortWithinPartitions("h0").mapInArrow(_classes, _CLASS)
    # Hardly a value is there twice in a file, so dictionaries are work for nothing.
    classes = C.store(grouped.withColumn("id", F.monotonically_increasing_id()), **{"parquet.enable.dictionary": "false"})
    joined = classes.where(F.col("size") >= _LEAST_JOINED)
    many = joined.agg(F.sum(F.expr("size - int(ceil(4 * size / 5)) + 1"))).first()[0] or 0
    buckets = max(parts, -(-many // _BUCKET))

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(parts, "bucket").sortWithinPartitions("bucket")

    counted = dealt(joined.select("prefix").mapInArrow(_counted(buckets), "bucket int, word binary, n binary"))
    cells = counted.mapInArrow(_by_bucket(_hot(LARGE_GROUP)), "cell long, k long").groupBy("cell").agg(F.max("k").alias("k")).collect()
    hot = np.array([r.cell for r in cells], np.int64), np.array([r.k for r in cells], np.int32)
    schema = "bucket int, word binary, tile binary, id binary, shape binary, s0 binary, s1 binary"
    postings = dealt(joined.select("id", "size", "s0", "s1", "prefix").mapInArrow(_postings(hot, buckets), schema))
    made = postings.mapInArrow(_by_bucket(_candidates(DENSE)), "word long, tile long, a long, b long")
    found = C.store(made)
    # A pair is settled under its first common word: here, or in the tile that is verified in place.
    pairs = C.store(found.where("b >= 0").groupBy("a", "b").agg(F.min(F.col("word").bitwiseXOR(F.lit(_SIGN))).alias("least")))
    rows = found.where("b < 0").select(F.expr("xxhash64(word, tile)").alias("key"), "word", "tile", F.col("a").alias("id"), (-1 - F.col("b")).alias("side"))

    used = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).unionAll(rows.select("id")).distinct()
    wanted = classes.select("id", *_FIRST).join(used, "id", "left_semi")
    sets = C.store(sets_of(docs, wanted, text, doc_id, level), **{"parquet.enable.dictionary": "false"})
    x, y = (sets.select(F.col("id").alias(i), F.struct(*_FIRST).alias(f"{i}_first"), F.col("words").alias(w)) for i, w in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "least", (F.col("a_first") > F.col("b_first")).alias("turned"), "x", "y")
    links = C.store(both.mapInArrow(_verified, "a long, b long"))

    whole = rows.join(sets, "id").repartition(parts, "key").sortWithinPartitions("key")
    schema = "a long, b long" if every else "id long, n long, earlier long"
    placed = C.store(whole.select("key", "word", "tile", "id", "side", *_FIRST, "words").mapInArrow(_tiles(_links_in(every)), schema))
    classes = classes.select("id", "h0", "h1", *_FIRST)
    if every:
        return classes, links.unionAll(placed)
    ends = [links.select(F.col(c).alias("id"), F.lit(1).cast("long").alias("n"), F.lit(e).cast("long").alias("earlier")) for c, e in (("a", 0), ("b", 1))]
    counts = ends[0].unionAll(ends[1]).unionAll(placed).groupBy("id").agg(F.sum("n").alias("n"), F.sum("earlier").alias("earlier"))
    return classes, counts.join(sets.select("id", *_FIRST), "id").select(*_FIRST, "n", "earlier")


#: ASCII white space, which parts words.
_BLANK = " \t\n\r\x0b\x0c"


def has_words(line: str, many: int) -> bool:
    """Whether a line has so many different words."""
    if many == 1:
        return bool(line.strip(_BLANK))  # no need to take it apart
    words = line.encode().lower().split()
    return len(words) >= many and len(set(words)) >= many


def cut_lines(text: str, kept: list[int], min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without lines that take part and are not kept; how many took part and went."""
    keep, out, taking, gone = set(kept), [], 0, 0
    for n, line in enumerate(text.split("\n")):
        if has_words(line, min_words):
            taking += 1
            if n not in keep:
                gone += 1
                continue
        out.append(line)
    return "\n".join(out), taking, gone


#: Kinds of rows that meet at a document, in their order.
_BEGINS, _LINKED, _TEXT = range(3)


def _cut(min_words: int):
    """Cut each text; the classes that begin in its document and their links come before it."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        kind, line, n, earlier = (rows.column(c).to_numpy() for c in ("kind", "line", "n", "earlier"))
        group = np.cumsum(_new_document(rows))
        begin, linked, text = (np.flatnonzero(kind == k) for k in (_BEGINS, _LINKED, _TEXT))
        place = group[begin] << 32 | line[begin]
        links, stays = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
        at = np.searchsorted(place, group[linked] << 32 | line[linked])
        links[at], stays[at] = n[linked], earlier[linked] == 0
        low, high = (np.searchsorted(group[begin], group[text], side) for side in ("left", "right"))
        own = _take_runs(low, high - low)
        ends = pa.array(np.append(0, np.cumsum(high - low)).astype(np.int32))
        names = pa.array(_names(*(rows.column(c).to_numpy()[begin] for c in ("h0", "h1"))), pa.string())
        texts, taking, gone, sha, chosen = [], [], [], [], rows.take(pa.array(text))
        lines = line[begin]
        for value, a, b in zip(chosen.column("text").to_pylist(), low.tolist(), high.tolist(), strict=True):
            left, x, y = cut_lines(value or "", lines[a:b][stays[a:b]].tolist(), min_words)
            texts.append(None if value is None else left)
            taking.append(x)
            gone.append(y)
            sha.append(hashlib.sha256(left.encode()).hexdigest())
        classes = [pa.ListArray.from_arrays(ends, c.take(pa.array(own))) for c in (names, pa.array(links))]
        return pa.RecordBatch.from_arrays(
            [chosen.column("rest").combine_chunks(), pa.array(texts, pa.string()), pa.array(taking, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *classes],
            ["rest", "text", "n_lines", "n_removed", "kept_sha256", "class_ids", "class_links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            for part in C.steps(batch, "text"):
                rows = pa.Table.from_batches([part])
                rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
                yield work(rows)
                # What is known of the last document stays for its texts that are still to come.
                rows = rows.slice(int(np.flatnonzero(_new_document(rows))[-1]))
                rest = rows.filter(pa.array(rows.column("kind").to_numpy() != _TEXT))

    return run


def _new_document(rows: pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in _DOCUMENT:
        values = rows.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def without_similar_lines(docs: DataFrame, rest: F.Column, rest_type: str, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(rest, text, n_lines, n_removed, kept_sha256, class_ids, class_links); ``rest`` is carried along.

    The classes that begin in a document, their links and its text are dealt by document and meet in its order.
    """
    classes, counts = similar_classes(docs, text, doc_id, min_words=min_words)
    nothing = {"kind": None, "line": "int", "h0": "long", "h1": "long", "n": "long", "earlier": "long", "text": "string", "rest": rest_type}

    def shaped(df: DataFrame, kind: int, *have: str) -> DataFrame:
        given = {"kind": F.lit(kind), "rest": F.lit(None).cast(rest_type), "text": F.lit(None).cast("string")}
        return df.select(*_DOCUMENT, *[F.col(c) if c in have else given.get(c, F.lit(0).cast(t or "int")).alias(c) for c, t in nothing.items()])

    texts = docs.select(*_document(doc_id, text), F.col(text).alias("text"), rest.alias("rest"))
    rows = shaped(classes, _BEGINS, "line", "h0", "h1").unionAll(shaped(counts, _LINKED, "line", "n", "earlier")).unionAll(shaped(texts, _TEXT, "text", "rest"))
    dealt = rows.repartition(C.shuffle_parts(docs.sparkSession), "doc", "d0").sortWithinPartitions("doc", "d0", "d1", "none", "kind", "line")
    schema = f"rest {rest_type}, text string, n_lines long, n_removed long, kept_sha256 string, class_ids array<string>, class_links array<long>"
    return dealt.mapInArrow(_cut(min_words), schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (that take part), n_removed, classes and links, and kept_sha256 of each document.

    A class counts for the document that it begins in: class_ids and class_links have the
    classes' ids and numbers of links in the order of the lines, n_links is their sum.
    """
    out = without_similar_lines(docs, F.col("doc_id"), docs.schema["doc_id"].dataType.simpleString(), min_words=min_words)
    return out.select(
        F.col("rest").cast("long").alias("doc_id"), "n_lines", "n_removed",
        F.aggregate("class_links", F.lit(0).cast("long"), lambda s, n: s + n).alias("n_links"),
        "class_ids", "class_links", "kept_sha256",
    )


def cut_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the lines that go; n_chars, where there is one, follows the text."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    kind = ", ".join(f"c{i}: {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = without_similar_lines(docs, rest, f"struct<{kind}>", min_words=min_words)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    return out.select(*[made[c].alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(C.table(spark, sf_dir, "documents"), ANY_LINE)
