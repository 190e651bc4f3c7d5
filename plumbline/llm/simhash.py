"""SimHash near-duplicates by bit-sliced comparison.

Each text becomes a 64-bit fingerprint of its 3-word shingles; texts whose fingerprints
differ in at most RADIUS bits are linked, and linked texts form groups.

Candidates: the 64 bits are cut into four bands of 16. Two fingerprints that differ in two
bits agree on at least two whole bands, so each distinct fingerprint goes to six buckets,
one per pair of bands. A bucket that is still large is cut again by thirds of the other 32
bits: a pair that agrees on the bucket's bands and differs in two bits agrees on one third
at least, so nothing is lost.

Comparison: inside a task, rows sorted by bucket are transposed into bit planes, one bit per
row. Shifting a plane by j rows against itself gives that bit's difference for all pairs j
apart at once; two carry-save counters add the planes up for 64 pairs per machine word, and
a word is left as soon as all of its pairs are beyond the radius.

Only distinct fingerprints are compared. Each task passes on a spanning forest of the links
it finds (copies and dense neighbourhoods do not multiply), and groups are joined up by
distributed star contraction.

Defined results: null, empty and blank texts have fingerprint zero and are linked like
others; repeated rows each get a row; a group whose ids are all null has a null
component_id, otherwise nulls are passed over; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.operators.joins import spread_join

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Rows of a bucket beyond which it is cut again; results do not depend on it.
LARGE_BUCKET = 2048

_BANDS = [0xFFFF << (16 * i) for i in range(4)]
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprints(batch_text: pa.Array) -> np.ndarray:
    """Fingerprint of each text: majority bits of the shingles' hashes."""
    out = np.zeros(len(batch_text), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(batch_text.cast(pa.binary())):
        words = (text.as_py() or b"").lower().split()  # ASCII case, ASCII white space
        if not words:
            continue
        n = len(words) - SHINGLE + 1
        if n <= 1:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:], strict=False)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
        out[i] = np.packbits(over).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame, keys: list, schema: str, text: str = "text") -> DataFrame:
    """Chosen key columns (k0, k1, ...) and ``fp``, the fingerprint as a signed long."""
    names = [f"k{i}" for i in range(len(keys))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = fingerprints(batch.column(len(names))).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(prints)], [*names, "fp"])

    columns = [k.alias(n) for k, n in zip(keys, names, strict=True)] + [F.col(text).alias("__text")]
    return C.map_batches(docs, columns, "__text", f"{schema}, fp long", work)


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 of them to a word."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(prints) // 64) * 64 + 64), np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Pairs whose count (bit j in ``counters[j]``) is above the radius, or has run over."""
    more, equal = np.zeros_like(over), ~np.zeros_like(over)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            more |= equal & counters[j]
            equal &= ~counters[j]
    return more | over


def close_pairs(planes: np.ndarray, j: int, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows i, among the ``wanted`` ones, whose fingerprint is within the radius of row i + j's."""
    alive = np.packbits(np.pad(wanted, (0, planes.shape[1] * 64 - len(wanted))), bitorder="little").view("<u8")
    at = np.flatnonzero(alive)
    whole, part = divmod(j, 64)
    last = planes.shape[1] - 1
    left = alive[at].copy()
    counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(at), np.uint64)
    for bit, plane in enumerate(planes):
        other = plane[np.minimum(at + whole, last)]
        if part:
            other = (other >> np.uint64(part)) | (plane[np.minimum(at + whole + 1, last)] << np.uint64(64 - part))
        carry = plane[at] ^ other
        for n, counter in enumerate(counters):
            counters[n], carry = counter ^ carry, counter & carry
        over |= carry
        if bit % 8 == 7:  # leave the words in which every pair is beyond the radius
            left &= ~_beyond(counters, over, radius)
            go_on = left != 0
            if not go_on.any():
                return np.zeros(0, np.int64)
            if not go_on.all():
                at, left, over = at[go_on], left[go_on], over[go_on]
                counters = [c[go_on] for c in counters]
    flags = np.unpackbits(np.ascontiguousarray(left).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, place = np.nonzero(flags)
    return at[word] * 64 + place


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Those of the links that connect something new."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def _compare(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links among rows that are sorted by bucket; a bucket may go across batches."""
    rest = pd.DataFrame({"bucket": np.zeros(0, np.int64), "part": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)})
    for batch in rows:
        rest = pd.concat([rest, batch[["bucket", "part", "fp"]]], ignore_index=True)
        last = (rest["bucket"] == rest["bucket"].iloc[-1]) & (rest["part"] == rest["part"].iloc[-1])
        yield _links(rest[~last])
        rest = rest[last]
    yield _links(rest)


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    prints = rows["fp"].to_numpy(np.int64)
    n = len(prints)
    if n < 2:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    key = np.stack([rows["bucket"].to_numpy(), rows["part"].to_numpy()])
    begins = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
    ends = np.append(np.flatnonzero(begins)[1:], n)
    end_of = np.repeat(ends, np.diff(np.append(np.flatnonzero(begins), n)))
    planes = _planes(prints)
    found_a, found_b = [], []
    room = end_of - np.arange(n)
    for j in range(1, int(room.max())):
        at = close_pairs(planes, j, room > j)
        found_a.append(prints[at])
        found_b.append(prints[at + j])
    if not found_a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _bucketed(prints: DataFrame) -> DataFrame:
    """(bucket, part, fp): six buckets for each fingerprint, large ones cut again."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(n, signed(_BANDS[i] | _BANDS[j]), [k for k in range(4) if k not in (i, j)]) for n, (i, j) in enumerate(_PAIRS)]
    pieces = F.array(*[
        F.struct(
            F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(n)).alias("bucket"),
            # The 32 bits outside the bucket's bands, side by side.
            F.shiftleft(F.shiftrightunsigned("fp", 16 * rest[1]).bitwiseAND(F.lit(0xFFFF)), 16)
            .bitwiseOR(F.shiftrightunsigned("fp", 16 * rest[0]).bitwiseAND(F.lit(0xFFFF))).alias("rest"),
        )
        for n, mask, rest in masks
    ])
    rows = prints.select("fp", F.explode(pieces).alias("p")).select("fp", "p.*")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_BUCKET).select("bucket", F.lit(True).alias("large"))
    thirds = F.array(*[F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1)) * 3 + i for i, (at, width) in enumerate([(0, 11), (11, 11), (22, 10)])])
    return rows.join(large, "bucket", "left").select(
        "bucket", F.explode(F.when(F.col("large"), thirds).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp"
    )


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """(fp, root): groups of distinct fingerprints that have links at all."""
    spread = _bucketed(prints).repartition(C.shuffle_parts(prints.sparkSession), "bucket", "part")
    links = spread.sortWithinPartitions("bucket", "part", "fp").mapInPandas(_compare, "a long, b long")
    return C.components(C.store(links)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id of the group)."""
    own = C.store(with_fingerprint(docs, [F.col("doc_id")], "k0 long"))
    by_print = C.store(own.groupBy("fp").agg(F.min("k0").alias("least")))
    groups = by_print.join(fingerprint_groups(by_print.select("fp")), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    ids = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    named = groups.join(ids, "group").select("fp", "component_id")
    return own.join(named, "fp").select(
        F.col("k0").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: For whole documents: shingle length, candidate bins, and the radius of their fingerprints.
#: At a similarity of 0.8 two fingerprints differ in 9.7 bits on average with a deviation of
#: 2.9 (12 and 3.1 for the shortest texts), and all bins disagree with a chance of 0.2 ** 8.
DOC_SHINGLE = 5
DOC_BINS = 8
DOC_RADIUS = 24
#: Rows and shingles of a block; a bucket is dealt to tasks as pairs of blocks.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 20
#: Parts of the hash range whose shingles are counted, to bound what two sets can share.
FOLDS = 256


def shingle_hashes(text: bytes, length: int = DOC_SHINGLE) -> np.ndarray:
    """Hashes of a text's different shingles (of all its words, if they are fewer)."""
    words = text.lower().split()
    if len(words) <= length:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(length)), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], np.uint64))


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints, sizes, bins = [], [], []
    for text in batch.column(1).cast(pa.binary()):
        hashes = shingle_hashes(text.as_py() or b"")
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        prints.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).view(">i8")[0]))
        sizes.append(len(hashes))
        # Hashes are sorted: the first one at or after each bin's begin is the bin's smallest.
        at = np.searchsorted(hashes, np.arange(DOC_BINS, dtype=np.uint64) << np.uint64(64 - DOC_BINS.bit_length() + 1))
        bins.append(hashes[np.minimum(at, len(hashes) - 1)].view(np.int64).tolist())
    columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["id", "fp", "size", "bins"])


def _shingle_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_hashes(t.as_py() or b"").tobytes() for t in batch.column(1).cast(pa.binary())]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def _whole_tiles(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tiles, as many as a batch ends; rows come sorted by tile."""
    rest: list[pd.DataFrame] = []
    for batch in rows:
        last = batch["tile"] == batch["tile"].iloc[-1]
        if rest and batch["tile"].iloc[0] != rest[-1]["tile"].iloc[-1] or rest and not last.all():
            yield pd.concat([*rest, batch[~last]], ignore_index=True)
            rest = [batch[last]]
        elif not rest and not last.all():
            yield batch[~last].reset_index(drop=True)
            rest = [batch[last]]
        else:
            rest.append(batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)


class _Tiles:
    """Groups of similar rows inside tiles, and the verified links that made them."""

    def __init__(self, part: pd.DataFrame):
        self.tile = part["tile"].to_numpy(np.int64)
        self.prints = part["fp"].to_numpy(np.int64)
        self.sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        row = np.repeat(np.arange(len(part)), self.size)
        fold = (np.concatenate(self.sets) >> np.uint64(56)).astype(np.int64)
        self.folds = np.bincount(row * FOLDS + fold, minlength=len(part) * FOLDS).reshape(-1, FOLDS).astype(np.int32)
        self.group = np.arange(len(part))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.group[x] != x:
            self.group[x] = x = self.group[self.group[x]]
        return x

    def similar(self, x: int, y: int) -> bool:
        """Whether two sets have a Jaccard similarity of 0.8 or more."""
        one, other = sorted((self.sets[x], self.sets[y]), key=len)
        at = np.minimum(np.searchsorted(other, one), len(other) - 1)
        shared = int((other[at] == one).sum())
        return 5 * shared >= 4 * (len(one) + len(other) - shared)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Verify the pairs of rows that are not in one group yet."""
        for at in range(0, len(x), 4096):
            u, v = x[at : at + 4096], y[at : at + 4096]
            most = np.minimum(self.folds[u], self.folds[v]).sum(axis=1)  # they share no more than this
            able = 5 * most >= 4 * (self.size[u] + self.size[v] - most)
            for i, j in zip(u[able].tolist(), v[able].tolist(), strict=True):
                a, b = self.root(i), self.root(j)
                if a != b and self.similar(i, j):
                    self.group[max(a, b)] = min(a, b)
                    self.links.append((i, j))

    def with_middle(self) -> None:
        """Each row with the row of its tile that is nearest to the bits most rows have."""
        n = len(self.tile)
        bits = np.unpackbits(self.prints.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], self.tile[1:] != self.tile[:-1]]))
        many = np.diff(np.append(first, n))
        most = np.repeat(2 * np.add.reduceat(bits, first) > many[:, None], many, axis=0)
        order = np.lexsort((np.arange(n), (bits != most).sum(axis=1), np.repeat(np.arange(len(first)), many)))
        middle = np.repeat(order[first], many)
        near = np.flatnonzero(((bits != bits[middle]).sum(axis=1) <= DOC_RADIUS) & (middle != np.arange(n)))
        self.link(near, middle[near])

    def with_all(self) -> None:
        """The bit-sliced comparison of all rows that are still in different groups."""
        planes, n, j = _planes(self.prints), len(self.tile), 1
        groups = np.array([self.root(i) for i in range(n)])
        while j < n and (same := self.tile[:-j] == self.tile[j:]).any():
            wanted = same & (groups[:-j] != groups[j:])
            if wanted.any():
                at = close_pairs(planes, j, np.pad(wanted, (0, j)), DOC_RADIUS)
                before = len(self.links)
                self.link(at, at + j)
                if len(self.links) > before:
                    groups = np.array([self.root(i) for i in range(n)])
            j += 1


def _compare_tiles(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verified links of each tile, a forest of them: fewer than the tile has rows."""
    for part in _whole_tiles(rows):
        tiles, ids = _Tiles(part), part["id"].to_numpy()
        tiles.with_middle()
        tiles.with_all()
        a, b = (np.array([link[i] for link in tiles.links], np.int64) for i in (0, 1))
        yield pd.DataFrame({"a": ids[a], "b": ids[b]})


def similar_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, root): text digests of documents that have near copies, and their group's smallest.

    Five-word shingles at a Jaccard similarity of 0.8 or more. Texts are taken once for all
    their rows. They meet in buckets by the smallest shingle hash of each of DOC_BINS parts
    of the hash range. A bucket is cut into blocks of bounded rows and shingles, and each pair
    of blocks is a tile of its own, so a large bucket is spread over tasks. In a tile, rows are
    first compared with its middle, which settles most of a large group of copies with one
    pair a row; the bit-sliced comparison then finds all close fingerprints among rows that
    are still apart. Every pair is verified on whole shingle sets where it is found, and a
    tile passes on a forest of verified links, never its pairs.
    """
    parts = C.shuffle_parts(docs.sparkSession)
    texts = C.store(docs.select(C.digest_of(F.col(text)).alias("id"), F.col(text).alias("text")).groupBy("id").agg(F.first("text").alias("text")))
    sketches = C.store(C.map_batches(texts, ["id", "text"], "text", "id binary, fp long, size long, bins array<long>", _sketch))
    buckets = sketches.select("id", "fp", "size", F.explode(F.array_distinct("bins")).alias("bucket"))
    count = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), count.alias("blocks")).where("n > 1").select("bucket", "blocks")
    rows = spread_join(buckets, shared, ["bucket"], spread_by=["id"])
    rows = C.store(rows.withColumn("block", F.expr("pmod(xxhash64(id, bucket), blocks)")).drop("size"))
    sets = C.map_batches(texts.join(rows.select("id").distinct(), "id", "left_semi"), ["id", "text"], "text", "id binary, shingles binary", _shingle_sets)
    tile = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    dealt = rows.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select("id", "fp", tile.alias("tile"))
    dealt = dealt.join(C.store(sets), "id").repartition(parts, "tile").sortWithinPartitions("tile", "fp", "id")
    links = dealt.select("tile", "id", "fp", "shingles").mapInPandas(_compare_tiles, "a binary, b binary")
    return C.components(C.store(links)).select(F.col("node").alias("id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that with the smallest (doc_id, text digest).

    Null ids come last; rows that are equal in both are one document.
    """
    own = C.free_name(docs)
    digest = C.digest_of(F.col("text"))
    rows = docs.withColumn(own, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")))
    narrow = rows.select(F.col(own).alias("key"), F.col(f"`{own}`.digest").alias("id"))
    grouped = narrow.join(similar_documents(docs), "id", "left").groupBy(F.coalesce("root", "id").alias("g")).agg(F.min("key").alias("key"))
    plain = lambda c: F.concat(F.coalesce(F.col(f"`{c}`.id").cast("string"), F.lit("-")), F.lit("/"), F.hex(F.col(f"`{c}`.digest")))
    kept = grouped.select(plain("key").alias(own))
    return rows.withColumn(own, plain(own)).join(kept, own, "left_semi").dropDuplicates([own]).drop(own)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
