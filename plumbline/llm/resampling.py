"""Importance resampling towards a target distribution, with features hashed by CRC matrices.

Features of a text are all runs of one to three consecutive words; a feature's bucket is the
CRC-32 of its bytes modulo BUCKETS. Corpus and target are counted over the buckets, a bucket's
gain is the log ratio of both shares with one added, a document's weight is the sum of gains
of its features, and the documents with the highest weight plus Gumbel noise are drawn, which
is sampling without replacement in proportion to exp(weight).

Length-bucketed matrices: words of a step are interned, so are pairs and triples of word
codes, and only distinct features are hashed. Features of one length form a two-dimensional
byte array, whose rows all take a step of the CRC for one column after the other; results are
scattered back to the distinct features and from there to their occurrences. A feature longer
than SEGMENT bytes goes as a short head and segments of SEGMENT bytes, which are rows of the
array of that length, and its parts' sums are joined by the linear operator that shifts a sum
over SEGMENT bytes. The number of column steps is therefore bounded, however long words are.

Counting passes on one vector of BUCKETS counts a task; the gains, BUCKETS numbers, are all
that reaches the driver and is broadcast. Ranks come from a range-partitioned sort of narrow
rows and one count a partition. Tables with scores are stored before they are ranked.

Defined results: null, empty and blank texts have no words, weight 0 and a score of noise
alone; a null id has the noise of an empty id and comes last among ties; rows that repeat an
id are ranked one after the other; without target words every bucket's t is 0; an empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common as C

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
MIN_WORDS = 20
#: Share of the documents with MIN_WORDS words that is drawn: (5, 100) is floor(5 * N / 100).
SHARE = (5, 100)
SEGMENT = 128
#: Text bytes of a step.
STEP = 1 << 20

_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_steps()


def _zero_bytes(count: int) -> np.ndarray:
    """What ``count`` zero bytes make of a sum, as four tables of 256, one for each of its bytes."""
    out = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(count):
        out = _TABLE[out & 0xFF] ^ (out >> np.uint32(8))
    return out


_SHIFT = _zero_bytes(SEGMENT)


def _shift(sums: np.ndarray) -> np.ndarray:
    parts = sums[:, None] >> np.array([0, 8, 16, 24], np.uint32) & np.uint32(0xFF)
    return _SHIFT[0][parts[:, 0]] ^ _SHIFT[1][parts[:, 1]] ^ _SHIFT[2][parts[:, 2]] ^ _SHIFT[3][parts[:, 3]]


def _matrix_crc(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional byte array, one column at a time for all rows."""
    sums = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        sums = _TABLE[sums.astype(np.uint8) ^ column] ^ (sums >> np.uint32(8))
    return ~sums


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + length] of all spans; lengths are one at least."""
    head = (length - 1) % SEGMENT + 1
    more = (length - head) // SEGMENT
    long = np.flatnonzero(more)
    of_long = np.repeat(np.arange(len(long)), more[long])
    nth = np.arange(len(of_long)) - np.repeat(np.cumsum(more[long]) - more[long], more[long])
    starts = np.concatenate([start, (start[long] + head[long])[of_long] + nth * SEGMENT])
    lengths = np.concatenate([head, np.full(len(of_long), SEGMENT, head.dtype)])
    sums = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(1, SEGMENT + 2))
    for size in range(1, SEGMENT + 1):
        group = order[edges[size - 1] : edges[size]]
        if len(group):
            sums[group] = _matrix_crc(np.lib.stride_tricks.sliding_window_view(data, size)[starts[group]])
    out, parts = sums[: len(start)].copy(), sums[len(start) :]
    first = np.cumsum(more[long]) - more[long]
    for n in range(int(more.max(initial=0))):  # the n-th segment of all features that have one
        at = more[long] > n
        out[long[at]] = _shift(out[long[at]]) ^ parts[first[at] + n]
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal codes, and one place of each number."""
    number, _ = pd.factorize(codes)
    place = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    place[number] = np.arange(len(codes))
    return number, place


class Features:
    """Buckets of all features of a batch of texts."""

    def __init__(self, texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST_RUN):
        found = C.words(*C.text_buffer(texts), C.ALNUM_LOWER)
        self.first, self.n_words = found.first, np.diff(found.first)
        size = found.end - found.start
        letters = found.mapped[found.mapped != 0]
        spaced = np.full(len(letters) + len(size), 32, np.uint8)
        spaced[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
        begin = np.cumsum(size + 1) - size - 1
        edges = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
        code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_codes = int(code.max(initial=0)) + 1
        runs, spans, lengths = [], [], []
        number = code
        for k in range(1, longest + 1):  # runs of k words: (word where it begins, number among the distinct)
            at = np.flatnonzero(found.row[: max(len(size) - k + 1, 0)] == found.row[k - 1 :])
            wide = number[at] * n_codes + code[at + k - 1] if k > 1 else code
            own, place = _distinct(wide)
            runs.append((at, own + sum(map(len, spans))))
            spans.append(begin[at[place]])
            lengths.append(begin[at[place] + k - 1] + size[at[place] + k - 1] - begin[at[place]])
            number = np.zeros(len(size), np.int64)
            number[at] = own
        self.runs = runs
        self.bucket = (crc32_spans(spaced, np.concatenate(spans), np.concatenate(lengths)) % np.uint32(buckets)).astype(np.int64)
        self.n_features = sum(np.maximum(self.n_words - k, 0) for k in range(longest))

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        return sum(np.bincount(self.bucket[number], minlength=buckets) for _, number in self.runs)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        gain = gains[self.bucket]
        by_word = np.zeros(self.first[-1] + 1, np.int64)
        for at, number in self.runs:
            by_word[at + 1] += gain[number]
        total = np.cumsum(by_word)
        return total[self.first[1:]] - total[self.first[:-1]]


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows; a task passes on one vector of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in C.steps(batch, "__text", STEP):
                total += Features(part.column(0), buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = rows.select(F.col(text).alias("__text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: ``buckets`` rows."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text, buckets).withColumnRenamed("n", "t")
    both = C.store(
        spark.range(0, buckets, numPartitions=1).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    )
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    gain = F.expr(
        f"floor(1000 * ln((t + 1D) * (all_s + {float(buckets)}D) / ((s + 1D) * (all_t + {float(buckets)}D))))"
    )
    return both.join(F.broadcast(total)).select("bucket", gain.cast("long").alias("gain"))  # one row


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """key, row, n_words, n_features, weight, score of every document; stored."""
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(docs, target, text, buckets).collect():  # ``buckets`` rows
        gains[r.bucket] = r.gain
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Features(batch.column(1), buckets)
        columns = [pa.array(x) for x in (found.n_words, found.n_features, found.weights(shared.value))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    columns = [F.col(key).alias("key"), F.col(text).alias("__text")]
    rows = C.map_batches(docs, columns, "__text", f"key {kind}, n_words long, n_features long, weight long", work, STEP)
    chance = F.expr(f"(conv(substr(sha2(concat('{SEED}:', coalesce(cast(key AS string), '')), 256), 1, 8), 16, 10) + 0.5D) / 4294967296D")
    noise = F.floor(-1000 * F.log(-F.log(chance)))
    return C.store(rows.withColumns({"row": F.monotonically_increasing_id(), "score": (F.col("weight") + noise).cast("long")}))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``weighted`` with rank: 1, 2, 3 ... for those drawn, null for the others."""
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * share[0] // share[1]
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()]
    parts = C.shuffle_parts(scored.sparkSession)
    sorted_rows = able.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of a sorted row: its partition above bit 33, its place in it below.
    placed = C.store(sorted_rows.withColumn("__at", F.monotonically_increasing_id()).selectExpr("*", "__at >> 33 AS __part", "__at & 8589934591L AS __place"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    rank = F.col("__base") + F.col("__place") + 1
    out = placed.join(F.broadcast(bases), "__part").withColumn("rank", F.when(rank <= drawn, rank))  # a row a partition
    return out.select(*scored.columns, "rank").unionByName(
        scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    )


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents with all their columns."""
    drawn = ranked(weighted(docs, target, key, text)).where("rank is not null").select(F.col("key").alias(own := C.free_name(docs))).distinct()
    return docs.join(drawn, F.col(key) == F.col(own), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return ranked(scored).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
