"""Helpers the operators share: stored tables, text buffers, words, components."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint_dir, ship

#: Text bytes that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows into the shared checkpoint folder and go on from there.

    Cuts lineage like checkpoint(), survives lost executors, and later readers take only
    the columns and row groups they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    save(df, lambda writer: writer.options(**options).parquet(path))
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own setting that lets go of a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, write: Callable) -> None:
    """Write a table whose shuffles nobody reads again, so that they do not pile up on disk."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        write(df.write.option("compression", "zstd"))
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    i = batch.schema.get_field_index(column)
    _, offsets = text_buffer(batch.column(i))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the rows' offsets in it; null is empty."""
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _byte_table(separator: Callable[[int], bool], lower: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[[i for i in range(256) if separator(i)]] = 0
    return out


#: Words between white space: [^\x20\x09-\x0D]+. NUL is a word character and maps to 255, which no UTF-8 has.
SPACED = _byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=False)
SPACED[0] = 255
SPACED_LOWER = _byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=True)
SPACED_LOWER[0] = 255
#: Lower-cased words of digits, letters and everything beyond ASCII.
ALNUM_LOWER = _byte_table(
    lambda b: b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127, lower=True
)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept, since every step needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of splitmix64 kind: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], the same for equal spans wherever they are."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(_BASE, n), out=sums[1:])
    spans = (sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start]
    return mix(spans + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of many texts: byte spans, the row of each, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    mapped: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.mapped, self.start, self.end)


def words(buffer: np.ndarray, offsets: np.ndarray, byte_table: np.ndarray) -> Words:
    mapped = byte_table[buffer]
    inside = mapped != 0
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buffer))]
    begin[edges] = inside[edges]  # words never cross rows
    stop[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, first, mapped)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring hashes (rows are not told apart here)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n]
    return mix(out)


_memories: list[Callable[[], None]] = []


def on_other_work(forget: Callable[[], None]) -> None:
    """Have ``forget`` called when this Python worker goes on to a stage that needs no memory of words."""
    if forget not in _memories:
        _memories.append(forget)


def other_work() -> None:
    """Empty what a stage before has left in this worker, which outlives it and shares the executor's memory."""
    for forget in _memories:
        forget()


def map_batches(
    df: DataFrame,
    columns: list,
    text: str,
    schema: str,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    limit: int = STEP_BYTES,
) -> DataFrame:
    """Run ``work`` over slices of bounded text size of the chosen columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            for part in steps(batch, text, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def free_name(df: DataFrame) -> str:
    """A column name that the frame does not have."""
    return "__" + "_".join(re.sub(r"\W", "_", c) for c in df.columns)


def digest_of(text) -> F.Column:
    """Identity of a text as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of undirected ``edges``: (node, root).

    Smallest nodes themselves, and nodes without edges, have no row.

    Alternates large-star and small-star steps; every round is one pass over a stored edge
    table and the number of rounds grows with the logarithm of the longest path. Stars with
    hot centres are aggregated with a partial minimum, never collected.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    current = store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = store(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
