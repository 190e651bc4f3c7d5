"""Sharding by a Feistel permutation over global row numbers; DataFrame functions only.

Rows get global numbers 0 .. n-1 in an order that follows from their content. A keyed
Feistel network with two uneven halves permutes [0, a * b) with a * b just above n; numbers
that land at n or beyond walk the cycle until they fall below it, which leaves a permutation
of [0, n). The permuted number p gives shard p mod S and slot p div S: shard sizes differ by
one row at most, slots have no gaps, and both can be computed again for any row number.

Numbering moves only narrow rows. They are dealt into NUMBER_BUCKETS buckets by content,
bucket sizes become offsets (a table of that many rows at most, so broadcasting it is
bounded), and rows are counted off inside their bucket. Rows equal in all they carry are
counted first and spread out afterwards, so a group of copies is one row until then.

Defined results: null text has size 1 and the checksum of the empty string; null and
repeated ids are numbered like others; an empty table gives no rows; more shards than rows
leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common as C

SHARDS = 16
SEED = 42
ROUNDS = 6
NUMBER_BUCKETS = 4096
#: A walk visits numbers at or beyond n only, fewer than sqrt(n) + 2 of them; this many
#: steps in a row have a chance below n ** -32. A row that needs more stops the job.
WALK = 64


def _round_value(half: str, number: int, seed: int) -> str:
    return f"(xxhash64({half}, {number}, {seed}) & 9223372036854775807)"


def feistel(x: str, a: str, b: str, seed: int = SEED) -> str:
    """SQL text of one pass of the network over [0, a * b)."""
    state = f"named_struct('l', {x} % {a}, 'r', {x} div {a})"
    rounds = ", ".join(str(i) for i in range(ROUNDS))
    left = f"(s.l + {_round_value('s.r', -1, seed).replace('-1', 'i')}) % {a}"
    right = f"(s.r + {_round_value('s.l', -1, seed).replace('-1', 'i')}) % {b}"
    return (
        f"aggregate(array({rounds}), {state}, (s, i) -> named_struct("
        f"'l', if(i % 2 = 0, {left}, s.l), 'r', if(i % 2 = 0, s.r, {right})), s -> s.r * {a} + s.l)"
    )


def permuted(number: str, n: str, seed: int = SEED) -> F.Column:
    """Place of a row number in a keyed shuffle of [0, n)."""
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    b = f"CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT)"
    walk = (
        f"aggregate(sequence(1, {WALK}), {feistel(number, a, b, seed)}, "
        f"(p, k) -> if(p < {n}, p, {feistel('p', a, b, seed)}))"
    )
    return F.expr(f"({walk})")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with __number (0 .. n-1) and __n; equal rows get neighbouring numbers."""
    columns = rows.columns
    counted = C.store(
        rows.groupBy(*columns)
        .agg(F.count("*").alias("__copies"))
        .withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(NUMBER_BUCKETS)))
    )
    sizes = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"),
        F.sum("__size").over(Window.partitionBy()).alias("__n"),
    )
    inside = Window.partitionBy("__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("__at", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    return first.join(F.broadcast(offsets), "__bucket").select(
        *columns, "__n", F.explode(F.expr("sequence(__base + __at, __base + __at + __copies - 1)")).alias("__number")
    )


def shards(rows: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with shard and slot under the ``rows`` law."""
    spot = numbered(rows).withColumn("__p", permuted("__number", "__n", seed))
    spot = spot.withColumn("__p", F.expr("if(__p < __n, __p, raise_error('walk did not end'))").cast("long"))
    return spot.select(
        *rows.columns,
        (F.col("__p") % n_shards).cast("int").alias("shard"),
        F.expr(f"__p div {n_shards}").cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shards(narrow, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents"))
