"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of a benchmark item; an item with fewer words is one
window itself. Documents and items are fingerprinted alike: of each run of hashes of
K-word grams that makes up a span, the smallest is kept (the last of equal ones). Two equal
spans keep the same gram, so joining the fingerprints finds every shared span. Each joined
pair is then extended word by word to both sides, on the words themselves, within the
reach of the spans that kept the gram; runs as long as a span are hits.

Items shorter than SPAN are fingerprinted in the same way with their own length as span,
once for each length that occurs (lengths below SPAN, so nine at most).

Before the join, document fingerprints are checked against a bit table of the benchmark's
fingerprints. The table has FILTER_BITS bits whatever the size of the benchmark; what it
lets through wrongly the join removes.

Defined results: null and empty texts have no words; items without words have no window;
repeated items each count; rows of documents with equal text get equal results, rows with a
null or repeated doc_id are rows like any other; empty tables give no rows (documents) or no
hits (benchmark).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.operators.joins import spread_join

SPAN = 10
K = 4
FILTER_BITS = 1 << 24


def gram_length(span: int) -> int:
    return min(K, span)


def picked(found: C.Words, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that some span of its row keeps as smallest."""
    k = gram_length(span)
    width = span - k + 1
    grams = C.grams(hashes, k)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = np.arange(n)
    low = grams[:n].copy()
    for j in range(1, width):
        take = grams[j : j + n] <= low
        low[take] = grams[j : j + n][take]
        best[take] = np.flatnonzero(take) + j
    within = found.row[:n] == found.row[span - 1 :]
    at = np.unique(best[within])
    return at, grams[at] ^ np.uint64(span)


def _parts(found: C.Words, text: bytes, low: int, high: int) -> list[bytes]:
    return [text[s:e] for s, e in zip(found.start[low:high], found.end[low:high], strict=True)]


def _prints(spans: list[int], bits: np.ndarray | None):
    """For each text its words' number, and (fingerprint, position, words around it) of each kept gram.

    ``left`` and ``right`` are the words before the gram and from its start on, as far as a
    span around it may reach, joined by spaces (no word contains one).
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buffer, offsets = C.text_buffer(batch.column(1))
        found = C.words(buffer, offsets, C.ALNUM_LOWER)
        hashes = found.hashes()
        text = found.mapped.tobytes()
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        counts = np.diff(found.first)
        for span in spans:
            at, keys = picked(found, hashes, span)
            if bits is not None and len(at):
                cell = keys & np.uint64(FILTER_BITS - 1)
                kept = (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
                at, keys = at[kept], keys[kept]
            for i, h in zip(at.tolist(), keys.view(np.int64).tolist(), strict=True):
                row = int(found.row[i])
                low = max(int(found.first[row]), i - span + gram_length(span))
                high = min(int(found.first[row + 1]), i + span)
                left, right = _parts(found, text, low, i), _parts(found, text, i, high)
                rows[row].append(
                    {"h": h, "span": span, "pos": i - int(found.first[row]), "left": b" ".join(left), "right": b" ".join(right)}
                )
        prints = pa.array(rows, PRINTS)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int64)), prints], ["id", "n_words", "prints"]
        )

    return work


PRINTS = pa.list_(
    pa.struct([("h", pa.int64()), ("span", pa.int32()), ("pos", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
)
_PRINT_TYPE = "array<struct<h: long, span: int, pos: long, left: binary, right: binary>>"


def prints(rows: DataFrame, key, key_type: str, text: str, spans: list[int], bits: np.ndarray | None) -> DataFrame:
    columns = [key.alias("id"), F.col(text).alias("__text")]
    return C.map_batches(rows, columns, "__text", f"id {key_type}, n_words long, prints {_PRINT_TYPE}", _prints(spans, bits))


def item_prints(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items and the span lengths that occur."""
    key = F.col(item_id).cast("string")
    # Words are counted first: an item is fingerprinted with one span length only.
    classes = items.select(key.alias("item"), F.col(text).alias("t"))
    counted = C.store(prints(classes, F.struct("item", "t"), "struct<item: string, t: string>", "t", [], None))
    least = F.least(F.lit(SPAN), F.col("n_words")).alias("span")
    lengths = sorted(r.span for r in counted.where("n_words > 0").select(least).distinct().collect())
    out = [
        prints(counted.where(least == n).select("id.item", "id.t"), F.col("item"), "string", "t", [int(n)], None)
        for n in lengths
    ]
    if not out:
        return counted.select(F.col("id.item").alias("item"), F.explode("prints").alias("p")), []
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return C.store(found.select(F.col("id").alias("item"), F.explode("prints").alias("p"))), [int(n) for n in lengths]


def filter_bits(found: DataFrame) -> np.ndarray:
    """The benchmark's bit table: at most FILTER_BITS / 64 words reach the driver."""
    cell = F.col("p.h").bitwiseAND(F.lit(FILTER_BITS - 1))
    word = F.shiftright(cell, 6).alias("w")
    bit = F.expr("shiftleft(1L, CAST(p.h & 63 AS INT))")
    rows = found.groupBy(word).agg(F.bit_or(bit).alias("b")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        bits[r.w] = r.b
    return bits.view(np.uint64)


def _reach(mine: str, other: str, backwards: bool) -> F.Column:
    """How many words two lists share from the gram on (or before it)."""
    turn = (lambda c: F.reverse(F.split(F.col(c).cast("string"), " "))) if backwards else (lambda c: F.split(F.col(c).cast("string"), " "))
    a, b = turn(mine), turn(other)
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x != "") & (x == y))
    stop = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(stop > 0, stop - 1).otherwise(F.least(F.size(a), F.size(b)))


def contaminated(docs: DataFrame, items: DataFrame, keys: list, schema: str, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row: its keys, n_words, the hit word ranges, and the ids of items that occur.

    ``hits`` is a list of (from, to) word ranges in order, overlapping or not, or null.
    """
    names = [f"k{i}" for i in range(len(keys))]
    theirs, spans = item_prints(items, item_id, item_text)
    bits = filter_bits(theirs)
    digest = C.digest_of(F.col(text)).alias("digest")
    key = F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)], digest)
    own = C.store(prints(docs, key, "struct<" + (schema + ", " if schema else "") + "digest: binary>", text, spans, bits))

    mine = own.where(F.size("prints") > 0).select("id.digest", F.explode("prints").alias("d"))
    pairs = (
        mine.dropDuplicates(["digest", "d"])
        .select("digest", F.col("d.h").alias("h"), F.col("d.pos").alias("pos"), F.col("d.left").alias("dl"), F.col("d.right").alias("dr"))
        .join(theirs.select("item", F.col("p.h").alias("h"), F.col("p.span").alias("span"), F.col("p.left").alias("il"), F.col("p.right").alias("ir")), "h")
    )
    runs = pairs.select(
        "digest", "item", "span",
        (F.col("pos") - _reach("dl", "il", True)).alias("low"),
        (F.col("pos") + _reach("dr", "ir", False)).alias("high"),
    ).where("high - low >= span")
    ranges = runs.groupBy("digest", "low").agg(F.max("high").alias("high"), F.collect_set("item").alias("items"))
    found = ranges.groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("low", "high"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    rows = own.select(*[F.col(f"id.{n}").alias(n) for n in names], F.col("id.digest").alias("digest"), "n_words")
    # Many rows may share one text: they are spread over tasks, unless nothing tells them apart.
    return spread_join(rows, found, ["digest"], "left", spread_by=[*names, "n_words"], ways=8)


def n_hit(hits: str = "hits") -> F.Column:
    """Words covered by ranges that are sorted by their start."""
    return F.coalesce(
        F.aggregate(
            hits,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
            lambda s, r: F.struct(
                (s["n"] + F.greatest(F.lit(0), r["high"] - F.greatest(r["low"], s["to"]))).alias("n"),
                F.greatest(r["high"], s["to"]).alias("to"),
            ),
            lambda s: s["n"],
        ),
        F.lit(0),
    ).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = contaminated(docs, items, [F.col("doc_id")], "k0: long")
    ids = F.coalesce(F.sort_array("items"), F.array().cast("array<string>"))
    out = found.select(
        F.col("k0").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs, all columns unchanged."""
    own = C.free_name(docs)
    bad = contaminated(docs, items, [], "").where("hits IS NOT NULL").select(F.col("digest").alias(own)).distinct()
    return docs.withColumn(own, C.digest_of(F.col("text"))).join(bad, own, "left_anti").drop(own)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
