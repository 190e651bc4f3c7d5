"""Exact duplicates by content-defined chunk recipes; DataFrame functions only.

A text is cut where its own characters say so: after four characters whose codes have the
remainders ANCHOR modulo 8, once LEAST characters have passed, and after MOST characters at
the latest. Equal texts therefore have equal chunks, shared passages share most of theirs,
and upper and lower case of a letter have the same remainder, so cutting comes before
lower-casing.

Identifiers: each chunk gets WIDTH hashes of 64 bits. Every chunk's content is then grouped
once by (identifier, content), with partial groups before the shuffle; if two contents ever
share an identifier, all chunks get one hash more and the check is repeated, so an identifier
that is used stands for one content, compared byte by byte. Verification is the only step that
moves text, and moves each chunk of a task once.

Recipes: a document becomes the ordered list of its chunks' identifiers (16 bytes for some
600 characters). Documents are equal exactly if their lists are equal; lists, ids and sizes
are all that is grouped and joined. A group reaches its members through SALTS salts, of which
it takes only those that its members have, so a group with a third of all rows is spread and
small groups are not repeated.

Defined results: null and empty texts are equal (an empty list). The largest doc_id of a group
stays; null ids are passed over unless a group has no other, and of rows that repeat the id
that stays one is kept. Other columns, whatever their names, are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C

LEAST, MOST = 256, 4096
#: Remainders modulo 8 of the four characters in front of a cut.
ANCHOR = (4, 5, 0, 7)
#: 64-bit hashes in an identifier at first.
WIDTH = 2
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _class(remainder: int) -> str:
    """Latin characters whose code has this remainder modulo 8."""
    return "[" + "".join(f"\\x{{{code:x}}}" for code in range(remainder, 0x100, 8)) + "]"


def chunk_pattern(least: int = LEAST, most: int = MOST, anchor: tuple[int, ...] = ANCHOR) -> str:
    """Finds one chunk after the other; the last one may be shorter than ``least``."""
    cut = "".join(_class(r) for r in anchor)
    return f"(?s).{{{least - len(anchor)},{most - len(anchor)}}}?{cut}|.{{1,{most}}}"


def lowered(text: F.Column) -> F.Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: F.Column, pattern: str | None = None) -> F.Column:
    """Content-defined chunks of a text in order, lower-cased; none for null or empty texts."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern or chunk_pattern()), F.lit(0))
    return F.transform(raw, lowered)


def identifier(chunk: F.Column, width: int, bits: int = 64) -> F.Column:
    """``width`` hashes of ``bits`` bits each."""
    keep = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return F.array(*[F.xxhash64(F.lit(seed), chunk).bitwiseAND(keep) for seed in range(width)])


def _clashes(pieces: DataFrame) -> bool:
    """Whether two contents have one identifier; every content is looked at."""
    contents = pieces.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return not contents.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def recipes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None, width: int = WIDTH, bits: int = 64
) -> DataFrame:
    """key, row (a number of the stored row), n_chunks, text_sha256, recipe: verified identifiers in order."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    while _clashes(
        source.select(F.explode(F.array_distinct(chunks(F.col("text"), pattern))).alias("chunk")).select(
            identifier(F.col("chunk"), width, bits).alias("id"), "chunk"
        )
    ):
        width += 1
    whole = source.select("key", chunks(F.col("text"), pattern).alias("chunks")).select(
        "key",
        F.monotonically_increasing_id().alias("row"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.sha2(F.concat_ws("", "chunks"), 256).alias("text_sha256"),
        F.flatten(F.transform("chunks", lambda c: identifier(c, width, bits))).alias("recipe"),
    )
    return C.store(whole)


def groups(recipe_rows: DataFrame) -> DataFrame:
    """Rows of ``recipes`` with keep_id, group_size, kept."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    rows = recipe_rows.withColumn("salt", salt)
    best = rows.groupBy("recipe").agg(
        F.max(F.struct("key", "row")).alias("best"),
        F.count("*").alias("group_size"),
        F.expr("bit_or(shiftleft(1L, salt))").alias("salts"),
    )
    held = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftrightunsigned(salts, s) & 1L = 1L)")
    spread = best.select("recipe", "best", "group_size", F.explode(held).alias("salt"))
    return rows.join(spread, ["recipe", "salt"]).select(
        "key", F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256", "n_chunks", "row",
    )


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256, n_chunks."""
    out = groups(recipes(docs, key, text, pattern))
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", "text_sha256", "n_chunks")


def shared_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """The chunk dictionary: id, n_bytes, uses (over all documents), n_documents."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), chunks(F.col(text), pattern).alias("chunks"))
    pieces = source.select("row", F.explode("chunks").alias("chunk")).select(
        "row", identifier(F.col("chunk"), WIDTH).alias("id"), F.octet_length("chunk").alias("n_bytes")
    )
    inside = pieces.groupBy("id", "n_bytes", "row").agg(F.count("*").alias("uses"))
    return inside.groupBy("id", "n_bytes").agg(F.sum("uses").alias("uses"), F.count("*").alias("n_documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(C.table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(s) AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""
