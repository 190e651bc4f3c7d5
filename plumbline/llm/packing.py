"""Best-fit packing of token sequences, bulk-synchronously.

Documents are tokenised and closed with an end id; longer ones are cut into full pieces and
a rest. Pieces are range-sorted by length, gaps (room left in open sequences) by size. In
each superstep all pieces of one length, the longest left, look for their successor gap: the
smallest gap that holds them. A gap that holds several takes them before the next one, since
what is left of it is the smallest gap that does. Pieces compete for gaps of that size by
rank, those left go on to the next larger gap, and those without any open sequences of their own. Gaps are updated and the next length follows. That is
best-fit decreasing, done for a whole length at a time.

What is distributed: tokenising, counting lengths, ranking the pieces of a length (each task
numbers its own, and prefix sums over the tasks' counts make the numbers global, so a length
that a third of all rows share is never in one place) and looking up each piece's place by
its rank. Pieces of one length are interchangeable, so the sweep itself runs over runs of
equal gaps and not over pieces: its input is a histogram of at most ``room`` counts, however
many documents there are, and it is the only thing the driver sees.

Defined results: null and empty texts are the end id alone; repeated rows are packed each;
an empty table gives no pieces; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common as C

ROOM = 2048
END_ID = 0
#: Words and lower-case stems of words whose ids a Python worker remembers. A full memory is
#: emptied, which changes no result, and so is that of a worker that goes on to other work.
MEMORY_WORDS = 1_000_000
#: ASCII signs that this vocabulary always parts from letters before them. The apostrophe is
#: not one of them, since it begins contractions.
TAIL = b".,;:!?*#$%&|<>()\""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts under one vocabulary file, with a memory of words.

    The vocabulary drops white space and never joins what it parts, so the ids of a text are
    those of its words in a row. Only ASCII white space parts words here: it is in the class
    the tokenizer drops, and no normalisation composes across it. A word of ASCII letters
    with signs behind it is those letters in lower case, then the signs. All other words go
    to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}  # a stem is a word too
        self.tails: dict[bytes, bytes] = {b"": b""}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_stems(self, new: list[bytes]) -> None:
        """Encode many stems in one go; each ends with the one id that closes a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(new).decode(), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(new):  # a vocabulary without closing ids
            self.words.update((s, self.plain(s.decode())) for s in new)
            return
        data, at = ids.tobytes(), 0
        for stem, end in zip(new, ends, strict=True):
            self.words[stem] = data[4 * at : 4 * end]
            at = end

    def _learn_others(self, new: list[bytes]) -> None:
        """Encode many words in one call, each on its own."""
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(new, found, strict=True))

    def _learn(self, new: set[bytes]) -> None:
        split, others = {}, []
        for w in new:
            stem = w.rstrip(TAIL)
            if stem.isalpha():  # ASCII letters only
                split[w] = stem.lower(), w[len(stem) :]
            else:
                others.append(w)
        if others:
            self._learn_others(others)
        stems = list({stem for stem, _ in split.values() if stem not in self.words})
        if stems:
            self._learn_stems(stems)
        for w, (stem, tail) in split.items():
            if tail not in self.tails:
                self.tails[tail] = self.plain(tail.decode())
            self.words[w] = self.words[stem] + self.tails[tail]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.words) > MEMORY_WORDS:
            self.words.clear()
        split = [t.split() for t in texts]
        known = [list(map(self.words.get, found)) for found in split]
        new = {w for found, ids in zip(split, known, strict=True) if None in ids for w, i in zip(found, ids, strict=True) if i is None}
        if new:
            self._learn(new)
        for found, ids in zip(split, known, strict=True):
            if None in ids:
                ids = [self.words[w] if i is None else i for w, i in zip(found, ids, strict=True)]
            yield b"".join(ids)


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    for e in _encoders.values():
        e.words.clear()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = Encoder(path)
        C.on_other_work(_forget)
    return _encoders[path]


_PIECE = "doc_id {0}, piece int, start long, length long, ids_crc32 long, chunk int, local_rank long"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, room: int = ROOM) -> DataFrame:
    """Pieces of all documents, each with its rank among the pieces of its length in its task."""
    path = path or default_vocabulary()
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ranks = TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in C.steps(batch, "__text"):
                row, number, start, length, crc, rank = [], [], [], [], [], []
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                for i, ids in enumerate(encoder(path).encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    for n, at in enumerate(range(0, total, room)):
                        size = min(room, total - at)
                        row.append(i)
                        number.append(n)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        rank.append(ranks[size])
                        ranks[size] += 1
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                columns += [pa.array([chunk] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "local_rank"]
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, _PIECE.format(key_type))


def sweep(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over whole lengths at a time.

    ``counts`` says how many pieces have each length. Returns runs (length, first rank,
    first sequence, offset): from that rank on, up to the next run of the length, the k-th
    piece lies in the k-th sequence of the run.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: (first sequence, how many)
    sizes: list[int] = []  # gap sizes that are open, ascending
    out, next_sequence = [], 0

    def open_gap(size: int, first: int, many: int) -> None:
        if size:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # no successor: sequences of their own
                size, first, many = room, next_sequence, -(-left // (room // length))
                next_sequence += many
            else:
                size = sizes[at]
                first, many = gaps[size].pop()
                if not gaps[size]:
                    sizes.pop(at)
            # The rest of a gap that holds one more piece is the smallest that does, so each is filled before the next.
            per = size // length
            full, more = divmod(min(left, many * per), per)
            for begin, width, slots in ((first, full, per), (first + full, 1, more)):
                for slot in range(slots if width else 0):
                    out.append((length, rank, begin, room - size + slot * length))
                    rank, left = rank + width, left - width
                if width and slots:
                    open_gap(size - slots * length, begin, width)
            used = full + (more > 0)
            if used < many:
                open_gap(size, first + used, many - used)
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    stored = C.store(pieces(docs, key, text, path, room))
    counted = C.store(stored.groupBy("chunk", "length").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= room rows
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, first, offset in sweep(totals, room):
        runs[length].append((rank, first, offset))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored.join(bases, ["chunk", "length"])
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})
    key_type = stored.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.other_work()
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                table = places.value[n]
                run = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                sequence[own] = table[run, 1] + rank[own] - table[run, 0]
                offset[own] = table[run, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank")]
    schema = f"doc_id {key_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns).mapInArrow(place, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
