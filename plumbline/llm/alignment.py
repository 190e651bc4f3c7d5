"""Alignment of two tokenizers' outputs by lockstep merging.

Both tokenizers cut the same bytes (a space and the text). Byte offsets where tokens of both
end cut the tokens into groups, and an A token is linked with each B token whose bytes overlap
its own. Over the whole corpus an id pair counts the documents that have it linked.

Lockstep: all documents of a step lie one after the other in one byte space, and one NumPy
state vector holds a pointer into the A tokens and one into the B tokens for every lane. In
each step all lanes emit the link they stand on and, where both tokens end together, a cut;
then they advance the pointer whose token ends first, or both. Finished lanes are compacted
away. A lane is LANE consecutive A tokens of a document, begun at the B token that overlaps
their first byte, so a long document is many lanes and the number of steps is bounded.

Corpus counts: documents are taken in blocks of bounded size. A block passes on its different
pairs with the number of its documents that have them (not a row a link); these are summed
into the pair table. The block then asks for the counts of its own pairs, and answers meet its
documents again in one group a block. A pair is asked for once a block at most, so no key is
hot, and nothing is collected or broadcast.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes,
have no tokens: zeros and an empty string. Strings of special tokens in a text are plain text.
Repeated rows are documents of their own and count each; null ids stay null; an empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.session import store_by

#: A tokens of a lane.
LANE = 64
#: Text bytes and rows after which a block ends (a longer single document is a block).
BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 20_000


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Vocabulary:
    """The bytes of each id, and a way to encode texts."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.data[at + np.arange(len(at))]


#: Fixed value: how byte-level tokenizers cut a text into words.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space on which the encoder by rank would run out of stack; such texts take the file's own.
LONG_SPACE = re.compile(r"\s{2048}")


class ByteLevel(Vocabulary):
    """A byte-level file. Where its merges are numbered as they are ordered, a text is encoded
    by rank, which gives the same ids in a quarter of the time; otherwise as the file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        pieces = [b""] * (max(names.values()) + 1)
        letters = _byte_letters()
        for name, i in names.items():
            pieces[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        super().__init__(pieces)
        self.by_rank = self._by_rank(json.loads(self.tokenizer.to_str()), names, pieces)

    @staticmethod
    def _by_rank(file: dict, names: dict[str, int], pieces: list[bytes]):
        """An encoder by rank, or None if the file could mean something else."""
        import tiktoken

        model, words = file["model"], file["pre_tokenizer"] or {}
        merged = [names["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = not file["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        cut = words.get("type") == "ByteLevel" and words.get("use_regex", True)
        special = {t["id"] for t in file["added_tokens"]}
        ranks = {p: i for i, p in enumerate(pieces) if i not in special and p}
        singles = {i for p, i in ranks.items() if len(p) == 1}
        whole = len(singles) == 256 and set(ranks.values()) == singles | set(merged)
        if plain and cut and whole and merged == sorted(merged) and max(singles) < min(merged):
            return tiktoken.Encoding("by-rank", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        return None

    def encode(self, texts: list[str]) -> list[list[int]]:
        by_rank, plain = self.by_rank, self.tokenizer
        if by_rank is None:
            return [e.ids for e in plain.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return [
            plain.encode(" " + t, add_special_tokens=False).ids if LONG_SPACE.search(t) else by_rank.encode_ordinary(" " + t)
            for t in texts
        ]


class Pieces(Vocabulary):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            pieces.append(bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode())
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_loaded: dict[tuple[str, str], tuple[Vocabulary, Vocabulary]] = {}


def vocabularies(paths: tuple[str, str]) -> tuple[Vocabulary, Vocabulary]:
    if paths not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _loaded[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _loaded[paths]


@dataclass
class Tokens:
    """Tokens of many documents in one byte space: ids, byte ends, each document's first."""

    ids: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]], vocabulary: Vocabulary) -> Tokens:
        first = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=first[1:])
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(first[-1]))
        return cls(ids, np.cumsum(vocabulary.length[ids]), first)

    def document_ends(self) -> np.ndarray:
        return np.concatenate([[0], self.end])[self.first]


def _encoded(texts: list[str], vocabulary: Vocabulary) -> tuple[Tokens, np.ndarray]:
    """Tokens, and for each text whether they give back its bytes behind a space."""
    lists = vocabulary.encode(texts)
    raw = [b" " + t.encode() for t in texts]
    tokens = Tokens.of(lists, vocabulary)
    edges = tokens.document_ends()
    same = np.diff(edges) == np.array([len(r) for r in raw], np.int64)
    got = vocabulary.joined(tokens.ids)
    if same.all():  # one comparison for all of them
        differ = np.flatnonzero(got != np.frombuffer(b"".join(raw), np.uint8))
        same[np.searchsorted(edges, differ, side="right") - 1] = False
    else:
        for i in np.flatnonzero(same):
            same[i] = got[edges[i] : edges[i + 1]].tobytes() == raw[i]
    return tokens, same


def _only(tokens: Tokens, keep: np.ndarray, vocabulary: Vocabulary) -> Tokens:
    count = np.where(keep, np.diff(tokens.first), 0)
    ids = tokens.ids[np.repeat(keep, np.diff(tokens.first))]
    return Tokens(ids, np.cumsum(vocabulary.length[ids]), np.concatenate([[0], np.cumsum(count)]))


def lockstep(a: Tokens, b: Tokens, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as pairs of token places (a, b), and marks of the tokens that end at a cut."""
    count = np.diff(a.first)
    lanes = -(-count // lane)
    nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at_a = np.repeat(a.first[:-1], lanes) + nth * lane
    stop = np.minimum(at_a + lane, np.repeat(a.first[1:], lanes))
    begin = np.concatenate([[0], a.end])[at_a]
    at_b = np.searchsorted(b.end, begin, side="right")
    cut_a, cut_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    link_a, link_b = [at_a[:0]], [at_b[:0]]
    while len(at_a):
        link_a.append(at_a)
        link_b.append(at_b)
        end_a, end_b = a.end[at_a], b.end[at_b]
        both = end_a == end_b
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    return np.concatenate(link_a), np.concatenate(link_b), cut_a, cut_b


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. size - 1 from the left, with room for a sign behind them; their number."""
    text = np.char.mod("%d", np.arange(size)).astype("S")
    width = text.dtype.itemsize
    digits = np.zeros((size, width + 1), np.uint8)
    digits[:, :width] = text.view(np.uint8).reshape(size, width)
    return digits, (digits[:, :width] != 0).sum(axis=1)


class Alignment:
    """Links and groups of a list of texts under two vocabularies."""

    _digits: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, texts: list[str | None], vocabs: tuple[Vocabulary, Vocabulary]):
        filled = [i for i, t in enumerate(texts) if t]
        used = [texts[i] for i in filled]
        (a, same_a), (b, same_b) = (_encoded(used, v) for v in vocabs)
        keep = same_a & same_b
        if not keep.all():
            a, b = (_only(t, keep, v) for t, v in zip((a, b), vocabs, strict=True))
        whole = np.zeros(len(texts), np.int64)
        for tokens in (a, b):  # texts without tokens have none between their neighbours
            count = whole.copy()
            count[filled] = np.diff(tokens.first)
            tokens.first = np.concatenate([[0], np.cumsum(count)])
        self.a, self.b, self.vocabs = a, b, vocabs
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(a, b)
        self.doc_of_a = np.repeat(np.arange(len(texts)), np.diff(a.first))

    def per_document(self, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[first[1:]] - total[first[:-1]]

    def digests(self) -> list[str]:
        """Of a1,a2|b1;a3|b2,b3 for each text; empty without tokens."""
        if Alignment._digits is None or len(Alignment._digits[0]) < max(v.size for v in self.vocabs):
            Alignment._digits = _decimals(max(v.size for v in self.vocabs))
        a, b = self.a, self.b
        n_groups = int(self.cut_a.sum())
        group_a, group_b = (np.cumsum(c) - c for c in (self.cut_a, self.cut_b))
        in_a, in_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in (group_a, group_b))
        at_a = np.arange(len(a.ids)) + in_b[group_a]
        at_b = np.arange(len(b.ids)) + in_a[group_b + 1]
        ids = np.zeros(len(a.ids) + len(b.ids), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a.ids, b.ids
        sign[at_a[self.cut_a]], sign[at_b[self.cut_b]] = ord("|"), ord(";")
        digits, size = Alignment._digits
        rows, size = digits[ids], size[ids]
        rows[np.arange(len(ids)), size] = sign
        size += 1
        text = rows[np.arange(rows.shape[1]) < size[:, None]]
        end = np.concatenate([[0], np.cumsum(size)])[a.first + b.first]
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code, times) of each document's different id pairs, in order; code is a * size of B + b."""
        wide = self.vocabs[0].size * self.vocabs[1].size
        code = self.a.ids[self.link_a] * self.vocabs[1].size + self.b.ids[self.link_b]
        found, times = np.unique(self.doc_of_a[self.link_a] * wide + code, return_counts=True)
        return found // wide, found % wide, times


_BLOCKS = (
    "kind int, block long, key {0}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes array<long>, times array<long>"
)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _blocks(docs: DataFrame, key: str, text: str, paths: tuple[str, str]) -> DataFrame:
    """Kind 0: a row a document; kind 1: a row a block, with its pairs and their documents' number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        codes, n_bytes, n_rows, none = [], 0, 0, None

        def total() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(codes), return_counts=True)
            columns = [pa.array([1], pa.int32()), pa.array([block], pa.int64()), none, *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
            columns += [_lists(np.array([0, len(found)]), found), _lists(np.array([0, len(count)]), count)]
            return pa.RecordBatch.from_arrays(columns, names)

        names = [c.split(" ")[0] for c in _BLOCKS.split(", ")]
        for batch in batches:
            for part in C.steps(batch, "__text"):
                n, none = part.num_rows, pa.nulls(1, part.column(0).type)
                found = Alignment(part.column(1).to_pylist(), vocabularies(paths))
                doc, code, times = found.pairs()
                edges = np.searchsorted(doc, np.arange(n + 1))
                counts = [np.diff(found.a.first), np.diff(found.b.first), found.per_document(found.cut_a, found.a.first)]
                counts.append(np.bincount(found.doc_of_a[found.link_a], minlength=n))
                columns = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), part.column(0), *[pa.array(x, pa.int64()) for x in counts]]
                columns += [pa.array(found.digests(), pa.string()), _lists(edges, code), _lists(edges, times)]
                yield pa.RecordBatch.from_arrays(columns, names)
                codes.append(code)
                n_bytes += part.column(1).nbytes
                n_rows += n
                if n_bytes >= BLOCK_BYTES or n_rows >= BLOCK_ROWS:
                    yield total()
                    codes, n_bytes, n_rows, block = [], 0, 0, block + 1
        if codes:
            yield total()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).mapInArrow(run, _BLOCKS.format(kind))


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(code, n, best): documents that have the pair, and whether its A id has no pair with more."""
    counted = blocks.groupBy("code").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.expr(f"code div {size_b}"))  # at most as many rows as B has ids
    return counted.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _scored(kind: str) -> tuple:
    names = ["key", "n_a", "n_b", "n_groups", "n_links"]

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.combine_chunks(), answers.combine_chunks()
        codes, times = (docs.column(c).combine_chunks() for c in ("codes", "times"))
        if isinstance(codes, pa.ChunkedArray):  # no rows
            codes, times = (pa.array([], pa.list_(pa.int64())) for _ in range(2))
        edges = codes.offsets.to_numpy()
        code, many = codes.values.to_numpy()[edges[0] : edges[-1]], times.values.to_numpy()[edges[0] : edges[-1]]
        edges = edges - edges[0]
        known = answers.column("code").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], code)]
        n, best = answers.column("n").to_numpy()[at], answers.column("best").to_numpy()[at]
        totals = [np.concatenate([[0], np.cumsum(x)])[edges] for x in (many * best, many * n)]
        columns = [docs.column(c) for c in names] + [pa.array(np.diff(t), pa.int64()) for t in totals] + [docs.column("groups_sha256")]
        return pa.Table.from_arrays(columns, [*names, "n_best", "count_sum", "groups_sha256"])

    return work, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = paths or default_vocabularies()
    stored = store_by(_blocks(docs, key, text, paths), "kind")
    asked = stored.where("kind = 1").select("block", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    asked = asked.select("block", F.col("p.codes").alias("code"), F.col("p.times").alias("n"))
    counts = C.store(pair_counts(asked, vocabularies(paths)[1].size))
    answers = asked.select(F.col("block").alias("asker"), "code").join(counts, "code")
    work, schema = _scored(docs.schema[key].dataType.simpleString())
    own = stored.where("kind = 0").drop("kind")
    return own.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(work, schema)


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The alignment itself: key, ids and byte ends of both sides, links (places of tokens), cuts (byte offsets)."""
    paths = paths or default_vocabularies()
    kind = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Alignment(batch.column(1).to_pylist(), vocabularies(paths))
        a, b = found.a, found.b
        order = np.lexsort((found.link_b, found.link_a))
        link_a, link_b = found.link_a[order], found.link_b[order]
        doc = found.doc_of_a[link_a]
        edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        base = a.document_ends()[:-1]
        cuts = a.end[found.cut_a] - base[found.doc_of_a[found.cut_a]]
        cut_edges = np.searchsorted(found.doc_of_a[found.cut_a], np.arange(batch.num_rows + 1))
        doc_of_b = np.repeat(np.arange(batch.num_rows), np.diff(b.first))
        columns = [batch.column(0), _lists(a.first, a.ids), _lists(b.first, b.ids), _lists(a.first, a.end - base[found.doc_of_a])]
        columns += [_lists(b.first, b.end - base[doc_of_b]), _lists(edges, link_a - a.first[doc]), _lists(edges, link_b - b.first[doc]), _lists(cut_edges, cuts)]
        return pa.RecordBatch.from_arrays(columns, ["key", "a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b", "cuts"])

    lists = ", ".join(f"{c} array<long>" for c in ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b", "cuts"))
    return C.map_batches(docs, [F.col(key).alias("key"), F.col(text).alias("__text")], "__text", f"key {kind}, {lists}", work)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(C.table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
