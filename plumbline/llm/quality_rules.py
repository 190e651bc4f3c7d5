"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Every document becomes a vector of transformed statistics. For each group (language,
source) the centre and scatter of the most concentrated three quarters of its documents
are estimated by concentration steps (minimum covariance determinant); a document whose
Mahalanobis distance from that centre is beyond a chi-square limit is rejected. The scatter
is the group's own, with the measurement noise of the document's statistics added: one
character, symbol, line, window or word at its length, since most statistics of clean text
are constant and a scatter of zero would reject every other value.

A concentration step is one aggregation over all documents: distances are put into
logarithmic bins, and count and moments are summed per (group, bin), partially before the
shuffle. What meets in one place is a table of at most BINS rows a group, however many
documents the group has. Joins with the per-group estimates salt the documents' side, so a
group with a third of all rows is spread over tasks. Nothing is sampled.

Defined results: null or empty texts have no words and fail the base rules; null languages
and sources form groups of their own; a group with one document has it as its centre; equal
rows get equal verdicts; tables without rows give no rows. Other columns of the input are
carried by ``keep_clean`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C
from plumbline.operators.joins import spread_join

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Share of a group that the estimate rests on, and the number of concentration steps.
CORE_SHARE = 0.75
STEPS = 6
BINS = 512
DIMENSIONS = ["length", "symbols", "lines", "repeats", "size"]
#: Squared distance beyond which a document goes: chi-square with five degrees of freedom
#: at 0.999, and the factor that makes the scatter of the inner 75 % consistent.
LIMIT = 20.52
CONSISTENCY = 1.38
#: Lengths that share their measurement noise: half octaves of the word count.
LENGTHS = range(8, 41)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(buffer: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base statistics of each text of a buffer."""
    n = len(offsets) - 1
    found = C.words(buffer, offsets, C.SPACED)
    n_words = np.diff(found.first)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    per_row = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    points = ((buffer & 0xC0) != 0x80) & (found.mapped != 0)
    word_chars, n_symbols = per_row(before(points)), per_row(before(SYMBOLS[buffer]))

    breaks = np.flatnonzero(buffer == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buffer)]
    line_end = np.append(line_start[1:], len(buffer))
    # A line ends before its break; the last line of a row ends with the row.
    line_end = line_end - (buffer[line_end - 1] == 10) if len(line_start) else line_end
    worded = np.searchsorted(found.start, line_end) > np.searchsorted(found.start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    key = C.span_hashes(buffer.astype(np.uint16) + np.uint16(1), line_start, line_end) ^ C.mix(
        line_row.astype(np.uint64)
    )
    distinct = np.unique(key, return_index=True)[1]
    n_dup_lines = np.bincount(line_row, minlength=n) - np.bincount(line_row[distinct], minlength=n)

    hashes = C.grams(found.hashes(), WINDOW)
    n_repeat = np.zeros(n, np.int64)
    at = np.flatnonzero(found.row[: len(hashes)] == found.row[WINDOW - 1 :]) if len(hashes) else np.zeros(0, int)
    if len(at):
        keys = hashes[at] ^ C.mix(found.row[at].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        change = np.zeros(len(found.row) + 1, np.int64)
        change[at[twice]] += 1
        change[at[twice] + WINDOW] -= 1
        covered = np.cumsum(change[:-1]) > 0
        n_repeat = np.bincount(found.row[covered], minlength=n)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines.astype(np.int64),
        "n_repeat_words": n_repeat.astype(np.int64),
    }


def with_stats(docs: DataFrame, keys: list, text: str, schema: str) -> DataFrame:
    """Chosen key columns with the base statistics of the text beside them."""
    names = [f"k{i}" for i in range(len(keys))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = text_stats(*C.text_buffer(batch.column(len(names))))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(names)], *(pa.array(v) for v in stats.values())], [*names, *stats]
        )

    columns = [k.alias(n) for k, n in zip(keys, names, strict=True)] + [F.col(text).alias("__text")]
    out = C.map_batches(docs, columns, "__text", schema + ", " + STATS, work)
    return out.withColumn(
        "base_failed",
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    )


def _rate(column: str) -> F.Column:
    return F.log1p(100 * F.col(column) / F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Statistics of documents the base rules pass, as a vector of near-normal numbers.

    The mean word length of a short text varies more, so its distance from the group's
    median is scaled by the root of the word count. The base rule bounds the share of
    repeated words, so it is not put on a logarithmic scale.
    """
    passed = stats.where("NOT base_failed").withColumn("mean_length", F.col("word_chars") / F.col("n_words"))
    middle = passed.groupBy("grp").agg(F.percentile_approx("mean_length", 0.5, 1000).alias("middle"))
    return spread_join(passed, middle, ["grp"], spread_by=["row_key"]).select(
        "grp",
        "row_key",
        ((F.col("mean_length") - F.col("middle")) * F.sqrt("n_words")).alias("length"),
        _rate("n_symbols").alias("symbols"),
        _rate("n_dup_lines").alias("lines"),
        (100 * F.col("n_repeat_words") / F.col("n_words")).alias("repeats"),
        F.log("n_words").alias("size"),
    )


def noise(n_words: float) -> np.ndarray:
    """What one character, symbol, line, window or word changes in the vector of a text this long."""
    rate = lambda n: np.log1p(100 * n / n_words)
    return np.array([n_words**-0.5, rate(1), rate(1), 100 * WINDOW / n_words, np.log1p(1 / n_words)])


def _inverses(scatter: np.ndarray) -> list[list[float]]:
    """Inverse of a scatter matrix with the measurement noise added, for each of LENGTHS."""
    return [np.linalg.inv(scatter + np.diag(noise(2 ** ((k + 0.5) / 2)) ** 2)).ravel().tolist() for k in LENGTHS]


_PAIRS = [(i, j) for i in range(len(DIMENSIONS)) for j in range(i, len(DIMENSIONS))]
_PARAMS = "grp string, centre array<double>, inverses array<array<double>>"


def _params(group, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"grp": [group], "centre": [centre.tolist()], "inverses": [_inverses(scatter)]})


def _start(vecs: DataFrame) -> DataFrame:
    """Medians and interquartile ranges, coordinate by coordinate."""
    quartiles = [F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(d) for d in DIMENSIONS]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.array([[*pdf[d].iloc[0]] for d in DIMENSIONS])
        return _params(pdf["grp"].iloc[0], q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))

    return vecs.groupBy("grp").agg(*quartiles).groupBy("grp").applyInPandas(fit, _PARAMS)


def distances(vecs: DataFrame, params: DataFrame) -> DataFrame:
    n = len(DIMENSIONS)
    off = [f"({d} - centre[{i}])" for i, d in enumerate(DIMENSIONS)]
    square = " + ".join(f"{1 if i == j else 2} * inverse[{n * i + j}] * {off[i]} * {off[j]}" for i, j in _PAIRS)
    last = len(LENGTHS) - 1
    length = F.greatest(F.lit(0), F.least(F.lit(last), (F.floor(2 * F.col("size") / np.log(2)) - LENGTHS[0]).cast("int")))
    joined = spread_join(vecs, params, ["grp"], spread_by=["row_key"]).withColumn("inverse", F.col("inverses")[length])
    return joined.withColumn("d2", F.expr(square)).drop("centre", "inverse", "inverses")


def concentrate(vecs: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: refit each group on its CORE_SHARE nearest documents."""
    fine = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(16 * F.log2(F.col("d2") + 2.0**-8)) + 128))
    sums = [F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMENSIONS)]
    sums += [F.sum(F.col(DIMENSIONS[i]) * F.col(DIMENSIONS[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    binned = distances(vecs, params).groupBy("grp", fine.alias("bin")).agg(F.count("*").alias("n"), *sums)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        reached = pdf["n"].cumsum().to_numpy()
        core = pdf.iloc[: int(np.searchsorted(reached, CORE_SHARE * reached[-1])) + 1]
        n = core["n"].sum()
        centre = np.array([core[f"s{i}"].sum() / n for i in range(len(DIMENSIONS))])
        scatter = np.zeros((len(DIMENSIONS),) * 2)
        for i, j in _PAIRS:
            scatter[i, j] = scatter[j, i] = core[f"p{i}{j}"].sum() / n - centre[i] * centre[j]
        return _params(pdf["grp"].iloc[0], centre, scatter * CONSISTENCY)

    return binned.groupBy("grp").applyInPandas(fit, _PARAMS)


def verdicts(stats: DataFrame) -> DataFrame:
    """row_key of every document beyond the limit; ``stats`` is a stored table."""
    vecs = C.store(vectors(stats))
    params = C.store(_start(vecs))
    for _ in range(STEPS):
        params = C.store(concentrate(vecs, params))
    return distances(vecs, params).where(F.col("d2") > LIMIT).select("row_key").distinct()


def judged(docs: DataFrame, key, key_type: str, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Statistics, base_failed and kept for each row; k0 is the key handed in.

    Rows are told apart by (key, group, statistics): rows equal in these get equal verdicts.
    """
    group = F.to_json(F.struct(F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s")))
    stats = with_stats(docs, [key, group], text, f"k0 {key_type}, k1 string").withColumnRenamed("k1", "grp")
    names = ["grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = C.store(stats.withColumn("row_key", F.xxhash64(*names)))
    out = verdicts(stats).withColumn("far", F.lit(True))
    return stats.join(out, "row_key", "left").withColumn("kept", F.expr("NOT base_failed AND far IS NULL"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each document."""
    return judged(docs, F.col("doc_id"), "long").select(
        F.col("k0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all their columns unchanged."""
    own = C.free_name(docs)
    identity = F.md5(F.to_json(F.struct(C.digest_of(F.col("text")).alias("t"), F.col("lang").alias("l"), F.col("source").alias("s"))))
    bad = judged(docs, identity, "string").where("NOT kept").select(F.col("k0").alias(own)).distinct()
    return docs.withColumn(own, identity).join(bad, own, "left_anti").drop(own)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents"))
