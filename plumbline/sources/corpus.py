"""File corpus: which files count, how much of them is read, whether they are tracked."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.joins import spread_join
from plumbline.sources.tree import dot_files

# What is scanned and what is never scanned.
INCLUDE = (
    "\\.(ts|tsx|js|jsx|mjs|cjs|py|rb|go|rs|php|java|kt|json|env|md|mdx|yml|yaml|toml|ini|conf|sh|bash|zsh"
    "|csv|tsv|jsonl|ndjson|sql|prisma|html|htm)$"
    "|(^|/)\\.[^/]*history[^/]*$|^\\.env[^/]*$|^\\.gitignore$"
)
IGNORE = (
    "(^|/)(node_modules|dist|dist-[^/]*|out-[^/]*|release|\\.output|\\.svelte-kit|storybook-static|build|\\.next"
    "|coverage|\\.git|out|corpus|venv|\\.venv|site-packages|vendor|\\.tox|__pycache__|target|\\.gradle|Pods"
    "|\\.vercel|\\.turbo|\\.cache)/"
    "|^report/|\\.min\\.(js|css)$|\\.bundle\\.js$|-min\\.js$"
)
DATA_FILE = "(?i)\\.(csv|tsv|jsonl|ndjson)$"
MINIFIABLE = "(?i)\\.(js|mjs|cjs|css)$"
MINIFIED_HEAD = 8192
LONGEST_LINE = 1000
MEAN_LINE = 400


def wanted_path(path: Column) -> Column:
    return path.rlike(INCLUDE) & ~path.rlike(IGNORE)


def is_minified(path: Column, content: Column) -> Column:
    """Script or style whose first 8 KiB has a huge line or a huge mean line."""
    head = F.substring(content, 1, MINIFIED_HEAD)
    lines = F.split(head, "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.char_length(x)))
    mean = F.char_length(head) / F.size(lines)
    return path.rlike(MINIFIABLE) & ((longest > LONGEST_LINE) | (mean > MEAN_LINE))


def drop_minified(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(is_minified(F.col("path"), F.col("content")), F.lit(False)))


def head(content: Column, n_bytes: int = 64 * 1024) -> Column:
    """First bytes of a text; a character cut in half becomes a replacement character."""
    return lenient(F.substring(F.encode(content, "UTF-8"), 1, n_bytes))


def lenient(raw: Column) -> Column:
    """Bytes as UTF-8 text; invalid bytes become replacement characters, never an error."""
    return F.make_valid_utf8(raw.cast("string"))


def scan_corpus(
    spark: SparkSession, root: str, hidden: DataFrame | None = None, size_limit: int | None = None
) -> DataFrame:
    """Files under ``root/<project>/...`` as rows, whole.

    With ``size_limit`` larger files are not opened; ``oversized`` lists them. The path is
    tested before content is decoded.

    Files whose names start with a dot (.env, .gitignore) come from a data source of their
    own where ``root`` is a folder that driver and executors share, and through
    ``hidden(project, path, content, size)`` where it is not, such as a bucket.
    """
    named = _named_files(spark, root)
    if size_limit is not None:
        named = named.where(F.col("size") <= size_limit)
    files = named.select("project", "path", lenient(F.col("__bytes")).alias("content"), "size")
    if hidden is None and root.startswith(("/", "file:")):
        dotted = dot_files(spark, root, INCLUDE, IGNORE, size_limit)
        hidden = dotted.select("project", "path", lenient(F.col("content")).alias("content"), "size")
    if hidden is not None:
        files = files.unionByName(hidden.where(wanted_path(F.col("path"))).select(*files.columns))
    return with_path_columns(drop_minified(files))


def oversized(spark: SparkSession, root: str, size_limit: int) -> DataFrame:
    """(project, path, size) of wanted files that a scan with this limit leaves out."""
    return _named_files(spark, root).where(F.col("size") > size_limit).select("project", "path", "size")


def _named_files(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # File names come back with a scheme of Spark's own spelling.
    folder = re.sub("^[a-z0-9]+:(//[^/]*)?(?=/)", "", base)
    relative = F.substring_index(F.col("path"), folder + "/", -1)
    return raw.select(
        F.regexp_extract(relative, "^([^/]+)/", 1).alias("project"),
        F.regexp_replace(relative, "^[^/]+/", "").alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("__bytes"),
    ).where(wanted_path(F.col("path")))


def with_path_columns(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", T.extension(F.col("path"))).withColumn("is_test", T.is_test_path(F.col("path")))


def mark_tracked(files: DataFrame, tracked: DataFrame | None) -> DataFrame:
    """``tracked`` true/false for projects with a listing, null where there is none."""
    if tracked is None:
        return files.withColumn("tracked", F.lit(None).cast("boolean"))
    listing = tracked.select("project", T.posix(F.col("path")).alias("path")).distinct()
    listed = listing.select("project").distinct().withColumn("__listed", F.lit(True))
    flagged = files.join(listing.withColumn("__hit", F.lit(True)), ["project", "path"], "left")
    known = spread_join(flagged, listed, ["project"], "left", spread_by=["path"])
    return known.withColumn("tracked", F.when(F.col("__listed"), F.coalesce(F.col("__hit"), F.lit(False)))).drop(
        "__hit", "__listed"
    )


def csv_header(content: Column, path: Column) -> Column:
    """Column names on the first line, quotes trimmed."""
    first = F.element_at(F.split(content, "\\r?\\n"), 1)
    names = F.when(path.rlike("(?i)\\.tsv$"), F.split(first, "\t")).otherwise(F.split(first, ","))
    trimmed = F.transform(names, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(trimmed, lambda x: x != "")


def jsonl_keys(content: Column) -> Column:
    """Keys of the first object line; a truncated object falls back to a regex."""
    first = F.trim(F.try_element_at(F.filter(F.split(content, "\\r?\\n"), lambda x: F.trim(x).startswith("{")), F.lit(1)))
    return F.coalesce(
        F.json_object_keys(first),
        F.regexp_extract_all(first, F.lit('"(\\w+)"\\s*:'), F.lit(1)),
        F.array().cast("array<string>"),
    )


# Extensions the rules can read, and known languages they cannot.
READABLE = (
    ".ts .tsx .js .jsx .mjs .cjs .json .sql .prisma .html .htm .env .mdx .py .rb .go .php .java .kt".split()
)
UNREADABLE = {
    ".rs": "Rust",
    ".cs": "C#",
    ".swift": "Swift",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".dart": "Dart",
    ".scala": "Scala",
    ".clj": "Clojure",
}


def coverage(rows: DataFrame, group: str, kind: Column, readable: list[str], unreadable: dict[str, str]) -> DataFrame:
    """Readable and unreadable rows per group, per language; 0 percent when there is nothing."""
    language = F.lit(None).cast("string")
    for key, name in unreadable.items():
        language = F.when(kind == key, F.lit(name)).otherwise(language)
    tagged = rows.select(F.col(group), kind.isin(readable).alias("ok"), language.alias("language"))
    per_language = tagged.groupBy(group, "ok", "language").agg(F.count("*").alias("n"))
    out = per_language.groupBy(group).agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("readable"),
        F.coalesce(F.sum(F.when(F.col("language").isNotNull(), F.col("n"))), F.lit(0)).alias("unreadable"),
        F.array_sort(
            F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n")))
        ).alias("languages"),
    )
    total = F.col("readable") + F.col("unreadable")
    return out.withColumn(
        "percent",
        F.when(total == 0, F.lit(0)).otherwise(F.round(F.try_divide(F.col("readable") * 100, total))).cast("int"),
    )


def corpus_coverage(files: DataFrame) -> DataFrame:
    counted = files.where(
        ~F.col("path").rlike(
            "(^|/)(node_modules|venv|\\.venv|site-packages|vendor|\\.git|dist|build|\\.next|out|coverage"
            "|__pycache__|target|Pods|\\.tox)(/|$)"
        )
    )
    return coverage(counted, "project", T.extension(F.col("path")), READABLE, UNREADABLE)


def file_digests(files: DataFrame, findings: DataFrame) -> DataFrame:
    """First 16 hex digits of sha256 for files that have findings.

    Content is hashed where it is read; only path and digest go into the join.
    """
    digest = F.substring(F.sha2(F.col("content"), 256), 1, 16)
    return digests_with_findings(files.select("project", "path", digest.alias("digest")), findings)


def digests_with_findings(seen: DataFrame, findings: DataFrame) -> DataFrame:
    """Digests, given as (project, path, digest), of files that have findings."""
    hit = findings.where(F.col("file").isNotNull()).select("project", F.col("file").alias("path")).distinct()
    return seen.join(hit, ["project", "path"], "left_semi").select("project", F.col("path").alias("file"), "digest")
