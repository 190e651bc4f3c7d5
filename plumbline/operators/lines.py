"""Lines of a file, matches on lines and neighbouring lines.

A file is one row, so its lines are an array inside that row. Context windows are
slices of that array: no shuffle, no window operator, and neighbours can never come
from another file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = "\\r?\\n"


def split_lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK)


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with a 1-based ``line_no``; narrow, no shuffle."""
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(split_lines(F.col(content))).alias("__pos", "text")).select(
        *others, (F.col("__pos") + 1).alias("line_no"), "text"
    )


def context(lines: Column, index: Column, before: int, after: int) -> Column:
    """Lines ``index-before .. index+after`` (1-based) joined with newlines."""
    start = F.greatest(index - before, F.lit(1))
    return F.array_join(F.slice(lines, start, index + after - start + 1), "\n")


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda text, i: F.struct((i + 1).alias("line_no"), text.alias("text")))


def matches_on(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in ``text`` as (column_no, value), left to right.

    The pieces between matches and the matches themselves interleave; one fold over
    both keeps the running position, so the text is split once per row.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )
    none = F.array().cast("array<struct<column_no:int,value:string>>")

    def step(acc: Column, pair: Column) -> Column:
        at = acc["pos"] + F.char_length(pair["piece"])
        return F.struct(
            (at + F.coalesce(F.char_length(pair["value"]), F.lit(0))).alias("pos"),
            F.when(pair["value"].isNull(), acc["out"])
            .otherwise(
                F.array_append(acc["out"], F.struct(at.alias("column_no"), pair["value"].alias("value")))
            )
            .alias("out"),
        )

    return F.aggregate(pairs, F.struct(F.lit(1).alias("pos"), none.alias("out")), step)["out"]


def grep_lines(
    files: DataFrame, pattern: str, include: Column | None = None, content: str = "content"
) -> DataFrame:
    """Every match on every line. ``pattern`` must not match the empty string.

    The path predicate runs first, then one regex over the whole file decides
    whether its lines are looked at at all.
    """
    source = files if include is None else files.where(include)
    others = [c for c in files.columns if c != content]
    gated = source.where(F.col(content).rlike("(?m)" + pattern))
    lines = explode_lines(gated.select(*others, content), content).where(F.col("text").rlike(pattern))
    return lines.select("*", F.explode(matches_on(F.col("text"), pattern)).alias("__m")).select(
        *others, "line_no", F.col("__m.column_no").alias("column_no"), "text", F.col("__m.value").alias("value")
    )


def context_hits(
    files: DataFrame,
    hit: str,
    before: int,
    after: int,
    require: str | None = None,
    exclude: str | None = None,
    content: str = "content",
    first_only: bool = False,
) -> DataFrame:
    """Lines matching ``hit`` whose neighbourhood holds ``require`` and not ``exclude``."""
    others = [c for c in files.columns if c != content]
    gated = files.where(F.col(content).rlike("(?m)" + hit)).select(
        *others, split_lines(F.col(content)).alias("__lines")
    )

    def keep(entry: Column) -> Column:
        cond = entry["text"].rlike(hit)
        near = context(F.col("__lines"), entry["line_no"], before, after)
        if require:
            cond = cond & near.rlike(require)
        if exclude:
            cond = cond & ~near.rlike(exclude)
        return cond

    hits = F.filter(numbered(F.col("__lines")), keep)
    if first_only:
        hits = F.slice(hits, 1, 1)
    shaped = F.transform(
        hits,
        lambda e: F.struct(
            e["line_no"].alias("line_no"),
            e["text"].alias("text"),
            context(F.col("__lines"), e["line_no"], before, after).alias("context"),
        ),
    )
    return gated.select(*others, F.explode(shaped).alias("__h")).select(*others, "__h.*")


def line_of(content: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    return F.char_length(F.regexp_replace(F.substring(content, F.lit(1), position - 1), "[^\\n]", "")) + 1
