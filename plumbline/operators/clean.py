"""The clean surface: comments, pattern literals and prose strings blanked in place.

Line and column positions survive because every blanked character becomes one
space. The text is cut into tokens by one alternation, each token is kept or
blanked, and the tokens are joined again: all inside Catalyst, one pass, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_EXT = "\\.(ts|tsx|js|jsx|mjs|cjs|sql)$"

_COMMENT = r"--[^\n]*+|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)'
_SINGLE = r"'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\z)"
# A template may hold expressions, and one level of templates inside those.
_INNER = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
_BRACES = r"\{[^{}`]*+(?:" + _INNER + r"[^{}`]*+)*+\}"
_HOLE = r"\$\{[^{}`]*+(?:(?:" + _INNER + "|" + _BRACES + r")[^{}`]*+)*+\}"
_TEMPLATE = r"`[^`\\$]*+(?:(?:\\(?s:.)|" + _HOLE + r"|\$)[^`\\$]*+)*+(?:`|\z)"
# A slash opens a pattern only where an operand is expected.
_PATTERN = (
    r"(?<=(?:\A|[=(,:\[!&|?{};+\-*%<>~^])\s{0,40})"
    r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[gimsuyd]*+"
)
_BUILT = r"new\s+RegExp\s*\(\s*(?:" + _DOUBLE + "|" + _SINGLE + "|" + _INNER + ")"
_TOKEN = "|".join([_COMMENT, _BUILT, _DOUBLE, _SINGLE, _TEMPLATE, _PATTERN, r"n?[^\"'`/\-n]++", r"(?s:.)"])

# A long string that holds a statement or a clause is code, not prose.
_STATEMENTS = r"delete\s+from|insert\s+into|select\s.+from|update\s+\w+\s+set"
_CLAUSES = r"(?:group|order)\s+by|ilike|where\s"
_SQL_IN_TEXT = rf"(?i)\b(?:{_STATEMENTS}|{_CLAUSES})\b"


def _blank(token: Column) -> Column:
    # Line by line: a pattern would stop at each character.
    return F.array_join(F.transform(F.split(token, "\n"), lambda line: F.repeat(F.lit(" "), F.char_length(line))), "\n")


def _is_prose(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.greatest(F.char_length(token) - 2, F.lit(0)))
    return (
        (F.char_length(inner) >= 25)
        & (F.size(F.split(F.trim(inner), "\\s+")) >= 4)
        & ~inner.contains("${")
        & ~inner.rlike(_SQL_IN_TEXT)
    )


def _shown(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    two = F.substring(token, 1, 2)
    comment = two.isin("--", "//", "/*") & (F.char_length(token) > 1)
    literal = (first == "/") & (F.char_length(token) > 1)
    built = (first == "n") & token.rlike("^new\\s+RegExp\\s*\\(\\s*[\"'`]")
    quoted = first.isin('"', "'", "`")
    return F.when(comment | literal | built | (quoted & _is_prose(token)), _blank(token)).otherwise(token)


def clean_text(content: Column) -> Column:
    tokens = F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, _shown), "")


def clean_corpus(files: DataFrame) -> DataFrame:
    """Adds ``clean``: blanked for script and SQL files, the raw text otherwise."""
    return files.withColumn(
        "clean",
        F.when(F.col("path").rlike(CODE_EXT) & F.col("content").rlike("[/\"'`-]"), clean_text(F.col("content"))).otherwise(
            F.col("content")
        ),
    )


def strip_comments(content: Column) -> Column:
    """Lighter form: block comments become spaces, line comments are cut."""
    blocks = F.regexp_extract_all(content, F.lit(r"/\*(?s:.*?)\*/|[^/]++|/"), F.lit(0))
    joined = F.array_join(F.transform(blocks, lambda t: F.when(t.startswith("/*"), _blank(t)).otherwise(t)), "")
    return F.regexp_replace(joined, "//[^\\n]*", "")


def mask_pattern_literals(line: Column) -> Column:
    """Blanks pattern literals on a line so that a match inside one does not count."""
    tokens = F.regexp_extract_all(line, F.lit(_PATTERN + "|" + _BUILT + r"|[^/n]++|(?s:.)"), F.lit(0))
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(
                (F.char_length(t) > 1) & (t.startswith("/") | t.rlike("^new\\s+RegExp")), _blank(t)
            ).otherwise(t),
        ),
        "",
    )
