"""Small text expressions shared by every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_FILE = "(no file)"

# Folders and suffixes that mark a test or fixture file.
TEST_DIR = (
    "(?i)(^|/)(__tests__|__mocks__|__fixtures__|tests?|spec|specs|fixtures?|e2e|cypress|playwright|stories)(/|$)"
)
TEST_SUFFIX = "(?i)\\.(test|spec|stories|fixture|mock)\\.[jt]sx?$"
# Route files of the two supported layouts, only at the root or under src/.
ROUTE_ROOT = "^(?:src/)?(?:app|pages)/"
ROUTE_FILE = "(^|/)app/.*/route\\.(ts|js|tsx|jsx)$|(^|/)pages/api/.*\\.(ts|js|tsx|jsx)$"


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_DIR) | path.rlike(TEST_SUFFIX)


def is_route_path(path: Column) -> Column:
    return path.rlike(ROUTE_ROOT) & path.rlike(ROUTE_FILE)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/.](\\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_name(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "\\.[^.]+$", "")


def snippet(text: Column) -> Column:
    """Evidence text: trimmed, at most 240 characters."""
    return F.substring(F.trim(text), 1, 240)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def fingerprint(rule_id: Column, file: Column, snip: Column, line: Column) -> Column:
    """Identity of a finding: independent of line shifts as long as there is a snippet."""
    short = F.substring(collapsed(F.coalesce(snip, F.lit(""))), 1, 100)
    key = F.when(short != "", short).otherwise(F.concat(F.lit("L"), F.coalesce(line, F.lit(0)).cast("string")))
    return F.concat_ws("::", rule_id, F.coalesce(file, F.lit(NO_FILE)), key)


def project_fingerprint(project: Column, rule_id: Column, file: Column, snip: Column, line: Column) -> Column:
    return F.concat_ws("::", project, fingerprint(rule_id, F.coalesce(file, F.lit("-")), snip, line))


def name_parts(name: Column) -> Column:
    """camelCase, snake_case and punctuation split into lower-case words."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def indent(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, "^[ \\t]*", 0))


def redact_literal(line: Column, at_least: int = 4) -> Column:
    return F.regexp_replace(line, "[\"'`][^\"'`\\n]{%d,}[\"'`]" % at_least, "\"[redacted]\"")


def local_date_stamp(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def days_until(ts: Column, now: Column) -> Column:
    """Whole days from ``now`` to ``ts``, rounded down; ``now`` is always a parameter."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(now)) / F.lit(86_400_000_000)).cast("int")


def expiry_band(days: Column) -> Column:
    return (
        F.when(days < 0, F.lit("expired"))
        .when(days < 7, F.lit("critical"))
        .when(days < 30, F.lit("high"))
        .otherwise(F.lit("ok"))
    )
