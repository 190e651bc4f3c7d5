"""Character-statistics of tokens as column expressions (no Python per row)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits per character each character class can carry.
CLASS_CEILING = {
    "hex": 4.0,
    "base32": 5.0,
    "base64": 6.0,
    "alnum": math.log2(62),
    "printable": math.log2(94),
}
WEAK_BITS = 64
STRONG_BITS = 112


def char_histogram(s: Column) -> Column:
    """Counts of each distinct character, as an array (one entry per distinct character).

    After sorting, equal characters are neighbours; removing runs leaves the count as
    the difference in length: cheap and free of quadratic scans over the alphabet.
    """
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)))


def shannon_entropy(s: Column) -> Column:
    """-sum(p * log2 p) over code points; 0 for the empty string."""
    total = F.char_length(s).cast("double")
    return F.when(F.char_length(s) == 0, F.lit(0.0)).otherwise(
        F.aggregate(
            char_histogram(s),
            F.lit(0.0),
            lambda acc, n: acc - (n / total) * F.log2(n / total),
        )
    )


def distinct_chars(s: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")))


def char_class(s: Column) -> Column:
    """First class that fits, in this order; base64 needs its padding or block length."""
    shaped = s.rlike("^[A-Za-z0-9+/]+={0,2}$") | s.rlike("^[A-Za-z0-9_-]+={0,2}$")
    blocked = (F.char_length(s) % 4 == 0) | s.endswith("=")
    return (
        F.when(F.char_length(s) == 0, F.lit("text"))
        .when(s.rlike("^[0-9a-fA-F]+$"), F.lit("hex"))
        .when(s.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
        .when(s.rlike("^[A-Za-z0-9]+$"), F.lit("alnum"))
        .when(shaped & blocked, F.lit("base64"))
        .when(s.rlike("^[\\x21-\\x7E]+$"), F.lit("printable"))
        .otherwise(F.lit("text"))
    )


def class_ceiling(klass: Column) -> Column:
    expr = F.lit(None).cast("double")
    for name, bits in CLASS_CEILING.items():
        expr = F.when(klass == name, F.lit(bits)).otherwise(expr)
    return expr


def keyspace_bits(s: Column, klass: Column) -> Column:
    per_char = F.when(klass == "text", F.log2(F.greatest(distinct_chars(s), F.lit(2)).cast("double"))).otherwise(
        class_ceiling(klass)
    )
    return F.when(F.char_length(s) == 0, F.lit(0.0)).otherwise(F.char_length(s) * per_char)


def normalized_entropy(entropy: Column, klass: Column) -> Column:
    return F.when(klass == "text", F.lit(1.0)).otherwise(entropy / class_ceiling(klass))


def max_run(s: Column) -> Column:
    """Longest run of one repeated character."""
    runs = F.regexp_extract_all(s, F.lit("(?s)((.)\\2*+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0))


def strength(bits: Column) -> Column:
    return (
        F.when(bits < WEAK_BITS, F.lit("weak")).when(bits < STRONG_BITS, F.lit("marginal")).otherwise(F.lit("strong"))
    )


def bytes_strength(n_bytes: Column) -> Column:
    return strength(n_bytes * 8)
