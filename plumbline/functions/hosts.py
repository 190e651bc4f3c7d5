"""How generated a host name looks, 0..1, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.entropy import shannon_entropy

# Labels and suffixes that never count as the name of a host.
COMMON_LABELS = (
    "www app api mail smtp ftp cdn static assets auth login admin panel test staging dev beta "
    "shop blog news support help docs status img images media video download update ns1 ns2"
).split()
TLDS = (
    "com org net edu gov dev app io co me ai tr de uk fr nl eu xyz site online store tech cloud "
    "top info biz net.tr com.tr org.tr"
).split()
DGA_THRESHOLD = 0.65
EXPECTED_VOWELS = 0.38


def longest_label(host: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.lower(host)), "/.*$", ""), ":\\d+$", "")
    skipped = F.array(*[F.lit(x) for x in COMMON_LABELS + TLDS])
    labels = F.filter(
        F.split(clean, "\\."), lambda x: ~F.array_contains(skipped, x) & (F.char_length(x) >= 6)
    )
    # First of the longest, as a stable sort by length would give.
    size = F.array_max(F.transform(labels, lambda x: F.char_length(x)))
    return F.try_element_at(F.filter(labels, lambda x: F.char_length(x) == size), F.lit(1))


def dga_likeness(host: Column) -> Column:
    label = longest_label(host)
    letters = F.regexp_replace(label, "[^a-z]", "")
    n = F.char_length(letters)
    distinct = F.size(F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != "")))
    ratio = F.try_divide(shannon_entropy(letters), F.least(F.log2(F.lit(26.0)), F.log2(F.greatest(distinct, F.lit(1)).cast("double"))))
    spread = F.when(n < 12, F.lit(0)).when(ratio >= 0.92, F.lit(35)).when(ratio >= 0.85, F.lit(20)).otherwise(F.lit(0))
    vowels = F.char_length(F.regexp_replace(letters, "[^aeiou]", ""))
    drift = F.abs(F.try_divide(vowels, n) - F.lit(EXPECTED_VOWELS))
    drifted = F.when(drift >= 0.28, F.lit(30)).when(drift >= 0.2, F.lit(15)).otherwise(F.lit(0))
    runs = F.transform(F.split(letters, "[aeiou]"), lambda r: F.char_length(r))
    longest = F.array_max(runs)
    clumped = F.when(longest >= 6, F.lit(35)).when(longest >= 5, F.lit(20)).otherwise(F.lit(0))
    others = F.when((F.char_length(label) - n) / F.char_length(label) > 0.2, F.lit(10)).otherwise(F.lit(0))
    score = F.least(F.lit(100), spread + drifted + clumped + others) / F.lit(100.0)
    return F.when(label.isNull() | (n < 6), F.lit(0.0)).otherwise(score)
