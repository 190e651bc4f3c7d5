"""Token and host profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import entropy as E
from plumbline.functions import hosts as H

TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"


def candidate_tokens(documents: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Distinct token values per group with their number of uses."""
    tokens = documents.select(by, F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token"))
    return tokens.groupBy(by, "token").agg(F.count("*").alias("uses"))


def token_profile(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Entropy profile of each token; run it on distinct tokens."""
    t = F.col(column)
    base = tokens.select(
        "*",
        F.char_length(t).alias("length"),
        E.distinct_chars(t).alias("distinct_chars"),
        E.shannon_entropy(t).alias("entropy"),
        E.char_class(t).alias("klass"),
        E.max_run(t).alias("max_run"),
    )
    bits = E.keyspace_bits(t, F.col("klass"))
    return base.select(
        "*",
        E.normalized_entropy(F.col("entropy"), F.col("klass")).alias("normalized"),
        bits.alias("keyspace_bits"),
        E.strength(bits).alias("strength"),
    )


def strength_histogram(profile: DataFrame, by: str = "source") -> DataFrame:
    return profile.groupBy(by, "klass", "strength").agg(
        F.count("*").alias("tokens"), F.sum("uses").alias("uses")
    )


def host_profile(pages: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts with their pages and how generated their name looks."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    hosts = pages.select(host.alias("host")).where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("pages")
    )
    score = H.dga_likeness(F.col("host"))
    return hosts.select("host", "pages", score.alias("likeness"), (score >= H.DGA_THRESHOLD).alias("flagged"))
