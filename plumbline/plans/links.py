"""Link health of a set of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import page_links, page_rank


def link_health(pages: DataFrame, rounds: int = 10) -> DataFrame:
    """Pages and link targets with rank, in-links and orphan flag."""
    nodes, edges = page_links(pages)
    return page_rank(nodes, edges, rounds)


def link_summary(ranks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row: pages, orphans and number of link suggestions; ``counts`` has n of each page."""
    counted = ranks.agg(
        F.count("*").alias("pages"), F.sum(F.col("orphan").cast("long")).alias("orphans"), F.max("pagerank").alias("top_rank")
    )
    made = F.lit(0) if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return counted.withColumn("suggestions", made.cast("long"))


def top_pages(ranks: DataFrame, k: int = 3) -> DataFrame:
    """The report's feature is the short list, hence the limit."""
    return ranks.orderBy(F.desc("pagerank"), "url").limit(k)


def orphan_pages(ranks: DataFrame) -> DataFrame:
    return ranks.where("orphan")
