"""Link graph and redirect chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

DAMPING = 0.85


def page_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, distinct edges): a page is its host and path, edges are links inside a host.

    Links given by path or by full address count; query and fragment do not. Both tables
    are stored, so the markup is parsed once.
    """
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1))
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))
    hrefs = F.regexp_extract_all("html", F.lit('href="((?:https?://[^"/?#]+)?/[^"#?]*)'), F.lit(1))
    linked = pages.select(host.alias("host"), path.alias("path"), F.explode(hrefs).alias("href")).where(~F.col("href").startswith("//"))
    target = F.regexp_replace("href", "^https?://", "")
    full = F.col("href").rlike("^https?://")
    same = F.lower(F.substring_index(target, "/", 1)) == F.col("host")
    tail = F.concat(F.lit("/"), F.substring(target, F.instr(target, "/") + 1, F.length(target)))
    edges = cut_lineage(
        linked.where(~full | same)
        .select(F.concat("host", "path").alias("src"), F.concat("host", F.when(full, tail).otherwise(F.col("href"))).alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
    own = pages.select(F.concat(host, path).alias("url"))
    return cut_lineage(own.unionByName(edges.select(F.col("dst").alias("url"))).distinct()), edges


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Rank, in-links and orphan flag per node; damping 0.85, dangling mass spread evenly.

    Out-degrees join once. Each round joins ranks to edges on the source and sums per
    target with partial aggregation, so a popular target shrinks before the shuffle.
    Both sides of the join are as large as the graph, so nothing is replicated by
    hand: a source with very many links is split by adaptive skew handling.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("url", F.lit(0.0).alias("pagerank"), F.lit(0).cast("long").alias("in_links"), F.lit(True).alias("orphan"))
    degree = edges.groupBy("src").agg(F.count("*").alias("__deg"))
    weighted = cut_lineage(edges.join(degree, "src"))
    node_deg = cut_lineage(
        nodes.join(degree.withColumnRenamed("src", "url"), "url", "left").select("url", F.col("__deg").isNull().alias("dangling"))
    )
    ranks = node_deg.select("url", "dangling", F.lit(1.0 / n).alias("pagerank"))
    for _ in range(rounds):
        sent = (
            weighted.join(ranks.select(F.col("url").alias("src"), "pagerank"), "src")
            .groupBy(F.col("dst").alias("url"))
            .agg(F.sum(F.col("pagerank") / F.col("__deg")).alias("__in"))
        )
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0)).alias("v")).scalar()
        ranks = (
            node_deg.join(sent, "url", "left").select(
                "url",
                "dangling",
                (
                    F.lit((1.0 - DAMPING) / n)
                    + F.lit(DAMPING) * (F.coalesce("__in", F.lit(0.0)) + lost / F.lit(float(n)))
                ).alias("pagerank"),
            )
        )
        # Both the sum and the next join read the ranks, so each round is stored once.
        ranks = cut_lineage(ranks)
    in_links = edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("in_links"))
    return ranks.join(in_links, "url", "left").select(
        "url",
        "pagerank",
        F.coalesce("in_links", F.lit(0)).cast("long").alias("in_links"),
        F.col("in_links").isNull().alias("orphan"),
    )


def redirect_chain(starts: DataFrame, hops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Follow redirects from each start url to the end, or to the first repeat.

    ``starts(keys..., url)``, ``hops(keys..., url, location)`` with one location per
    url. Adds ``hops`` and the visited urls; four or more hops is a long chain. Chains
    that have ended leave the loop, so later rounds shuffle only what still moves.
    """
    keys = keys or []
    moving = starts.select(
        *keys,
        F.col("url").alias("start"),
        F.col("url").alias("final"),
        F.array().cast("array<string>").alias("visited"),
        F.lit(0).alias("hops"),
    )
    step = cut_lineage(hops.select(*keys, F.col("url").alias("final"), F.col("location").alias("__next")))
    ended = None
    while True:
        # Many chains may meet in one url; that join key is split by adaptive skew handling.
        goes = F.col("__next").isNotNull() & ~F.array_contains("visited", F.col("__next"))
        moved = cut_lineage(moving.join(step, [*keys, "final"], "left").withColumn("__goes", F.coalesce(goes, F.lit(False))))
        rest = moved.where(~F.col("__goes")).select(*keys, "start", "final", "hops", "visited")
        ended = rest if ended is None else ended.unionByName(rest)
        on = moved.where("__goes")
        if on.isEmpty():
            return ended.withColumn("long", F.col("hops") >= 4)
        moving = on.select(
            *keys, "start", F.col("__next").alias("final"), F.array_append("visited", F.col("__next")).alias("visited"), (F.col("hops") + 1).alias("hops")
        )


# Definitions: functions by name, and constants that hold a function or a wrapped one.
DEFINITION = r"(?:\bfunction|\bconst)\s+\w+(?:\s*=\s*(?:async\s*)?\w*\s*\(|\s*\()"
