"""Link suggestions: for each page the pages of its host that are most like it and not linked yet.

Words of a page weigh what they tell apart in its host, floor(1000 * ln(pages / pages with the
word)); words that all pages have weigh nothing. Two pages are alike by the weight of the words
they share over the weight of all their words. Each page gets the best ``k``.

The pages of a host are dealt into blocks, and a pair of blocks is a tile. A tile scores its
pages against each other as matrices and keeps the best ``k`` of each page; those are ranked
over all tiles of the page.

* Words are numbered for each host once. Words of one page count for its weight only.
* In a tile, words that many of its pages have are one product of two matrices, the others
  are summed along their postings; how words are divided changes the cost, not the result.
* A block has at most ``BLOCK`` pages and about ``CELLS`` words, and sums are taken for some
  pages at a time, so memory is bounded. Hosts of one block share tiles, since their words
  have different numbers.

The work is quadratic in the pages of a host, spread over its tiles; rows out are at most k for
each page and tile.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import page_links
from plumbline.operators.joins import spread_join
from plumbline.session import cut_lineage, ship

TOP = 3
#: Most pages of a block, pages of a block while a host has fewer than eight such blocks, most words of a block.
BLOCK, LEAST, CELLS = 8192, 512, 3_000_000
#: Words that a larger share of a tile's pages has go by matrix product. It changes the cost, not the result.
DENSE = 0.07
#: Words of a tile with fewer pages than this go by postings.
FEW = 32
#: Sums taken at a time.
AT_ONCE = 4_000_000
#: Words of a host that are looked up first where suggestions are only counted. It changes the cost, not the result.
WITNESSES = 64

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/')"


def plain_text(html: Column) -> Column:
    """Text outside scripts, styles, navigation and markup, white space as one blank."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</(script|style|nav)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def page_texts(pages: DataFrame) -> DataFrame:
    """host, node, text of each page; stored.

    A page is its host and path; of several rows for one page the smallest markup counts. The
    number of partitions is given, since a small table would else become few tasks here.
    """
    page = pages.select(F.expr(_HOST).alias("host"), F.expr(f"concat({_HOST}, {_PATH})").alias("node"), F.coalesce("html", F.lit("")).alias("html"))
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    markup = page.repartition(n, "host", "node").groupBy("host", "node").agg(F.min("html").alias("html"))
    return cut_lineage(markup.select("host", "node", plain_text(F.col("html")).alias("text")))


def _found() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))


def _words_of(texts: DataFrame) -> DataFrame:
    return texts.select("host", "node", F.explode(_found()).alias("word"))


def _weighed(texts: DataFrame) -> DataFrame:
    """host, word, df (pages with the word), w of each word of a host."""
    total = texts.groupBy("host").agg(F.count("*").alias("n"))
    common = _words_of(texts).groupBy("host", "word").agg(F.count("*").alias("df"))
    return spread_join(common, total, ["host"], spread_by=["word"]).select("host", "word", "df", F.floor(1000 * F.log(F.col("n") / F.col("df"))).cast("long").alias("w"))


def page_words(pages: DataFrame) -> DataFrame:
    """node, host, text, weight, words (heaviest first), ids and ws (words of several pages) of each page; stored."""
    texts = page_texts(pages)
    words = _words_of(texts)
    weighed = _weighed(texts).select("host", "word", "w", F.when(F.col("df") > 1, F.monotonically_increasing_id()).alias("id"))
    rows = spread_join(words, cut_lineage(weighed.where("w > 0")), ["host", "word"], spread_by=["node"])
    shared = F.when(F.col("id").isNotNull(), F.struct("id", "w"))
    listed = rows.groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "word"))), lambda x: x["word"]).alias("words"),
        F.collect_list(shared).alias("__shared"),
        F.sum("w").alias("weight"),
    )
    return cut_lineage(texts.join(listed.withColumns({"ids": F.col("__shared.id"), "ws": F.col("__shared.w")}).drop("__shared"), "node"))


def _placed(words: DataFrame) -> DataFrame:
    """host, node, place, block, blocks, weight, ids, ws: a host of several blocks is a place of its own."""
    sized = words.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("cells")).where("n > 1")
    pages = F.least(F.greatest(F.ceil(F.col("n") / 8), F.lit(LEAST)), F.lit(BLOCK))
    blocks = F.greatest(F.ceil(F.col("n") / pages), F.ceil(F.col("cells") / CELLS)).cast("int")
    sized = cut_lineage(sized.select("host", "n", blocks.alias("blocks")))
    bins = sized.where("blocks = 1").agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / LEAST) + 1).scalar()
    dealt = spread_join(words.where(F.size("ids") > 0), sized, ["host"], spread_by=["node"])
    place = F.when(F.col("blocks") > 1, F.concat(F.lit("host "), "host")).otherwise(F.concat(F.lit("bin "), F.pmod(F.xxhash64("host"), bins).cast("string")))
    return dealt.select("host", "node", place.alias("place"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "weight", "ids", "ws")


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns) of the k largest of each row, ties to the smaller column; empties ``sims`` of them."""
    at = np.arange(len(sims))
    values, columns = np.zeros((k, len(sims))), np.zeros((k, len(sims)), np.int64)
    for i in range(k):
        columns[i] = sims.argmax(1)
        values[i] = sims[at, columns[i]]
        sims[at, columns[i]] = 0
    return values, columns


def _tile(k: int, few: int, share: float = DENSE, at_once: int = AT_ONCE) -> Callable[[pa.Table], pa.Table]:
    """The best ``k`` of each page of a block among those of the other, in both directions."""

    def sort(rows: pa.Table) -> tuple:
        rows = rows.sort_by("node")
        ids, ws = rows["ids"].combine_chunks(), rows["ws"].combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        return rows["node"].to_pylist(), rows["weight"].to_numpy().astype(float), np.repeat(np.arange(len(sizes)), sizes), ids.flatten().to_numpy(), ws.flatten().to_numpy()

    def links(rows: pa.Table, here: dict, there: dict) -> np.ndarray:
        pairs = [(here[a], there[b]) for a, b in zip(rows["node"].to_pylist(), rows["other"].to_pylist(), strict=True) if a in here and b in there]
        return np.array(sorted(pairs), np.int64).reshape(-1, 2)

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        one, two = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        within = len(two) == 0 and bool(table["same"][0].as_py())
        s_names, s_weight, s_row, s_id, s_w = sort(one)
        t_names, t_weight, t_row, t_id, _ = (s_names, s_weight, s_row, s_id, s_w) if within else sort(two)
        n, m = len(s_names), len(t_names)
        out: list[list] = [[], [], [], []]
        if n and m:
            known, s_id = np.unique(s_id, return_inverse=True)
            at = np.searchsorted(known, t_id).clip(0, max(len(known) - 1, 0))
            both = known[at] == t_id if len(known) else np.zeros(len(t_id), bool)
            t_row, t_id = t_row[both], at[both]
            order = np.argsort(t_id, kind="stable")
            t_row, t_id = t_row[order], t_id[order]
            held = np.bincount(t_id, minlength=len(known))
            first = np.concatenate([[0], np.cumsum(held)])
            weigh = np.zeros(len(known))
            weigh[s_id] = s_w
            # Whole numbers below 2^24 are exact in single precision.
            dense = np.flatnonzero(held >= max(few, share * m))
            exact = np.float32 if weigh[dense].sum() < 2**24 else np.float64
            column = np.full(len(known), -1)
            column[dense] = np.arange(len(dense))
            right = np.zeros((len(dense), m), exact)
            in_dense = column[t_id] >= 0
            right[column[t_id[in_dense]], t_row[in_dense]] = weigh[t_id[in_dense]]
            # Some pages at a time, by the number of their sums.
            steps = np.where(column[s_id] >= 0, 0, held[s_id])
            load = np.cumsum(np.bincount(s_row, weights=steps, minlength=n) + m)
            edges = table.filter(pa.array(side == 2))
            here, there = {x: i for i, x in enumerate(s_names)}, {x: i for i, x in enumerate(t_names)}
            forth = links(edges, here, there)
            back = links(edges, there, here)
            best = (np.zeros((0, m)), np.zeros((0, m), np.int64))
            start = 0
            while start < n:
                stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + at_once, "right")))
                a, b = np.searchsorted(s_row, [start, stop])
                rows, ids, times = s_row[a:b] - start, s_id[a:b], steps[a:b]
                total = int(times.sum())
                places = np.repeat(first[ids] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total) if total else np.zeros(0, np.int64)
                keys = np.repeat(rows * m, times) + t_row[places]
                score = np.bincount(keys, np.repeat(weigh[ids], times), (stop - start) * m).reshape(-1, m).astype(float, copy=False)
                if len(dense):
                    left = np.zeros((stop - start, len(dense)), exact)
                    some = column[ids] >= 0
                    left[rows[some], column[ids[some]]] = 1
                    score += left @ right
                sims = score / (s_weight[start:stop, None] + t_weight - score)
                if within:
                    sims[np.arange(stop - start), np.arange(start, stop)] = 0
                else:
                    mine = sims.T.copy()
                    near = back[(back[:, 1] >= start) & (back[:, 1] < stop)]
                    mine[near[:, 0], near[:, 1] - start] = 0
                    found, which = _top(mine, min(k, stop - start))
                    found, which = np.concatenate([best[0], found]), np.concatenate([best[1], which + start])
                    take = np.argsort(-found, axis=0, kind="stable")[:k]
                    best = np.take_along_axis(found, take, 0), np.take_along_axis(which, take, 0)
                a, b = np.searchsorted(forth[:, 0], [start, stop])
                sims[forth[a:b, 0] - start, forth[a:b, 1]] = 0
                found, which = _top(sims, min(k, m))
                i, j = np.nonzero(found > 0)
                values, columns = found[i, j], which[i, j]
                out[0] += [s_names[x] for x in j + start]
                out[1] += [t_names[x] for x in columns]
                out[2].append(score[j, columns].astype(np.int64))
                out[3].append(values)
                start = stop
            if not within:
                i, j = np.nonzero(best[0] > 0)
                values, rows = best[0][i, j], best[1][i, j]
                out[0] += [t_names[x] for x in j]
                out[1] += [s_names[x] for x in rows]
                # similarity = score / (all - score), solved for the whole number
                out[2].append(np.rint(values * (t_weight[j] + s_weight[rows]) / (1 + values)).astype(np.int64))
                out[3].append(values)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out[2:]]
        return pa.table({"source": pa.array(out[0], pa.string()), "target": pa.array(out[1], pa.string()), "score": pa.array(flat[0], pa.int64()), "similarity": pa.array(flat[1], pa.float64())})

    return run


class _Site(NamedTuple):
    placed: DataFrame
    linked: DataFrame
    k: int


def _scored(pairs: DataFrame, site: _Site) -> DataFrame:
    """source, target, score, similarity: the best ``k`` of each page in each pair of blocks (place, one, two)."""
    placed, linked, k = site
    ship(pairs.sparkSession)
    n = min(max(pairs.count(), 1), 4096)
    tile = F.struct("place", "one", "two").alias("tile")
    same = (F.col("one") == F.col("two")).alias("same")
    page = placed.select("place", "block", "node", "weight", "ids", "ws")
    none = [F.lit(None).cast("string").alias("other")]
    sides = [
        page.join(pairs.where("one <> two" if side else "true").withColumn("block", F.col(name)), ["place", "block"]).select(tile, same, F.lit(side).alias("side"), "node", *none, "weight", "ids", "ws")
        for side, name in enumerate(("one", "two"))
    ]
    end = lambda name, block: placed.select(F.col("node").alias(name), F.col("place").alias(f"{name}_place"), F.col("block").alias(block))
    edges = linked.join(end("src", "__a"), "src").join(end("dst", "__b"), "dst").where("src_place = dst_place").select(
        F.col("src_place").alias("place"), F.least("__a", "__b").alias("one"), F.greatest("__a", "__b").alias("two"), F.col("src").alias("node"), F.col("dst").alias("other")
    )
    gone = edges.select(tile, same, F.lit(2).alias("side"), "node", "other", F.lit(None).cast("long").alias("weight"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<long>").alias("ws"))
    rows = sides[0].unionByName(sides[1]).unionByName(gone).withColumn("tile", F.concat_ws(" ", "tile.place", "tile.one", "tile.two"))
    return rows.repartition(n, "tile").groupBy("tile").applyInArrow(_tile(k, FEW), "source string, target string, score long, similarity double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pages(words: DataFrame, linked: DataFrame, k: int = TOP) -> DataFrame:
    """source, target, score, similarity, rank: the best ``k`` targets of each page without a link."""
    placed = cut_lineage(_placed(words))
    blocks = placed.select("place", "blocks").distinct().where("blocks > 0")
    one = blocks.select("place", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"))
    pairs = cut_lineage(one.select("place", "one", F.explode(F.sequence(F.col("one"), F.col("blocks") - 1)).alias("two")))
    return _best(_scored(pairs, _Site(placed, linked, k)), k)


def suggestion_counts(pages: DataFrame, edges: DataFrame, k: int = TOP) -> DataFrame:
    """source, n: how many suggestions ``link_suggestions`` makes for each page that gets any.

    Every page that shares a word of some weight and is not linked can be suggested, so no pair
    has to be scored for the number. A word of ``df`` pages settles a page of fewer than
    ``df - k`` links: it gets ``k``. The ``WITNESSES`` words of a host that most pages have
    settle nearly all, all words of the others come next. What is left has only words of few
    pages, at most ``k`` more than its links; their pages are listed and counted.
    """
    texts = page_texts(pages)
    weighed = cut_lineage(_weighed(texts).where("w > 0 AND df > 1").select("host", "word", "df"))
    links = edges.join(texts.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("links"))
    enough = F.col("most") > F.coalesce("links", F.lit(0)) + k
    front = weighed.withColumn("__at", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("df"), "word"))).where(F.col("__at") <= WITNESSES)
    witnesses = front.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("dfs"))
    most = F.array_max(F.transform(F.array_intersect(_found(), F.map_keys("dfs")), lambda x: F.col("dfs")[x]))
    seen = spread_join(texts, witnesses, ["host"], spread_by=["node"]).select("node", most.alias("most"))
    first = cut_lineage(seen.join(links, "node", "left").select("node", F.coalesce(enough, F.lit(False)).alias("enough")))
    settled = first.where("enough").select("node")
    # Pages of hosts without such words are not in ``first``; they get none.
    rest = texts.join(first.where("NOT enough"), "node", "left_semi")
    # Few pages against many words: salting would repeat the larger side.
    held = cut_lineage(_words_of(rest).join(weighed, ["host", "word"]))
    second = cut_lineage(held.groupBy("node").agg(F.max("df").alias("most")).join(links, "node", "left").select("node", enough.alias("enough")))
    settled = settled.unionByName(second.where("enough").select("node"))
    out = settled.select(F.col("node").alias("source"), F.lit(k).cast("long").alias("n"))
    mine = held.join(second.where("NOT enough"), "node", "left_semi").select("host", "word", "node")
    asked = cut_lineage(mine.select("host", "word").distinct())
    if asked.isEmpty():
        return out
    others = spread_join(_words_of(texts), asked, ["host", "word"], spread_by=["node"]).withColumnRenamed("node", "other")
    pairs = mine.join(others, ["host", "word"]).where("node <> other").select("node", "other").distinct()
    free = pairs.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("other")), ["node", "other"], "left_anti")
    return out.unionByName(free.groupBy(F.col("node").alias("source")).agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("n")))


def link_suggestions(pages: DataFrame, k: int = TOP) -> DataFrame:
    """source, target, sentence, anchor, score, similarity, rank.

    The anchor is the heaviest word both pages have, the sentence the first of the source
    with that word.
    """
    words = page_words(pages)
    _, edges = page_links(pages)
    best = cut_lineage(similar_pages(words, edges, k))
    source = words.select(F.col("node").alias("source"), "text", F.col("words").alias("mine"))
    target = words.select(F.col("node").alias("target"), F.col("words").alias("theirs"))
    both = best.join(source, "source").join(target, "target")
    # Words are in order of weight, and the intersection keeps it.
    anchor = F.try_element_at(F.array_intersect("mine", "theirs"), F.lit(1))
    placed = both.withColumn("anchor", anchor).withColumn("__in", F.split("text", r"[.!?] "))
    has = lambda s: F.array_contains(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}{4,}"), F.lit(0)), F.col("anchor"))
    sentence = F.trim(F.try_element_at(F.filter("__in", has), F.lit(1)))
    return placed.select("source", "target", sentence.alias("sentence"), "anchor", "score", "similarity", "rank")
