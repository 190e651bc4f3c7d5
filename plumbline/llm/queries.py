"""Registered queries of this folder and their SQL twins where SQL can express them."""

from __future__ import annotations

from plumbline.llm import alignment, chat, decontaminate, exact, extraction, line_dedup, packing, quality_rules, resampling, sharding, simhash, suffixes, warc
from plumbline.llm.common import Query

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS n
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS span
  FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM item)
), doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM doc, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (n, span)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
        FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    "op1_suffixes": Query(suffixes.op1_suffixes),
    "op2_line_dedup": Query(line_dedup.op2_line_dedup),
    "op3_decontaminate": Query(decontaminate.op3_decontaminate, DECONTAMINATE),
    "op4_chat": Query(chat.op4_chat),
    "op5_warc": Query(warc.op5_warc),
    "op6_packing": Query(packing.op6_packing),
    "op7_simhash": Query(simhash.op7_simhash),
    "op8_extraction": Query(extraction.op8_extraction),
    "op9_sharding": Query(sharding.op9_sharding),
    "op10_quality_rules": Query(quality_rules.op10_quality_rules),
    "op11_exact": Query(exact.op11_exact, exact.SQL),
    "op12_alignment": Query(alignment.op12_alignment),
    "op13_resampling": Query(resampling.op13_resampling),
}
