import hashlib
import random
import string

from plumbline.llm import exact
from pyspark.sql import functions as F


def lowered(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")


def brute(rows):
    by_text = {}
    for key, text in rows:
        by_text.setdefault(lowered(text), []).append(key)
    out = []
    for key, text in rows:
        same = by_text[lowered(text)]
        keep = max((k for k in same if k is not None), default=None)
        out.append((key, keep, len(same), hashlib.sha256(lowered(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()]


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    result = exact.exact_duplicates(docs).cache()
    assert sorted(found(result), key=repr) == brute(rows)
    kept = result.where("kept").groupBy("text_sha256").count()
    assert kept.where("count > 1").count() == 0
    assert kept.count() == len({lowered(t) for _, t in rows})
    assert result.where("kept and not (doc_id <=> keep_id)").count() == 0


def test_no_rows_and_clashing_names(spark, no_docs):
    assert exact.exact_duplicates(no_docs).count() == 0
    odd = spark.createDataFrame([(1, "A b", 7, "x", 3), (2, "a B", 8, "y", 4)], "doc_id long, text string, recipe int, key string, salt int")
    assert [(r.doc_id, r.keep_id, r.kept) for r in exact.exact_duplicates(odd).orderBy("doc_id").collect()] == [(1, 2, False), (2, 2, True)]


def test_one_group_holds_most_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Same text " * 300)).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    result = exact.exact_duplicates(rows)
    assert result.where("kept").count() == 1 + 1667
    assert result.where("group_size > 1").select("keep_id", "group_size").distinct().collect() == [(4999, 3333)]


def test_chunks_are_cut_by_content(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices(string.ascii_letters, k=rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(words)
    changed = " ".join([*words[:2000], "inserted", *words[2000:]])
    made = spark.createDataFrame([(text,), (text.swapcase(),), (changed,), ("é" * 10000,)], "text string").select(exact.chunks(F.col("text")).alias("c")).collect()
    one, other, more, plain = (r.c for r in made)
    assert "".join(one) == lowered(text) and one == [lowered(c) for c in one]
    assert [len(c) for c in other] == [len(c) for c in one]
    assert len(set(more) - set(one)) <= 3 < len(one)
    assert all(exact.LEAST <= len(c) <= exact.MOST for c in one[:-1])
    assert [len(c) for c in plain] == [4096, 4096, 1808]


def test_identifiers_are_verified(docs):
    weak = exact.groups(exact.recipes(docs, width=1, bits=4))
    strong = exact.groups(exact.recipes(docs))
    columns = ["key", "keep_id", "group_size", "text_sha256"]
    assert sorted(weak.select(*columns).collect(), key=repr) == sorted(strong.select(*columns).collect(), key=repr)


def test_dictionary_counts_uses(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "ABC"), (3, "x"), (4, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.uses, r.n_documents) for r in exact.shared_chunks(docs).collect()) == [(1, 1, 1), (3, 2, 2)]
