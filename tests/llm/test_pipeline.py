"""The stages in a row, each on what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from plumbline.llm import common as C
from plumbline.llm import decontaminate, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_stages(spark, shared_folder):
    docs = C.table(spark, SF, "documents")
    kept = {"quality_rules": {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = C.store(stage(spark, docs, SF))
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name in kept:
            assert {r.doc_id for r in after.select("doc_id").collect()} == kept[name]
        counts.append(after.count())
        docs = after
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    assert decontaminate.decontaminate(docs, C.table(spark, SF, "benchmark")).where("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names
