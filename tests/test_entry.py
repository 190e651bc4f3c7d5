"""The driver contract, and a sample of queries next to their SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.workloads.registry import all_queries
from tools.check_oracle import canon

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "secret_findings", "severity_scorecard", "detector_precision", "detector_recall", "snapshot_diff", "regression_gate", "orphan_invariants",
    "token_entropy_profile", "deadman_batch", "alarm_dedup_batch", "link_rank", "response_findings", "added_lines", "detect_injection", "rule_path_traversal",
]


def test_every_query_has_a_twin():
    own = all_queries()
    assert {name for name in own if name not in entry.oracle_sql()} == set()
    assert set(own) <= set(entry.queries())
    assert len(own) > 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert canon(entry.queries()[name](spark, SF).toPandas()) == canon(con.execute(entry.oracle_sql()[name]).df())
