"""The corpus is scanned once and in time proportional to its length."""

import re
import time

from pyspark.sql import functions as F

from plumbline.plans import detect as D


def test_squeeze_looks_at_a_run_once(spark):
    """Runs just too short, long runs without a line break and mixed ones: same result, linear time."""
    texts = ["x" + " " * 309 + "y", "a" + " " * 700 + "b\n", "a\n" + (" " * 200 + "\n") * 9 + "  z", "\t" * 311, " " * 310 + "\n" + " " * 400 + "\n\n c", ""]

    def old(text):
        inner = re.sub("([ \\t]{310})[ \\t]+", r"\1", text)
        return re.sub(r"([ \t\n\x0b\f\r]{310})[ \t\n\x0b\f\r]*\n", "\\1\n", inner)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.squeeze(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [old(r.t) for r in got]
    # Each of these places used to look through the rest of the run.
    rows = spark.range(0, 20, 1, 1).select(F.concat(F.repeat(F.lit("\r"), 40_000), F.lit("x")).alias("t"))
    start = time.monotonic()
    assert rows.select(F.sum(F.length(D.squeeze(F.col("t"))))).first()[0] == 20 * 40_001
    assert time.monotonic() - start < 10
