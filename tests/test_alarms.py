"""Alarms with a pause, against walking through the silences one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import heartbeats

START = dt.datetime(2024, 1, 1)
PAUSE = 6 * 3600


def walk(times):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] > PAUSE:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(6):
        t = rng.randrange(10**6)
        for _ in range(rng.randrange(1, 120)):
            t += rng.choice([0, 1, 1800, 3600, PAUSE - 1, PAUSE, PAUSE + 1, 2 * PAUSE, 5 * 86400][: 3 + p])
            rows.append((f"p{p}", t))
    frame = spark.createDataFrame([(p, START + dt.timedelta(seconds=t)) for p, t in rows], "project string, silent_from timestamp")
    got = sorted((r.project, r.alarm_ts) for r in heartbeats.alarm_dedup(frame).collect())
    want = sorted((p, START + dt.timedelta(seconds=t)) for p in {p for p, _ in rows} for t in walk([t for q, t in rows if q == p]))
    assert got == want


def test_no_silences(spark):
    assert heartbeats.alarm_dedup(spark.createDataFrame([], "project string, silent_from timestamp")).count() == 0


def test_one_project_with_a_million_silences(spark):
    """One every half hour without a longer pause: every thirteenth is an alarm."""
    n = 1_000_000
    frame = spark.range(n).select(F.lit("hot").alias("project"), F.timestamp_seconds(F.col("id") * 1800).alias("silent_from"))
    out = heartbeats.alarm_dedup(frame)
    step = PAUSE // 1800 + 1
    got = out.agg(F.count("*"), F.min("alarm_ts"), F.sum((F.unix_seconds("alarm_ts") % (step * 1800) != 0).cast("int"))).first()
    assert got[0] == -(-n // step) and got[2] == 0
