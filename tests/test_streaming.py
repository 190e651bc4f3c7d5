"""Replays: what a stream says equals what the batch job says about the same beats."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit as A
from plumbline.plans import heartbeats
from plumbline.streaming import beats as B
from plumbline.streaming import incremental as I
from plumbline.workloads import seed

START = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    data = [(p, START + dt.timedelta(seconds=s), "good", 90, "") for p, s in rows]
    spark.createDataFrame(data, B.BEAT_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def replay(spark, path, tmp_path, name):
    stream = B.read_beats(spark, str(path), files_per_batch=1)
    B.run_available(B.deadman_alarms(stream), str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_cp"))
    return spark.read.schema(B.ALARM_SCHEMA).parquet(str(tmp_path / f"{name}_out"))


def test_deadman_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    src = tmp_path / "beats"
    rows, t = [], 0
    for _ in range(12):
        chunk = []
        for _ in range(25):
            t += rng.choice([60, 300, 900, 1500])
            chunk.append((f"p{rng.randint(0, 3)}", t))
        rows += chunk
        write(spark, src, chunk)
    rows.append(("clock", t + 50_000))
    write(spark, src, [rows[-1]])
    got = replay(spark, src, tmp_path, "a").collect()
    mark = START + dt.timedelta(seconds=t + 50_000 - 600)
    all_beats = spark.createDataFrame([(p, START + dt.timedelta(seconds=s)) for p, s in rows], "project string, ts timestamp")
    want = heartbeats.deadman(all_beats.where("project <> 'clock'"), F.lit(mark))
    silences = {(r.project, r.silent_from) for r in want.collect()}
    assert {(r.project, r.silent_from) for r in got if r.project != "clock"} == silences and silences
    alarms = {(r.project, r.alarm_ts) for r in heartbeats.alarm_dedup(want).collect()}
    assert {(r.project, r.silent_from) for r in got if r.raised and r.project != "clock"} == alarms


def test_late_beats_do_not_revive(spark, tmp_path):
    src = tmp_path / "late"
    write(spark, src, [("a", 0), ("b", 0)])
    write(spark, src, [("b", 9000)])
    write(spark, src, [("b", 9100)])
    write(spark, src, [("a", 2000), ("b", 9200)])
    got = replay(spark, src, tmp_path, "late").collect()
    a = [r for r in got if r.project == "a"]
    assert [r.silent_from for r in a] == [START + dt.timedelta(seconds=1800)]


def test_uptime_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "up"
    for i in range(4):
        write(spark, src, [("a", i * 400 + j * 40) for j in range(10)] + [("b", i * 400 + 7)])
    write(spark, src, [("clock", 50_000)])
    write(spark, src, [("clock", 50_001)])
    B.run_available(B.uptime(B.read_beats(spark, str(src), files_per_batch=1)), str(tmp_path / "up_out"), str(tmp_path / "up_cp"))
    key = lambda df: {(r.project, r.window_start, r.beats, r.last_ts, r.status) for r in df.where("project <> 'clock'").collect()}
    got = spark.read.parquet(str(tmp_path / "up_out"))
    assert key(got) == key(heartbeats.uptime_windows(spark.read.parquet(str(src))))


def test_breakage_stream_is_stateless(spark, tmp_path):
    src = tmp_path / "brk"
    data = [("a", START, "broken", 0, ""), ("b", START, "good", 5, ""), ("c", START, "good", 50, "")]
    spark.createDataFrame(data, B.BEAT_SCHEMA).write.parquet(str(src))
    B.run_available(B.breakage_alerts(B.read_beats(spark, str(src))), str(tmp_path / "brk_out"), str(tmp_path / "brk_cp"))
    assert {r.project for r in spark.read.parquet(str(tmp_path / "brk_out")).collect()} == {"a", "b"}


GROUPS = ("bad:int-generated-file-hand-edited", "bad:a07-jwt-weak-verification", "bad:int-contract-two-writers", "bad:a04-check-then-act-upsert")


def found(df):
    return {(r.project, r.rule_id, r.file, r.line, r.severity) for r in df.collect()}


def test_incremental_scan_equals_batch(spark, tmp_path):
    """Files of one project arrive in batches, change and go; cross-file rules see all of them."""
    rows = [
        (s.group, s.path.replace("{id}", "d7"), s.body.replace("{id}", "d7").replace("{prev}", "d7"), s.tracked, False)
        for s in seed.SEEDS
        if s.group in GROUPS
    ]
    extra = [(GROUPS[1], "src/lib/gone.ts", "export const o = { alg: 'none' };", True, False), ("whole", "a.py", "import json\ndef f(x):\n    return json.loads(x)", True, False)]
    gone = [(*r[:2], None, None, True) for r in extra]
    old = [(*r[:2], "export const nothing = 1;", *r[3:]) for r in rows[1::2]]
    src = tmp_path / "files"
    for part in (rows[::2] + extra, old + [(GROUPS[0], "never/there.ts", None, None, True)], rows[1::2] + gone):
        spark.createDataFrame(part, I.FILE_SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    out = str(tmp_path / "inc")
    I.incremental_audit(I.read_files(spark, str(src), 1), out, str(tmp_path / "inc_cp")).awaitTermination()
    got = found(I.current_findings(spark, out))
    batch, _ = A.static_findings(A.scan(spark.createDataFrame(rows, I.FILE_SCHEMA)))
    assert got == found(batch)
    assert any(r == "int-generated-file-hand-edited" for _, r, _, _, _ in got)
    assert I.current_facts(spark, out).where("project = 'whole'").count() == 0


def test_a_failed_rule_fails_the_batch(spark, tmp_path, monkeypatch):
    """A batch whose rule fails leaves no generation behind, where it once left findings without the rule."""

    def broken(*_):
        raise ValueError("this rule is broken")

    out = str(tmp_path / "failed")
    monkeypatch.setattr(A.X, "two_writers", broken)
    with pytest.raises(ValueError, match="this rule is broken"):
        I.upsert(spark.createDataFrame([("p", "a.py", "pass", True, False)], I.FILE_SCHEMA), 0, out)
    assert I.generations(spark, out) == {}


def test_a_bucket_is_a_file_and_not_one_of_each_task(spark, tmp_path):
    out = tmp_path / "files"
    rows = [(f"p{i}", "a.py", "import json\ndef f(x):\n    return json.loads(x)", True, False) for i in range(300)]
    I.upsert(spark.createDataFrame(rows, I.FILE_SCHEMA).repartition(12), 0, str(out))
    for table in ("facts", "findings"):
        held = [len(list(b.glob("*.parquet"))) for b in (out / table / "batch=0").glob("bucket=*")]
        assert len(held) == len(I.generations(spark, str(out))) and sum(held) <= 2 * len(held)


def test_a_batch_touches_its_own_buckets_and_may_run_twice(spark, tmp_path):
    out = str(tmp_path / "state")
    body = "import json\ndef f(x):\n    return json.loads(x)"
    first = [(f"p{i}", "a.py", body, True, False) for i in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, I.FILE_SCHEMA)
    I.upsert(frame(first), 0, out)
    before = I.generations(spark, out)
    I.upsert(frame([("p3", "b.py", body, True, False)]), 1, out)
    once = found(I.current_findings(spark, out))
    after = I.generations(spark, out)
    assert [b for b in after if after[b] != before[b]] == [b for b, g in after.items() if g == 1] and list(after.values()).count(1) == 1
    I.upsert(frame([("p3", "b.py", body, True, False)]), 1, out)
    assert found(I.current_findings(spark, out)) == once
    assert {(p, f) for p, r, f, _, _ in once if r == "a04-unguarded-json-parse"} == {(f"p{i}", "a.py") for i in range(12)} | {("p3", "b.py")}
    I.upsert(frame([("p3", "b.py", None, None, True), ("p3", "a.py", None, None, True)]), 2, out)
    assert "p3" not in {r[0] for r in found(I.current_findings(spark, out))}
    assert I.current_facts(spark, out).select("project").distinct().count() == 11
