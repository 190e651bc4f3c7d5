"""Structured Streaming jobs over heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.plans import heartbeats as H

BEAT_SCHEMA = "project string, ts timestamp, status string, ssl_days int, note string"
ALARM_SCHEMA = "project string, last_beat timestamp, silent_from timestamp, raised boolean"
STATE_SCHEMA = "last_us bigint, told_us bigint, alarm_us bigint, edges array<bigint>"
NONE = -(2**62)


def read_beats(spark: SparkSession, path: str, lateness: str = "10 minutes", files_per_batch: int = 100) -> DataFrame:
    """Beats as a stream with a fixed schema and a watermark on event time."""
    stream = (
        spark.readStream.schema(BEAT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format("parquet").load(path)
    )
    return stream.withWatermark("ts", lateness)


def _watch(silence_us: int, pause_us: int):
    slot_us = max(silence_us // 2, 1)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One project: keep unfinished slots, settle those the watermark has passed."""
        last, told, alarm, flat = state.get if state.exists else (NONE, NONE, NONE, [])
        slots = {flat[i] // slot_us: (flat[i], flat[i + 1]) for i in range(0, len(flat or []), 2)}
        mark = state.getCurrentWatermarkMs() * 1000
        # Only the edges of each slot are kept, never the rows, however hot the project is.
        for batch in batches:
            us = batch["ts"].astype("int64") // 1000 if batch["ts"].dtype == "datetime64[ns]" else batch[
                "ts"
            ].astype("datetime64[us]").astype("int64")
            us = us[us >= mark]
            for slot, group in us.groupby(us // slot_us):
                lo, hi = slots.get(slot, (2**62, NONE))
                slots[slot] = (min(lo, int(group.min())), max(hi, int(group.max())))
        rows = []

        def silence(since: int) -> None:
            nonlocal told, alarm
            if told == since:
                return
            told = since
            start = since + silence_us
            raised = alarm == NONE or start - alarm > pause_us
            if raised:
                alarm = start
            rows.append((key[0], since, start, raised))

        for slot in sorted(slots):
            lo, hi = slots[slot]
            if hi >= mark:
                break
            if last != NONE and lo - last > silence_us:
                silence(last)
            last = max(last, hi)
            del slots[slot]
        pending = min((lo for lo, _ in slots.values()), default=None)
        if last != NONE and mark > last + silence_us and (pending is None or pending > last + silence_us):
            silence(last)
        state.update((last, told, alarm, [v for s in sorted(slots) for v in slots[s]]))
        wake = [hi + 1000 for _, hi in slots.values()]
        if last != NONE and told != last:
            wake.append(last + silence_us + 1000)
        if wake:
            state.setTimeoutTimestamp(max(min(wake) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            out = pd.DataFrame(rows, columns=["project", "last_beat", "silent_from", "raised"])
            for c in ("last_beat", "silent_from"):
                out[c] = pd.to_datetime(out[c], unit="us")
            yield out

    return watch


def deadman_alarms(
    beats: DataFrame,
    silence_seconds: int = H.SILENCE_SECONDS,
    pause_seconds: int = H.ALARM_PAUSE_SECONDS,
) -> DataFrame:
    """Silences as they become certain, ``raised`` true for the ones that may alarm.

    A silence is certain once the watermark has passed it, or a later beat shows the
    gap. Beats older than the watermark are dropped and cannot revive a project. A
    project with no more input is noticed when other projects move the watermark.
    """
    watch = _watch(silence_seconds * 1_000_000, pause_seconds * 1_000_000)
    return (
        beats.select("project", "ts")
        .groupBy("project")
        .applyInPandasWithState(
            watch, ALARM_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def breakage_alerts(beats: DataFrame) -> DataFrame:
    return H.breakage(beats)


def uptime(beats: DataFrame, window: str = H.WINDOW) -> DataFrame:
    return H.uptime_windows(beats, window)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there, write parquet, stop."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
