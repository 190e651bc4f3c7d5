"""Heartbeat monitoring over stored beats: batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import previous_value
from plumbline.session import cut_lineage

# Silence that raises an alarm, and the pause between two alarms.
SILENCE_SECONDS = 1800
ALARM_PAUSE_SECONDS = 6 * 3600
TLS_WARN_DAYS = 14
WINDOW = "5 minutes"


def slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def beat_edges(beats: DataFrame, silence_seconds: int = SILENCE_SECONDS) -> DataFrame:
    """First and last beat per (project, half silence period).

    Two beats further apart than the limit are never in one slot, and in different
    slots the gap runs from the last of one to the first of the next. So the slots
    carry every silence while a hot project shrinks to a few rows per hour.
    """
    return beats.groupBy("project", slot(F.col("ts"), max(silence_seconds // 2, 1)).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def deadman(beats: DataFrame, now: Column, silence_seconds: int = SILENCE_SECONDS) -> DataFrame:
    """Silences strictly longer than the limit, each with the beat that cleared it.

    The trailing silence up to ``now`` is open: ``cleared_at`` is null.
    """
    edges = beat_edges(beats.where(F.col("ts") < now), silence_seconds)
    day = F.floor(F.col("slot") / F.lit(max(86_400 // max(silence_seconds // 2, 1), 1)))
    linked = previous_value(edges, ["project"], ["slot"], "last_ts", day, "prev_ts")
    limit = F.expr(f"INTERVAL {silence_seconds} SECONDS")
    closed = linked.where(F.col("first_ts") > F.col("prev_ts") + limit).select(
        "project", F.col("prev_ts").alias("last_beat"), F.col("first_ts").alias("cleared_at")
    )
    still = (
        edges.groupBy("project")
        .agg(F.max("last_ts").alias("last_beat"))
        .where(now > F.col("last_beat") + limit)
        .select("project", "last_beat", F.lit(None).cast("timestamp").alias("cleared_at"))
    )
    return closed.unionByName(still).withColumn("silent_from", F.col("last_beat") + limit)


def next_alarm(silences: DataFrame, pause: int) -> DataFrame:
    """(project, at, next, run_start): for each silence the first one more than ``pause`` later.

    Times are whole microseconds. In slots of the pause's width that one lies in the next slot
    or is the first of a later one, and a silence begins a run if none in its own slot and the
    one before is less than a pause earlier. So a window sees the silences of one slot, or the
    slots of one project, of which there are four a day.
    """
    points = silences.select("project", "at", F.floor(F.col("at") / pause).alias("slot"))
    by_slot = Window.partitionBy("project").orderBy("slot")
    slots = points.groupBy("project", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    follows = F.lead("slot").over(by_slot) == F.col("slot") + 1
    slots = slots.select(
        "project",
        "slot",
        F.when(follows, F.lead("first", 2).over(by_slot)).otherwise(F.lead("first").over(by_slot)).alias("far"),
        F.when(F.lag("slot").over(by_slot) == F.col("slot") - 1, F.lag("last").over(by_slot)).alias("last_before"),
    )
    in_slot = Window.partitionBy("project", "slot").orderBy("at")
    before = F.coalesce(F.lag("at").over(in_slot), F.col("last_before"))
    known = points.join(slots, ["project", "slot"]).select(
        "project", "slot", "at", "far", (before.isNull() | (F.col("at") - before > pause)).alias("run_start")
    )
    probes = known.select("project", (F.col("slot") + 1).alias("slot"), (F.col("at") + pause).alias("at"), "far", "run_start", F.lit(None).cast("long").alias("point"))
    both = points.select("project", "slot", "at", F.col("at").alias("point")).unionByName(probes, allowMissingColumns=True)
    later = Window.partitionBy("project", "slot").orderBy("at", F.col("point").isNull()).rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("near", F.first("point", ignorenulls=True).over(later)).where("point is null")
    return near.select("project", (F.col("at") - pause).alias("at"), F.coalesce("near", "far").alias("next"), "run_start")


def alarm_dedup(silences: DataFrame, pause_seconds: int = ALARM_PAUSE_SECONDS) -> DataFrame:
    """Alarms left when a project may raise at most one per pause.

    Which alarm is raised depends on the one raised before, so alarms are a path: from each
    alarm to the first silence after its pause. A silence that follows a whole pause without
    one is an alarm whatever came before, so paths begin there and are short; they are walked
    by pointer doubling, in as many rounds as the longest of them has binary digits. All keys
    are single silences, so a project with very many of them is spread like any other.
    """
    pause = pause_seconds * 1_000_000
    times = silences.select("project", F.unix_micros("silent_from").alias("at")).distinct()
    links = cut_lineage(next_alarm(times, pause))
    raised = links.where("run_start").select("project", "at")
    # A step onto the beginning of another run adds nothing: that one has its own path.
    inside = links.where("not run_start").select("project", F.col("at").alias("next"))
    jumps = links.where("next is not null").select("project", "at", "next").join(inside, ["project", "next"], "left_semi")
    while True:
        fresh = cut_lineage(raised.join(jumps, ["project", "at"]).select("project", F.col("next").alias("at")))
        if fresh.isEmpty():
            return raised.select("project", F.timestamp_micros("at").alias("alarm_ts"))
        raised = raised.unionByName(fresh)
        further = jumps.select("project", F.col("at").alias("next"), F.col("next").alias("__to"))
        jumps = cut_lineage(jumps.join(further, ["project", "next"]).select("project", "at", F.col("__to").alias("next")))


def breakage(beats: DataFrame) -> DataFrame:
    """Beats that are a problem by themselves: not good, or certificate days in 1..13."""
    broken = F.col("status") != "good"
    expiring = F.col("ssl_days").between(1, TLS_WARN_DAYS - 1)
    return beats.where(broken | expiring).withColumn(
        "problem",
        F.when(broken & expiring, F.lit("broken+tls")).when(broken, F.lit("broken")).otherwise(F.lit("tls")),
    )


def uptime_windows(beats: DataFrame, window: str = WINDOW) -> DataFrame:
    """Tumbling windows per project; batch and streaming use the same expression."""
    grouped = beats.groupBy(F.window("ts", window).alias("w"), "project").agg(
        F.count("*").alias("beats"),
        F.sum(F.when(F.col("status") == "good", 0).otherwise(1)).alias("broken"),
        F.max("ts").alias("last_ts"),
    )
    return grouped.select(
        "project",
        F.col("w.start").alias("window_start"),
        "beats",
        "broken",
        "last_ts",
        F.when(F.col("broken") > 0, F.lit("broken")).otherwise(F.lit("good")).alias("status"),
    )


def last_status(beats: DataFrame, now: Column) -> DataFrame:
    """Latest beat per project with its age in whole minutes."""
    last = beats.groupBy("project").agg(F.max(F.struct("ts", "status", "ssl_days")).alias("b"))
    return last.select(
        "project",
        F.col("b.ts").alias("last_beat"),
        F.col("b.status").alias("beat_status"),
        F.col("b.ssl_days").alias("ssl_days"),
        F.floor((F.unix_micros(now) - F.unix_micros("b.ts")) / F.lit(60_000_000)).alias("age_minutes"),
    )
