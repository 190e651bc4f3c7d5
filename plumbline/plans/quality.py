"""How good the findings are: precision, recall, labels, regressions, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.joins import spread_join
from plumbline.operators.ordered import first_per_group



def precision_input(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") != "info")


def readable_projects(findings: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Drops projects that could not be read; list them with :func:`excluded_projects`."""
    return findings.join(unreadable.select("project").distinct(), "project", "left_anti")


def excluded_projects(projects: DataFrame, rules_run: DataFrame) -> DataFrame:
    """Registered projects no rule ran on."""
    return projects.select(F.col("name").alias("project")).join(
        rules_run.select("project").distinct(), "project", "left_anti"
    )


def rule_precision(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """tp, fp, unlabelled and precision per rule and overall (``rule_id`` null).

    Findings are first reduced to one row per (rule, fingerprint), so the join with
    the labels carries counts, not raw findings. Precision stays null without labels.
    """
    grouped = findings.groupBy("rule_id", "fingerprint").agg(F.count("*").alias("n"))
    judged = grouped.join(labels.select("fingerprint", "verdict"), "fingerprint", "left")
    tp = F.coalesce(F.sum(F.when(F.col("verdict") == "tp", F.col("n"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(F.col("verdict") == "fp", F.col("n"))), F.lit(0))
    other = ~F.coalesce(F.col("verdict").isin("tp", "fp"), F.lit(False))
    out = judged.rollup("rule_id").agg(
        tp.alias("tp"),
        fp.alias("fp"),
        F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("unlabeled"),
    )
    return out.withColumn(
        "precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    ).orderBy(F.coalesce(F.col("precision"), F.lit(2.0)), F.desc("unlabeled"))


def recall_hits(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries with ``hit``: some finding of the rule lies in a file that ends with the entry.

    Each found path is cut to the entry lengths that its rule has (path lengths, so a short
    list), and cut paths equal entries or not: one equality join, without a residual test
    that would compare all files with a common ending.
    """
    entries = manifest.withColumn("__wanted", T.posix(F.col("file")))
    found = findings.where(F.col("file").isNotNull()).select("rule_id", T.posix(F.col("file")).alias("__path")).distinct()
    keys = entries.select("rule_id", "__wanted").distinct()
    lengths = keys.groupBy("rule_id").agg(F.collect_set(F.char_length("__wanted")).alias("__lengths"))
    fitting = F.filter("__lengths", lambda n: n <= F.char_length("__path"))
    cut = (
        spread_join(found, lengths, ["rule_id"], spread_by=["__path"])
        .select("rule_id", "__path", F.explode(fitting).alias("__n"))
        .select("rule_id", F.expr("right(__path, __n)").alias("__wanted"))
        .distinct()
    )
    hits = keys.join(cut, ["rule_id", "__wanted"], "left_semi").withColumn("__hit", F.lit(True))
    return (
        entries.join(hits, ["rule_id", "__wanted"], "left")
        .withColumn("hit", F.coalesce("__hit", F.lit(False)))
        .select(*manifest.columns, "hit")
    )


def rule_recall(hits: DataFrame) -> DataFrame:
    """Worst rule first; the overall row has ``rule_id`` null."""
    out = hits.rollup("rule_id").agg(
        F.count("*").alias("total"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits")
    )
    return out.withColumn("recall", F.col("hits").cast("double") / F.col("total")).orderBy("recall", "rule_id")


def label_states(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and current findings side by side, one row per fingerprint.

    ``state``: added (new finding), kept (label still fires), stale (label no longer
    fires and is now marked), noted (already carries a note). Verdicts never change.
    """
    current = findings.groupBy("fingerprint").agg(
        F.min(F.struct("line", "rule_id", "file", "snippet", "title")).alias("f")
    )
    both = labels.alias("l").join(current.alias("c"), F.col("l.fingerprint") == F.col("c.fingerprint"), "full")
    seen = F.col("c.fingerprint").isNotNull()
    known = F.col("l.fingerprint").isNotNull()
    state = (
        F.when(~known, F.lit("added"))
        .when(seen, F.lit("kept"))
        .when(F.coalesce(F.col("l.note"), F.lit("")) != "stale", F.lit("stale"))
        .otherwise(F.lit("noted"))
    )
    shown = F.substring(F.coalesce(F.col("c.f.snippet"), F.col("c.f.title")), 1, 120)
    note = F.when(
        known & ~seen & (F.coalesce(F.col("l.note"), F.lit("")) == ""), F.lit("stale")
    ).otherwise(F.col("l.note"))
    return both.select(
        F.coalesce("l.fingerprint", "c.fingerprint").alias("fingerprint"),
        F.coalesce(F.col("l.verdict"), F.lit("?")).alias("verdict"),
        F.coalesce(F.col("l.rule"), F.col("c.f.rule_id")).alias("rule"),
        F.coalesce(F.col("l.file"), F.col("c.f.file"), F.lit(T.NO_FILE)).alias("file"),
        F.coalesce(F.col("l.line"), F.col("c.f.line"), F.lit(0)).alias("line"),
        F.coalesce(F.col("l.snippet"), shown).alias("snippet"),
        note.alias("note"),
        state.alias("state"),
        seen.alias("fires"),
    )


def sync_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    return label_states(findings, labels).drop("state", "fires")


def label_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("labels"))


def regressions(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that break the gate: lost-tp or returned-fp. Takes unfiltered findings."""
    current = findings.select("fingerprint").distinct().withColumn("__fires", F.lit(True))
    joined = labels.join(current, "fingerprint", "left")
    fires = F.coalesce(F.col("__fires"), F.lit(False))
    note = F.coalesce(F.col("note"), F.lit(""))
    # Words in a note that mark a label as resolved.
    resolved = F.lower(note).rlike("çözüldü|resolved|fixed|düzeltildi")
    reason = (
        F.when((F.col("verdict") == "tp") & resolved & fires, F.lit("lost-tp: returned hole"))
        .when((F.col("verdict") == "tp") & ~resolved & ~fires, F.lit("lost-tp"))
        .when((F.col("verdict") == "fp") & fires & note.contains("stale"), F.lit("returned-fp"))
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__fires")


def flatten_snapshot(findings: DataFrame) -> DataFrame:
    """One row per identity; of duplicates the last one (by ``ordinal``) wins."""
    identified = findings.withColumn(
        "identity",
        T.project_fingerprint(
            F.col("project"), F.col("rule_id"), F.col("file"), F.col("snippet"), F.col("line")
        ),
    )
    return first_per_group(identified, ["identity"], [F.desc("ordinal")])


def snapshot_diff(
    before: DataFrame, after: DataFrame, before_digests: DataFrame, after_digests: DataFrame
) -> DataFrame:
    """New and vanished findings; a vanished one in an identical file is suspicious.

    A missing digest on either side counts as a changed file, never as suspicious.
    """
    old, new = flatten_snapshot(before), flatten_snapshot(after)
    cols = ["project", "rule_id", "file", "line", "snippet", "severity"]
    added = new.join(old.select("identity"), "identity", "left_anti").select(
        "identity", *cols, F.lit("new").alias("change"), F.lit(None).cast("string").alias("reason")
    )
    gone = old.join(new.select("identity"), "identity", "left_anti")
    od = before_digests.select("project", "file", F.col("digest").alias("__old"))
    nd = after_digests.select("project", "file", F.col("digest").alias("__new"))
    reason = F.when(F.col("__old") == F.col("__new"), F.lit("file-identical")).otherwise(F.lit("file-changed"))
    vanished = (
        gone.join(od, ["project", "file"], "left")
        .join(nd, ["project", "file"], "left")
        .select("identity", *cols, F.lit("vanished").alias("change"), reason.alias("reason"))
    )
    return added.unionByName(vanished).withColumn(
        "suspicious", F.coalesce(F.col("reason") == "file-identical", F.lit(False))
    )
