"""The whole audit: files and side tables in, findings, gaps, scores and digests out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.plans import past, scoring
from plumbline.plans import rules as R
from plumbline.plans.dependencies import dependency_health
from plumbline.session import cut_lineage, store_by
from plumbline.sources import corpus


@dataclass
class Context:
    """What a custom rule may read: facts of the scan and what was joined from them."""

    files: DataFrame
    facts: DataFrame
    flags: DataFrame
    helpers: DataFrame
    calling: DataFrame
    projects: DataFrame | None


@dataclass
class Audit:
    findings: DataFrame
    gaps: DataFrame
    scores: DataFrame
    digests: DataFrame
    coverage: DataFrame
    notes: DataFrame
    flags: DataFrame
    context: Context | None = field(default=None, repr=False)


NOTE_SCHEMA = "rule_id string, note string"
CustomRule = Callable[[Context], DataFrame]


def scan(files: DataFrame, projects: DataFrame | None = None) -> Context:
    """One pass over the corpus; its facts are stored by kind and shared by all rules."""
    facts = store_by(D.scan_facts(files, extractors=X.extractors()), "kind")
    flags = cut_lineage(D.project_flags(facts))
    helpers = D.helper_names(facts)
    calling = cut_lineage(D.files_calling(facts, helpers))
    return Context(files, facts, flags, helpers, calling, projects)


def static_findings(
    ctx: Context, custom: Mapping[str, CustomRule] | None = None
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Findings of all rules. A built-in rule that fails ends the audit, since findings without
    it would look whole; a custom rule that fails becomes a note and the others go on."""
    parts = [D.clause_findings(ctx.facts, ctx.flags, ctx.calling), D.project_findings(ctx.flags)]
    notes: list[tuple[str, str]] = []
    for _, build in X.cross_rules(ctx.facts, ctx.flags, ctx.helpers, ctx.calling, ctx.projects):
        parts.append(build().select(*D.FINDING_COLUMNS))
    for name, rule in (custom or {}).items():
        try:
            # Run now, so that a failure at run time stays with this rule too.
            parts.append(cut_lineage(rule(ctx).select(*D.FINDING_COLUMNS)))
        except Exception as error:  # noqa: BLE001
            notes.append((name, f"rule failed: {str(error)[:200]}"))
    return reduce(DataFrame.unionByName, parts), notes


def target_findings(projects: DataFrame, seen: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Projects without a path or without files: a high finding, never an empty result.

    ``seen(project)`` has the projects with at least one file; ``existing(project)``
    those whose path exists.
    """
    named = projects.select(F.col("name").alias("project"), F.col("path").alias("__path"))
    bare = named.join(seen.select("project").distinct(), "project", "left_anti")
    if existing is None:
        there = bare.withColumn("__there", F.lit(True))
    else:
        there = bare.join(existing.select("project").distinct().withColumn("__there", F.lit(True)), "project", "left")
    rule = F.when(F.coalesce("__there", F.lit(False)), F.lit("int-scan-target-empty")).otherwise(
        F.lit("int-scan-target-missing")
    )
    return there.select(
        "project",
        rule.alias("rule_id"),
        F.lit("targets.json").alias("file"),
        F.lit(1).alias("line"),
        F.concat(F.lit("path: "), F.col("__path")).alias("snippet"),
        F.lit("high").alias("severity"),
        F.lit("certain").alias("confidence"),
        F.lit("").alias("note"),
    )


def dependency_findings(deps: DataFrame) -> DataFrame:
    health = dependency_health(deps)
    return health.select(
        "project",
        F.lit("a06-outdated-deps").alias("rule_id"),
        F.lit("package.json").alias("file"),
        F.lit(1).alias("line"),
        F.col("name").alias("snippet"),
        "severity",
        "confidence",
        F.col("reason").alias("note"),
    )


def with_rules(findings: DataFrame) -> DataFrame:
    """title, owasp and cwe from the rule table; that table is fixed and small."""
    dim = F.broadcast(R.rule_table(findings.sparkSession).select("rule_id", "title", "owasp", "cwe"))
    return findings.join(dim, "rule_id", "left")


def failed_gaps(names: DataFrame, notes: list[tuple[str, str]]) -> DataFrame:
    """A gap of every project for each rule that failed: it has not measured anything."""
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule_id"), F.lit(note).alias("reason")) for rule, note in notes])
    rows = names.select("project").distinct().select("project", F.explode(pairs).alias("n"))
    return rows.select("project", "n.rule_id", F.lit("rule").alias("requirement"), "n.reason")


def audit(
    files: DataFrame,
    projects: DataFrame | None = None,
    existing: DataFrame | None = None,
    commits: DataFrame | None = None,
    diff: DataFrame | None = None,
    deps: DataFrame | None = None,
    live: DataFrame | None = None,
    custom: Mapping[str, CustomRule] | None = None,
) -> Audit:
    spark: SparkSession = files.sparkSession
    ctx = scan(files, projects)
    found, notes = static_findings(ctx, custom)
    extra = []
    if commits is not None:
        extra.append(past.commit_message_findings(commits))
    if diff is not None:
        extra.append(past.history_secrets(diff))
    if deps is not None:
        extra.append(dependency_findings(deps))
    if live is not None:
        extra.append(live.select(*D.FINDING_COLUMNS))
    known = ctx.facts.select("project").distinct()
    if projects is not None:
        extra.append(target_findings(projects, known, existing))
    everything = reduce(DataFrame.unionByName, [found, *extra])
    seen = ctx.facts.where(F.col("kind") == "file").select("project", F.col("key").alias("path"), F.col("text").alias("digest"))
    names = known if projects is None else projects.select(F.col("name").alias("project"))
    gaps = cut_lineage(
        D.requirement_gaps(R.rule_table(spark), names, D.capabilities(ctx.flags, projects))
    )
    # A rule with an unmet requirement has not measured anything, so it cannot report.
    static_gaps = gaps.where(F.col("requirement") != "live").select("project", "rule_id")
    kept = cut_lineage(with_rules(everything.join(static_gaps, ["project", "rule_id"], "left_anti")))
    if notes:
        gaps = gaps.unionByName(failed_gaps(names, notes))
    counts = scoring.severity_counts(kept)
    all_counts = names.distinct().join(counts, "project", "left").na.fill(0)
    return Audit(
        findings=kept,
        gaps=gaps,
        scores=scoring.banded(all_counts, gaps),
        digests=corpus.digests_with_findings(seen, kept),
        coverage=corpus.corpus_coverage(seen),
        notes=spark.createDataFrame(notes, NOTE_SCHEMA),
        flags=ctx.flags,
        context=ctx,
    )
