"""Standards profile: 28 checks per project with status and penalties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalty of an open check by level.
PENALTY = {"critical": 25, "warning": 10, "info": 3}


@dataclass(frozen=True)
class Check:
    check_id: str
    category: str
    level: str
    # Flag names that make the check apply; empty means always.
    applies: tuple[str, ...] = ()
    # Ordered (condition, status, level or None); the first that holds decides.
    ladder: tuple[tuple[str, str, str | None], ...] = ()
    rule_id: str | None = None
    manual: bool = False


def rule_check(check_id: str, level: str, rule_id: str, applies: tuple[str, ...] = ()) -> Check:
    return Check(check_id, "integrity", level, applies, rule_id=rule_id)


def by_hand(check_id: str) -> Check:
    return Check(check_id, "integrity", "warning", manual=True)


# Conditions are SQL over ``flags`` (array), ``stack_db``, ``framework`` and ``hits`` (map rule -> worst).
def flag(name: str) -> str:
    return f"array_contains(flags, '{name}')"


SERVER = f"({flag('api_routes')} or framework = 'node' or {flag('server_code')})"
HEADERS = " + ".join(f"int({flag(n)})" for n in ("hdr_csp", "hdr_frame", "hdr_type", "hdr_hsts", "hdr_referrer"))

CHECKS: list[Check] = [
    Check("std-sec-rate-limit", "security", "warning", ladder=((f"not {SERVER}", "na", None), (flag("limiter"), "pass", None), ("true", "open", None))),
    Check(
        "std-sec-auth-guard",
        "security",
        "critical",
        ladder=(
            (f"not {flag('api_routes')}", "na", None),
            ("not array_contains(map_keys(hits), 'a01-api-route-auth-missing')", "pass", None),
            ("hits['a01-api-route-auth-missing'] <= 1", "manual", None),
            ("true", "manual", "warning"),
        ),
    ),
    Check(
        "std-sec-env-protection",
        "security",
        "critical",
        ladder=(
            ("array_contains(map_keys(hits), 'env-tracked')", "open", None),
            (f"not {flag('gitignore_env')} and {flag('npm')}", "open", "warning"),
            (f"not {flag('git')} and {flag('env_tracked')}", "manual", None),
            ("true", "pass", None),
        ),
    ),
    Check(
        "std-sec-hardcoded-secret",
        "security",
        "critical",
        ladder=(
            ("not array_contains(map_keys(hits), 'a02-hardcoded-secret')", "pass", None),
            ("hits['a02-hardcoded-secret'] = 0", "open", None),
            ("true", "manual", None),
        ),
    ),
    Check(
        "std-sec-headers",
        "security",
        "warning",
        ladder=(
            (f"not {flag('header_source')} and framework <> 'next'", "manual", "info"),
            (f"not {flag('header_source')}", "open", None),
            (f"{HEADERS} = 5", "pass", None),
            (f"{HEADERS} = 0", "open", None),
            ("true", "open", "info"),
        ),
    ),
    Check("std-sec-rls", "security", "warning", ladder=(("stack_db <> 'supabase'", "na", None), (flag("rls_text"), "pass", None), ("true", "manual", None))),
    Check("std-sec-input-validation", "security", "info", ladder=((f"not {SERVER}", "na", None), (flag("validation"), "pass", None), ("true", "manual", None))),
    Check("std-perf-region", "performance", "warning", ladder=((f"not {flag('vercel_json')}", "manual", None), (flag("regions"), "pass", None), ("true", "open", None))),
    Check("std-perf-sequential-await", "performance", "info", ladder=((f"not {flag('page_files')}", "na", None), (f"not {flag('await_chain')}", "pass", None), ("true", "manual", None))),
    Check(
        "std-perf-loading",
        "performance",
        "warning",
        ladder=((f"framework <> 'next' or not {flag('app_pages')}", "na", None), (flag("loading_files"), "pass", None), ("true", "open", None)),
    ),
    Check("std-perf-select-star", "performance", "info", ladder=((f"not {flag('select_star')}", "pass", None), ("true", "open", None))),
    rule_check("integrity-status-measured", "warning", "int-hardcoded-status"),
    by_hand("integrity-negative-test"),
    by_hand("integrity-numbers-derived"),
    rule_check("integrity-revoke-ends-session", "critical", "int-session-revoke-missing"),
    rule_check("integrity-delete-guard", "critical", "int-update-guard-without-delete", ("sql",)),
    rule_check("integrity-scope-derived", "critical", "int-scope-hand-enumerated"),
    rule_check("integrity-backup-rehearsal", "critical", "int-backup-without-restore-rehearsal", ("backup_files",)),
    rule_check("integrity-alert-target", "warning", "int-alert-target-missing", ("monitor_files",)),
    by_hand("integrity-monitor-last-run"),
    by_hand("integrity-health-called-by-hand"),
    by_hand("integrity-dependent-services"),
    rule_check("integrity-static-page-csp", "warning", "int-static-page-strict-csp"),
    by_hand("integrity-looked-in-browser"),
    rule_check("integrity-scan-before-write", "critical", "int-scan-after-write", ("scan_words",)),
    by_hand("integrity-bucket-public-url"),
    rule_check("integrity-generated-file", "warning", "int-generated-file-hand-edited"),
    rule_check("integrity-test-list", "warning", "int-hand-enumerated-test-list", ("npm",)),
]


def _ladder(check: Check) -> tuple[tuple[str, str, str | None], ...]:
    if check.manual:
        return (("true", "manual", None),)
    if check.rule_id:
        steps = [(f"not {flag(a)}", "na", None) for a in check.applies]
        steps += [(f"not array_contains(map_keys(hits), '{check.rule_id}')", "pass", None), ("true", "open", None)]
        return tuple(steps)
    return check.ladder


def _result(check: Check) -> str:
    """One struct per check; a condition that comes out null falls to manual, never to pass."""
    steps = _ladder(check)
    status = "case " + " ".join(f"when {c} then '{s}'" for c, s, _ in steps) + " else 'manual' end"
    level = "case " + " ".join(f"when {c} then '{lv or check.level}'" for c, _, lv in steps) + f" else '{check.level}' end"
    return f"named_struct('check_id', '{check.check_id}', 'category', '{check.category}', 'level', {level}, 'status', {status})"


def standards_profile(flags: DataFrame, findings: DataFrame, stacks: DataFrame) -> DataFrame:
    """(project, check_id, category, level, status) from flags, findings and stacks.

    All checks of a project come from one row: its flags and, per rule, the worst
    severity among its findings. Findings are reduced before the join.
    """
    from plumbline.functions import severity as S

    certain_secret = (F.col("rule_id") == "a02-hardcoded-secret") & (F.col("confidence") != "likely")
    rank = F.when(F.col("rule_id") == "a02-hardcoded-secret", F.when(certain_secret, 0).otherwise(1)).otherwise(
        S.order(F.col("severity"))
    )
    # A tracked environment file counts twice. Both rows come from one, so findings are made once.
    env = F.when((F.col("rule_id") == "a02-env-file-committed") & (F.col("note") == "tracked"), F.struct(F.lit("env-tracked").alias("rule_id"), F.lit(0).alias("rank")))
    both = F.array_compact(F.array(F.struct("rule_id", rank.alias("rank")), env))
    worst = (
        findings.select("project", F.explode(both).alias("r"))
        .select("project", "r.*")
        .groupBy("project", "rule_id")
        .agg(F.min("rank").alias("rank"))
        .groupBy("project")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "rank"))).alias("hits"))
    )
    joined = (
        flags.join(worst, "project", "left")
        .join(stacks.select("project", "framework", F.col("db").alias("stack_db")), "project", "left")
        .select(
            "project",
            "flags",
            F.coalesce("hits", F.create_map().cast("map<string,int>")).alias("hits"),
            F.coalesce("framework", F.lit("unknown")).alias("framework"),
            F.coalesce("stack_db", F.lit("unknown")).alias("stack_db"),
        )
    )
    results = F.expr("array(" + ", ".join(_result(c) for c in CHECKS) + ")")
    return joined.select("project", F.explode(results).alias("r")).select("project", "r.*")


def standards_scores(results: DataFrame) -> DataFrame:
    """Per project and category, plus the project total (category null).

    Only open checks cost points; manual and na never do.
    """
    penalty: Column = F.lit(0)
    for level, points in PENALTY.items():
        penalty = F.when(F.col("level") == level, F.lit(points)).otherwise(penalty)
    cost = F.coalesce(F.sum(F.when(F.col("status") == "open", penalty)), F.lit(0))
    grouped = results.groupBy("project", "category").agg(
        cost.alias("cost"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"__{s}") for s in ("pass", "open", "manual", "na")]
    )
    rolled = grouped.rollup("project", "category").agg(
        F.sum("cost").alias("cost"), *[F.sum(f"__{s}").alias(s) for s in ("pass", "open", "manual", "na")]
    ).where(F.col("project").isNotNull())
    return rolled.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("cost")))).drop("cost")
