"""The rule table: one row per rule, independent of how the rule is detected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.severity import CATEGORIES

RULE_SCHEMA = (
    "rule_id string, title string, owasp string, severity string, confidence string, kind string, "
    "requires array<string>, surface string, cwe string, approx boolean"
)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    category: int
    severity: str
    confidence: str = "likely"
    kind: str = "static"
    requires: tuple[str, ...] = ()
    # clean: blanked text of production files; all: blanked text, tests too; raw: text as stored.
    surface: str = "clean"
    cwe: str | None = None
    # True where the rule reads text although the exact check would need a syntax tree.
    approx: bool = False

    @property
    def owasp(self) -> str:
        return CATEGORIES[self.category - 1]


JS, GIT, SQL, LIVE = ("js",), ("git",), ("sql",), ("live",)

RULES = [
    Rule("a01-client-controlled-entitlement", "Entitlement taken from the request", 1, "high", cwe="CWE-639", approx=True),
    Rule("int-page-api-auth-divergence", "Page authorises differently from its API", 1, "high"),
    Rule("a01-server-action-auth-missing", "Server action without an authorisation check", 1, "high"),
    Rule("int-scope-hand-enumerated", "Scoper lists its keys by hand", 1, "high"),
    Rule("int-permission-after-validation", "Authorisation runs after validation", 1, "low"),
    Rule("a01-api-route-auth-missing", "API route without an authentication check", 1, "high"),
    Rule("a01-idor-direct-object-reference", "Object read by id without an ownership check", 1, "high"),
    Rule("a01-supabase-service-role-key", "Service-role key in use", 1, "high"),
    Rule("a01-missing-rls", "Table without row level security", 1, "high", "certain", requires=SQL, cwe="CWE-284"),
    Rule("a01-open-redirect", "Redirect target from the request", 1, "medium", cwe="CWE-601", approx=True),
    Rule("a01-csrf-missing", "State change without a CSRF check", 1, "medium", cwe="CWE-352", approx=True),
    Rule("a01-mass-assignment", "Request object written to the database", 1, "high", requires=JS, cwe="CWE-915", approx=True),
    Rule("a01-path-traversal", "File path from the request", 1, "high", requires=JS, cwe="CWE-22", approx=True),
    Rule("a02-pii-in-repo", "Personal data file tracked", 2, "high", "certain", requires=GIT, cwe="CWE-359"),
    Rule("a02-pii-in-generated-output", "Generated output with street addresses", 2, "high", "certain", surface="raw", cwe="CWE-359"),
    Rule("a02-pii-in-commit-messages", "Street addresses in commit messages", 2, "medium", "certain", requires=GIT, cwe="CWE-359"),
    Rule("a02-hardcoded-secret", "Secret in source", 2, "critical", "certain", cwe="CWE-798"),
    Rule("a02-env-file-committed", "Environment file under version control", 2, "high", requires=GIT),
    Rule("a02-next-public-secret-leak", "Secret under a public prefix", 2, "critical", "certain", cwe="CWE-200"),
    Rule("a02-weak-hash-or-jwt-secret", "Weak hash or literal signing secret", 2, "high", "certain"),
    Rule("a02-sensitive-data-plaintext", "Sensitive field in plain text", 2, "high", "certain", cwe="CWE-311", approx=True),
    Rule("a02-secrets-git-history", "Secret added in a commit", 2, "high", requires=GIT, cwe="CWE-798"),
    Rule("kvkk-special-category-data", "Special-category personal data column", 2, "info", cwe="CWE-359"),
    Rule("a03-sql-injection", "SQL built from variables", 3, "high", requires=JS, cwe="CWE-89", approx=True),
    Rule("a03-sql-identifier-injection", "SQL identifier built from variables", 3, "high"),
    Rule("a03-redos", "Regular expression open to blow-up", 3, "medium", requires=JS, cwe="CWE-1333", approx=True),
    Rule("a03-prototype-pollution", "Prototype pollution", 3, "medium", requires=JS, cwe="CWE-1321", approx=True),
    Rule("a03-dangerous-execution-sink", "Code, command or raw HTML sink", 3, "high", approx=True),
    Rule("webhook-idempotency-ttl", "Replay lock of a webhook expires", 4, "medium"),
    Rule("int-sql-dialect-leftover", "Function of another SQL engine", 4, "high", "certain"),
    Rule("int-ic-link-alakasiz-capa", "Internal link chosen without a topic check", 4, "medium"),
    Rule("a04-missing-rate-limit", "Sensitive endpoint without a rate limit", 4, "medium"),
    Rule("a04-sqlite-no-busy-timeout", "SQLite writer without a lock wait", 4, "low"),
    Rule("a04-check-then-act-upsert", "Check then write without a conflict clause", 4, "low"),
    Rule("a04-inmemory-ratelimit-serverless", "Rate limit kept in memory on serverless", 4, "medium"),
    Rule("a04-tarih-utc-gun-kaymasi", "Local day cut from a UTC string", 4, "medium"),
    Rule("a04-fk-cascade-off", "Foreign keys declared but not enforced", 4, "medium", requires=SQL),
    Rule("a04-unguarded-json-parse", "JSON parsed without a guard", 4, "low", approx=True),
    Rule("a04-unbounded-paid-loop", "Paid call in a loop without a bound", 4, "medium"),
    Rule("int-static-page-strict-csp", "Static page under a strict-dynamic policy", 5, "medium"),
    Rule("a05-missing-security-headers", "Security header not configured", 5, "medium"),
    Rule("a05-cors-misconfiguration", "Open cross-origin policy", 5, "medium"),
    Rule("a05-build-config-health", "Build and configuration health", 5, "low", requires=JS),
    Rule("a05-backup-cruft-tracked", "Backup leftovers in the project", 5, "low", requires=GIT),
    Rule("a06-outdated-deps", "Deprecated or far outdated package", 6, "low", kind="deps"),
    Rule("int-unbound-session-fallthrough", "Unbound session becomes a default identity", 7, "high", cwe="CWE-1188"),
    Rule("int-gate-condition-too-broad", "Gate closed by an unrelated record", 7, "high"),
    Rule("int-session-revoke-missing", "Access revoked, sessions kept", 7, "high"),
    Rule("a07-jwt-weak-verification", "Weak token verification", 7, "high", "certain"),
    Rule("a07-spoofable-client-ip", "Decision on a forwarded client address", 7, "high"),
    Rule("a07-jwt-alg-none", "Token algorithm none accepted", 7, "high", "certain", requires=JS, cwe="CWE-347", approx=True),
    Rule("a07-weak-random-token", "Token from weak randomness", 7, "high", cwe="CWE-338"),
    Rule("int-hand-enumerated-test-list", "Test command lists files by hand", 8, "medium", "certain", surface="all"),
    Rule("int-generated-file-hand-edited", "Generated file without an additions file", 8, "high", surface="raw"),
    Rule("int-update-guard-without-delete", "Update guard without a delete guard", 8, "high"),
    Rule("int-contract-two-writers", "Typed and untyped writers of one contract", 8, "medium", requires=JS),
    Rule("int-scan-after-write", "Malware scan after the write", 8, "high"),
    Rule("a08-yedek-kaniti-yok", "No evidence of a scheduled backup", 8, "info"),
    Rule("a08-unverified-webhook", "Webhook signature not verified", 8, "high"),
    Rule("a08-external-script-no-sri", "External script without integrity", 8, "medium", cwe="CWE-353"),
    Rule("a08-test-schema-divergence", "Test creates its own schema", 8, "low", surface="all"),
    Rule("int-pii-in-logs", "Personal data in a log call", 9, "medium", cwe="CWE-532"),
    Rule("int-status-from-config-not-probe", "Status claimed from configuration", 9, "medium"),
    Rule("int-hardcoded-status", "Status is a constant", 9, "medium", requires=JS, approx=True),
    Rule("int-backup-without-restore-rehearsal", "Backup never restored", 9, "high"),
    Rule("int-alert-target-missing", "Monitor without an alert target", 9, "medium"),
    Rule("int-silent-budget-denial", "Exhausted budget answers silently", 9, "medium"),
    Rule("a09-missing-audit-logging", "Sensitive route without logging", 9, "info"),
    Rule("a09-security-txt-missing", "No security contact file", 9, "info", cwe="CWE-200"),
    Rule("a09-swallowed-ddl-error", "Schema error swallowed", 9, "low"),
    Rule("a10-ssrf-user-controlled-request", "Outbound request target from input", 10, "medium"),
    Rule("int-scan-target-missing", "Project path does not exist", 9, "high", "certain"),
    Rule("int-scan-target-empty", "Project has no scannable file", 9, "high", "certain"),
    Rule("a05-live-security-headers", "Response lacks a security header", 5, "medium", kind="live", requires=LIVE),
    Rule("a02-live-transport-and-cookies", "Transport or cookie flag missing", 2, "medium", kind="live", requires=LIVE),
    Rule("a05-live-exposed-files", "Sensitive file served", 5, "high", kind="live", requires=LIVE),
    Rule("a05-live-exposed-secrets", "Secret or source map served", 5, "high", "certain", kind="live", requires=LIVE),
    Rule("a05-live-ssl-domain", "Certificate, name or redirect problem", 5, "high", kind="live", requires=LIVE),
    Rule("a01-live-open-admin-endpoints", "Admin path open", 1, "high", kind="live", requires=LIVE),
    Rule("a03-live-reflected-input", "Input reflected unencoded", 3, "high", kind="live", requires=LIVE),
    Rule("a07-live-login-hardening", "Login without a rate limit signal", 7, "medium", kind="live", requires=LIVE),
    Rule("int-live-health-endpoints", "Health endpoint fails", 9, "high", "certain", kind="live", requires=LIVE),
    Rule("a05-live-cors-misconfig", "Response allows a foreign origin", 5, "high", "certain", kind="live", requires=LIVE),
    Rule("a05-live-http-methods", "Dangerous methods enabled", 5, "low", kind="live", requires=LIVE),
    Rule("a05-live-directory-listing", "Directory listing served", 5, "medium", "certain", kind="live", requires=LIVE),
    Rule("int-live-page-nonce-coverage", "Scripts without a nonce", 5, "medium", "certain", kind="live", requires=LIVE),
]
BY_ID = {r.rule_id: r for r in RULES}

# Why a requirement is unmet.
REQUIREMENT_REASON = {
    "git": "no version control listing",
    "live": "no reachable url",
    "npm": "no package.json",
    "net": "no network access",
    "js": "no script file",
    "python": "no Python project file",
    "sql": "no SQL schema or migration",
    "prisma": "no Prisma schema",
}


def rule_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [
        (r.rule_id, r.title, r.owasp, r.severity, r.confidence, r.kind, list(r.requires), r.surface, r.cwe, r.approx)
        for r in (RULES if rules is None else rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
