"""Checks over stored HTTP responses.

``probes(project, url, path, method, status, headers, body, ok, error, cert_valid_to)``,
optionally ``attempt`` (1 or 2, repeated login posts) and ``origin`` (Origin header the
request carried). Most checks look at one response, so they run as one projection; the
rest are small aggregates per project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import web as W
from plumbline.operators.graph import redirect_chain
from plumbline.operators.joins import spread_join
from plumbline.operators.ordered import first_per_group
from plumbline.plans import rules as R
from plumbline.plans import vocabulary as V

# Probed paths, headers, signatures and the marker of the reflection probe.
ABSENT_PATH = "/__absent__"
MARKER = "plumb__marker__q"
FOREIGN_ORIGIN = "https://evil.example"
REQUIRED_HEADERS = [
    ("content-security-policy", "medium"),
    ("x-frame-options", "medium"),
    ("x-content-type-options", "low"),
    ("referrer-policy", "low"),
]
SIGNATURES = [
    ("/.env", "critical", "(?m)^[A-Z0-9_]+\\s*="),
    ("/.git/config", "high", "(?i)\\[core\\]|repositoryformatversion"),
    ("/.git/HEAD", "high", "ref:\\s*refs/"),
]
SECRET_FILES = ["/.env.local", "/.env.production", "/.env.development"]
CONFIG_FILES = ["/config.json", "/env.json", "/settings.json"]
CONFIG_SECRET = "(?i)\"\\w*(secret|private_?key|service_?role|password|access_?token)\\w*\"\\s*:\\s*\"[^\"]{6,}\"|sk_(live|test)_[A-Za-z0-9]{8,}"
ADMIN_PATHS = ["/admin", "/dashboard/admin", "/api/admin", "/api/users"]
LOGIN_LIKE = V.part("sign-in log-in giriş-yap unauthorized yetkisiz please-authenticate")
LOGIN_PATHS = ["/api/auth/login", "/api/login", "/api/auth/callback/credentials"]
ORIGIN_GATE = V.part("csrf cross-origin invalid-origin forbidden-origin")
HEALTH_PATHS = ["/api/health/live", "/api/health/ready", "/api/health", "/api/healthz", "/healthz", "/health", "/api/status"]
LISTED_DIRS = ["/uploads", "/files", "/static", "/assets", "/images", "/backup", "/logs", "/.git"]
LISTING = V.part("directory-listing parent-directory") + "|(?i:\\bindex of /)"
WRITE_METHODS = "(?i)\\b(TRACE|TRACK|PUT|DELETE)\\b"
LONG_CHAIN = 4


def h(name: str) -> Column:
    return W.header(F.col("headers"), name)


def has(name: str) -> Column:
    return F.coalesce(h(name), F.lit("")) != ""


def row(rule: str, severity: Column | str, note: Column | str, confidence: str | None = None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule).alias("rule_id"),
        as_col(severity).alias("severity"),
        F.lit(confidence or R.BY_ID[rule].confidence).alias("confidence"),
        as_col(note).alias("note"),
    )


def root() -> Column:
    return (F.col("path") == "/") & (F.col("method") == "GET") & F.col("origin").isNull()


def single_response_checks() -> Column:
    """Array of findings one response gives on its own."""
    ok, status, body = F.col("ok"), F.col("status"), F.col("body")
    https = F.lower("url").startswith("https://")
    csp = F.coalesce(h("content-security-policy"), F.lit(""))
    out = []
    for name, severity in REQUIRED_HEADERS:
        lacking = ok & root() & ~has(name)
        if name == "x-frame-options":
            lacking = lacking & ~csp.rlike("(?i)frame-ancestors")
        out.append(F.when(lacking, row("a05-live-security-headers", severity, name)))
    out.append(
        F.when(ok & root() & https & ~has("strict-transport-security"), row("a02-live-transport-and-cookies", "medium", "hsts"))
    )
    cookie = F.lower(h("set-cookie"))
    flags = F.array_compact(
        F.array(
            F.when(~cookie.rlike("httponly"), F.lit("HttpOnly")),
            F.when(https & ~cookie.rlike("secure"), F.lit("Secure")),
            F.when(~cookie.rlike("samesite"), F.lit("SameSite")),
        )
    )
    out.append(
        F.when(
            ok & root() & has("set-cookie") & (F.size(flags) > 0),
            row(
                "a02-live-transport-and-cookies",
                F.when(F.array_contains(flags, "HttpOnly"), F.lit("medium")).otherwise(F.lit("low")),
                F.array_join(flags, ","),
            ),
        )
    )
    for path, severity, signature in SIGNATURES:
        out.append(
            F.when(ok & (F.col("path") == path) & (status == 200) & body.rlike(signature), row("a05-live-exposed-files", severity, path))
        )
    out.append(
        F.when(
            ok & F.col("path").isin(SECRET_FILES) & (status == 200) & body.rlike(SIGNATURES[0][2]),
            row("a05-live-exposed-secrets", "critical", F.col("path")),
        )
    )
    page = body.rlike("(?i)^\\s*<(!doctype|html)")
    out.append(
        F.when(
            ok & F.col("path").isin(CONFIG_FILES) & (status == 200) & ~page & body.rlike(CONFIG_SECRET),
            row("a05-live-exposed-secrets", "high", F.col("path")),
        )
    )
    out.append(
        F.when(
            ok & F.col("path").endswith(".js.map") & (status == 200) & body.rlike('"mappings"\\s*:|"sources"\\s*:'),
            row("a05-live-exposed-secrets", "medium", "source map"),
        )
    )
    raw = body.contains(MARKER + "<z>")
    safe = body.contains(MARKER + "&lt;z&gt;") | body.contains(MARKER + "%3C")
    out.append(
        F.when(
            ok & F.col("path").contains("?q=") & (status == 200) & F.coalesce(h("content-type"), F.lit("")).contains("html") & raw & ~safe,
            row("a03-live-reflected-input", "high", F.col("path")),
        )
    )
    bad_health = ~status.isin(404, 0) & ~status.between(200, 399) & ~((status == 503) & (F.trim("body") != ""))
    out.append(F.when(F.col("path").isin(HEALTH_PATHS) & bad_health, row("int-live-health-endpoints", "high", F.col("path"))))
    acao = F.trim(h("access-control-allow-origin"))
    open_cors = (acao == F.col("origin")) | ((acao == "*") & (F.lower(h("access-control-allow-credentials")) == "true"))
    out.append(F.when(ok & (F.col("path") == "/") & F.col("origin").isNotNull() & open_cors, row("a05-live-cors-misconfig", "high", "foreign origin")))
    fine = ok & (F.col("path") == "/") & status.between(200, 299)
    out.append(F.when(fine & (F.col("method") == "TRACE"), row("a05-live-http-methods", "medium", "TRACE")))
    allow = F.coalesce(h("allow"), h("access-control-allow-methods"))
    out.append(F.when(fine & (F.col("method") == "OPTIONS") & allow.rlike(WRITE_METHODS), row("a05-live-http-methods", "low", "OPTIONS")))
    scripts = F.regexp_count("body", F.lit("(?i)<script[\\s>]"))
    nonces = F.regexp_count("body", F.lit("(?i)<script[^>]*\\snonce="))
    out.append(
        F.when(
            F.col("path").isin("/", ABSENT_PATH) & (F.col("method") == "GET") & F.col("origin").isNull() & csp.contains("strict-dynamic") & (scripts > 0) & (nonces == 0),
            row("int-live-page-nonce-coverage", "medium", F.concat(F.lit("scripts="), scripts.cast("string"))),
        )
    )
    days = F.col("cert_days")
    out.append(
        F.when(
            root() & https & (days < 30),
            row("a05-live-ssl-domain", F.when(days < 7, F.lit("critical")).otherwise(F.lit("high")), F.when(days < 0, F.lit("certificate expired")).otherwise(F.lit("certificate expiring")), "certain"),
        )
    )
    out.append(F.when(root() & ~ok & F.lower("error").rlike("enotfound|dns|nxdomain"), row("a05-live-ssl-domain", "medium", "dns", "likely")))
    plain = ok & root() & F.lower("url").startswith("http://")
    moved = status.between(300, 399)
    to_https = F.lower(F.coalesce(h("location"), F.lit(""))).startswith("https://")
    out.append(F.when(plain & (status == 200), row("a05-live-ssl-domain", "medium", "http not redirected", "likely")))
    out.append(F.when(plain & moved & ~to_https, row("a05-live-ssl-domain", "low", "redirect not to https", "likely")))
    return F.array_compact(F.array(*out))


def challenged_projects(probes: DataFrame) -> DataFrame:
    kind = W.challenge_kind(F.col("status"), F.col("headers"), F.col("body"))
    return probes.where(F.col("ok") & kind.isNotNull()).select("project").distinct()


def open_admin(probes: DataFrame) -> DataFrame:
    """Admin paths that answer 200; unmeasurable where an absent path answers 200 too."""
    catch_all = F.max(
        (F.col("path") == ABSENT_PATH) & F.col("ok") & (F.col("status") == 200)
    )
    per = probes.groupBy("project").agg(catch_all.alias("__all"))
    blind = per.where("__all").select("project", F.lit(ABSENT_PATH).alias("path"), row("a01-live-open-admin-endpoints", "info", "cannot measure", "certain").alias("f"))
    hits = probes.where(
        F.col("path").isin(ADMIN_PATHS) & F.col("ok") & (F.col("status") == 200) & ~F.col("body").rlike(LOGIN_LIKE)
    ).select("project", "path").distinct()
    seen = spread_join(hits, per.where(~F.col("__all")), ["project"], "left_semi", spread_by=["path"])
    return blind.unionByName(seen.select("project", "path", row("a01-live-open-admin-endpoints", "high", F.col("path")).alias("f")))


def login_hardening(probes: DataFrame) -> DataFrame:
    """First login path that answers: two posts without a sign of rate limiting."""
    rank = F.array_position(F.array(*[F.lit(p) for p in LOGIN_PATHS]), F.col("path"))
    posts = probes.where(F.col("path").isin(LOGIN_PATHS) & (F.col("method") == "POST"))
    hinted = has("ratelimit-limit") | has("x-ratelimit-limit") | has("retry-after")
    per = posts.groupBy("project", "path").agg(
        F.max(F.when(F.col("attempt") == 1, F.struct(F.col("ok"), F.col("status"), hinted.alias("hint"), has("retry-after").alias("retry"), F.col("body").rlike(ORIGIN_GATE).alias("gate")))).alias("one"),
        F.max((F.col("attempt") == 2) & (F.col("status") == 429)).alias("limited"),
    )
    answered = per.where(F.col("one.ok") & ~F.col("one.status").isin(404, 405)).withColumn("__rank", rank)
    first = first_per_group(answered, ["project"], ["__rank"])
    gated = F.col("one.status").isin(401, 403) & ~F.col("one.retry") & F.col("one.gate")
    signal = F.col("one.hint") | F.coalesce("limited", F.lit(False))
    found = F.when(gated, row("a07-live-login-hardening", "info", "origin gate", "certain")).when(
        ~signal, row("a07-live-login-hardening", "medium", F.col("path"), "likely")
    )
    return first.select("project", "path", found.alias("f")).where(F.col("f").isNotNull())


def directory_listing(probes: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(p) for p in LISTED_DIRS]), F.col("path"))
    hits = probes.where(F.col("path").isin(LISTED_DIRS) & F.col("ok") & (F.col("status") < 400) & F.col("body").rlike(LISTING))
    first = first_per_group(hits.withColumn("__rank", rank), ["project"], ["__rank"])
    return first.select("project", "path", row("a05-live-directory-listing", "medium", F.col("path")).alias("f"))


def long_redirects(probes: DataFrame) -> DataFrame:
    """Four or more redirects from the root of a project."""
    full = F.when(F.col("path").rlike("^[a-zA-Z]+://"), F.col("path")).otherwise(F.col("url"))
    hops = (
        probes.where(F.col("ok") & F.col("status").between(300, 399) & has("location") & (F.col("method") == "GET"))
        .select("project", full.alias("url"), W.absolute_url(full, h("location")).alias("location"))
        .groupBy("project", "url")
        .agg(F.min("location").alias("location"))
    )
    starts = probes.where(root()).select("project", full.alias("url")).distinct()
    chain = redirect_chain(starts, hops, ["project"])
    return chain.where(F.col("hops") >= LONG_CHAIN).select(
        "project", F.lit("/").alias("path"), row("a05-live-ssl-domain", "low", F.concat(F.lit("redirects="), F.col("hops").cast("string")), "likely").alias("f")
    )


def response_findings(probes: DataFrame, now: Column, with_chains: bool = True) -> DataFrame:
    """Findings of all response checks; a challenged project has none at all."""
    columns = probes.columns
    full = probes
    if "attempt" not in columns:
        full = full.withColumn("attempt", F.lit(1))
    if "origin" not in columns:
        full = full.withColumn("origin", F.lit(None).cast("string"))
    full = full.withColumn("cert_days", T.days_until(F.col("cert_valid_to"), now))
    single = full.select("project", "path", F.explode(single_response_checks()).alias("f"))
    parts = [open_admin(full), login_hardening(full), directory_listing(full)]
    if with_chains:
        parts.append(long_redirects(full))
    found = single
    for p in parts:
        found = found.unionByName(p)
    open_ = spread_join(found, challenged_projects(full), ["project"], "left_anti", spread_by=["path"])
    return open_.select(
        "project",
        F.col("f.rule_id").alias("rule_id"),
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.col("path").alias("snippet"),
        F.col("f.severity").alias("severity"),
        F.col("f.confidence").alias("confidence"),
        F.col("f.note").alias("note"),
    ).distinct()
