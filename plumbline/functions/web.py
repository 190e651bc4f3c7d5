"""Header, challenge and redirect expressions over stored responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """Header by lower-case name; sources lower-case all names on read."""
    return F.try_element_at(headers, F.lit(name))


def challenge_kind(status: Column, headers: Column, body: Column) -> Column:
    """Name of the bot challenge that answered instead of the application, or null."""
    low = F.lower(F.coalesce(body, F.lit("")))
    blocked = status.isin(403, 503)
    return (
        F.when(
            (F.lower(header(headers, "x-vercel-mitigated")) == "challenge")
            | (F.coalesce(header(headers, "x-vercel-challenge-token"), F.lit("")) != ""),
            F.lit("Vercel deployment protection (challenge)"),
        )
        .when(F.lower(header(headers, "cf-mitigated")) == "challenge", F.lit("Cloudflare challenge"))
        .when(blocked & low.contains("vercel security checkpoint"), F.lit("Vercel Security Checkpoint"))
        .when(
            blocked & (low.contains("cf-browser-verification") | low.contains("just a moment")),
            F.lit("Cloudflare bot protection"),
        )
        .when(
            blocked & low.contains("attention required") & low.contains("cloudflare"),
            F.lit("Cloudflare bot protection"),
        )
    )


def absolute_url(base: Column, location: Column) -> Column:
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    return (
        F.when(location.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), location)
        .when(location.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), location))
        .when(location.startswith("/"), F.concat(origin, location))
        .otherwise(F.concat(origin, F.lit("/"), location))
    )


def origin_of(url: Column) -> Column:
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    bare = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(
        F.regexp_replace(authority, ":80$", "")
    )
    return F.concat(scheme, F.lit("://"), bare)


def redirect_target(base: Column, status: Column, location: Column) -> Column:
    """Origin to measure instead of ``base``: same host, other scheme or port; else null."""
    target = absolute_url(base, location)
    same_host = F.lower(F.try_parse_url(target, F.lit("HOST"))) == F.lower(F.try_parse_url(base, F.lit("HOST")))
    moved = origin_of(target) != origin_of(base)
    return F.when(status.between(300, 399) & location.isNotNull() & same_host & moved, origin_of(target))
