"""Words the detectors look for, by concept, and the few shapes they appear in.

Names of libraries, functions, headers and columns are plain lists; the builders turn a
list into a call, a member access, a quoted name or a word. What a detector means is then a
combination of concepts and not one long pattern. Results use neither look-around nor
back-references, so they mean the same in Java and RE2.
"""

from __future__ import annotations

import re

QUOTE = "['\"`]"


def listed(words: str) -> str:
    return "|".join(re.sub(r"([.()\[\]$?*+|{}^\\])", r"\\\1", w) for w in words.split())


def either(*patterns: str) -> str:
    return "(?:" + "|".join(patterns) + ")"


def word(words: str) -> str:
    """One of the words on its own, in any case."""
    return rf"(?i:\b(?:{listed(words)})\b)"


def part(words: str) -> str:
    """One of the words anywhere, in any case; a hyphen stands for any separator or none."""
    return "(?i:" + listed(words).replace("-", "[-_ ]?") + ")"


def call(names: str) -> str:
    return rf"\b(?:{listed(names)})\s*\("


def method(names: str) -> str:
    return rf"\.\s*(?:{listed(names)})\s*\("


def member(owners: str, members: str) -> str:
    return rf"\b(?:{listed(owners)})\s*\.\s*(?:{listed(members)})\b"


def exported(names: str) -> str:
    return rf"\bexport\s+(?:(?:async\s+)?function|const)\s+(?:{listed(names)})\b"


def named_call(verbs: str, objects: str = "") -> str:
    """Calls such as requireRole( or verifyWebhookSignature(: a verb, then an object in the name."""
    then = rf"(?i:{listed(objects)})\w*" if objects else ""
    return rf"\b(?i:{listed(verbs)})\w*{then}\s*\("


def header_value(name: str, value: str) -> str:
    """A response header by name and what it is set to, on one line."""
    return rf"(?i:{name}){QUOTE}?\s*[:=,]\s*{QUOTE}?{value}"


# Request data.
REQUEST = "req request"
PARSED_BODY = "body json formData"
READ_METHODS, WRITE_METHODS = "GET HEAD OPTIONS", "POST PUT PATCH DELETE"
IDENTIFIER = r"[A-Za-z_$][\w$]*"

# Storage.
ROW_WRITES = "create createMany insert insertMany save update updateMany upsert"
ROW_READS = "findFirst findMany findUnique findById find aggregate"
DATABASES = "prisma drizzle knex mongoose sequelize"

# Who may act.
GUARD_VERBS = "require assert ensure enforce"
CHECK_VERBS = "is has can check verify validate normalize parse to authorize"
RIGHTS = "role permission admin owner member plan entitlement access auth session user gate"
SIGNED = "signature hmac token secret webhook"

# Services that charge per call.
PAID_SERVICES = "openai anthropic cohere replicate apify elevenlabs deepgram assemblyai deepseek"
