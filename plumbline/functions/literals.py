"""Literals that a pattern cannot match without, read from the pattern itself.

A text that holds none of them cannot match, and looking for a short string is many times
cheaper than trying a pattern at each position. The literals are lower-case ASCII, to be
looked for in the lower-cased text, so they hold for either case; a letter outside ASCII only
ever ends a literal. The result is a necessary condition: the pattern still decides.
"""

from __future__ import annotations

import re
from functools import lru_cache

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as parser

#: More strings than this cost as much as the pattern; shorter ones are found anywhere.
MOST, SHORTEST = 24, 3
_REPEATS = tuple(getattr(C, n) for n in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") if hasattr(C, n))
_ATOMIC = getattr(C, "ATOMIC_GROUP", None)
Strings = frozenset[str]


def _rank(found: Strings) -> tuple:
    """Of two sets the better one: long enough, then few, then long."""
    shortest = min(map(len, found))
    return (shortest >= SHORTEST, -len(found), shortest)


def _char(code: int) -> Strings | None:
    return frozenset([chr(code).lower()]) if code < 128 else None


def _node(op, arg) -> tuple[Strings | None, Strings | None]:
    """(all strings the node can match, if few and known; strings one of which it must hold)."""
    if op is C.LITERAL:
        one = _char(arg)
        return one, one
    if op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
        return frozenset([""]), None
    if op is C.IN:
        if all(o is C.LITERAL and a < 128 for o, a in arg):
            chars = frozenset(chr(a).lower() for _, a in arg)
            return (chars if len(chars) <= 4 else None), None
        return None, None
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if _ATOMIC is not None and op is _ATOMIC:
        return _sequence(arg)
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        exact = frozenset().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        held = frozenset().union(*(h for _, h in parts)) if all(h is not None for _, h in parts) else None
        return exact, held
    if op in _REPEATS:
        least, most, body = arg
        if least < 1:
            return None, None
        exact, held = _sequence(body)
        return (exact if most == 1 else None), held
    return None, None


def _sequence(nodes) -> tuple[Strings | None, Strings | None]:
    run: Strings = frozenset([""])
    found: list[Strings] = []
    whole = True

    def end(strings: Strings) -> None:
        if min(map(len, strings)) > 0:
            found.append(strings)

    for op, arg in nodes:
        exact, held = _node(op, arg)
        if held is not None:
            found.append(held)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        end(run)
        run = exact if exact is not None and len(exact) <= MOST else frozenset([""])
    end(run)
    return (run if whole else None), max(found, key=_rank, default=None)


@lru_cache(maxsize=None)
def needs(pattern: str) -> tuple[str, ...] | None:
    """Strings one of which every lower-cased match holds; None where none can be told."""
    try:
        _, held = _sequence(parser.parse(pattern))
    except (re.error, OverflowError):
        return None
    if held is None or min(map(len, held)) < SHORTEST or len(held) > MOST:
        return None
    # A string that holds another of them adds nothing.
    return tuple(sorted(s for s in held if not any(o != s and o in s for o in held)))
