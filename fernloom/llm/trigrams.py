"""Boolean trigram queries of regular expressions.

A query is None (any text may match), or a set of alternatives, each a set of
trigrams of lower-case ASCII that a matching text must contain all of.
"""

from __future__ import annotations

import re

try:  # the parser of Python's own re module
    from re import _constants as sc
    from re import _parser as sp
except ImportError:  # Python before 3.11
    import sre_constants as sc
    import sre_parse as sp

#: Alternatives beyond which a part of an expression counts as unknown text.
MOST = 64


def _exact(nodes) -> list[set[str] | None]:
    """The expression as a row of parts: the texts that a part can be, or None for unknown text."""
    parts: list[set[str] | None] = []
    for op, arg in nodes:
        if op is sc.LITERAL:
            parts.append({chr(arg).lower()} if arg < 128 else None)
        elif op is sc.SUBPATTERN:
            parts += _exact(arg[3])
        elif op is sc.BRANCH:
            parts.append(_either([_exact(x) for x in arg[1]]))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[1] == 1:
            one = _either([_exact(arg[2])])
            parts.append(None if one is None else one | {""})
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and 0 < arg[0] <= 4:
            parts += _exact(arg[2]) * arg[0] + ([None] if arg[1] > arg[0] else [])
        elif op is sc.IN and len(arg) <= 8 and all(k is sc.LITERAL and v < 128 for k, v in arg):
            parts.append({chr(v).lower() for _, v in arg})
        elif op is sc.AT:
            continue
        else:
            parts.append(None)
    return parts


def _either(branches: list[list[set[str] | None]]) -> set[str] | None:
    out: set[str] = set()
    for parts in branches:
        whole = {""}
        for p in parts:
            if p is None or len(whole) * len(p) > MOST:
                return None
            whole = {a + b for a in whole for b in p}
        out |= whole
    return out if len(out) <= MOST else None


def query(pattern: str) -> set[frozenset[str]] | None:
    """The alternatives of the pattern's most selective run of known text."""
    best, run = None, {""}
    for p in [*_exact(sp.parse(pattern)), None]:
        if p is not None and len(run) * len(p) <= MOST:
            run = {a + b for a in run for b in p}
            continue
        if all(len(x) >= 3 for x in run):
            found = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run}
            found = {x for x in found if not any(y < x for y in found)}
            if best is None or min(map(len, found)) > min(map(len, best)):
                best = found
        run = {""} if p is None else p
    return best


def of_rule(pattern: re.Pattern) -> set[frozenset[str]] | None:
    return query(pattern.pattern)
