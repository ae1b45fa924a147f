"""Boolean trigram queries from regular expressions.

A query is a list of clauses that must all hold; a clause is a list of alternatives, each a set of trigrams that must
all occur. Queries are over text whose A-Z are lower-cased; they never miss a match. An empty query means that the
expression has no mandatory trigram, so that every text has to be scanned.
"""

from __future__ import annotations

from re import _constants as c
from re import _parser as parser

#: Strings that one clause may hold; beyond it, the clause is closed early.
MOST_STRINGS = 64

Query = list[list[frozenset[str]]]


def _chars(node) -> set[str] | None:
    """The characters that a literal or a small class stands for, lower-cased; None if there are many."""
    op, arg = node
    if op is c.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is not c.IN or any(k is not c.LITERAL for k, _ in arg):
        return None
    found = set().union(*(_chars(x) for x in arg))
    return found if len(found) <= 8 else None


def _exact(tree) -> set[str] | None:
    """All strings that a tree matches, if they are few."""
    out = {""}
    for node in tree:
        op, arg = node
        if op is c.SUBPATTERN:
            part = _exact(arg[3])
        elif op is c.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] != c.MAXREPEAT and arg[1] <= 4:
            one, part = _exact(arg[2]), set()
            if one is None:
                return None
            for n in range(arg[0], arg[1] + 1):
                power = {""}
                for _ in range(n):
                    power = {a + b for a in power for b in one}
                    if len(power) > MOST_STRINGS:
                        return None
                part |= power
        else:
            part = _chars(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> list[list[frozenset[str]]]:
    sets = {_trigrams(s) for s in strings}
    if frozenset() in sets:
        return []
    least = [a for a in sets if not any(b < a for b in sets)]
    return [sorted(least, key=sorted)]


def _walk(tree) -> Query:
    query, held = [], {""}
    for node in tree:
        part = _exact([node])
        if part is not None and len(held) * len(part) <= MOST_STRINGS:
            held = {a + b for a in held for b in part}
            continue
        query += _clause(held)
        held = part if part is not None else {""}
        if part is None:
            op, arg = node
            if op is c.SUBPATTERN:
                query += _walk(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
                query += _walk(arg[2])
    return query + _clause(held)


def trigram_query(pattern: str) -> Query:
    """The query of a pattern without look-around, back-references and inline flags."""
    return _walk(parser.parse(pattern))
