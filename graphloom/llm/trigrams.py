"""Boolean trigram queries from regular expressions.

For each part of a pattern we keep what every match must contain: a small set of whole strings if the part can only
match those, else the strings that it can begin and end with, and a query over trigrams. Queries are nested tuples:
("and", q...), ("or", q...), a trigram, or ALL, which any text satisfies. Everything is lower-cased, as the index is.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

ALL = ("and",)
MOST = 40  # strings in a set before it is given up


def conjunction(*qs):
    flat: list = []
    for q in qs:
        flat += [x for x in (q[1:] if isinstance(q, tuple) and q[0] == "and" else (q,)) if x not in flat]
    return flat[0] if len(flat) == 1 else ("and", *flat)


def disjunction(*qs):
    if any(q == ALL for q in qs):
        return ALL
    flat: list = []
    for q in qs:
        flat += [x for x in (q[1:] if isinstance(q, tuple) and q[0] == "or" else (q,)) if x not in flat]
    needs = [(q, trigrams_of(q)) for q in flat]
    flat = [q for q, t in needs if not any(u < t and _plain(p) for p, u in needs)]  # what asks for more is implied
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _plain(q) -> bool:
    return isinstance(q, str) or (q[0] == "and" and all(isinstance(x, str) for x in q[1:]))


def of_strings(strings: set[str]):
    """What a text that holds one of the strings satisfies."""
    if not strings:
        return ALL
    return disjunction(*(conjunction(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass
class Part:
    exact: set[str] | None  # all strings that it matches, if few
    prefix: set[str]
    suffix: set[str]
    query: object = ALL

    def needs(self):
        return conjunction(self.query, of_strings(self.exact)) if self.exact is not None else conjunction(self.query, of_strings(self.prefix), of_strings(self.suffix))


def _short(strings: set[str], end: bool) -> set[str]:
    cut = {s[-2:] if end else s[:2] for s in strings}
    return cut if len(cut) <= MOST else {""}


def _then(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        both = {x + y for x in a.exact for y in b.exact}
        return Part(both, both, both, conjunction(a.query, b.query))
    left = a.exact if a.exact is not None else a.suffix
    right = b.exact if b.exact is not None else b.prefix
    seam = {x[-2:] + y[:2] for x in left for y in right}
    query = conjunction(a.needs(), b.needs(), of_strings(seam) if len(seam) <= MOST else ALL)
    prefix = {x + y for x in a.exact for y in right} if a.exact is not None else a.prefix
    suffix = {x + y for x in left for y in b.exact} if b.exact is not None else b.suffix
    return Part(None, prefix if len(prefix) <= MOST else _short(prefix, False), suffix if len(suffix) <= MOST else _short(suffix, True), query)


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        every = set().union(*(p.exact for p in parts))
        if len(every) <= MOST:
            return Part(every, every, every, disjunction(*(p.query for p in parts)))
    query = disjunction(*(p.needs() for p in parts))
    prefix = set().union(*((p.exact if p.exact is not None else p.prefix) for p in parts))
    suffix = set().union(*((p.exact if p.exact is not None else p.suffix) for p in parts))
    return Part(None, prefix if len(prefix) <= MOST else {""}, suffix if len(suffix) <= MOST else {""}, query)


def _any() -> Part:
    return Part(None, {""}, {""})


def _characters(items) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _any()
    return Part(found, found, found) if len(found) <= 8 else _any()


def _sequence(tree) -> Part:
    out = Part({""}, {""}, {""})
    for kind, value in tree:
        out = _then(out, _node(kind, value))
    return out


def _node(kind, value) -> Part:
    if kind is C.LITERAL:
        s = {chr(value).lower()}
        return Part(s, s, s)
    if kind is C.IN:
        return _characters(value)
    if kind is C.SUBPATTERN:
        return _sequence(value[-1])
    if kind is C.BRANCH:
        return _either([_sequence(b) for b in value[1]])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = value
        part = _sequence(body)
        if low == 0:
            return _either([Part({""}, {""}, {""}), part]) if high == 1 else _any()
        if low == high == 1:
            return part
        once = part
        for _ in range(min(low, 3) - 1):
            once = _then(once, part)
        return once if low == high <= 3 else _then(once, _any())
    if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return Part({""}, {""}, {""})
    return _any()


def query(pattern: str):
    """The Boolean trigram query that every text with a match satisfies."""
    return _sequence(P.parse(pattern)).needs()


def trigrams_of(q) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*(trigrams_of(x) for x in q[1:]), set())
