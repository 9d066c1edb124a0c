"""Boolean trigram queries: what a text must contain for a regular expression to match it.

A query is a conjunction of disjunctions of conjunctions of trigrams: a tuple of clauses, each a frozenset of
alternatives, each alternative a frozenset of trigrams that must all be there. Trigrams are those of the text in lower
case, so that one index serves patterns of either case.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

Clause = frozenset[frozenset[str]]
#: Sets of possible strings, and classes of characters, are followed up to these sizes.
MOST_STRINGS, MOST_CHARACTERS = 24, 6


def trigrams_of(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def clause_of(strings: set[str]) -> Clause | None:
    """One of the strings must be there; None if that demands nothing. An alternative that implies another is left out."""
    found = {trigrams_of(s) for s in strings}
    return None if frozenset() in found else frozenset(a for a in found if not any(b < a for b in found))


def strings_of(node: tuple) -> set[str] | None:
    """All strings that an element of the parsed pattern can match, in lower case, or None if they are too many."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN and value[0][0] is not sre.NEGATE:
        found: set[str] = set()
        for k, v in value:
            if k is sre.LITERAL:
                found.add(chr(v).lower())
            elif k is sre.RANGE and v[1] - v[0] < 2 * MOST_CHARACTERS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_CHARACTERS else None
    if kind is sre.SUBPATTERN:
        return joined([*value[3]])
    if kind is sre.BRANCH:
        parts = [joined([*b]) for b in value[1]]
        if any(p is None for p in parts):
            return None
        found = set().union(*parts)
        return found if len(found) <= MOST_STRINGS else None
    if kind is sre.MAX_REPEAT and value[1] <= 3:
        one = joined([*value[2]])
        if one is None:
            return None
        found = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(sorted(one), repeat=n)}
        return found if len(found) <= MOST_STRINGS else None
    if kind is sre.AT:
        return {""}
    return None


def joined(nodes: list[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = strings_of(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def clauses_of(nodes: list[tuple]) -> list[Clause]:
    """Clauses of a sequence: of each longest stretch whose strings are known, and of what stands between."""
    found: list[Clause | None] = []
    known = {""}
    for node in nodes:
        more = strings_of(node)
        if more is not None and len(known) * len(more) <= MOST_STRINGS:
            known = {a + b for a in known for b in more}
            continue
        found.append(clause_of(known))
        known = {""}
        kind, value = node
        if more is not None:
            known = more
        elif kind is sre.SUBPATTERN:
            found += clauses_of([*value[3]])
        elif kind is sre.MAX_REPEAT and value[0] > 0:
            once = joined([*value[2]])
            if once is not None and len(once) == 1 and value[0] * len(next(iter(once))) >= 3:
                found.append(clause_of({next(iter(once)) * value[0]}))
            else:
                found += clauses_of([*value[2]])
    found.append(clause_of(known))
    return [c for c in found if c is not None]


def trigram_query(pattern: str) -> tuple[Clause, ...]:
    """The clauses that every text with a match meets; none if the pattern demands no trigram, so that all texts qualify."""
    best: dict[Clause, None] = dict.fromkeys(clauses_of([*sre_parse.parse(pattern, re.ASCII if isinstance(pattern, str) else 0)]))
    return tuple(best)


#: Letters, the most frequent ones of English prose first; what isn't among them is taken to be rarer still.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def rarity(gram: str) -> tuple[int, str]:
    return sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in gram), gram


def selective(query: tuple[Clause, ...], most: int = 2) -> tuple[Clause, ...]:
    """A weaker query with ``most`` trigrams an alternative at most: those that all alternatives of a clause share come
    first, then the rarest. What meets a query meets the weaker one, and fewer trigrams have to be looked for."""

    def fewer(clause: Clause) -> Clause:
        shared = frozenset.intersection(*clause)
        return frozenset(frozenset(sorted(a, key=lambda g: (g in shared, *rarity(g)), reverse=True)[:most]) for a in clause)

    return tuple(dict.fromkeys(map(fewer, query)))
