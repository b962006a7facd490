"""What every match of a pattern holds, read from the pattern itself: a text without it needs no search."""

from __future__ import annotations

import re
from functools import cache
from re import _parser as parser

MOST = 8                                                 # more words cost as much as the search


def _weight(word: str) -> float:
    """About how many texts hold a word, and what looking for it costs."""
    if len(word) == 1:
        return 0.65 if word.isalpha() or word in " .,-'" else 0.15
    return 0.04 + {2: 0.25, 3: 0.1}.get(len(word), 0.02)


def _fewest(words: frozenset[str]) -> frozenset[str]:
    """Without those that hold another."""
    return frozenset(w for w in words if not any(o != w and o in w for o in words))


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    return min(sets, key=lambda s: (sum(map(_weight, s)), sorted(s))) if sets else None


def _needs(items) -> frozenset[str] | None:
    """The best set of words, in lower case, of which every match of a sequence holds one; None where none is known."""
    sets, run = [], ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if name == "AT":                                 # has no width
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        found = None
        if name == "SUBPATTERN":
            found = _needs(arg[3])
        elif name == "ATOMIC_GROUP":
            found = _needs(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found = _needs(arg[2])
        elif name == "BRANCH":
            ways = [_needs(w) for w in arg[1]]
            if all(ways):
                found = _fewest(frozenset().union(*ways))
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and not any(chr(v) in "[&^" for _, v in arg):
            found = frozenset(chr(v).lower() for _, v in arg)
        if found:
            sets.append(found)
    if run:
        sets.append(frozenset([run]))
    return _best([s for s in sets if len(s) <= MOST])


@cache
def words_in(pattern: str) -> tuple[str, ...] | None:
    """Words, in lower case, of which every match of a pattern holds one, letter case aside; None where there are none worth looking for, or where
    the pattern is written in a way that is not read here."""
    try:
        found = _needs(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return tuple(sorted(found)) if found and sum(map(_weight, found)) < 0.6 else None
