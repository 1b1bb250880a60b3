"""Regular expressions for sets of literal terms.

Every set handed to `alternation` is prefix-free, so at one text position at most
one of its terms can match and the alternatives may be tried in any order. That
lets common prefixes be factored out, which keeps the cost per position near the
term length instead of the number of terms.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import groupby

_SPECIAL = frozenset("\\.[]{}()*+-?^$|&~#")


def quote(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def nesting_levels(terms: Iterable[str]) -> list[list[str]]:
    """Split terms by how many other terms are proper prefixes of them.

    Each level is prefix-free; level 0 holds the shortest term at any position.
    """
    levels: list[list[str]] = []
    open_prefixes: list[str] = []
    for term in sorted({t for t in terms if t}):
        while open_prefixes and not term.startswith(open_prefixes[-1]):
            open_prefixes.pop()
        if len(open_prefixes) == len(levels):
            levels.append([])
        levels[len(open_prefixes)].append(term)
        open_prefixes.append(term)
    return levels


def alternation(prefix_free: list[str]) -> str:
    """One pattern for a sorted, non-empty, prefix-free list of terms."""
    if len(prefix_free) == 1:
        return quote(prefix_free[0])
    head = os.path.commonprefix(prefix_free)
    tails = [t[len(head):] for t in prefix_free]
    branches = [alternation(list(g)) for _, g in groupby(tails, key=lambda t: t[0])]
    return f"{quote(head)}(?:{'|'.join(branches)})"


def longest(terms: Iterable[str]) -> str | None:
    """Pattern of the longest term at a place. A class of their first characters goes first, as it rules out most places at once."""
    usable = sorted({t for t in terms if t})
    if not usable:
        return None
    return f"{begins_like(usable)}(?:{_longest(usable)})"


def begins_like(terms: Iterable[str]) -> str:
    """A look at the next character alone: one that begins any of the (non-empty) terms."""
    return f"(?=[{''.join(sorted({quote(t[0]) for t in terms}))}])"


def _longest(terms: list[str]) -> str:
    head = os.path.commonprefix(terms)
    tails = [t[len(head):] for t in terms]
    branches = [_longest(list(g)) for _, g in groupby((t for t in tails if t), key=lambda t: t[0])]
    if not branches:
        return quote(head)
    return f"{quote(head)}(?:{'|'.join(branches)}){'' if tails[0] else '?'}"


def any_of(terms: Iterable[str]) -> str | None:
    """Pattern that finds the leftmost occurrence and, there, the shortest term."""
    levels = nesting_levels(terms)
    return f"{begins_like(levels[0])}(?:{alternation(levels[0])})" if levels else None
