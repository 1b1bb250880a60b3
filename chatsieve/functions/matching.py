"""Column expressions that look for lexicon terms in one text.

`terms` is always a driver-side list in lexicon order whose size the caller has
checked; sets too large for that take the join in `operators.matching` instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsieve.functions.patterns import alternation, any_of, begins_like, nesting_levels
from chatsieve.functions.text import let

#: So few terms are searched for one by one, which takes less time than a pattern.
FEW = 8


def _usable(terms: list[str]) -> list[str]:
    return [t for t in dict.fromkeys(terms) if t]


def occurs(text: Column, terms: list[str]) -> Column:
    """Does any of the terms occur (null for null text)?"""
    usable = _usable(terms)
    if not usable:
        return F.when(text.isNotNull(), F.lit(False))
    if len(usable) <= FEW:
        return reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in usable])
    return text.rlike(any_of(usable))


def first_term(text: Column, terms: list[str]) -> Column:
    """Term with the leftmost start, the shortest one there; null when none occurs."""
    pattern = any_of(_usable(terms))
    if pattern is None:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def start_of(text: Column, term: Column) -> Column:
    """0-based offset of the term's first occurrence; null when the term is null.

    For the result of `first_term` this is the match position: an earlier occurrence
    of the same term would itself have been the leftmost match.
    """
    return F.when(term.isNotNull(), F.instr(text, term) - 1)


def count_all(text: Column, terms: list[str]) -> Column:
    """Number of (term, start) occurrences, overlapping and nested ones included."""
    total = F.when(text.isNotNull(), F.lit(0))
    for level in nesting_levels(_usable(terms)):
        # A look-ahead consumes nothing, so every start is tried.
        total = total + F.regexp_count(text, F.lit(f"{begins_like(level)}(?={alternation(level)})"))
    return total


def all_hits(text: Column, terms: list[str]) -> Column:
    """Array of (start, term) for every occurrence, overlapping and nested included.

    One pass per nesting level: each character yields the term starting there or an
    empty string, so the array index is the offset in characters.
    """
    none = F.array().cast("array<struct<start:int,term:string>>")
    hits = F.when(text.isNotNull(), none)
    for level in nesting_levels(_usable(terms)):
        pattern = f"{begins_like(level)}{alternation(level)}"
        starts = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({pattern}))?."), F.lit(1))
        pairs = F.transform(starts, lambda t, i: F.struct(i.alias("start"), t.alias("term")))
        found = F.filter(pairs, lambda h: h["term"] != "")
        hits = F.concat(hits, F.when(text.rlike(pattern), found).otherwise(none))
    return hits


def beginnings(terms: list[str]) -> dict[str, list[str]]:
    """For each term the terms that it begins with, itself included."""
    out: dict[str, list[str]] = {}
    begun: list[str] = []
    for term in sorted({t for t in terms if t}):
        while begun and not term.startswith(begun[-1]):
            begun.pop()
        begun.append(term)
        out[term] = list(begun)
    return out


def contained(text: Column, terms: list[str]) -> Column:
    """The terms that occur anywhere, once each, in lexicon order (null for null text)."""
    terms = [t for t in dict.fromkeys(terms) if t]
    none = F.array().cast("array<string>")
    if not terms:
        return F.when(text.isNotNull(), none)
    if len(terms) <= 64:
        found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
        return F.when(text.isNotNull(), found) if len(terms) <= FEW else F.when(occurs(text, terms), found).when(text.isNotNull(), none)
    order = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])
    distinct = F.array_distinct(F.transform(all_hits(text, terms), lambda h: h["term"]))
    ranked = F.array_sort(F.transform(
        distinct, lambda t: F.struct(F.element_at(order, t).alias("pos"), t.alias("term"))))
    return F.when(text.isNotNull(), F.transform(ranked, lambda r: r["term"]))


def fuzzy_bounds(length: Column, cutoff: float) -> tuple[Column, Column]:
    """For a term's length: the edits that a window of the cutoff's similarity may need, and the longest such window."""
    slack = 1.0 - cutoff / 100.0
    longest = F.floor(length / (1.0 - slack) + 1e-9).cast("int") if slack < 1 else length
    return F.floor(slack * longest + 1e-9).cast("int"), longest


def word_windows(words: Column, n: int) -> Column:
    """The distinct windows of n words."""
    if n == 1:
        return F.array_distinct(words)
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    cut = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(words) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def fuzzy_term(text: Column, terms: list[str], cutoff: float) -> Column:
    """Best (similarity, rank, term) among terms of a similarity of at least `cutoff`.

    Similarity is 100 * (1 - edit distance / longer length), taken over the windows of
    as many words as the term has; ties go to the earlier term. A term within k edits
    of a window shares at least one of any k+1 pieces of it with the text, so terms
    without such a piece in the text are left out before any distance is computed.
    """
    slack = 1.0 - cutoff / 100.0
    entries = []
    for order, term in enumerate(dict.fromkeys(terms)):
        # longest window that can still reach the cutoff, and the edits it may need
        longest = int(len(term) / (1.0 - slack) + 1e-9) if slack < 1 else len(term)
        edits = int(slack * longest + 1e-9)
        if not term:
            continue
        step = max(1, len(term) // (edits + 1))
        cuts = [term[i * step:(i + 1) * step] for i in range(edits)] + [term[edits * step:]]
        entries.append((order, term, len(term.split(" ")), edits, [c for c in cuts if c]))
    if not entries:
        return F.lit(None).cast("struct<similarity:double,rank:int,term:string>")

    def candidates(n: int) -> Column:
        return F.array(*[
            F.struct(F.lit(-o).alias("rank"), F.lit(t).alias("term"), F.lit(k).alias("edits"),
                     F.array(*map(F.lit, cuts)).alias("pieces"))
            for o, t, m, k, cuts in entries if m == n])

    def similarity(cuts: Column, c: Column) -> Column:
        term, edits = c["term"], c["edits"]
        close = F.filter(cuts, lambda w: (F.abs(F.length(w) - F.length(term)) <= edits) & F.exists(c["pieces"], lambda p: F.contains(w, p)))

        def one(w: Column) -> Column:
            distance = F.nullif(F.call_function("levenshtein", w, term, edits), F.lit(-1))
            return F.lit(100.0) * (1 - distance / F.greatest(F.length(w), F.length(term)))

        return F.array_max(F.transform(close, one))

    def scored(words: Column, n: int) -> Column:
        near = F.filter(candidates(n), lambda c: F.exists(c["pieces"], lambda p: F.contains(text, p)))
        return let(word_windows(words, n), lambda cuts: F.transform(near, lambda c: F.struct(
            similarity(cuts, c).alias("similarity"), c["rank"].alias("rank"), c["term"].alias("term"))))

    def best(words: Column) -> Column:
        every = F.concat(*[scored(words, n) for n in sorted({e[2] for e in entries})])
        return F.array_max(F.filter(every, lambda s: s["similarity"] >= cutoff))

    any_piece = any_of(p for e in entries for p in e[4])
    return F.when(text.rlike(any_piece), let(F.split(text, " "), best))
