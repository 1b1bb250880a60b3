"""Column expressions over message text. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsieve.config import (
    EMAIL_PATTERN, PHONE_PATTERN, REPEAT_PATTERN, TERM_BOUNDARY, URL_PATTERN, WS, ScriptProfile,
)
from chatsieve.functions.patterns import begins_like, quote

# Noncharacters, reserved for use inside a program and so absent from real text.
_OPEN, _CLOSE = "\uFDD0", "\uFDD1"


def _members(char_class: str) -> str:
    """All characters of a class written as `\\x{h}` and `\\x{h}-\\x{h}`."""
    ranges = re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", char_class)
    return "".join(chr(c) for low, high in ranges for c in range(int(low, 16), int(high or low, 16) + 1))


def strip_ws(text: Column) -> Column:
    """Without white space at both ends; the inside isn't looked at."""
    return F.btrim(text, F.lit(_members(WS)))


# The same classes with a range in front that decides most characters, as members of a class are tested one after another.
_WHITE = rf"[[\x{{0}}-\x{{20}}\x{{85}}-\x{{3000}}]&&[{WS}]]"
_INK = rf"[\x{{21}}-\x{{84}}[^{WS}]]"


def collapse_ws(text: Column) -> Column:
    """Each run of white space as one space. Runs that are one already, as most are, need no replacement."""
    return F.regexp_replace(text, f"{_WHITE}(?:(?<! )|{_WHITE}){_WHITE}*", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_INK}+"))


def norm_word_count(text: Column) -> Column:
    """Word count of normalized text, whose only white space is the plain space."""
    return F.regexp_count(text, F.lit("[^ ]+"))


def share_of(text: Column, char_class: str) -> Column:
    """Share of the characters of `text` that fall into the class; 0 for empty text."""
    hits = F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))
    return hits / F.greatest(F.length(text), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column, profile: ScriptProfile) -> Column:
    out = F.lower(F.trim(collapse_ws(text)))
    if profile.fold_from:
        out = F.translate(out, profile.fold_from, profile.fold_to)
    if profile.strip:
        out = F.regexp_replace(out, f"[{profile.strip}]", "")
    return out


def replace_terms(text: Column, mapping: dict[str, str]) -> Column:
    """Replace each bounded occurrence of a key by its value, in one pass.

    Longer keys win at the same place, and replaced text is not looked at again.
    """
    keys = sorted((k for k in mapping if k), key=len, reverse=True)
    if not keys:
        return text
    # first characters and letters before go first: they rule out most places at once
    pattern = rf"{begins_like(keys)}(?<![a-z])(?<![^{TERM_BOUNDARY}])({'|'.join(map(quote, keys))})(?=$|[{TERM_BOUNDARY}])"
    lookup = F.create_map(*[F.lit(x) for k in keys for x in (k, mapping[k])])
    safe = F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, "")).otherwise(text)

    def swap(piece: Column) -> Column:
        return F.concat(
            F.element_at(lookup, F.substring_index(piece, _CLOSE, 1)),
            F.substring(piece, F.instr(piece, _CLOSE) + 1, F.length(piece)),
        )

    return let(
        F.split(F.regexp_replace(safe, pattern, f"{_OPEN}$1{_CLOSE}"), _OPEN),
        lambda pieces: F.concat(
            pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), swap), "")),
    )


def emoji_runs(text: Column, emoji_class: str) -> Column:
    """Runs of characters of a class in `\\x{h}` notation. One comparison with its lowest member comes first, as most characters lie below it."""
    lowest = min(_members(emoji_class))
    return F.regexp_count(text, F.lit(rf"(?=[\x{{{ord(lowest):X}}}-\x{{10FFFF}}]){emoji_class}+"))


def url_count(text: Column) -> Column:
    """Every URL head has a slash or `www.`, so texts without either are done."""
    return F.when(text.contains("/") | text.contains("www."), F.regexp_count(text, F.lit(URL_PATTERN))).when(text.isNotNull(), 0)


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE_PATTERN)


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(EMAIL_PATTERN)


def has_repeat(text: Column) -> Column:
    return text.rlike(REPEAT_PATTERN)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truncate(text: Column, limit: int) -> Column:
    """Whole text up to the limit, else limit-1 characters and three dots."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("..."))
    )
