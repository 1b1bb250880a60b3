"""Multi-pattern matching of message text against lexicon tables.

Two plans give the same rows. A lexicon within the driver bound becomes one regular
expression per nesting level and is matched where the text is, without any shuffle.
A larger one is joined: the windows of a text first meet the distinct beginnings of the
terms, a much smaller table, and what is left of them meets the terms in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.functions import matching as M
from chatsieve.functions.patterns import longest
from chatsieve.operators.bounds import DRIVER_ROWS, broadcast_if_small, collect_bounded, try_collect

# Characters of literal terms that one pattern may hold before the join takes over.
PATTERN_CHARS = 200_000
# Characters of a text that one row holds while its starts are looked up.
PIECE = 16
# Characters of a term that its windows are looked up by first.
HEAD_CHARS = 4


def _literal_terms(terms: DataFrame, strategy: str) -> list[str] | None:
    if strategy == "join":
        return None
    rows = try_collect(terms.select("term").distinct(), DRIVER_ROWS)
    if rows is None or sum(len(r["term"]) for r in rows) > PATTERN_CHARS:
        return None
    return sorted(r["term"] for r in rows)


def pieces(text: Column, overlap: int) -> Column:
    """The text in pieces of `PIECE` characters, each with the next `overlap` behind it; the array index times `PIECE` is the start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{PIECE + overlap}}})).{{1,{PIECE}}}"), F.lit(1))


def _joined_hits(msgs: DataFrame, terms: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One pass over the text and one row per start and length of a beginning; the beginnings of terms leave few of them."""
    usable = terms.select("term").filter(F.col("term") != "").distinct()
    # One row per distinct term length: bounded by the longest term.
    lengths = sorted(r["n"] for r in collect_bounded(
        usable.select(F.length("term").alias("n")).distinct(), "term lengths"))
    if not lengths:
        return msgs.limit(0).select(*keys, F.lit("").alias("term"), F.lit(0).alias("start"))
    # a term shorter than HEAD_CHARS is its own beginning
    heads = usable.groupBy(F.substring("term", 1, HEAD_CHARS).alias("_head")).agg(F.collect_set(F.length("term")).alias("_sizes"))
    begun = sorted({min(n, HEAD_CHARS) for n in lengths})
    cut = msgs.select(*keys, F.posexplode(pieces(F.col(text), lengths[-1] - 1)).alias("_piece", "_chars")).withColumn("_here", F.length("_chars"))
    at = F.col("_at") + 1
    starts = cut.withColumn("_at", F.explode(F.array(*map(F.lit, range(PIECE))))).filter(F.col("_at") + begun[0] <= F.col("_here"))
    starts = starts.withColumn("_head", F.substring(F.col("_chars"), at, F.lit(begun[0]))).withColumn("_n", F.lit(begun[0]))
    if len(begun) > 1:  # the shortest beginnings go first, so that few starts are tried with the longer ones
        shortest = usable.select(F.substring("term", 1, begun[0]).alias("_head")).distinct()
        starts = starts.join(broadcast_if_small(shortest), "_head").withColumn("_n", F.explode(F.array(*map(F.lit, begun))))
        starts = starts.withColumn("_head", F.substring(F.col("_chars"), at, F.col("_n")))
    met = starts.filter(F.col("_at") + F.col("_n") <= F.col("_here")).select(
        *keys, (F.col("_piece") * PIECE + F.col("_at")).alias("start"), F.substring(F.col("_chars"), at, F.lit(lengths[-1])).alias("_cut"), "_head")
    met = met.join(broadcast_if_small(heads), "_head").withColumn("_n", F.explode("_sizes"))
    whole = met.filter(F.length("_cut") >= F.col("_n")).withColumn("term", F.substring(F.col("_cut"), F.lit(1), F.col("_n")))
    return whole.select(*keys, "term", "start").join(broadcast_if_small(usable), "term").select(*keys, "term", "start")


def match_all(
    msgs: DataFrame, terms: DataFrame, keys: list[str], text: str = "norm_text",
    strategy: str = "auto",
) -> DataFrame:
    """(keys, term, start): every occurrence, overlapping and nested ones included."""
    literal = _literal_terms(terms, strategy)
    if literal is None:
        return _joined_hits(msgs, terms, keys, text)
    pattern = longest(literal)
    if pattern is None:
        return msgs.limit(0).select(*keys, F.lit("").alias("term"), F.lit(0).alias("start"))
    # one pass: terms at one place are beginnings of the longest one there; each character yields a term or an empty string
    found = F.when(F.col(text).rlike(pattern), F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=({pattern}))?."), F.lit(1)))
    hits = msgs.select(*keys, F.posexplode(found).alias("start", "term")).filter(F.col("term") != "")
    nested = M.beginnings(literal)
    if all(len(x) == 1 for x in nested.values()):
        return hits.select(*keys, "term", "start")
    table = msgs.sparkSession.createDataFrame([(t, x) for t, xs in nested.items() for x in xs], "_longest string, term string")
    return hits.withColumnRenamed("term", "_longest").join(F.broadcast(table), "_longest").select(*keys, "term", "start")


def match_first(
    msgs: DataFrame, terms: DataFrame, keys: list[str], text: str = "norm_text",
    strategy: str = "auto",
) -> DataFrame:
    """(keys, term, start) of the leftmost occurrence, the shortest term at that place."""
    literal = _literal_terms(terms, strategy)
    if literal is None:
        hits = _joined_hits(msgs, terms, keys, text)
        best = hits.groupBy(*keys).agg(
            F.min(F.struct("start", F.length("term").alias("n"), "term")).alias("best"))
        return best.select(*keys, "best.term", "best.start")
    found = msgs.withColumn("term", M.first_term(F.col(text), literal))
    return found.filter(F.col("term").isNotNull()).select(
        *keys, "term", M.start_of(F.col(text), F.col("term")).alias("start"))


def match_contains(
    msgs: DataFrame, terms: DataFrame, keys: list[str], text: str = "norm_text", strategy: str = "auto",
) -> DataFrame:
    """(keys, term): the terms that occur anywhere in the text, once each."""
    literal = _literal_terms(terms, strategy)
    if literal is None:
        return _joined_hits(msgs, terms, keys, text).select(*keys, "term").distinct()
    return msgs.select(*keys, F.explode(M.contained(F.col(text), literal)).alias("term"))


def fuzzy_match(
    msgs: DataFrame, intent_terms: DataFrame, request_terms: DataFrame, keys: list[str],
    text: str = "norm_text", cutoff: float = 85.0, discount: float = 0.85, strategy: str = "auto",
) -> DataFrame:
    """Near matches of intent terms in messages without any exact request term.

    `intent_terms` has (term, weight, ord). Gives (keys, term, similarity, weight, start);
    the weight is discounted and the start is 0. Terms of any number: past the driver bound they are joined.
    """
    exact = _literal_terms(request_terms, strategy)
    if exact is None:
        hit = _joined_hits(msgs, request_terms, keys, text).select(*keys).distinct()
        unmatched = msgs.select(*keys, text).join(hit, keys, "left_anti")
    else:
        unmatched = msgs.select(*keys, text).filter(~M.occurs(F.col(text), exact))
    if _literal_terms(intent_terms, strategy) is None:
        return _joined_fuzzy(unmatched, intent_terms, keys, text, cutoff, discount)
    rows = sorted(collect_bounded(intent_terms.select("term", "weight", "ord"), "intent terms"),
                  key=lambda r: r["ord"])
    weights = {r["term"]: r["weight"] for r in rows}
    # Exploding the at most one find, rather than filtering on it, computes it only once.
    found = F.filter(F.array(M.fuzzy_term(F.col(text), list(weights), cutoff)), lambda b: b.isNotNull())
    return unmatched.select(*keys, F.explode(found).alias("best")).select(
        *keys, "best.term", "best.similarity",
        (lookup(F.col("best.term"), weights, 0.7) * discount).alias("weight"), F.lit(0).alias("start"))


def _joined_fuzzy(unmatched: DataFrame, terms: DataFrame, keys: list[str], text: str, cutoff: float, discount: float) -> DataFrame:
    """The same by joins. A term within k edits of a window of words holds one of any k + 1 pieces of it unchanged, so windows meet terms
    by pieces. Each distinct window is compared once, however many messages hold it."""
    edits, longest = M.fuzzy_bounds(F.length("term"), cutoff)
    first = terms.filter(F.col("term") != "").groupBy("term").agg(
        F.min("ord").alias("ord"), F.max_by("weight", "ord").alias("weight")).select(
        "term", "ord", "weight", F.size(F.split("term", " ")).alias("words"), edits.alias("edits"), longest.alias("longest"))
    step = F.greatest(F.lit(1), F.floor(F.length("term") / (F.col("edits") + 1)).cast("int"))
    last = F.col("i") == F.col("edits")
    pieces = first.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits")))).withColumn(
        "piece", F.substring(F.col("term"), F.col("i") * step + 1, F.when(last, F.length("term")).otherwise(step))).filter(F.col("piece") != "")
    # A piece keeps its place but for the edits before it. Word counts and sizes are bounded by the longest term.
    place, size = F.col("i") * step, F.length("term")
    spots = [tuple(r) for r in collect_bounded(pieces.groupBy("words", F.length("piece").alias("n")).agg(
        F.greatest(F.lit(0), F.min(place - F.col("edits"))), F.max(place + F.col("edits")),
        F.min(size - F.col("edits")), F.max(size + F.col("edits"))), "sizes of pieces")]
    words = sorted({r[0] for r in spots})
    if not words:
        return unmatched.limit(0).select(*keys, F.lit("").alias("term"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("weight"), F.lit(0).alias("start"))
    cut = unmatched.withColumn("_words", F.split(text, " "))

    def cut_in(n: int) -> Column:
        return F.transform(M.word_windows(F.col("_words"), n), lambda w: F.struct(F.lit(n).alias("words"), w.alias("window")))

    each = F.explode(F.flatten(F.array(*map(cut_in, words)))).alias("w")
    held = cut.select(*keys, each).select(*keys, "w.words", "w.window")
    distinct = held.select("words", "window").distinct()
    names = ("words", "n", "first", "last", "least", "most")
    spot = F.explode(F.array(*[F.struct(*[F.lit(int(x)).alias(c) for x, c in zip(r, names, strict=True)]) for r in sorted(spots)]))
    some = distinct.withColumn("_s", spot).filter(
        (F.col("_s.words") == F.col("words")) & F.length("window").between(F.col("_s.least"), F.col("_s.most")) & (F.length("window") >= F.col("_s.n") + F.col("_s.first")))
    until = F.least(F.col("_s.last"), F.length("window") - F.col("_s.n"))
    parts = some.withColumn("_at", F.explode(F.sequence(F.col("_s.first"), until))).select(
        "words", "window", F.substring(F.col("window"), F.col("_at") + 1, F.col("_s.n")).alias("piece"))
    near = parts.join(pieces.select("words", "piece", "term", "edits").distinct(), ["words", "piece"]).filter(
        F.abs(F.length("window") - F.length("term")) <= F.col("edits")).select("words", "window", "term", "edits").distinct()
    distance = F.nullif(F.call_function("levenshtein", F.col("window"), F.col("term"), F.col("edits")), F.lit(-1))
    scored = near.withColumn("similarity", F.lit(100.0) * (1 - distance / F.greatest(F.length("window"), F.length("term")))).filter(
        F.col("similarity") >= cutoff)
    ranked = scored.join(first.select("term", "ord", "weight"), "term")
    row = F.struct((-F.col("similarity")).alias("s"), "ord", "term", "weight", "similarity")
    best = ranked.groupBy("words", "window").agg(F.min(row).alias("best"))
    return held.join(best, ["words", "window"]).groupBy(*keys).agg(F.min("best").alias("best")).select(
        *keys, "best.term", "best.similarity", (F.coalesce("best.weight", F.lit(0.7)) * discount).alias("weight"), F.lit(0).alias("start"))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    if not table:
        return F.when(key.isNotNull(), F.lit(default))
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(entries, key), F.lit(default)))
