"""Scores and scopes computed from lexicon matches in one normalized text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.config import TriageConfig
from chatsieve.functions import matching as M
from chatsieve.functions import text as X
from chatsieve.plans.lexicon import Band, TriageLexicon

DEFAULTS = TriageConfig()


# --- negation ---------------------------------------------------------------
def negation_scope(
    df: DataFrame, lex: TriageLexicon, cfg: TriageConfig = DEFAULTS,
    text: str = "norm_text", intent_start: str = "intent_start",
) -> DataFrame:
    """Add negated, negation_score and negation_reason, evaluated in list order.

    A resolution phrase settles it (1.0). Then the first post-clause negator in the list
    that occurs (0.8), unless an exception phrase occurs too. Then the first pre-verb
    negator in the list that occurs: an exception phrase, or a clause boundary before it,
    ends the search without negation; more than the scope's number of spaces between it
    and the intent moves on to the next negator; else it negates (0.6).
    """
    boundaries = lex.terms("clause_boundary") if cfg.clause_boundaries_enabled else []
    start = F.col(intent_start)
    # One scan tells whether any of the terms is there at all; most texts stop here.
    some = lex.terms("resolution") + lex.terms("post_negator") + lex.terms("pre_negator")
    df = df.withColumn("_said", F.when(M.occurs(F.col(text), some), F.col(text)))
    said = F.col("_said")
    df = df.withColumns({
        "_resolution": M.first_term(said, lex.terms("resolution")),
        "_post": F.get(M.contained(said, lex.terms("post_negator")), F.lit(0)),
        "_excepted": F.coalesce(M.occurs(said, lex.terms("negation_exception")), F.lit(False)),
        "_pre_all": M.contained(said, lex.terms("pre_negator")),
    })

    def weigh(negator: Column) -> Column:
        at = F.instr(said, negator) - 1
        between = F.substring(said, F.least(at, start) + 1, F.abs(start - at))
        spaces = F.length(between) - F.length(F.replace(between, F.lit(" "), F.lit("")))
        out_of_scope = start.isNotNull() & (spaces > cfg.negation_scope_tokens)
        blocked = F.col("_excepted") | M.occurs(F.substring(said, F.lit(1), at), boundaries)
        return F.when(blocked, F.lit("")).when(~out_of_scope, negator)

    judged = F.filter(F.transform("_pre_all", weigh), lambda r: r.isNotNull())
    df = df.withColumn("_pre", F.get(judged, F.lit(0)))
    is_post = F.col("_post").isNotNull() & F.col("_resolution").isNull()
    score = (
        F.when(F.col("_resolution").isNotNull(), 1.0)
        .when(is_post, F.when(F.col("_excepted"), 0.0).otherwise(0.8))
        .when(F.col("_pre") != "", 0.6).otherwise(0.0))
    df = df.withColumn("negation_score", F.when(F.col(text).isNotNull(), score))
    reason = (
        F.when(F.col("negation_score") == 1.0, F.concat(F.lit("resolution_phrase: "), "_resolution"))
        .when(F.col("negation_score") == 0.8, F.concat(F.lit("post_clause_negator: "), "_post"))
        .when(F.col("negation_score") == 0.6, F.concat(F.lit("pre_verb_negator: "), "_pre")))
    return df.withColumns({"negated": F.col("negation_score") > 0, "negation_reason": reason}).drop(
        "_said", "_resolution", "_post", "_excepted", "_pre_all", "_pre")


# --- advertisement ----------------------------------------------------------
def ad_hits(text: Column, lex: TriageLexicon) -> Column:
    """struct of the ad terms found, one array per kind, in list order."""
    kinds = ("hard_signal", "medium_signal", "strong_provider", "individual_provider", "weak_provider",
             "cta_signal", "payment", "institution", "ad_blocker", "ad_emoji")
    return F.struct(*[M.contained(text, lex.terms(k)).alias(k) for k in kinds])


def ad_steps(hits: Column, cfg: TriageConfig) -> Column:
    """array of (score step, reason) in the order in which the steps add up."""
    n = lambda kind: F.size(hits[kind])
    own_provider = (n("strong_provider") > 0) | (n("individual_provider") > 0)
    none = F.array().cast("array<struct<step:double,reason:string>>")

    def each(kind: str, label: str, step: float) -> Column:
        return F.transform(hits[kind], lambda t: F.struct(
            F.lit(step).alias("step"), F.concat(F.lit(f"{label}: "), t).alias("reason")))

    def single(step: float, reason: Column) -> Column:
        return F.array(F.struct(F.lit(step).alias("step"), reason.alias("reason")))

    provider = (
        F.when(own_provider, single(0.3, F.lit("provider_detected")))
        .when(n("weak_provider") >= cfg.weak_provider_threshold, single(0.25, F.lit("weak_provider_multiple")))
        .otherwise(none))
    emoji = F.when(
        n("ad_emoji") >= cfg.ad_emoji_threshold,
        single(0.2, F.concat(F.lit("ad_emoji_count: "), n("ad_emoji").cast("string")))).otherwise(none)
    return F.concat(
        each("hard_signal", "hard_ad_signal", 0.4),
        each("medium_signal", "medium_ad_signal", 0.2),
        provider,
        each("cta_signal", "cta_signal", 0.1),
        F.when(own_provider, each("payment", "payment_signal", 0.1)).otherwise(none),
        each("institution", "institution_term", 0.15),
        each("ad_blocker", "url_signal", 0.2),
        emoji,
    )


def ad_total(steps: Column) -> Column:
    """The steps added up one by one (so that rounding is that of a running sum), at most 1."""
    total = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["step"])
    return F.when(total < 1.0, total).when(total.isNotNull(), 1.0)


def ad_terms(lex: TriageLexicon) -> list[str]:
    kinds = ("hard_signal", "medium_signal", "strong_provider", "individual_provider", "weak_provider",
             "cta_signal", "payment", "institution", "ad_blocker", "ad_emoji")
    return [t for k in kinds for t in lex.terms(k)]


def ad_score(
    df: DataFrame, lex: TriageLexicon, cfg: TriageConfig = DEFAULTS, text: str = "norm_text"
) -> DataFrame:
    """Add advert_score (0..1) and advert_reasons."""
    # Most texts hold no ad term at all: one scan decides that before the per-kind work.
    suspect = F.when(M.occurs(F.col(text), ad_terms(lex)), F.col(text))
    df = df.withColumn("_suspect", suspect)
    df = df.withColumn("_hits", F.when(F.col("_suspect").isNotNull(), ad_hits(F.col("_suspect"), lex)))
    df = df.withColumn("_steps", ad_steps(F.col("_hits"), cfg))
    return df.withColumns({
        "advert_score": F.when(F.col(text).isNotNull(), F.coalesce(ad_total(F.col("_steps")), F.lit(0.0))),
        "advert_reasons": F.coalesce(
            F.transform("_steps", lambda s: s["reason"]), F.array().cast("array<string>")),
    }).drop("_suspect", "_hits", "_steps")


def ad_block(df: DataFrame, lex: TriageLexicon, cfg: TriageConfig = DEFAULTS, text: str = "norm_text") -> DataFrame:
    """Add block_reason: advertisement, education_provider, advertisement_emoji or null."""
    def hit(kind: str) -> Column:
        return M.occurs(F.col(text), lex.terms(kind))

    return df.withColumn("block_reason", (
        F.when(hit("advertisement"), "advertisement")
        .when(hit("education"), "education_provider")
        .when(M.occurs(F.col(text), lex.terms("ad_emoji")), "advertisement_emoji")))


# --- distance and length ----------------------------------------------------
def first_band(value: Column, bands: tuple[Band, ...], otherwise: Column) -> Column:
    """Value of the first band, in list order, that holds the number."""
    chain = None
    for band in bands:
        inside = value >= band.low if band.high is None else value.between(band.low, band.high)
        chain = F.when(inside, band.value) if chain is None else chain.when(inside, band.value)
    return otherwise if chain is None else chain.otherwise(otherwise)


def proximity(
    intent_start: Column, object_start: Column, has_intent: Column, text_len: Column, bands: tuple[Band, ...]
) -> Column:
    gap = F.abs(intent_start - object_start)
    default = F.when(
        text_len > 100, F.when(gap <= 10, 0.9).when(gap <= 20, 0.7).otherwise(0.4)
    ).otherwise(F.when(gap <= 5, 1.0).when(gap <= 10, 0.8).otherwise(0.5))
    return (
        F.when(intent_start.isNotNull() & object_start.isNotNull(), first_band(gap, bands, default))
        .when(has_intent, 0.5).otherwise(0.0)
    )


def proximity_score(
    df: DataFrame, bands: tuple[Band, ...] = (), intent_start: str = "intent_start",
    object_start: str = "object_start", text: str = "norm_text",
) -> DataFrame:
    """Add distance_score from the character distance of intent and object."""
    start = F.col(intent_start)
    return df.withColumn("distance_score", proximity(
        start, F.col(object_start), start.isNotNull(), F.length(text), bands))


def length_modifier(df: DataFrame, bands: tuple[Band, ...] = (), text: str = "norm_text") -> DataFrame:
    """Add length_modifier: factor of the first band holding the word count, else 0.9."""
    return df.withColumn("length_modifier", first_band(X.word_count(F.col(text)), bands, F.lit(0.9)))
