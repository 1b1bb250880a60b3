"""The triage of messages: gates, matches, score, decision.

One projection per stage over the message rows. A row that a gate has decided carries
null text into the later stages, so that their regular expressions are skipped. Text
never shuffles: only the content hash and the finished result rows do, for the
duplicate gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.config import ARABIC, DEFAULT_TERM_WEIGHT, ScriptProfile, TriageConfig
from chatsieve.functions import matching as M
from chatsieve.functions import text as X
from chatsieve.operators.matching import lookup
from chatsieve.operators.ordered import mark_first
from chatsieve.operators.scoring import ad_block, ad_score, first_band, negation_scope, proximity
from chatsieve.operators.text import is_script, prefilter_reason, spam_value, validity_reason
from chatsieve.plans.lexicon import TriageLexicon

RESULT_COLUMNS = (
    "valid", "reason", "keyword", "score", "match_score", "spam_score", "language", "lang_conf", "word_count",
    "context_boost", "indirect", "urgent", "context_type", "context_confidence", "decision", "confidence",
    "reasons", "score_details", "intent_verb", "academic_object", "urgency_marker", "negation_detected",
    "advert_score", "key_phrases", "fuzzy_matched",
)


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def triage(
    msgs: DataFrame, lex: TriageLexicon, keys: list[str], order: list[str],
    cfg: TriageConfig = TriageConfig(), profile: ScriptProfile = ARABIC,
    text: str = "text", content_dedup: bool = True,
    known_content: DataFrame | None = None, keep_content: bool = False,
) -> DataFrame:
    """Triage result per message: the key and order columns plus `RESULT_COLUMNS`.

    `order` decides which of several messages with equal normalized text is the first one;
    the others end as duplicates. It must tell messages apart. `known_content` (content_hash)
    holds what earlier batches have seen.
    """
    carried = list(dict.fromkeys([*keys, *order]))
    df = _clean(msgs.select(*carried, F.col(text).alias("_raw")), cfg, profile, lex)
    df = _cheap_gates(df, carried, cfg, profile)
    df = _matches(df, carried, lex, cfg)
    df = _scores(df, carried, lex, cfg)
    results = _decide(df, carried, lex, cfg, profile)
    if not content_dedup:
        return results.drop("_content", "_passed")
    return _mark_duplicates(results, carried, order, known_content, keep_content)


def _clean(df: DataFrame, cfg: TriageConfig, profile: ScriptProfile, lex: TriageLexicon) -> DataFrame:
    trimmed = df.withColumn("_trimmed", X.strip_ws(F.col("_raw")))
    checked = trimmed.withColumn("_invalid", validity_reason(F.col("_raw"), F.col("_trimmed"), cfg))
    norm = X.normalize(F.when(F.col("_invalid").isNull(), F.col("_trimmed")), profile)
    cleaned = checked.withColumn("_norm", norm).drop("_raw", "_trimmed")
    if lex.dialect:
        cleaned = cleaned.withColumn(
            "_norm", X.replace_terms(F.col("_norm"), lex.dialect))
    return cleaned


def _cheap_gates(df: DataFrame, carried: list[str], cfg: TriageConfig, profile: ScriptProfile) -> DataFrame:
    norm = F.col("_norm")
    df = df.withColumns({
        "_words": X.norm_word_count(norm),
        "_emoji": X.emoji_runs(norm, cfg.emoji_class),
        "_block_ratio": X.share_of(norm, profile.block),
    })
    pre = prefilter_reason(norm, F.col("_words"), F.col("_emoji"), F.col("_block_ratio"), cfg)
    early = F.coalesce("_invalid", pre) if cfg.prefilter_enabled else F.col("_invalid")
    df = df.withColumn("_early", early)
    df = df.withColumn("_t", F.when(F.col("_early").isNull(), norm))
    t = F.col("_t")
    return df.withColumns({
        "_content": F.sha2("_t", 256),
        "_ratio": F.col("_block_ratio") if profile.letters == profile.block else X.share_of(t, profile.letters),
        "_spam": spam_value(X.has_phone(t), X.url_count(t), F.col("_emoji"), X.has_repeat(t)),
    }).drop("_norm", "_invalid", "_emoji", "_block_ratio")


def _matches(df: DataFrame, carried: list[str], lex: TriageLexicon, cfg: TriageConfig) -> DataFrame:
    t = F.col("_t")

    def occurs(name: str, where: Column) -> Column:
        return M.occurs(where, lex.terms(name))

    gates = (
        F.when(F.col("_early").isNotNull(), None)
        .when(F.lit(cfg.language_filter) & ~is_script(F.col("_ratio")), "non_arabic")
        .when(F.col("_spam") > cfg.spam_threshold, "spam_detected")
        .when(occurs("spam", t), "spam_pattern")
        .when(occurs("ignore", t), "ignore_pattern")
        .when(occurs("ad_blocker", t), "ad_blocker")
    )
    df = df.withColumn("_gate", gates)
    df = df.withColumn("_t", F.when(F.col("_gate").isNull(), F.col("_t")))
    df = df.withColumns({
        "_exact": M.first_term(t, lex.terms("request")),
        "_indirect": M.first_term(t, lex.terms("indirect")),
        "_urgency": M.first_term(t, lex.terms("urgency")),
        "_implicit": M.first_term(t, lex.terms("implicit")),
        "_boost": M.first_term(t, lex.terms("boost")),
        "_object": M.first_term(t, lex.terms("context")),
        "_n_context": M.count_all(t, lex.terms("context")),
        "_grammar": occurs("subject", t) | occurs("action", t),
    })
    if cfg.fuzzy_enabled:
        df = df.withColumn("_open", F.when(F.col("_exact").isNull(), t))
        df = df.withColumn("_fuzzy", M.fuzzy_term(F.col("_open"), lex.terms("intent"), cfg.fuzzy_cutoff)["term"])
    else:
        df = df.withColumn("_fuzzy", F.lit(None).cast("string"))
    return df.withColumns({
        "_intent": F.coalesce("_exact", "_fuzzy"),
        "_intent_start": F.when(F.col("_exact").isNotNull(), M.start_of(t, F.col("_exact")))
        .when(F.col("_fuzzy").isNotNull(), 0),
        "_object_start": M.start_of(t, F.col("_object")),
    })


def _scores(df: DataFrame, carried: list[str], lex: TriageLexicon, cfg: TriageConfig) -> DataFrame:
    t = F.col("_t")
    if cfg.negation_enabled:
        df = negation_scope(df, lex, cfg, "_t", "_intent_start")
    else:
        df = df.withColumns({"negated": F.lit(False), "negation_score": F.lit(0.0),
                             "negation_reason": F.lit(None).cast("string")})
    if cfg.ad_detection_enabled:
        df = ad_score(df, lex, cfg, "_t")
    else:
        df = df.withColumns({"advert_score": F.lit(0.0), "advert_reasons": _no_texts()})
    df = ad_block(df, lex, cfg, "_t")
    exact_weight = lookup(F.col("_exact"), lex.intent_weights, DEFAULT_TERM_WEIGHT)
    fuzzy_weight = lookup(F.col("_fuzzy"), lex.intent_weights, DEFAULT_TERM_WEIGHT) * cfg.fuzzy_discount
    df = df.withColumns({
        "_w_intent": F.coalesce(exact_weight, fuzzy_weight, F.lit(0.0)),
        "_w_object": F.coalesce(lookup(F.col("_object"), lex.object_weights, DEFAULT_TERM_WEIGHT), F.lit(0.0)),
        "_keyword": F.coalesce("_intent", "_indirect"),
        "_length": first_band(F.col("_words"), lex.length_bands, F.lit(0.9)),
        "_distance": proximity(F.col("_intent_start"), F.col("_object_start"), F.col("_intent").isNotNull(),
                               F.length(t), lex.distance_bands),
        "_ad": F.coalesce("advert_score", F.lit(0.0)),
    })
    legacy = (
        F.when(F.col("_intent").isNotNull(), cfg.score_direct).otherwise(0)
        + F.col("_boosted")
        + F.when(F.col("_urgency").isNotNull(), cfg.score_urgency).otherwise(0)
        + F.when(F.col("_indirect").isNotNull() & F.col("_intent").isNull(), cfg.score_indirect).otherwise(0)
    )
    df = df.withColumn("_boosted", F.least(F.col("_n_context") * 5, F.lit(cfg.score_context_max)))
    df = df.withColumn("_legacy", legacy)
    parts = (
        (F.col("_w_intent"), cfg.weight_intent),
        (F.col("_w_object"), cfg.weight_object),
        (F.when(F.col("_grammar"), 1.0).otherwise(0.0), cfg.weight_grammar),
        (F.col("_distance"), cfg.weight_distance),
        (F.when(F.col("_urgency").isNotNull(), 1.0).otherwise(0.0), cfg.weight_urgency),
        (F.least(F.col("_n_context") / 3.0, F.lit(1.0)), cfg.weight_context),
    )
    total = sum(w for _, w in parts) or 1.0
    weighted = sum((c * w for c, w in parts[1:]), parts[0][0] * parts[0][1]) / total
    weighted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted))
    df = df.withColumn("_weighted", weighted if cfg.distance_scoring_enabled else F.lit(None).cast("double"))
    base = F.coalesce((F.col("_legacy") / 100.0 + F.col("_weighted")) / 2.0, F.col("_legacy") / 100.0)
    conf = base * F.col("_length")
    conf = F.when(F.col("negated"), conf * (1 - F.col("negation_score") * 0.7)).otherwise(conf)
    conf = conf * (1 - F.col("_ad") * 0.9)
    conf = F.when(F.col("_boost").isNotNull(), conf + 0.25).otherwise(conf)
    return df.withColumn("_conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))


def _decide(
    df: DataFrame, carried: list[str], lex: TriageLexicon, cfg: TriageConfig, profile: ScriptProfile
) -> DataFrame:
    negated, neg_score, neg_reason = F.col("negated"), F.col("negation_score"), F.col("negation_reason")
    ad = F.col("_ad")
    # How the row ended: an early or later gate, or the scored path.
    df = df.withColumn("_stop", F.coalesce(
        "_early", "_gate",
        F.when(negated & (neg_score > 0.7), F.lit("<negation>"))
        .when(ad > 0.6, F.lit("<ad>"))
        .when(F.col("block_reason").isNotNull(), F.lit("<block>"))
        .when(F.col("_keyword").isNull(), F.lit("<no_keyword>")),
    ))
    stop = F.col("_stop")
    scored = stop.isNull()
    soft = stop.isin("<negation>", "<ad>")      # ends with a confidence of its own
    quiet = stop.isin("<block>", "<no_keyword>")  # ends without reasons
    analysed = F.col("_early").isNull()
    decision = (
        F.when(~scored, "ignore")
        .when(F.col("_conf") >= cfg.accept_threshold, "accept")
        .when(F.col("_conf") >= cfg.review_threshold, "review")
        .otherwise("ignore")
    )
    gate_conf = F.when(stop == "<negation>", 1.0 - neg_score).when(stop == "<ad>", 1.0 - ad).otherwise(0.0)
    end_reason = (
        F.when(stop == "<negation>", neg_reason).when(stop == "<ad>", F.get("advert_reasons", F.lit(0)))
        .when(stop == "<block>", F.col("block_reason")).when(stop == "<no_keyword>", "no_keyword").otherwise(stop))

    def tag(label: str, term: str) -> Column:
        one = F.array(F.concat(F.lit(f"{label}: "), F.col(term)))
        return F.when(F.col(term).isNotNull(), one).otherwise(_no_texts())

    reasons = F.concat(
        tag("intent_verb", "_intent"), tag("academic_object", "_object"), tag("urgency", "_urgency"),
        F.when(F.col("_implicit").isNotNull(), F.array(F.lit("implicit_request"))).otherwise(_no_texts()),
        F.when(negated, F.array(neg_reason)).otherwise(_no_texts()),
        F.when(ad > 0.3, F.col("advert_reasons")).otherwise(_no_texts()),
        tag("template_boost", "_boost"),
    )
    detail = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    details = F.create_map(
        F.lit("legacy_score"), detail(F.col("_legacy") / 100.0),
        F.lit("weighted_score"), detail(F.col("_weighted")),
        F.lit("intent_weight"), detail(F.col("_w_intent")),
        F.lit("academic_weight"), detail(F.col("_w_object")),
        F.lit("grammar_score"), detail(F.when(F.col("_grammar") & F.lit(cfg.distance_scoring_enabled), 1.0)),
        F.lit("distance_score"), detail(
            F.col("_distance") if cfg.distance_scoring_enabled else F.lit(0.0)),
        F.lit("length_modifier"), detail(F.col("_length")),
    )
    phrases = F.filter(F.array("_intent", "_object", "_boost"), lambda p: p.isNotNull())
    when_scored = lambda value, other: F.when(scored, value).otherwise(other)
    none = F.lit(None).cast("string")
    columns = {
        "valid": scored & (F.col("_legacy") >= cfg.score_min_valid) & (decision != "ignore"),
        "reason": when_scored(
            F.when(F.col("_intent").isNotNull(), "keyword_found").otherwise("indirect_request"), end_reason),
        "keyword": when_scored(F.col("_keyword"), none),
        "score": when_scored(F.col("_legacy"), (gate_conf * 100).cast("int")),
        "match_score": gate_conf,
        "spam_score": F.when(quiet, ad).otherwise(0.0),
        "language": F.when(analysed & is_script(F.col("_ratio")), profile.name).otherwise("unknown"),
        "lang_conf": F.when(analysed, F.col("_ratio")).otherwise(0.0),
        "word_count": F.when(analysed, F.col("_words")).otherwise(0),
        "context_boost": when_scored(F.col("_boosted"), 0),
        "indirect": scored & F.col("_indirect").isNotNull() & F.col("_intent").isNull(),
        "urgent": scored & F.col("_urgency").isNotNull(),
        "context_type": when_scored(
            F.when(F.col("_n_context") > 0, "academic_request")
            .when(F.col("_urgency").isNotNull(), "urgent_request").otherwise("direct_request"), "general"),
        "context_confidence": when_scored(
            F.when(F.col("_n_context") > 0, 0.90).when(F.col("_urgency").isNotNull(), 0.85).otherwise(0.75),
            F.when(quiet, 0.5).otherwise(gate_conf)),
        "decision": decision,
        "confidence": when_scored(F.col("_conf"), gate_conf),
        "reasons": when_scored(reasons, F.when(stop == "<ad>", F.col("advert_reasons"))
                               .when(quiet, _no_texts()).otherwise(F.array(end_reason))),
        "score_details": F.when(scored, details).otherwise(F.create_map().cast("map<string,double>")),
        "intent_verb": when_scored(F.col("_intent"), none),
        "academic_object": when_scored(F.col("_object"), none),
        "urgency_marker": when_scored(F.col("_urgency"), none),
        "negation_detected": scored & F.coalesce(negated, F.lit(False)),
        "advert_score": when_scored(ad, F.lit(0.0)),
        "key_phrases": when_scored(phrases, _no_texts()),
        "fuzzy_matched": scored & F.col("_fuzzy").isNotNull(),
    }
    return df.select(*carried, *[c.alias(n) for n, c in columns.items()],
                     F.col("_content"), analysed.alias("_passed"))


def _mark_duplicates(
    results: DataFrame, carried: list[str], order: list[str], known: DataFrame | None, keep_content: bool
) -> DataFrame:
    """End all but the first message of equal content as duplicates.

    Messages that failed before the duplicate gate have no content hash; each of them is
    a group of its own.
    """
    keyed = results.withColumn("_group", F.coalesce("_content", F.concat_ws(
        "/", F.lit("-"), *[F.col(c).cast("string") for c in carried])))
    marked = mark_first(keyed, ["_group"], order)
    again = ~F.col("is_first")
    if known is not None:
        # on the group, which is never null: rows without a hash stay spread out
        seen = known.select(F.col("content_hash").alias("_group")).distinct().withColumn("_seen", F.lit(True))
        marked = marked.join(seen, "_group", "left")
        again = again | F.col("_seen").isNotNull()
    repeat = again & F.col("_passed")
    empty = {
        "valid": F.lit(False), "reason": F.lit("duplicate"), "keyword": F.lit(None).cast("string"),
        "score": F.lit(0), "match_score": F.lit(0.0), "spam_score": F.lit(0.0), "context_boost": F.lit(0),
        "indirect": F.lit(False), "urgent": F.lit(False), "context_type": F.lit("general"),
        "context_confidence": F.lit(0.0), "decision": F.lit("ignore"), "confidence": F.lit(0.0),
        "reasons": F.array(F.lit("duplicate")), "score_details": F.create_map().cast("map<string,double>"),
        "intent_verb": F.lit(None).cast("string"), "academic_object": F.lit(None).cast("string"),
        "urgency_marker": F.lit(None).cast("string"), "negation_detected": F.lit(False),
        "advert_score": F.lit(0.0), "key_phrases": _no_texts(), "fuzzy_matched": F.lit(False),
    }
    final = marked.withColumns({n: F.when(repeat, v).otherwise(F.col(n)) for n, v in empty.items()})
    content = [F.col("_content").alias("content_hash")] if keep_content else []
    return final.select(*carried, *RESULT_COLUMNS, *content)


def triage_report(results: DataFrame) -> DataFrame:
    """One row of totals over triage results."""
    reason, decision = F.col("reason"), F.col("decision")
    passed = ~(
        reason.isin("too_long", "invalid_input", "empty_or_too_short", "low_arabic_ratio", "duplicate")
        | reason.startswith("too_few_words_") | reason.startswith("too_many_emojis_"))
    prefiltered = (
        reason.isin("empty_or_too_short", "low_arabic_ratio")
        | reason.startswith("too_few_words_") | reason.startswith("too_many_emojis_"))
    scored = reason.isin("keyword_found", "indirect_request")
    counts = results.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(passed).alias("processed"),
        F.count_if(F.col("valid")).alias("valid"),
        F.count_if(scored & ~F.col("valid")).alias("rejected"),
        F.count_if(reason.isin("spam_detected", "spam_pattern")).alias("spam"),
        F.count_if(prefiltered).alias("prefilter_rejected"),
        F.count_if(reason == "duplicate").alias("duplicates"),
        F.count_if(F.col("fuzzy_matched")).alias("fuzzy"),
        F.count_if(decision == "accept").alias("accepted"),
        F.count_if(decision == "review").alias("reviewed"),
        F.count_if(decision == "ignore").alias("ignored"),
    )
    rate = F.when(F.col("processed") > 0, F.col("valid") * 100.0 / F.col("processed")).otherwise(0.0)
    return counts.withColumn("hit_rate", rate)
