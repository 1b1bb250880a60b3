"""Text preparation: validation, normalization, signals, gates and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.config import ARABIC, HTML_TAG_PATTERN, ScriptProfile, TriageConfig
from chatsieve.functions import text as X
from chatsieve.operators.bounds import collect_bounded

DEFAULTS = TriageConfig()


def validity_reason(text: Column, trimmed: Column, cfg: TriageConfig) -> Column:
    """Length gate on the raw text, then on the trimmed text; null when valid."""
    return (
        F.when(F.length(text) > cfg.max_len, "too_long")
        .when(text.isNull() | ~F.length(trimmed).between(cfg.min_len, cfg.max_len), "invalid_input")
    )


def validate_messages(df: DataFrame, min_len: int = 10, max_len: int = 5000, text: str = "text") -> DataFrame:
    """Add `invalid_reason`: too_long, invalid_input or null."""
    cfg = TriageConfig(min_len=min_len, max_len=max_len)
    return df.withColumn("invalid_reason", validity_reason(F.col(text), X.strip_ws(F.col(text)), cfg))


def normalize_messages(df: DataFrame, profile: ScriptProfile = ARABIC, text: str = "text") -> DataFrame:
    """Add `norm_text`; the original text stays in its own column."""
    return df.withColumn("norm_text", X.normalize(F.col(text), profile))


def canonicalize_terms(df: DataFrame, dialect: DataFrame | dict[str, str], text: str = "norm_text") -> DataFrame:
    """Replace dialect variants by their canonical form, in one pass over the whole text."""
    if not isinstance(dialect, dict):
        rows = collect_bounded(dialect.select("variant", "canonical"), "dialect map")
        dialect = {r["variant"]: r["canonical"] for r in rows}
    return df.withColumn(text, X.replace_terms(F.col(text), dialect))


def text_signals(
    df: DataFrame, profile: ScriptProfile = ARABIC, cfg: TriageConfig = DEFAULTS, text: str = "text"
) -> DataFrame:
    """Add word, emoji-run and URL counts, phone/e-mail/repeat flags and the script share."""
    whole = F.col(text)
    return df.withColumns({
        "word_count": X.word_count(whole),
        "emoji_runs": X.emoji_runs(whole, cfg.emoji_class),
        "url_count": X.url_count(whole),
        "has_phone": X.has_phone(whole),
        "has_email": X.has_email(whole),
        "has_repeat": X.has_repeat(whole),
        "block_ratio": X.share_of(whole, profile.block),
    })


def prefilter_reason(text: Column, words: Column, emoji: Column, ratio: Column, cfg: TriageConfig) -> Column:
    """First failing check on normalized text, given its counts; null when it passes."""
    return (
        F.when(text.isNull(), None)
        .when(F.length(F.trim(text)) < 2, "empty_or_too_short")
        .when(words < cfg.min_words, F.concat(F.lit("too_few_words_"), words.cast("string")))
        .when(emoji > cfg.max_emojis, F.concat(F.lit("too_many_emojis_"), emoji.cast("string")))
        .when(ratio < cfg.min_block_ratio, "low_arabic_ratio")
    )


def prefilter(
    df: DataFrame, min_words: int = 2, max_emojis: int = 5, min_ratio: float = 0.1,
    profile: ScriptProfile = ARABIC, text: str = "norm_text",
) -> DataFrame:
    """Add `prefilter_reason`, the first failing check on the normalized text, or null."""
    cfg = TriageConfig(min_words=min_words, max_emojis=max_emojis, min_block_ratio=min_ratio)
    counted = df.withColumns({
        "_words": X.norm_word_count(F.col(text)),
        "_emoji": X.emoji_runs(F.col(text), cfg.emoji_class),
        "_block": X.share_of(F.col(text), profile.block),
    })
    reason = prefilter_reason(F.col(text), F.col("_words"), F.col("_emoji"), F.col("_block"), cfg)
    return counted.withColumn("prefilter_reason", reason).drop("_words", "_emoji", "_block")


def is_script(ratio: Column) -> Column:
    return F.when(ratio > 0.35, True).when(ratio < 0.12, False).otherwise(ratio > 0.25)


def detect_script(df: DataFrame, profile: ScriptProfile = ARABIC, text: str = "norm_text") -> DataFrame:
    """Add `script_ratio` and `is_script` for the profile's letters."""
    ratio = X.share_of(F.col(text), profile.letters)
    return df.withColumn("script_ratio", ratio).withColumn("is_script", is_script(F.col("script_ratio")))


def spam_value(phone: Column, urls: Column, emoji: Column, repeat: Column) -> Column:
    score = (
        F.when(phone, 0.3).otherwise(0.0)
        + F.least(F.lit(0.4), F.coalesce(urls, F.lit(0)) * 0.2)
        + F.least(F.lit(0.2), F.coalesce(emoji, F.lit(0)) * 0.04)
        + F.when(repeat, 0.15).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def spam_score(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Add `spam_score` and `is_spam` to a frame that has the signals of `text_signals`."""
    score = spam_value(F.col("has_phone"), F.col("url_count"), F.col("emoji_runs"), F.col("has_repeat"))
    return df.withColumn("spam_score", score).withColumn("is_spam", F.col("spam_score") > threshold)


def identity_hash(chat_id: Column, message_id: Column, text: Column) -> Column:
    body = X.strip_ws(F.lower(F.coalesce(text, F.lit(""))))
    return F.sha2(F.concat_ws("_", chat_id.cast("string"), message_id.cast("string"), body), 256)


def message_identity(df: DataFrame, profile: ScriptProfile = ARABIC, text: str = "text") -> DataFrame:
    """Add `message_hash` (chat, message and text) and `content_hash` (normalized text)."""
    return df.withColumns({
        "message_hash": identity_hash(F.col("chat_id"), F.col("message_id"), F.col(text)),
        "content_hash": F.sha2(X.normalize(X.strip_ws(F.col(text)), profile), 256),
    })


def chat_links(chat_id: Column, message_id: Column, username: Column) -> tuple[Column, Column]:
    """Group and message link, by public name or by the inner id of a -100... chat."""
    name = F.nullif(F.regexp_replace(username, "^@+", ""), F.lit(""))
    inner = F.nullif(F.regexp_extract(chat_id.cast("string"), r"^-100(.*)$", 1), F.lit(""))
    group = F.when(name.isNotNull(), F.concat(F.lit("https://t.me/"), name)).when(
        inner.isNotNull(), F.concat(F.lit("https://t.me/c/"), inner))
    message = F.concat_ws("/", group, message_id.cast("string"))
    return F.coalesce(group, F.lit("#")), F.when(group.isNotNull(), message).otherwise("#")


def profile_link(sender_id: Column, username: Column, access_hash: Column | None = None) -> Column:
    name = F.nullif(F.regexp_replace(username, "^@+", ""), F.lit(""))
    by_id = F.concat(F.lit("tg://user?id="), sender_id.cast("string"))
    if access_hash is not None:
        opened = F.concat(F.lit("tg://openmessage?user_id="), sender_id.cast("string"))
        by_id = F.when(F.coalesce(access_hash, F.lit(0)) != 0, opened).otherwise(by_id)
    return F.when(name.isNotNull(), F.concat(F.lit("https://t.me/"), name)).when(
        F.coalesce(sender_id, F.lit(0)) != 0, by_id)


def score_bar(score: Column, width: int = 10) -> Column:
    """`[███░░░] n` with `width` cells for 0..100, half cells rounding to even."""
    filled = F.least(F.lit(width), F.bround(score / 100.0 * width).cast("int"))
    filled = F.greatest(filled, F.lit(0))
    cells = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))
    return F.concat(F.lit("["), cells, F.lit("] "), score.cast("string"))


def alert_card(df: DataFrame, text_limit: int = 400, fallback_name: str = "مستخدم") -> DataFrame:
    """Add the presentation columns of an alert: links, display name, safe text, score bar.

    Expects chat_id, message_id, sender_id, chat_username, sender_username,
    sender_first_name, sender_last_name, sender_access_hash, text and score.
    """
    group, message = chat_links(F.col("chat_id"), F.col("message_id"), F.col("chat_username"))
    first = F.coalesce("sender_first_name", F.lit(""))
    last = F.coalesce("sender_last_name", F.lit(""))
    name = X.strip_ws(F.concat(first, F.lit(" "), last))
    fallback = F.concat(F.lit(f"{fallback_name} ("), F.col("sender_id").cast("string"), F.lit(")"))
    return df.withColumns({
        "group_link": group,
        "message_link": message,
        "profile_link": profile_link(F.col("sender_id"), F.col("sender_username"), F.col("sender_access_hash")),
        "display_name": F.coalesce(F.nullif(name, F.lit("")), fallback),
        "safe_text": X.escape_html(X.truncate(F.col("text"), text_limit)),
        "score_bar": score_bar(F.col("score")),
    })


def flag_dangerous_html(df: DataFrame, text: str = "html") -> DataFrame:
    """Add `dangerous_html`: the text holds a script, iframe, object, embed, form or input tag."""
    return df.withColumn("dangerous_html", F.col(text).rlike(HTML_TAG_PATTERN))
