"""Queries over messages, alerts and senders.

Profiles are joined after the page of rows is picked: the join is by a unique sender key,
so it never changes which rows are on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.operators.bounds import broadcast_if_small
from chatsieve.operators.profiles import with_profile

def _newest() -> list[Column]:
    return [F.desc("ts"), F.desc("message_hash")]


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    ordered = df.orderBy(*_newest())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _time_range(df: DataFrame, since: str | None, until: str | None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col("ts") >= F.to_timestamp(F.lit(since)))
    if until is not None:
        df = df.filter(F.col("ts") <= F.to_timestamp(F.lit(until)))
    return df


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _holds(column: str, part: str, case_sensitive: bool) -> Column:
    """Does the text hold `part`? The letters A to Z match in either case unless told otherwise."""
    if case_sensitive:
        return F.contains(column, F.lit(part))
    return F.contains(F.translate(column, _UPPER, _LOWER), F.translate(F.lit(part), _UPPER, _LOWER))


def search_messages(
    messages: DataFrame, contacts: DataFrame, keyword: str | None = None, chat_id: int | None = None,
    sender_id: int | None = None, since: str | None = None, until: str | None = None,
    limit: int = 50, offset: int = 0, case_sensitive: bool = False,
) -> DataFrame:
    df = _time_range(messages, since, until)
    if keyword:  # an empty keyword is in every text
        df = df.filter(_holds("message_text", keyword, case_sensitive))
    if chat_id is not None:
        df = df.filter(F.col("chat_id") == chat_id)
    if sender_id is not None:
        df = df.filter(F.col("sender_id") == sender_id)
    return with_profile(_page(df, limit, offset), contacts).orderBy(*_newest())


def filter_alerts(
    alerts: DataFrame, keyword: str | None = None, account: str | None = None, sender_id: int | None = None,
    since: str | None = None, until: str | None = None, decision: str | None = None,
    min_confidence: float | None = None, case_sensitive: bool = False,
) -> DataFrame:
    df = _time_range(alerts, since, until)
    if keyword:  # an empty keyword is in every text
        df = df.filter(_holds("keyword", keyword, case_sensitive))
    if account:
        df = df.filter(F.col("account_name") == account)
    if sender_id is not None:
        df = df.filter(F.col("sender_id") == sender_id)
    if decision:
        df = df.filter(F.col("decision") == decision)
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= min_confidence)
    return df


def search_alerts(
    alerts: DataFrame, contacts: DataFrame, limit: int = 50, offset: int = 0, **filters
) -> DataFrame:
    return with_profile(_page(filter_alerts(alerts, **filters), limit, offset), contacts).orderBy(*_newest())


def alerts_in_category(alerts: DataFrame, lexicon: DataFrame, category: str | None) -> DataFrame:
    """Alerts whose keyword is a term of the category; all of them if it has no terms."""
    terms = lexicon.filter(F.col("category") == category).select(F.col("term").alias("keyword")).distinct()
    if not category or terms.isEmpty():
        return alerts
    return alerts.join(broadcast_if_small(terms), "keyword", "left_semi")


def search_category(
    alerts: DataFrame, contacts: DataFrame, lexicon: DataFrame, category: str | None, limit: int = 50, offset: int = 0, **filters
) -> DataFrame:
    """One page of the alerts of a lexicon category that pass the filters, newest first."""
    return search_alerts(alerts_in_category(alerts, lexicon, category), contacts, limit, offset, **filters)


def hourly_stats(messages: DataFrame, results: DataFrame, since: str) -> DataFrame:
    """Per hour: messages, those with a keyword, accepted ones, mean of positive confidences."""
    recent = messages.filter(F.col("ts") >= F.to_timestamp(F.lit(since))).select("message_hash", "ts")
    outcome = results.select("message_hash", "keyword", "decision", "confidence")
    joined = recent.join(outcome, "message_hash", "left")
    return joined.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("messages_count"),
        F.count("keyword").alias("alerts_count"),
        F.count_if(F.col("decision") == "accept").alias("accepted_count"),
        F.avg(_positive("confidence")).alias("avg_confidence"),
    ).orderBy("hour")


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def top_keywords(alerts: DataFrame, n: int = 20) -> DataFrame:
    named = alerts.filter(F.col("keyword") != "")
    return named.groupBy("keyword").count().orderBy(F.desc("count"), "keyword").limit(n)


def top_senders(messages: DataFrame, contacts: DataFrame, stats: DataFrame, n: int = 20) -> DataFrame:
    """Busiest senders with profile and reputation: aggregate, pick n, then join."""
    top = messages.groupBy("sender_id").agg(
        F.count(F.lit(1)).alias("total_messages"), F.count("keyword").alias("alerts_count"),
    ).orderBy(F.desc("total_messages"), "sender_id").limit(n)
    joined = with_profile(top, contacts).join(stats.select("sender_id", "reputation_score"), "sender_id", "left")
    return joined.orderBy(F.desc("total_messages"), "sender_id")


def dashboard_summary(
    messages: DataFrame, alerts: DataFrame, stats: DataFrame, blocked_senders: DataFrame
) -> DataFrame:
    """Ten totals in one row: one aggregate per table, the one-row results side by side."""
    m = messages.agg(
        F.count(F.lit(1)).alias("total_messages"), F.countDistinct("sender_id").alias("unique_senders"),
        F.countDistinct("chat_id").alias("unique_chats"))
    a = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("decision") == "accept").alias("accepted_count"),
        F.count_if(F.col("decision") == "review").alias("reviewed_count"),
        F.count_if(F.col("decision") == "ignore").alias("ignored_count"),
        F.coalesce(F.avg(_positive("confidence")), F.lit(0.0)).alias("avg_confidence"))
    s = stats.filter(F.col("total_messages") > 0).agg(
        F.coalesce(F.avg("reputation_score"), F.lit(0.0)).alias("avg_reputation"))
    b = blocked_senders.agg(F.count(F.lit(1)).alias("blocked_senders"))
    return m.crossJoin(a).crossJoin(s).crossJoin(b)


def activity_stats(
    messages: DataFrame, alerts: DataFrame, now: str, stats: DataFrame, blocked_senders: DataFrame,
    decisions: tuple[str, ...] = ("accept", "review", "ignore"),
) -> DataFrame:
    """One row: distinct senders and chats, last-hour volumes, alerts by decision (those beside `decisions` together), mean
    confidence, mean reputation of senders with messages (`stats`: total_messages, reputation_score), blocked senders."""
    hour_ago = F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 1 HOUR")
    m = messages.agg(
        F.countDistinct("sender_id").alias("unique_senders"), F.countDistinct("chat_id").alias("unique_chats"),
        F.count_if(F.col("ts") > hour_ago).alias("messages_last_hour"))
    a = alerts.agg(
        F.count_if(F.col("ts") > hour_ago).alias("alerts_last_hour"),
        *[F.count_if(F.col("decision") == d).alias(f"decision_{d}") for d in decisions],
        F.count_if(~F.coalesce(F.col("decision"), F.lit("")).isin(*decisions)).alias("decision_other"),
        F.round(F.coalesce(F.avg(_positive("confidence")), F.lit(0.0)), 2).alias("avg_confidence"))
    s = stats.filter(F.col("total_messages") > 0).agg(
        F.round(F.coalesce(F.avg("reputation_score"), F.lit(0.0)), 2).alias("avg_reputation"))
    b = blocked_senders.agg(F.count(F.lit(1)).alias("blocked_senders"))
    # four one-row frames side by side
    return m.crossJoin(a).crossJoin(s).crossJoin(b)


def recent(df: DataFrame, contacts: DataFrame, n: int = 10) -> DataFrame:
    """The newest n alerts or messages with their sender's profile."""
    return with_profile(_page(df, n, 0), contacts).orderBy(*_newest())
