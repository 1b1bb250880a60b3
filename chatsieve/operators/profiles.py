"""Blocklists and the sender profile dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.operators.bounds import broadcast_if_small
from chatsieve.operators.dedup import last_per_key


def drop_blocked(df: DataFrame, blocked_senders: DataFrame | None, blocked_chats: DataFrame | None) -> DataFrame:
    """Rows of neither a blocked sender nor a blocked chat; a list that isn't given blocks nothing."""
    for blocked, key in ((blocked_senders, "sender_id"), (blocked_chats, "chat_id")):
        if blocked is not None:
            df = df.join(broadcast_if_small(blocked.select(key)), key, "left_anti")
    return df


def apply_block_events(
    events: DataFrame, blocklist: DataFrame | None = None, key: str = "sender_id",
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """The blocklist after block/unblock events: the first block after the last unblock counts.

    Needs no ordering of a key's events in one place: the last unblock is an aggregate, and
    the first block after it another one.
    """
    at = F.struct(*order)
    columns = [key, "reason", "blocked_at"]
    events = events.select(key, "action", "reason", "ts", at.alias("at"))
    lifted = events.filter(F.col("action") == "unblock").groupBy(key).agg(F.max("at").alias("lifted_at"))
    live = events.filter(F.col("action") == "block").join(lifted, key, "left").filter(
        F.col("lifted_at").isNull() | (F.col("at") > F.col("lifted_at")))
    blocked = live.groupBy(key).agg(F.min_by(F.struct("reason", F.col("ts").alias("blocked_at")), "at").alias("b"))
    blocked = blocked.select(key, "b.reason", "b.blocked_at")
    if blocklist is None:
        return blocked
    kept = blocklist.select(*columns).join(lifted.select(key), key, "left_anti")
    return kept.unionByName(blocked.join(kept.select(key), key, "left_anti"))


def newest_blocks(blocklist: DataFrame, key: str = "sender_id", limit: int = 100) -> DataFrame:
    return blocklist.orderBy(F.desc("blocked_at"), F.desc(key)).limit(limit)


def with_profile(df: DataFrame, contacts: DataFrame, columns: tuple[str, ...] = (
        "username", "first_name", "last_name")) -> DataFrame:
    """Left join of sender names (or links) onto message or alert rows."""
    return df.join(contacts.select("sender_id", *columns), "sender_id", "left")


def latest_profile(events: DataFrame, order: tuple[str, ...] = ("ts", "message_id")) -> DataFrame:
    """The last profile seen per sender."""
    return last_per_key(events, ["sender_id"], list(order))


def lookup_by_hash(hashes: DataFrame, alerts: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_hash, text): the alert text, else the message text.

    The requested hashes are few against the tables, so each table is first cut down to
    them by a broadcast semi join.
    """
    wanted = broadcast_if_small(hashes.select("message_hash"))
    a = alerts.select("message_hash", "alert_text").join(wanted, "message_hash", "left_semi")
    m = messages.select("message_hash", "message_text").join(wanted, "message_hash", "left_semi")
    return (
        hashes.select("message_hash").join(a, "message_hash", "left").join(m, "message_hash", "left")
        .select("message_hash", F.coalesce("alert_text", "message_text").alias("text")))
