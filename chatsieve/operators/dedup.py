"""Removing repeated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.config import ARABIC, ScriptProfile
from chatsieve.functions import text as X
from chatsieve.operators.ordered import mark_first
from chatsieve.operators.text import identity_hash


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Partial aggregation keeps one row per key and map task,
    so a key with very many copies does not meet in one place."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return best.select("row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def dedup_messages(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """First message per identity (chat, message, text); adds `message_hash`."""
    hashed = df.withColumn("message_hash", identity_hash(F.col("chat_id"), F.col("message_id"), F.col(text)))
    return first_per_key(hashed, ["message_hash"], order)


def dedup_messages_stream(df: DataFrame, text: str = "text") -> DataFrame:
    """The same on a stream with a watermark; identities are remembered within it."""
    hashed = df.withColumn("message_hash", identity_hash(F.col("chat_id"), F.col("message_id"), F.col(text)))
    return hashed.dropDuplicatesWithinWatermark(["message_hash"])


def dedup_content(
    df: DataFrame, order: list[str], profile: ScriptProfile = ARABIC, text: str = "text"
) -> DataFrame:
    """Add `content_hash` and `is_duplicate`: equal normalized text came earlier in `order`.

    Exact, across senders. The text itself is dropped before rows shuffle; join it back by
    key where it is needed.
    """
    hashed = df.withColumn("content_hash", F.sha2(X.normalize(X.strip_ws(F.col(text)), profile), 256)).drop(text)
    marked = mark_first(hashed, ["content_hash"], order)
    return marked.withColumn("is_duplicate", ~F.col("is_first")).drop("is_first")
