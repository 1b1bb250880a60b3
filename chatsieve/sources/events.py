"""Reading and admitting incoming events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.functions.text import strip_ws
from chatsieve.schemas import EVENT_SCHEMA


def with_derived(raw: DataFrame) -> DataFrame:
    """Full text, text/media flags and the event time of raw event rows."""
    body = strip_ws(F.coalesce(F.nullif("text", F.lit("")), "caption", F.lit("")))
    return raw.withColumns({
        "text": body,
        "has_text": body != "",
        "has_media": F.coalesce(F.col("media_type").isin("photo", "document"), F.lit(False)),
        "sender_id": F.coalesce("sender_id", F.lit(0).cast("long")),
        "ts": F.timestamp_seconds("timestamp"),
    }).drop("caption")


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return with_derived(spark.read.schema(EVENT_SCHEMA).format(fmt).load(path))


def read_events_stream(
    spark: SparkSession, path: str, fmt: str = "json", watermark: str = "1 hour", max_files: int | None = None
) -> DataFrame:
    """The same rows as a stream, with a watermark on `ts`."""
    reader = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_derived(reader.load(path)).withWatermark("ts", watermark)


def admit_events(df: DataFrame, admin_chat: int | None = None, started_at: str | None = None) -> DataFrame:
    """Drop own, bot and admin-chat messages and those older than the start less 5 s.

    Adds `priority`: 7 with text, else 3.
    """
    keep = ~F.coalesce("is_outgoing", F.lit(False)) & ~F.coalesce("is_bot", F.lit(False))
    if admin_chat is not None:
        keep = keep & (F.col("chat_id") != admin_chat)
    if started_at is not None:
        since = F.to_timestamp(F.lit(started_at)) - F.expr("INTERVAL 5 SECONDS")
        keep = keep & (F.col("ts") >= since)
    return df.filter(keep).withColumn("priority", F.when(F.col("has_text"), 7).otherwise(3))
