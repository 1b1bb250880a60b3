"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("chat_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("sender_id", T.LongType()),
    T.StructField("sender_username", T.StringType()),
    T.StructField("sender_first_name", T.StringType()),
    T.StructField("sender_last_name", T.StringType()),
    T.StructField("sender_access_hash", T.LongType()),
    T.StructField("chat_access_hash", T.LongType()),
    T.StructField("chat_username", T.StringType()),
    T.StructField("chat_title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("is_outgoing", T.BooleanType()),
    T.StructField("is_bot", T.BooleanType()),
    T.StructField("timestamp", T.DoubleType()),
])
