"""Writing results: insert-or-ignore, alert export, lexicon export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.operators.dedup import first_per_key


def new_by_key(df: DataFrame, existing: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """Rows whose key is not in `existing`, the first one per key."""
    fresh = first_per_key(df, [key], order)
    return fresh if existing is None else fresh.join(existing.select(key), key, "left_anti")


def write_new_by_key(df: DataFrame, target: str, key: str, order: list[str]) -> DataFrame:
    """Append rows with new keys to the parquet table at `target`; gives the rows written.

    The rows are checkpointed before the append, since they depend on the target itself.
    """
    from chatsieve.operators.ordered import stable

    spark = df.sparkSession
    fresh = stable(new_by_key(df, read_if_any(spark, target), key, order))
    fresh.write.mode("append").parquet(target)
    return fresh


def read_if_any(spark, path: str) -> DataFrame | None:
    """The parquet table at `path`, or None while nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def alert_export_rows(alerts: DataFrame, contacts: DataFrame, limit: int | None = None) -> DataFrame:
    """The 12 columns of the alert export, newest first; with `limit`, so many of the newest rows."""
    newest = alerts if limit is None else alerts.orderBy(F.desc("ts"), F.desc("message_hash")).limit(limit)
    joined = newest.join(contacts, "sender_id", "left")
    name: Column = F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit("")))
    return joined.select(
        F.col("message_hash").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "sender_id",
        F.nullif(name, F.lit("")).alias("sender_name"),
        "username", "chat_id",
        F.col("account_name").alias("account"),
        "keyword", "decision", "confidence",
        F.substring(F.coalesce("alert_text", F.lit("")), 1, 200).alias("text"),
        F.col("last_message_link").alias("message_link"),
    ).orderBy(F.desc("time"), F.desc("id"))


def export_alerts_csv(alerts: DataFrame, contacts: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV files with a header, in order from file to file; one file where a `limit` bounds the rows."""
    rows = alert_export_rows(alerts, contacts, limit)
    (rows if limit is None else rows.coalesce(1)).write.mode("overwrite").option("header", True).csv(path)
