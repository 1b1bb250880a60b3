"""Backlog, retries, dead letters and retention as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.operators.bounds import broadcast_if_small
from chatsieve.operators.dedup import first_per_key

def _rank() -> list[Column]:
    return [F.desc("priority"), F.desc("created_at"), F.desc("id")]


def cap_backlog(df: DataFrame, capacity: int = 1000) -> DataFrame:
    """The rows kept when the backlog is cut to its capacity: the lowest priority goes
    first, and within a priority the oldest."""
    return df.orderBy(*_rank()).limit(capacity)


def evicted_backlog(df: DataFrame, capacity: int = 1000) -> DataFrame:
    """The rows `cap_backlog` does not keep."""
    kept = broadcast_if_small(cap_backlog(df.select("id", "priority", "created_at"), capacity).select("id"))
    return df.join(kept, "id", "left_anti")


def drain_order(df: DataFrame, n: int) -> DataFrame:
    """The next n rows: highest priority first, then oldest."""
    return df.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(n)


def schedule_retries(failures: DataFrame, max_retries: int = 5) -> tuple[DataFrame, DataFrame]:
    """(retries, dead letters) for failed events.

    Failures at the retry limit become dead letters. Of the others one retry per
    (chat, message) is scheduled, the first failure's, after min(2^n, 60) seconds.
    """
    dead = failures.filter(F.col("retry_count") >= max_retries).select(
        "*", F.lit(False).alias("resolved"))
    pending = failures.filter(F.col("retry_count") < max_retries)
    first = first_per_key(pending, ["chat_id", "message_id"], ["ts", "id"])
    delay = F.least(F.pow(F.lit(2.0), F.col("retry_count")), F.lit(60.0)).cast("int")
    retries = first.withColumns({"attempt": F.col("retry_count") + 1, "delay_seconds": delay})
    return retries, dead


def dead_letter_view(df: DataFrame, limit: int = 100, only_unresolved: bool = True) -> DataFrame:
    """Oldest dead letters first, with a summary taken from the event JSON."""
    rows = df.filter(~F.col("resolved")) if only_unresolved else df
    oldest = rows.orderBy("created_at", "id").limit(limit)
    return oldest.select(
        "id", "error_text", "retry_count", "resolved", "created_at",
        *[F.get_json_object("event_data", f"$.{k}").alias(k) for k in ("chat_id", "message_id", "account_name")])


def requeue_dead_letters(
    df: DataFrame, ids: DataFrame, max_retries: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(queue rows, dead letters after) when the given unresolved ids are retried.

    A retry raises the count and queues the event at priority 1; beyond the limit the
    letter is closed instead.
    """
    asked = broadcast_if_small(ids.select("id").distinct()).withColumn("asked", F.lit(True))
    marked = df.join(asked, "id", "left").withColumn(
        "asked", F.coalesce("asked", F.lit(False)) & ~F.col("resolved"))
    over = F.col("asked") & (F.col("retry_count") + 1 > max_retries)
    again = F.col("asked") & ~over
    queue = marked.filter(again).select("event_data", F.lit(1).alias("priority"), F.col("id").alias("letter_id"))
    after = marked.withColumns({
        "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "resolved": F.col("resolved") | over,
    }).drop("asked")
    return queue, after


def prune_dead_letters(df: DataFrame, now: str, days: int = 7, cap: int | None = None) -> DataFrame:
    """Drop resolved and old letters; with `cap`, keep only so many of the newest."""
    cutoff = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    live = df.filter(~F.col("resolved") & (F.col("created_at") >= cutoff))
    return live if cap is None else live.orderBy(F.desc("created_at"), F.desc("id")).limit(cap)


def retain(df: DataFrame, now: str, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows not older than the cut-off; prunes partitions when the table is laid out by date."""
    return df.filter(F.col(ts) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))
