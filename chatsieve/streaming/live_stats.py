"""Rolling totals over the event or result stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def live_stats(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """Per window and account: messages, alerts, decisions and mean confidence.

    Needs ts (with a watermark on streams), account_name, decision and confidence.
    """
    decision = F.col("decision")
    return rows.groupBy(F.window("ts", window), "account_name").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(decision.isin("accept", "review")).alias("alerts"),
        F.count_if(decision == "accept").alias("accepted"), F.count_if(decision == "review").alias("reviewed"),
        F.count_if(decision == "ignore").alias("ignored"),
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("avg_confidence"))


def start_live_stats(rows: DataFrame, sink, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Update the totals every two seconds; `sink(df, batch_id)` takes the changed rows."""
    writer = live_stats(rows).writeStream.outputMode("update").foreachBatch(sink).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()
