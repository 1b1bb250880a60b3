"""Per-sender and per-account state."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve.operators import admission
from chatsieve.operators import ordered as O
from chatsieve.operators.admission import cooled_down, walked_reputation

START, TOP = 50.0, 100.0

# The task functions travel to the workers by value: no package needs to be installed there.
cloudpickle.register_pickle_by_value(admission)


def sender_stats(messages: DataFrame, results: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals per sender: messages, valid and invalid ones, alerts, first seen, last alert."""
    outcome = results.select("message_hash", "is_valid")
    per_message = messages.select("message_hash", "sender_id", "ts").join(outcome, "message_hash", "left")
    totals = per_message.groupBy("sender_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("is_valid")).alias("valid_requests"),
        F.count_if(~F.col("is_valid")).alias("invalid_requests"),
        F.min("ts").alias("first_seen"))
    sent = alerts.groupBy("sender_id").agg(
        F.count(F.lit(1)).alias("alerts_sent"), F.max("ts").alias("last_alert_time"))
    return totals.join(sent, "sender_id", "left").withColumn("alerts_sent", F.coalesce("alerts_sent", F.lit(0)))


def _reputation_step():
    return O.step(1.0, F.when(F.col("is_valid"), 2.0).otherwise(-1.0), 0.0, TOP)


def reputation(results: DataFrame, order: list[str]) -> DataFrame:
    """(sender_id, reputation_score): from 50, +2 up to 100 per valid message, -1 down to 0
    per other one, in order. Needs sender_id and is_valid."""
    folded = O.fold_steps(results.select("sender_id", "is_valid", *order), ["sender_id"], order, _reputation_step())
    return folded.select("sender_id", O.apply_step(F.lit(START), F.col("step")).alias("reputation_score"))


def running_reputation(results: DataFrame, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Add `reputation` after each message, from 50 or from `start` (sender_id, start). A busy sender's rows are walked chunk by chunk
    in parallel, each chunk starting from the value folded over the earlier ones."""
    keys = ["sender_id", "_chunk"]
    rows = results if "_chunk" in results.columns else O.in_chunks(results, ["sender_id"], order)
    steps = O.chunk_steps(rows, ["sender_id"], order, _reputation_step())
    carried = O.carried_values(steps, ["sender_id"], START, start)
    joined = rows.join(carried, keys)
    schema = T.StructType([*rows.schema.fields, T.StructField("reputation", T.DoubleType())])
    ready = joined.select(*rows.columns, "carried").repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(walked_reputation(keys), schema)


def cooldown_gate(messages: DataFrame, order: list[str], base: float = 300.0) -> DataFrame:
    """Add `allowed` to valid messages (sender_id, ts, reputation and the order columns).

    A message may alert when at least max(30, base * (1 - reputation / 200)) seconds lie
    between it and the sender's last allowed one. No cooldown exceeds the base, so a pause
    of that length makes what follows independent of what came before: the unit of
    sequential work is a sender's unbroken session, not the sender.
    """
    rows = messages if "_chunk" in messages.columns else O.in_chunks(messages, ["sender_id"], order)
    cut = O.sessions(rows, ["sender_id"], order, "ts", max(base, 30.0))
    keys = ["sender_id", "session"]
    plain = [c for c in messages.columns if c != "_chunk"]
    ready = cut.select(*plain, "session", (F.unix_micros("ts") / 1e6).alias("_at"))
    ready = ready.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([
        *[messages.schema[c] for c in plain], T.StructField("session", T.LongType()),
        T.StructField("allowed", T.BooleanType())])
    return ready.mapInPandas(cooled_down(keys, base), schema).drop("session")


def account_stats(events: DataFrame) -> DataFrame:
    """Per account: volumes, outcomes, decisions and mean confidence.

    `outcome` is one of ok, alert, error, duplicate, rate_limited, send_error; decision is null for messages that were not
    analysed. has_media and queued (came through the backlog) are flags, ts is the time. A failed sending is counted under
    send_errors and as an error.
    """
    outcome, decision = F.col("outcome"), F.col("decision")
    return events.groupBy("account_name").agg(
        F.count(F.lit(1)).alias("messages_processed"),
        F.count_if(outcome == "alert").alias("alerts_sent"),
        F.count_if(outcome.isin("error", "send_error")).alias("errors"),
        F.count_if(outcome == "send_error").alias("send_errors"),
        F.count_if("has_media").alias("media_processed"), F.count_if("queued").alias("queue_processed"),
        F.count("decision").alias("decisions_count"), F.max(F.when(outcome == "alert", F.col("ts"))).alias("last_alert_time"),
        F.count_if(outcome == "duplicate").alias("duplicates"),
        F.count_if(outcome == "rate_limited").alias("rate_limited"),
        F.count_if(decision == "accept").alias("accepted"),
        F.count_if(decision == "review").alias("reviewed"),
        F.count_if(decision == "ignore").alias("ignored"),
        F.round(F.coalesce(F.avg(F.when(decision.isNotNull(), F.col("confidence"))), F.lit(0.0)), 2).alias(
            "avg_confidence"))
