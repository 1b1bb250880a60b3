"""Live triage: event stream to messages, results, alerts, sender state and profiles.

Each run (a micro-batch of the stream, or a retry) gets the next number of one common count. It writes its messages, results, alerts and
rejected events under `<root>/<table>/batch=<number>/day=<day>`, replacing what a failed attempt left there, and merges senders, profiles and
rate state into tables that hold the current row of each key (`sources.state`). The run is entered in `progress` once all is written. Runs read
what entered runs have written; a run that has been entered is not done again. So a repeated micro-batch gives the same tables, and stream and
retries see each other. All state is in those tables; runs follow each other, one writer at a time.

What a run reads: the state of its own senders; the hashes of earlier messages and contents, of the last `history_days` alone where
that is set; and earlier alerts only where alerts are sent again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatsieve.config import ARABIC, ScriptProfile, TriageConfig
from chatsieve.operators import ordered as O
from chatsieve.operators.admission import gated
from chatsieve.operators.bounds import broadcast_if_small
from chatsieve.operators.dedup import dedup_messages, last_per_key
from chatsieve.operators.feedback import update_weights
from chatsieve.operators.profiles import drop_blocked
from chatsieve.operators.senders import running_reputation
from chatsieve.operators.text import alert_card, chat_links
from chatsieve.plans.lexicon import TriageLexicon
from chatsieve.plans.triage import triage
from chatsieve.sources.events import admit_events
from chatsieve.sources.sinks import new_by_key, read_if_any
from chatsieve.sources.state import CurrentState

_KEYS = ["message_hash", "chat_id", "message_id", "sender_id", "account_name"]
_ORDER = ["ts", "message_hash"]
#: No run has this number yet.
_ALL = 1 << 62
_REJECTED = ["chat_id", "message_id", "sender_id", "account_name", "ts", "text", "rejected_reason"]


def _one_row(spark, values: dict) -> DataFrame:
    kinds = {"source": "string", "newest": "double"}
    return spark.range(1).select(*[F.lit(v).cast(kinds.get(c, "long")).alias(c) for c, v in values.items()]).coalesce(1)


@dataclass
class LiveTriage:
    """lexicon and blocklists may be functions: they are called at each run, so that a new lexicon version, or blocklists that
    `apply_block_events` keeps up to date, take effect without a restart. history_days: redeliveries and repeated contents older than so
    many days before a run's first event are not looked for, nor read; by default all are. allowed_lateness: events that lie more seconds
    before the newest one of earlier runs are rejected as late; by default none is."""

    root: str
    lexicon: TriageLexicon | Callable[[], TriageLexicon]
    cfg: TriageConfig = field(default_factory=TriageConfig)
    profile: ScriptProfile = ARABIC
    admin_chat: int | None = None
    started_at: str | None = None
    blocked_senders: DataFrame | Callable[[], DataFrame] | None = None
    blocked_chats: DataFrame | Callable[[], DataFrame] | None = None
    scope: str = "all"
    cooldown: float = 300.0
    per_min: int = 12
    per_hour: int = 120
    burst: int = 5
    history_days: int | None = None
    allowed_lateness: float | None = None
    buckets: int = 256

    # --- tables -----------------------------------------------------------
    def table(self, spark, name: str) -> DataFrame | None:
        return read_if_any(spark, f"{self.root}/{name}")

    @property
    def senders(self) -> CurrentState:
        return CurrentState(f"{self.root}/senders", "sender_id", self.buckets)

    @property
    def profiles(self) -> CurrentState:
        return CurrentState(f"{self.root}/profiles", "sender_id", self.buckets)

    @property
    def rates(self) -> CurrentState:
        return CurrentState(f"{self.root}/rates", "scope", 1)

    @property
    def progress(self) -> CurrentState:
        return CurrentState(f"{self.root}/progress", "source", 1)

    def _since(self, events: DataFrame) -> tuple | None:
        """The day and the time from which on earlier rows count for a run over `events`; None: all count."""
        if self.history_days is None:
            return None
        first = F.min("ts")
        day, at = events.agg(F.date_sub(F.to_date(first), self.history_days), F.unix_micros(first) - self.history_days * 86_400_000_000).first()
        return None if at is None else (day, at)

    def _before(self, spark, name: str, batch_id: int, since: tuple | None = None) -> DataFrame | None:
        """What earlier runs wrote; with `since`, from then on. Older days are left out when files are listed."""
        found = self.table(spark, name)
        if found is None:
            return None
        found = found.filter(F.col("batch") < batch_id)
        return found if since is None else found.filter((F.col("day") >= F.lit(since[0])) & (F.unix_micros("ts") >= since[1]))

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        dated = df.withColumn("day", F.to_date("ts"))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _begin(self, spark, source: str, number: int) -> tuple[int | None, float | None]:
        """The number of a run, None if it has been entered already; and the time of the newest event of earlier runs."""
        log = self.progress.read(spark, _ALL)
        if log is None:
            return 0, None
        done, last, newest = log.agg(F.count_if((F.col("source") == source) & (F.col("number") >= number)), F.max("last_run"), F.max("newest")).first()
        return None if done else last + 1, newest

    # --- one micro-batch -----------------------------------------------------
    def process(self, events: DataFrame, number: int, source: str = "stream", resent: DataFrame | None = None) -> None:
        """One run over `events`; `resent`: finished alerts that only have to be written. Numbers rise within a source."""
        spark = events.sparkSession
        batch_id, newest = self._begin(spark, source, number)
        if batch_id is None:
            return
        admitted = O.stable(self._admitted(events, newest if source == "stream" else None))
        rejected = admitted.filter(F.col("rejected_reason").isNotNull())
        self._write(rejected.select(*[c for c in rejected.columns if c in _REJECTED]), "rejected", batch_id)
        taken = admitted.filter(F.col("rejected_reason").isNull()).drop("rejected_reason")
        since = self._since(taken)
        fresh = O.stable(self._fresh(taken, batch_id, since))
        results = O.stable(self._results(fresh, batch_id, since))
        state = self.senders.read(spark, batch_id, fresh)
        rows = results.select(*_KEYS, "ts", F.col("valid").alias("is_valid"))
        start = None if state is None else state.select("sender_id", F.col("reputation_score").alias("start"))
        walked = O.stable(running_reputation(rows, _ORDER, start))
        gate = O.stable(self._gate(walked, state, batch_id))
        alerts = self._alerts(gate, fresh, results)
        self._write(fresh.select(*_KEYS, "ts", F.col("text").alias("message_text")), "messages", batch_id)
        self._write(results, "results", batch_id)
        self.flush_alerts(alerts, batch_id, resent)
        self.senders.merge(O.stable(self._sender_rows(walked, gate, state)), batch_id)
        self.profiles.merge(O.stable(self._profile_rows(fresh, batch_id)), batch_id)
        self.rates.merge(O.stable(self._rate_rows(gate)), batch_id)
        counts = admitted.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("rejected_reason") == "late").alias("late"),
                              F.count("rejected_reason").alias("rejected"), F.max(F.unix_micros("ts") / 1e6).alias("newest")).first()
        entry = {"source": source, "number": number, "run": batch_id, "events": counts["events"], "rejected": counts["rejected"], "late": counts["late"],
                 "messages": fresh.count(), "alerts": gate.filter("admitted").count()}
        _one_row(spark, entry).write.mode("overwrite").parquet(f"{self.root}/runs/batch={batch_id}")
        seen = [x for x in (newest, counts["newest"]) if x is not None]
        self.progress.merge(_one_row(spark, {"source": source, "number": number, "last_run": batch_id, "newest": max(seen) if seen else None}), batch_id)

    def _admitted(self, events: DataFrame, newest: float | None) -> DataFrame:
        """Admitted events of senders and chats that aren't blocked, with `rejected_reason` where the text's length is out of bounds or the event late."""
        given = [x() if callable(x) else x for x in (self.blocked_senders, self.blocked_chats)]
        df = drop_blocked(admit_events(events, self.admin_chat, self.started_at), *given)
        n = F.length("text")
        reason = F.when(n == 0, None).when(n < self.cfg.min_len, "too_short").when(n > self.cfg.max_len, "too_long")
        if self.allowed_lateness is not None and newest is not None:
            reason = F.when(F.unix_micros("ts") / 1e6 < newest - self.allowed_lateness, "late").otherwise(reason)
        return df.withColumn("rejected_reason", reason)

    def _fresh(self, events: DataFrame, batch_id: int, since: tuple | None) -> DataFrame:
        df = dedup_messages(events, ["ts", "message_id"])
        known = self._before(events.sparkSession, "messages", batch_id, since)
        return df if known is None else df.join(known.select("message_hash"), "message_hash", "left_anti")

    def _results(self, fresh: DataFrame, batch_id: int, since: tuple | None) -> DataFrame:
        earlier = self._before(fresh.sparkSession, "results", batch_id, since)
        known = None if earlier is None else earlier.select("content_hash").filter(F.col("content_hash").isNotNull())
        lexicon = self.lexicon() if callable(self.lexicon) else self.lexicon
        return triage(fresh, lexicon, _KEYS, _ORDER, self.cfg, self.profile,
                      known_content=known, keep_content=True)

    def _gate(self, walked: DataFrame, state: DataFrame | None, batch_id: int) -> DataFrame:
        spark = walked.sparkSession
        valid = walked.filter("is_valid").drop("_chunk").withColumns({
            "scope": F.lit(self.scope), "_at": F.unix_micros("ts") / 1e6})
        if state is None:
            valid = valid.withColumn("_last_alert", F.lit(None).cast("double"))
        else:
            last = state.select("sender_id", (F.unix_micros("last_alert_time") / 1e6).alias("_last_alert"))
            valid = valid.join(last, "sender_id", "left")
        rates = self.rates.read(spark, batch_id)
        if rates is None:
            valid = valid.withColumn("_rate_state", F.lit(None).cast("string"))
        else:
            valid = valid.join(broadcast_if_small(rates.select("scope", F.col("rate_state").alias("_rate_state"))), "scope", "left")
        kept = [f for f in valid.schema.fields if f.name not in ("_at", "_last_alert", "_rate_state")]
        schema = T.StructType([*kept, T.StructField("admitted", T.BooleanType()), T.StructField("rate_state", T.StringType())])
        ready = valid.select(*[f.name for f in kept], "_at", "_last_alert", "_rate_state")
        ready = ready.repartition("scope").sortWithinPartitions("scope", *_ORDER)
        return ready.mapInPandas(gated(self.cooldown, self.per_min, self.per_hour, self.burst), schema)

    def _alerts(self, gate: DataFrame, fresh: DataFrame, results: DataFrame) -> DataFrame:
        sent = gate.filter("admitted").select("message_hash", "scope", "rate_state")
        told = results.select("message_hash", "keyword", "score", "decision", "confidence", "reasons", "intent_verb",
                              "academic_object", "negation_detected", "advert_score")
        cards = alert_card(fresh.join(sent, "message_hash").join(told, "message_hash"))
        return cards.select(
            *_KEYS, "ts", "scope", "rate_state", "keyword", F.col("safe_text").alias("alert_text"), "decision",
            "confidence", "reasons", "intent_verb", "academic_object", "negation_detected", "advert_score",
            "group_link", "message_link", "profile_link", "display_name", "score_bar")

    def flush_alerts(self, alerts: DataFrame, batch_id: int, resent: DataFrame | None = None) -> None:
        """Write this run's alerts; and of those sent again the ones whose message has none yet. New messages have none by themselves."""
        if resent is not None:
            again = resent.select(*[c for c in resent.columns if c in alerts.columns])
            earlier = self._before(alerts.sparkSession, "alerts", batch_id)
            again = new_by_key(again, earlier, "message_hash", _ORDER).join(alerts.select("message_hash"), "message_hash", "left_anti")
            alerts = alerts.unionByName(again, allowMissingColumns=True)
        self._write(alerts, "alerts", batch_id)

    def _rate_rows(self, gate: DataFrame) -> DataFrame:
        last = gate.filter("admitted").groupBy("scope").agg(F.max_by("rate_state", F.struct(*_ORDER)).alias("rate_state"))
        return last.select("scope", "rate_state")

    def _sender_rows(self, walked: DataFrame, gate: DataFrame, state: DataFrame | None) -> DataFrame:
        seen = walked.groupBy("sender_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("good"), F.count_if(~F.col("is_valid")).alias("bad"),
            F.min("ts").alias("first_ts"), F.max_by("reputation", F.struct(*_ORDER)).alias("reputation_score"))
        sent = gate.filter("admitted").groupBy("sender_id").agg(
            F.count(F.lit(1)).alias("sent"), F.max("ts").alias("sent_ts"))
        new = seen.join(sent, "sender_id", "left")
        if state is None:
            zero = F.lit(0).cast("long")
            new = new.withColumns({c: zero for c in ("total_messages", "valid_requests", "invalid_requests", "alerts_sent")})
            new = new.withColumns({c: F.lit(None).cast("timestamp") for c in ("last_alert_time", "first_seen")})
        else:
            new = new.join(state.drop("reputation_score"), "sender_id", "left")
        plus = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
        return new.select(
            "sender_id", plus("total_messages", "n"), plus("valid_requests", "good"), plus("invalid_requests", "bad"),
            plus("alerts_sent", "sent"), "reputation_score", F.greatest("last_alert_time", "sent_ts").alias("last_alert_time"),
            F.least("first_seen", "first_ts").alias("first_seen"))

    def _profile_rows(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        group, message = chat_links(F.col("chat_id"), F.col("message_id"), F.col("chat_username"))
        seen = fresh.select(
            "sender_id", F.col("sender_access_hash").alias("access_hash"), F.col("sender_username").alias("username"),
            F.col("sender_first_name").alias("first_name"), F.col("sender_last_name").alias("last_name"),
            F.col("chat_id").alias("last_chat_id"), F.col("message_id").alias("last_message_id"),
            message.alias("last_message_link"), group.alias("last_group_link"), "ts")
        known = self.profiles.read(fresh.sparkSession, batch_id, fresh)
        seen = seen if known is None else seen.unionByName(known.join(fresh.select("sender_id").distinct(), "sender_id", "left_semi"))
        return last_per_key(seen, ["sender_id"], ["ts", "last_message_id"])

    def current_profiles(self, spark) -> DataFrame | None:
        return self.profiles.read(spark, _ALL)

    def current_senders(self, spark) -> DataFrame | None:
        return self.senders.read(spark, _ALL)

    # --- learned weights ---------------------------------------------------------
    @property
    def _weights(self) -> CurrentState:
        return CurrentState(f"{self.root}/weights", "key", 1)

    def weights(self, spark) -> DataFrame | None:
        """(kind, term, weight, n_feedback) as learned so far, for `compile_json` or `compile_documents`; None while there are none."""
        known = self._weights.read(spark, _ALL)
        return None if known is None else known.drop("key")

    def learn(self, feedback: DataFrame, number: int) -> None:
        """Take feedback (kind, term, was_correct, seq) into the weights, as a run of its own; `number` counts such runs, upwards.

        A term begins at its learned weight, else at the lexicon's, else at the default. With a lexicon that is compiled at each run from
        `weights`, what was learned takes effect in the next one.
        """
        spark = feedback.sparkSession
        run, _ = self._begin(spark, "feedback", number)
        if run is None:
            return
        lexicon = self.lexicon() if callable(self.lexicon) else self.lexicon
        given = [(kind, term, float(w)) for kind, table in (("intent", lexicon.intent_weights), ("academic", lexicon.object_weights)) for term, w in table.items()]
        begin = spark.createDataFrame(given, "kind string, term string, weight double").withColumn("n_feedback", F.lit(0).cast("long"))
        known = self._weights.read(spark, run)
        if known is not None:
            known = known.drop("key")
            begin = begin.join(known, ["kind", "term"], "left_anti").unionByName(known)
        touched = feedback.select("kind", "term").distinct()
        learned = update_weights(begin.select("kind", "term", "weight"), feedback).join(touched, ["kind", "term"], "left_semi")
        before = begin.select("kind", "term", F.col("n_feedback").alias("_n"))
        counted = learned.join(before, ["kind", "term"], "left").withColumn("n_feedback", (F.col("n_feedback") + F.coalesce("_n", F.lit(0))).cast("long")).drop("_n")
        self._weights.merge(O.stable(counted.withColumn("key", F.to_json(F.array("kind", "term")))), run)
        self.progress.merge(_one_row(spark, {"source": "feedback", "number": number, "last_run": run, "newest": None}), run)

    # --- entry points -----------------------------------------------------------
    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Run on a stream of events (`sources.events.read_events_stream`)."""
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
        return writer.start()

    def reprocess(self, failures: DataFrame, number: int) -> None:
        """Retry failed work as a run of its own; `number` counts retries, upwards, and has nothing to do with the stream's. Rows of kind
        `alert_resend` carry a finished alert and go straight to the alert table, unless their message has one; all others are
        triaged again, which known messages do not survive."""
        again = failures.filter(F.coalesce("kind", F.lit("")) != "alert_resend").select("event.*")
        resent = failures.filter(F.col("kind") == "alert_resend").select("alert.*") if "alert" in failures.columns else None
        self.process(again, number, "retry", resent)
