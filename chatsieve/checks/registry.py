"""The registered queries: every operator over the given tables, as (spark, sf_dir) callables.

Outputs are flat: times as text, flags as 0/1, arrays joined, doubles rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.config import LATIN, TriageConfig
from chatsieve.operators import backlog, dedup, feedback, lexicon_admin, matching, monitoring, profiles
from chatsieve.operators import scoring, search, senders
from chatsieve.operators import templates as tpl
from chatsieve.operators import text as txt
from chatsieve.plans import adapters as A
from chatsieve.plans.lexicon import TriageLexicon, compile_json
from chatsieve.plans.triage import triage, triage_report
from chatsieve.sources import events as ev
from chatsieve.sources import lexicon as lexsrc
from chatsieve.sources import logs
from chatsieve.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIALECT = {"the": "le", "und": "et", "de": "von", "que": "that"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@cache
def latin_lexicon() -> TriageLexicon:
    return compile_json(files("chatsieve.lexicons").joinpath("latin.json").read_text(encoding="utf-8"))


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def flag(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r9(c: Column | str) -> Column:
    """For means of two-digit values: at six places they often end in an exact 5, at nine they don't."""
    return F.round(c, 9)


def terms_frame(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, terms))).alias("term"))


def norm_messages(spark: SparkSession, sf: str) -> DataFrame:
    return txt.normalize_messages(A.msg_text(spark, sf), LATIN)


# --- sources and text ---------------------------------------------------------
def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    c = A.msg_chat(spark, sf)
    return c.select(
        "chat_id", "message_id", "sender_id", F.when(F.col("message_id") % 3 > 0, F.col("text")).alias("text"),
        F.concat(F.lit("  "), "text", F.lit("\n")).alias("caption"),
        F.when(F.col("message_id") % 4 == 0, "photo").when(F.col("message_id") % 4 == 1, "webpage").alias("media_type"),
        (F.col("role") == "system").alias("is_bot"), F.lit(False).alias("is_outgoing"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"))


@query
def read_events(spark, sf):
    df = ev.with_derived(_raw_events(spark, sf))
    return df.select("chat_id", "message_id", "text", flag("has_text").alias("has_text"),
                     flag("has_media").alias("has_media"), stamp("ts").alias("ts"))


@query
def admit_events(spark, sf):
    df = ev.admit_events(ev.with_derived(_raw_events(spark, sf)), admin_chat=3, started_at="2024-01-01 02:00:04")
    return df.select("chat_id", "message_id", "priority", stamp("ts").alias("ts"))


@query
def read_lexicon(spark, sf):
    lex = lexsrc.lexicon_from_documents(A.lexicon_docs_v(spark, sf), keys=("p_partkey",))
    return lex.select("p_partkey", "path", "category", "grp", "term", r6("weight").alias("weight"), "pos")


@query
def log_entries(spark, sf):
    # one log file per 40 users; some entries run over three lines, and each file begins in the middle of one
    e = A.events(spark, sf)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    more = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n  at step "), F.col("event_id").cast("string"), F.lit("\n | end"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level, F.lit(" | "), "event_type", F.lit(" | "), "props", more)
    file = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"))
    lines = e.select(file.alias("file"), "event_id", F.posexplode(F.split(line, "\n")).alias("pos", "line"))
    left = lines.select("file").distinct().select("file", F.lit(-2**63).alias("event_id"), F.lit(0).alias("pos"), F.lit("left over").alias("line"))
    entries = logs.entries_from_lines(lines.unionByName(left), ["event_id", "pos"])
    return entries.select("file", "entry", "time", "level", "source", "message")


@query
def validate_messages(spark, sf):
    return txt.validate_messages(A.msg_text(spark, sf)).select("message_id", "invalid_reason")


@query
def normalize_messages(spark, sf):
    return norm_messages(spark, sf).select("message_id", "norm_text")


@query
def canonicalize_terms(spark, sf):
    return txt.canonicalize_terms(norm_messages(spark, sf), DIALECT).select("message_id", "norm_text")


@query
def text_signals(spark, sf):
    docs = A.msg_text(spark, sf).select(F.lit("document").alias("origin"), F.col("message_id").alias("id"), "text")
    pages = A.spread_if_small(A.table(spark, sf, "pages")).select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    s = txt.text_signals(docs.unionByName(pages), LATIN)
    return s.select("origin", "id", "word_count", "emoji_runs", "url_count", flag("has_phone").alias("has_phone"),
                    flag("has_email").alias("has_email"), flag("has_repeat").alias("has_repeat"),
                    r6("block_ratio").alias("block_ratio"))


@query
def prefilter(spark, sf):
    return txt.prefilter(norm_messages(spark, sf), min_words=40, max_emojis=0, min_ratio=0.8, profile=LATIN).select(
        "message_id", "prefilter_reason")


@query
def detect_script(spark, sf):
    return txt.detect_script(norm_messages(spark, sf), LATIN).select(
        "message_id", r6("script_ratio").alias("script_ratio"), flag("is_script").alias("is_script"))


@query
def spam_score(spark, sf):
    s = txt.spam_score(txt.text_signals(norm_messages(spark, sf), LATIN, text="norm_text"), threshold=0.2)
    return s.select("message_id", r6("spam_score").alias("spam_score"), flag("is_spam").alias("is_spam"))


@query
def message_identity(spark, sf):
    return txt.message_identity(A.msg_text(spark, sf), LATIN).select("message_id", "message_hash", "content_hash")


@query
def alert_card(spark, sf):
    m = A.msg_text(spark, sf)
    n = F.col("message_id")
    df = m.select(
        n, F.when(n % 3 == 1, F.concat(F.lit("-100"), F.col("chat_id").cast("string"), F.lit("77")).cast("long"))
        .otherwise(F.col("chat_id")).alias("chat_id"),
        (n % 9).alias("sender_id"),
        F.when(n % 3 == 0, F.concat(F.lit("@src"), F.col("chat_id").cast("string"))).alias("chat_username"),
        F.when(n % 4 == 0, F.concat(F.lit("u"), F.col("sender_id").cast("string"))).alias("sender_username"),
        F.when(n % 5 > 0, F.col("lang")).alias("sender_first_name"),
        F.when(n % 7 == 0, F.col("account_name")).alias("sender_last_name"),
        F.when(n % 6 == 0, n).alias("sender_access_hash"), "text", (n % 131).alias("score"))
    return txt.alert_card(df, fallback_name="user").select(
        "message_id", "group_link", "message_link", "profile_link", "display_name", "safe_text", "score_bar")


@query
def flag_dangerous_html(spark, sf):
    p = A.spread_if_small(A.table(spark, sf, "pages"))
    return txt.flag_dangerous_html(p).select("page_id", flag("dangerous_html").alias("dangerous_html"))


# --- matching and scoring -------------------------------------------------------
@query
def match_all(spark, sf):
    terms = terms_frame(spark, latin_lexicon().terms("context"))
    return matching.match_all(norm_messages(spark, sf), terms, ["message_id"])


@query
def match_all_joined(spark, sf):
    terms = terms_frame(spark, latin_lexicon().terms("context"))
    return matching.match_all(norm_messages(spark, sf), terms, ["message_id"], strategy="join")


@query
def match_first(spark, sf):
    terms = terms_frame(spark, latin_lexicon().terms("request"))
    return matching.match_first(norm_messages(spark, sf), terms, ["message_id"])


@query
def match_first_joined(spark, sf):
    terms = terms_frame(spark, latin_lexicon().terms("request"))
    return matching.match_first(norm_messages(spark, sf), terms, ["message_id"], strategy="join")


@query
def match_contains(spark, sf):
    terms = terms_frame(spark, latin_lexicon().terms("request") + latin_lexicon().terms("context"))
    return matching.match_contains(norm_messages(spark, sf), terms, ["message_id"])


def _fuzzy(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    lex = latin_lexicon()
    intent = spark.range(0, 1, 1, 1).select(F.posexplode(F.array(*map(F.lit, lex.terms("intent")))).alias(
        "ord", "term"))
    weights = F.create_map(*[F.lit(x) for kv in lex.intent_weights.items() for x in kv])
    intent = intent.withColumn("weight", F.element_at(weights, F.col("term")))
    m = matching.fuzzy_match(norm_messages(spark, sf), intent, terms_frame(spark, lex.terms("request")), ["message_id"], strategy=strategy)
    return m.select("message_id", "term", r6("similarity").alias("similarity"), r6("weight").alias("weight"), "start")


@query
def fuzzy_match(spark, sf):
    return _fuzzy(spark, sf, "auto")


@query
def fuzzy_match_joined(spark, sf):
    return _fuzzy(spark, sf, "join")


@query
def match_table_terms(spark, sf):
    """Terms of a table: the longer words of `benchmark`, wherever they occur in the messages."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    terms = A.table(spark, sf, "benchmark").select(words.alias("term")).filter(F.length("term") >= 6).distinct()
    hits = matching.match_all(norm_messages(spark, sf), terms, ["message_id"], strategy="join")
    return hits.groupBy("message_id", "term").agg(F.count(F.lit(1)).alias("times"), F.min("start").alias("first_start"))


@query
def expand_templates(spark, sf):
    p = A.table(spark, sf, "part")
    tags = F.element_at(F.array(*map(F.lit, ("need", "person", "action", "expert", "availability"))),
                        (F.col("p_partkey") % 5).cast("int") + 1)
    slots = p.select(tags.alias("tag"), F.col("p_name").alias("term")).distinct()
    patterns = terms_frame(spark, ["<need> <person>", "<availability>  <expert>", "<need> <person> <action>",
                                   "<person> <need>"]).select(F.col("term").alias("pattern"))
    return tpl.expand_templates(slots, patterns)


def _with_starts(spark: SparkSession, sf: str) -> DataFrame:
    from chatsieve.functions import matching as M
    lex = latin_lexicon()
    t = F.col("norm_text")
    df = norm_messages(spark, sf).withColumns({
        "intent": M.first_term(t, lex.terms("request")), "object": M.first_term(t, lex.terms("context"))})
    return df.withColumns({
        "intent_start": M.start_of(t, F.col("intent")), "object_start": M.start_of(t, F.col("object"))})


@query
def negation_scope(spark, sf):
    return scoring.negation_scope(_with_starts(spark, sf), latin_lexicon()).select(
        "message_id", flag("negated").alias("negated"), r6("negation_score").alias("negation_score"),
        "negation_reason")


@query
def ad_score(spark, sf):
    return scoring.ad_score(norm_messages(spark, sf), latin_lexicon()).select(
        "message_id", r6("advert_score").alias("advert_score"),
        F.array_join("advert_reasons", "|").alias("advert_reasons"))


@query
def ad_block(spark, sf):
    return scoring.ad_block(norm_messages(spark, sf), latin_lexicon()).select("message_id", "block_reason")


@query
def proximity_score(spark, sf):
    return scoring.proximity_score(_with_starts(spark, sf), latin_lexicon().distance_bands).select(
        "message_id", "distance_score")


@query
def proximity_score_default(spark, sf):
    return scoring.proximity_score(_with_starts(spark, sf)).select("message_id", "distance_score")


@query
def length_modifier(spark, sf):
    return scoring.length_modifier(norm_messages(spark, sf), latin_lexicon().length_bands).select(
        "message_id", "length_modifier")


def triaged(spark: SparkSession, sf: str, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    keys = ["message_id", "lang", "account_name", "sender_id"]
    return triage(A.msg_text(spark, sf), latin_lexicon(), keys, ["ts", "message_id"], cfg, LATIN)


@query
def triage_messages(spark, sf):
    detail = lambda k: F.coalesce(F.try_element_at("score_details", F.lit(k)), F.lit(0.0)).alias(k)
    return triaged(spark, sf).select(
        "message_id", flag("valid").alias("valid"), "reason", "keyword", "score", "decision",
        r9("confidence").alias("confidence"), F.array_join("reasons", "|").alias("reasons"),
        F.array_join("key_phrases", "|").alias("key_phrases"), "context_type", "context_boost",
        r6("context_confidence").alias("context_confidence"), flag("indirect").alias("indirect"),
        flag("urgent").alias("urgent"), "intent_verb", "academic_object", "urgency_marker",
        flag("negation_detected").alias("negation_detected"), r6("advert_score").alias("advert_score"),
        flag("fuzzy_matched").alias("fuzzy_matched"),
        *[detail(k) for k in ("legacy_score", "weighted_score", "intent_weight", "academic_weight",
                              "grammar_score", "distance_score", "length_modifier")])


@query
def triage_long_texts(spark, sf):
    """The triage without a bound on a message's length."""
    return triaged(spark, sf, TriageConfig(max_len=1_000_000_000)).select(
        "message_id", flag("valid").alias("valid"), "reason", "decision", r9("confidence").alias("confidence"), "keyword", "academic_object", "context_boost")


@query
def triage_decisions_by_language(spark, sf):
    return triaged(spark, sf).groupBy("lang", "decision").agg(
        F.count(F.lit(1)).alias("messages"), r6(F.avg("confidence")).alias("avg_confidence"))


@query
def triage_totals(spark, sf):
    return triage_report(triaged(spark, sf)).withColumn("hit_rate", r6("hit_rate"))


@query
def update_weights(spark, sf):
    w = feedback.update_weights(A.weights_v(spark, sf), A.feedback_v(spark, sf))
    return w.select("kind", "term", r6("weight").alias("weight"), "n_feedback")


@query
def reseed_weights(spark, sf):
    learned = feedback.update_weights(A.weights_v(spark, sf), A.feedback_v(spark, sf))
    p = A.table(spark, sf, "part")
    fresh = p.filter("p_size > 10").select(F.lit("intent").alias("kind"), F.col("p_brand").alias("term")).union(
        p.select(F.lit("intent"), F.concat(F.lit("term"), (F.col("p_partkey") % 8).cast("string")))).distinct()
    return feedback.reseed_weights(fresh.withColumn("weight", F.lit(0.9)), learned).select(
        "kind", "term", r6("weight").alias("weight"))


# --- dedup, profiles --------------------------------------------------------------
@query
def dedup_messages(spark, sf):
    # every conversation turn is delivered twice, the second time a minute later
    c = A.msg_chat(spark, sf)
    twice = c.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "ts", F.timestamp_seconds(F.unix_seconds("ts") + F.col("copy") * 60))
    return dedup.dedup_messages(twice, ["ts", "copy"]).select(
        "chat_id", "message_id", "copy", "message_hash", stamp("ts").alias("ts"))


@query
def dedup_content(spark, sf):
    return dedup.dedup_content(A.msg_text(spark, sf), ["ts", "message_id"], LATIN).select(
        "message_id", "content_hash", flag("is_duplicate").alias("is_duplicate"))


@query
def drop_blocked(spark, sf):
    return profiles.drop_blocked(
        A.messages_v(spark, sf), A.blocked_senders_v(spark, sf), A.blocked_chats_v(spark, sf)).select(
        "message_hash", "sender_id", "chat_id")


@query
def apply_block_events(spark, sf):
    b = profiles.apply_block_events(A.block_events_v(spark, sf), A.blocked_senders_v(spark, sf))
    return b.select("sender_id", "reason", stamp("blocked_at").alias("blocked_at"))


@query
def newest_blocks(spark, sf):
    b = profiles.newest_blocks(profiles.apply_block_events(A.block_events_v(spark, sf)), limit=100)
    return b.select("sender_id", "reason", stamp("blocked_at").alias("blocked_at"))


@query
def with_profile(spark, sf):
    return profiles.with_profile(A.alerts_v(spark, sf), A.contacts_v(spark, sf)).select(
        "message_hash", "sender_id", "username", "first_name", "last_name")


@query
def latest_profile(spark, sf):
    a = A.activity(spark, sf).select(
        "sender_id", F.concat(F.lit("u"), F.col("sender_id").cast("string"), F.lit("_"), "event_type").alias("username"),
        F.col("chat_id").alias("last_chat_id"), F.col("message_id").alias("last_message_id"), "ts")
    return profiles.latest_profile(a, ("ts", "last_message_id")).select(
        "sender_id", "username", "last_chat_id", "last_message_id", stamp("ts").alias("ts"))


@query
def lookup_by_hash(spark, sf):
    wanted = A.events(spark, sf).select(
        F.concat(F.lit("h"), (F.col("event_id") * 3).cast("string")).alias("message_hash"))
    return profiles.lookup_by_hash(wanted, A.alerts_v(spark, sf), A.messages_v(spark, sf))


# --- senders -------------------------------------------------------------------------
def _sender_stats(spark: SparkSession, sf: str) -> DataFrame:
    return senders.sender_stats(A.messages_v(spark, sf), A.results_v(spark, sf), A.alerts_v(spark, sf))


def _reputation(spark: SparkSession, sf: str) -> DataFrame:
    return senders.reputation(A.activity(spark, sf), ["ts", "message_id"])


@query
def sender_stats(spark, sf):
    return _sender_stats(spark, sf).select(
        "sender_id", "total_messages", "valid_requests", "invalid_requests", "alerts_sent",
        stamp("first_seen").alias("first_seen"), stamp("last_alert_time").alias("last_alert_time"))


@query
def reputation(spark, sf):
    return _reputation(spark, sf)


@query
def running_reputation(spark, sf):
    rows = A.activity(spark, sf).select("sender_id", "ts", "message_id", "is_valid")
    return senders.running_reputation(rows, ["ts", "message_id"]).select("sender_id", "message_id", "reputation")


@query
def cooldown_gate(spark, sf):
    # 36 hours play the part of 300 seconds, so that the sparse test events collide
    rows = A.activity(spark, sf).select("sender_id", "ts", "message_id", "is_valid")
    valid = senders.running_reputation(rows, ["ts", "message_id"]).filter("is_valid")
    gated = senders.cooldown_gate(valid, ["ts", "message_id"], base=129600.0)
    return gated.select("sender_id", "message_id", flag("allowed").alias("allowed"))


@query
def account_stats(spark, sf):
    a = A.activity(spark, sf)
    kind = F.col("event_type")
    e = a.select(
        "account_name", F.when(kind == "purchase", "alert").when(kind == "error", "error").when(
            kind == "view", "duplicate").when(kind == "click", "rate_limited").when(
            F.col("chat_id") < 5, "send_error").otherwise("ok").alias("outcome"),
        F.when(kind != "view", F.col("decision")).alias("decision"), "confidence", "ts",
        (F.col("message_id") % 3 == 0).alias("has_media"), (F.col("message_id") % 7 == 0).alias("queued"))
    return senders.account_stats(e).withColumn("last_alert_time", stamp("last_alert_time"))


# --- backlog ---------------------------------------------------------------------------
def _queue_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "priority", stamp("created_at").alias("created_at"))


@query
def cap_backlog(spark, sf):
    return _queue_columns(backlog.cap_backlog(A.backlog_v(spark, sf), 1000))


@query
def evicted_backlog(spark, sf):
    return _queue_columns(backlog.evicted_backlog(A.backlog_v(spark, sf), 1000))


@query
def drain_order(spark, sf):
    return _queue_columns(backlog.drain_order(A.backlog_v(spark, sf), 500))


@query
def schedule_retries(spark, sf):
    retries, dead = backlog.schedule_retries(A.failures_v(spark, sf))
    r = retries.select(F.lit("retry").alias("kind"), "id", "chat_id", "message_id", "attempt", "delay_seconds",
                       F.length("error_text").alias("error_chars"))
    d = dead.select(F.lit("dead").alias("kind"), "id", "chat_id", "message_id", F.col("retry_count").alias("attempt"),
                    F.lit(0).alias("delay_seconds"), F.length("error_text").alias("error_chars"))
    return r.unionByName(d)


@query
def dead_letter_view(spark, sf):
    v = backlog.dead_letter_view(A.dead_letters_v(spark, sf), limit=100)
    return v.select("id", "error_text", "retry_count", flag("resolved").alias("resolved"),
                    stamp("created_at").alias("created_at"), "chat_id", "message_id", "account_name")


@query
def requeue_dead_letters(spark, sf):
    ids = A.dead_letters_v(spark, sf).filter("retry_count <> 2").select("id")
    queue, after = backlog.requeue_dead_letters(A.dead_letters_v(spark, sf), ids)
    q = queue.select(F.lit("queued").alias("kind"), F.col("letter_id").alias("id"), "priority")
    a = after.select(F.when(F.col("resolved"), "closed").otherwise("open").alias("kind"), "id",
                     F.col("retry_count").alias("priority"))
    return q.unionByName(a)


@query
def prune_dead_letters(spark, sf):
    return backlog.prune_dead_letters(A.dead_letters_v(spark, sf), A.NOW, days=20).select(
        "id", stamp("created_at").alias("created_at"))


@query
def retain(spark, sf):
    return backlog.retain(A.messages_v(spark, sf), A.NOW, days=7).select("message_hash", stamp("ts").alias("ts"))


# --- query surface -----------------------------------------------------------------------
def _listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("message_hash", "sender_id", stamp("ts").alias("ts"), "username", "first_name", *columns)


@query
def search_messages(spark, sf):
    return _listed(search.search_messages(
        A.messages_v(spark, sf), A.contacts_v(spark, sf), keyword="eRRor", since="2024-01-05 00:00:00",
        until="2024-01-28 12:00:00", limit=50, offset=25), "message_text")


@query
def search_alerts(spark, sf):
    return _listed(search.search_alerts(
        A.alerts_v(spark, sf), A.contacts_v(spark, sf), keyword="PURch", account="acct_2", decision="accept",
        min_confidence=0.3, limit=40, offset=10), "keyword", "decision")


@query
def alerts_in_category(spark, sf):
    lex = A.events(spark, sf).groupBy(F.col("event_type").alias("term")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "even").otherwise("odd").alias("category"))
    return search.alerts_in_category(A.alerts_v(spark, sf), lex, "even").select("message_hash", "keyword")


@query
def search_category(spark, sf):
    lex = A.events(spark, sf).groupBy(F.col("event_type").alias("term")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "even").otherwise("odd").alias("category"))
    return _listed(search.search_category(
        A.alerts_v(spark, sf), A.contacts_v(spark, sf), lex, "odd", limit=30, offset=5, account="acct_3", sender_id=8,
        min_confidence=0.1), "keyword", "decision")


@query
def hourly_stats(spark, sf):
    h = search.hourly_stats(A.messages_v(spark, sf), A.results_v(spark, sf), "2024-01-10 00:00:00")
    return h.select(stamp("hour").alias("hour"), "messages_count", "alerts_count", "accepted_count",
                    r9("avg_confidence").alias("avg_confidence"))


@query
def top_keywords(spark, sf):
    return search.top_keywords(A.alerts_v(spark, sf), 3).withColumnRenamed("count", "n")


@query
def top_senders(spark, sf):
    return search.top_senders(A.messages_v(spark, sf), A.contacts_v(spark, sf), _reputation(spark, sf), 20).select(
        "sender_id", "total_messages", "alerts_count", "username", "first_name", "reputation_score")


@query
def dashboard_summary(spark, sf):
    stats = _sender_stats(spark, sf).join(_reputation(spark, sf), "sender_id")
    s = search.dashboard_summary(
        A.messages_v(spark, sf), A.alerts_v(spark, sf), stats, A.blocked_senders_v(spark, sf))
    return s.withColumns({"avg_confidence": r6("avg_confidence"), "avg_reputation": r6("avg_reputation")})


@query
def activity_stats(spark, sf):
    stats = _sender_stats(spark, sf).join(_reputation(spark, sf), "sender_id")
    return search.activity_stats(A.messages_v(spark, sf), A.alerts_v(spark, sf), "2024-01-30 12:00:00", stats,
                                 A.blocked_senders_v(spark, sf), decisions=("accept", "review"))


@query
def recent_alerts(spark, sf):
    return _listed(search.recent(A.alerts_v(spark, sf), A.contacts_v(spark, sf), 10), "keyword")


@query
def recent_messages(spark, sf):
    return _listed(search.recent(A.messages_v(spark, sf), A.contacts_v(spark, sf), 10), "message_text")


@query
def new_by_key(spark, sf):
    m = A.messages_v(spark, sf)
    twice = m.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    existing = A.alerts_v(spark, sf)
    return sinks.new_by_key(twice, existing, "message_hash", ["ts", "copy"]).select(
        "message_hash", "copy", stamp("ts").alias("ts"))


@query
def alert_export(spark, sf):
    rows = sinks.alert_export_rows(A.alerts_v(spark, sf), A.contacts_v(spark, sf))
    return rows.withColumn("confidence", r6("confidence"))


# --- monitoring -----------------------------------------------------------------------------
@query
def latency_percentiles(spark, sf):
    return monitoring.latency_percentiles(A.samples_v(spark, sf)).withColumnRenamed("count", "n")


@query
def zscore_anomalies(spark, sf):
    z = monitoring.zscore_anomalies(A.samples_v(spark, sf), digits=None)
    return z.select("key", "id", F.round(F.col("mean") * F.when(F.col("sample_size") >= 30, F.col("sample_size")).otherwise(1), 4).alias("prior_sum"),
                    *[r6(c).alias(c) for c in ("std", "z_score")], "sample_size",
                    flag("is_anomaly").alias("is_anomaly"))


@query
def rolling_mean(spark, sf):
    return monitoring.rolling_mean(A.samples_v(spark, sf)).select(
        "key", "id", r9("rolling_mean").alias("rolling_mean"))


@query
def sustained_growth(spark, sf):
    g = monitoring.sustained_growth(A.samples_v(spark, sf), n=3, ratio=1.2, slack=0.5)
    return g.select("key", "id", "baseline", "peak", flag("elevated").alias("elevated"), flag("growing").alias("growing"))


@query
def health_rollup(spark, sf):
    status = A.health_v(spark, sf)
    queue = status.groupBy("scope", "check_time").agg(F.count(F.lit(1)).alias("queue_size")).filter(F.hour("check_time") > 5)
    h = monitoring.health_rollup(status, database="purchase", client="signup", queue=queue, queue_capacity=14)
    return h.select(stamp("check_time").alias("check_time"), "monitors_up", "monitors_total",
                    flag("healthy").alias("healthy"), "consecutive_unhealthy", "queue_size", flag("queue_ok").alias("queue_ok"))


# --- lexicon maintenance -----------------------------------------------------------------------
@query
def lexicon_index(spark, sf):
    i = lexicon_admin.lexicon_index(A.lexicon_v(spark, sf))
    return i.select("category", "total", "path", "label", F.col("count").alias("n"), F.array_join("items", "|").alias("items"))


@query
def lexicon_search(spark, sf):
    return lexicon_admin.lexicon_search(A.lexicon_v(spark, sf), " Red W")


@query
def apply_lexicon_edits(spark, sf):
    fresh, _ = lexicon_admin.apply_lexicon_edits(A.lexicon_v(spark, sf), A.edits_v(spark, sf))
    return fresh.select("path", "pos", "term")


@query
def lexicon_edit_statuses(spark, sf):
    return lexicon_admin.apply_lexicon_edits(A.lexicon_v(spark, sf), A.edits_v(spark, sf))[1]


@query
def export_lexicon(spark, sf):
    return lexicon_admin.export_lexicon(A.lexicon_v(spark, sf))
    return lists.select("category", "grp", F.array_join("items", "|").alias("items"))
