"""The test tables seen as the data model: messages, activity, samples, backlog, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_if_small(df: DataFrame) -> DataFrame:
    """Spread a table of a single file over the cores, as one row group is one task otherwise. A table of many files has
    splits of its own, so no text is shuffled for it."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def _minutes_after_start(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def msg_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread_if_small(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select(
        F.col("doc_id").alias("message_id"),
        F.regexp_extract("source", r"\d+", 0).cast("long").alias("chat_id"),
        (F.col("doc_id") % 97).alias("sender_id"),
        F.concat(F.lit("acct_"), (F.col("doc_id") % 5).cast("string")).alias("account_name"),
        _minutes_after_start(F.col("doc_id")).alias("ts"), "text", "lang")


def msg_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("turn").alias("message_id"), F.col("conv_id").alias("chat_id"),
        (F.col("conv_id") % 97).alias("sender_id"), "role", "text",
        _minutes_after_start(F.col("conv_id") * 60 + F.col("turn")).alias("ts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    decision = F.when(kind == "purchase", "accept").when(kind == "signup", "review").otherwise("ignore")
    return e.select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("message_hash"),
        F.col("event_id").alias("message_id"),
        (F.get_json_object("props", "$.k").cast("long") % 20).alias("chat_id"),
        F.col("user_id").alias("sender_id"),
        F.concat(F.lit("acct_"), (F.col("user_id") % 5).cast("string")).alias("account_name"),
        "ts", F.concat_ws(" ", "event_type", "props").alias("message_text"),
        F.when(kind != "view", kind).alias("keyword"),
        decision.alias("decision"),
        F.when(kind == "view", 0.0).otherwise(F.least(F.col("value") / 200, F.lit(1.0))).alias("confidence"),
        decision.isin("accept", "review").alias("is_valid"), kind.alias("event_type"))


def messages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select(
        "message_hash", "message_id", "chat_id", "sender_id", "account_name", "ts", "message_text", "keyword")


def alerts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).filter(F.col("keyword").isNotNull()).select(
        "message_hash", "chat_id", "sender_id", "account_name", "ts", "keyword",
        F.concat(F.lit("alert: "), "message_text").alias("alert_text"), "decision", "confidence")


def results_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select("message_hash", "keyword", "decision", "confidence", "is_valid")


def contacts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sender_id"), F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.concat(F.lit("https://t.me/c/"), F.col("c_custkey").cast("string")).alias("last_message_link"))


def blocked_senders_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).filter(F.col("sender_id") % 17 == 0).groupBy("sender_id").agg(
        F.lit("manual").alias("reason"), F.min("ts").alias("blocked_at"))


def blocked_chats_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).filter(F.col("chat_id") % 13 == 0).groupBy("chat_id").agg(
        F.lit("manual").alias("reason"), F.min("ts").alias("blocked_at"))


def block_events_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir).filter(F.col("event_type").isin("error", "signup"))
    return a.select(
        "sender_id", F.when(F.col("event_type") == "error", "block").otherwise("unblock").alias("action"),
        F.concat(F.lit("r"), F.col("chat_id").cast("string")).alias("reason"), "ts",
        F.col("message_id").alias("event_id"))


def samples_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"), "value")


def backlog_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "view", 7).otherwise(3).alias("priority"),
        F.col("ts").alias("created_at"), F.col("props").alias("event_data"))


def failures_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("chat_id"),
        (F.col("user_id") % 7).alias("message_id"), (F.col("event_id") % 7).cast("int").alias("retry_count"),
        F.concat(F.lit("Error: "), F.repeat(F.col("props"), 40)).alias("error_text"), "ts")


def dead_letters_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"),
        F.to_json(F.struct(
            (F.col("user_id") % 20).alias("chat_id"), F.col("event_id").alias("message_id"),
            F.concat(F.lit("acct_"), (F.col("user_id") % 5).cast("string")).alias("account_name"),
        )).alias("event_data"),
        F.lit("Error: failed").alias("error_text"), (F.col("event_id") % 7).cast("int").alias("retry_count"),
        (F.col("event_id") % 3 == 0).alias("resolved"), F.col("ts").alias("created_at"))


def feedback_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "intent").otherwise("academic").alias("kind"),
        F.concat(F.lit("term"), (F.col("doc_id") % 5).cast("string")).alias("term"),
        (F.col("quality") == 1).alias("was_correct"), F.col("doc_id").alias("seq"))


def weights_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weight per term of the benchmark-sized vocabulary: brands of `part`, and term0..2."""
    p = table(spark, sf_dir, "part")
    brands = p.groupBy(F.col("p_brand").alias("term")).agg(
        (F.avg("p_size") / 100 + 0.3).alias("weight")).select(F.lit("intent").alias("kind"), "term", "weight")
    low = p.groupBy(F.concat(F.lit("term"), (F.col("p_partkey") % 3).cast("string")).alias("term")).agg(
        (F.min("p_size") / 100 + 0.5).alias("weight")).select(F.lit("intent").alias("kind"), "term", "weight")
    return brands.unionByName(low)


def health_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(
        F.date_trunc("hour", "ts").alias("check_time"), F.col("event_type").alias("component")).agg(
        (F.max_by("value", "event_id") < 60).alias("ok")).withColumn("scope", F.lit("main"))


def lexicon_docs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lexicon document per part: lists at one, two and three levels, metadata, unknown keys."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    tiers = F.struct(F.struct((F.col("p_size") / 100).alias("_weight_hint"), words.alias("terms")).alias("tier"))
    return p.select("p_partkey", F.to_json(F.struct(
        F.lit("v1").alias("_version"), tiers.alias("intent_verbs"),
        F.struct(F.array("p_brand", "p_name").alias("general"), F.array("p_size").alias("numbers"))
        .alias("request_phrases"),
        F.array("p_type").alias("ad_blockers"), F.array("p_name").alias("not_a_category"))).alias("doc"))


def lexicon_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon table: a category per part type, a list per brand, the part names as terms."""
    p = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"\d+", 0).cast("int")
    category = F.lower(F.col("p_type"))
    grp = F.concat(F.lit("brand"), brand_no.cast("string"))
    lists = p.select(
        F.concat(category, F.lit("."), grp).alias("path"), category.alias("category"), grp.alias("grp"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("term"),
        F.lit(0.7).alias("weight"), F.col("p_partkey").cast("int").alias("pos"), F.array(brand_no).alias("ord"))
    return lists


def edits_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of that lexicon, one per part; several on one term, with every status occurring."""
    p = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"\d+", 0)
    path = F.when(F.col("p_partkey") % 11 == 0, F.lit("missing.list")).otherwise(
        F.concat(F.lower("p_type"), F.lit(".brand"), brand_no))
    full = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    k = F.col("p_partkey") % 7
    action = F.when(k < 3, "add").when(k < 5, "rename").otherwise("delete")
    new = F.when(k == 0, F.lit("  ")).when(k == 1, full).when(k == 2, F.concat(F.lit(" new "), "p_name")).when(
        k == 3, F.concat(F.lit("renamed "), F.col("p_partkey").cast("string"))).when(k == 4, full)
    old = F.when(k.isin(3, 5), full).when(k == 4, F.concat(F.lit("new "), "p_name")).when(k == 6, F.lit("absent"))
    return p.select(path.alias("path"), action.alias("action"), old.alias("old"), new.alias("new"),
                    F.col("p_partkey").alias("seq"))
