import json
from pathlib import Path

from pyspark.sql import functions as F

from chatsieve.plans.lexicon import compile_json
from chatsieve.sources.events import read_events_stream
from chatsieve.sources.state import CurrentState
from chatsieve.streaming.live_stats import start_live_stats
from chatsieve.streaming.live_triage import LiveTriage

LEXICON = compile_json((Path(__file__).parent / "fixtures" / "lexicon_ar.json").read_text(encoding="utf-8"))


def event(i, sender, at, text):
    return {"chat_id": -100500, "message_id": i, "sender_id": sender, "text": text, "account_name": f"acct_{sender % 2}",
            "timestamp": 1_700_000_000.0 + at}


EVENTS = [
    event(1, 1, 0, "انا محتاج بحث ضروري اليوم"),
    event(2, 1, 60, "انا محتاج تقرير ضروري اليوم"),      # within the cooldown
    event(3, 2, 90, "صباح الخير يا جماعه اليوم"),
    event(1, 1, 95, "انا محتاج بحث ضروري اليوم"),        # delivered again
    event(4, 1, 400, "انا محتاج واجب ضروري بكره"),
    event(5, 3, 410, "انا محتاج بحث ضروري اليوم"),       # same content, other sender
]


def run(spark, folder, groups, max_files):
    (folder / "in").mkdir(parents=True)
    for n, group in enumerate(groups):
        (folder / "in" / f"{n}.json").write_text("\n".join(json.dumps(e) for e in group), encoding="utf-8")
    live = LiveTriage(str(folder / "out"), LEXICON)
    stream = read_events_stream(spark, str(folder / "in"), max_files=max_files)
    live.start(stream, str(folder / "ckpt"), available_now=True).awaitTermination(120)
    return live


def test_one_batch_and_many_batches_agree(spark, tmp_path):
    whole = run(spark, tmp_path / "a", [EVENTS], None)
    split = run(spark, tmp_path / "b", [EVENTS[:2], EVENTS[2:4], EVENTS[4:]], 1)
    for live in (whole, split):
        assert live.table(spark, "messages").count() == 5
        reasons = {r["message_id"]: r["reason"] for r in live.table(spark, "results").collect()}
        assert reasons == {1: "keyword_found", 2: "keyword_found", 3: "no_keyword", 4: "keyword_found", 5: "duplicate"}
        assert sorted(r["message_id"] for r in live.table(spark, "alerts").collect()) == [1, 4]
        state = {r["sender_id"]: (r["total_messages"], r["alerts_sent"], r["reputation_score"]) for r in live.current_senders(spark).collect()}
        assert state == {1: (3, 2, 56.0), 2: (1, 0, 49.0), 3: (1, 0, 49.0)}
        assert {r["sender_id"]: r["last_message_id"] for r in live.current_profiles(spark).collect()} == {1: 4, 2: 3, 3: 5}


def frame(spark, events):
    from chatsieve.schemas import EVENT_SCHEMA
    from chatsieve.sources.events import with_derived
    rows = [{f.name: e.get(f.name) for f in EVENT_SCHEMA.fields} for e in events]
    return with_derived(spark.createDataFrame(rows, EVENT_SCHEMA))


def test_retries_and_stream_see_each_other(spark, tmp_path):
    blocked = []
    live = LiveTriage(str(tmp_path / "out"), lambda: LEXICON,
                      blocked_senders=lambda: spark.createDataFrame([(s,) for s in blocked], "sender_id long"))
    live.process(frame(spark, EVENTS[:1]), 0)
    failed = spark.createDataFrame([(None, 1)], "kind string, n int").join(
        frame(spark, EVENTS[4:5] + [event(9, 9, 500, "قصير"), event(10, 9, 501, "انا محتاج " + "بحث " * 300)]).select(F.struct("*").alias("event")))
    live.reprocess(failed, 0)
    live.process(frame(spark, EVENTS[4:5] + EVENTS[2:3]), 1)      # message 4 comes again after its retry
    live.process(frame(spark, EVENTS[4:5] + EVENTS[2:3]), 1)      # a repeated micro-batch does nothing
    blocked.append(3)
    live.process(frame(spark, EVENTS[5:]), 2)
    assert sorted((r.message_id, r.batch) for r in live.table(spark, "messages").collect()) == [(1, 0), (3, 2), (4, 1), (10, 1)]
    assert [len(r.message_text) for r in live.table(spark, "messages").filter("message_id = 10").collect()] == [1209]
    assert sorted(r.message_id for r in live.table(spark, "alerts").collect()).count(4) == 1
    assert [(r.message_id, r.rejected_reason) for r in live.table(spark, "rejected").collect()] == [(9, "too_short")]
    assert live.table(spark, "runs").count() == 4


def test_alerts_sent_again(spark, tmp_path):
    live = LiveTriage(str(tmp_path / "out"), LEXICON)
    live.process(frame(spark, EVENTS[:1]), 0)
    sent = live.table(spark, "alerts").drop("batch", "day")
    again = sent.unionByName(sent.withColumn("message_hash", F.lit("lost"))).unionByName(sent.withColumn("message_hash", F.lit("lost")))
    failures = again.select(F.lit("alert_resend").alias("kind"), F.struct("*").alias("alert")).withColumn(
        "event", F.lit(None).cast(frame(spark, []).select(F.struct("*").alias("e")).schema["e"].dataType))
    live.reprocess(failures, 0)
    live.reprocess(failures, 1)
    first = sent.first()["message_hash"]
    assert sorted((r.message_hash == first, r.batch) for r in live.table(spark, "alerts").collect()) == [(False, 1), (True, 0)]


def test_feedback_changes_the_weights_of_the_next_run(spark, tmp_path):
    text = (Path(__file__).parent / "fixtures" / "lexicon_ar.json").read_text(encoding="utf-8")
    live = LiveTriage(str(tmp_path / "out"), lambda: compile_json(text, live.weights(spark)))
    live.process(frame(spark, EVENTS[:1]), 0)
    first = live.table(spark, "results").first()
    term = first["intent_verb"]
    begin = LEXICON.intent_weights.get(term, 0.7)
    said = lambda *right: spark.createDataFrame([("intent", term, r, i) for i, r in enumerate(right)] + [("intent", "new term", True, 9)],
                                                "kind string, term string, was_correct boolean, seq int")
    live.learn(said(False, False), 0)
    live.learn(said(False, False), 0)       # the same again does nothing
    live.learn(said(True), 1)
    want = begin
    for target in (0.1, 0.1, 1.0):
        want += 0.05 * (target - want)
    got = {r.term: (round(r.weight, 9), r.n_feedback) for r in live.weights(spark).collect()}
    assert got == {term: (round(want, 9), 3), "new term": (round(0.7 + 0.05 * 0.3 + 0.05 * (1.0 - 0.7 - 0.05 * 0.3), 9), 2)}
    live.process(frame(spark, [event(30, 8, 900, "انا محتاج بحث ضروري الان فورا")]), 1)
    second = live.table(spark, "results").filter("message_id = 30").first()
    assert second["intent_verb"] == term and second["score_details"]["intent_weight"] == round(want, 4) != first["score_details"]["intent_weight"]
    assert sorted(r.run for r in live.table(spark, "runs").collect()) == [0, 3]


def test_late_events_are_rejected_and_counted(spark, tmp_path):
    live = LiveTriage(str(tmp_path / "out"), LEXICON, allowed_lateness=100.0)
    live.process(frame(spark, EVENTS[4:5]), 0)
    live.process(frame(spark, EVENTS[1:3] + [event(20, 7, 301, "انا محتاج بحث ضروري جدا")]), 1)
    live.reprocess(frame(spark, EVENTS[1:2]).select(F.lit(None).cast("string").alias("kind"), F.struct("*").alias("event")), 0)
    assert sorted((r.message_id, r.batch) for r in live.table(spark, "messages").collect()) == [(2, 2), (4, 0), (20, 1)]
    assert sorted((r.message_id, r.rejected_reason) for r in live.table(spark, "rejected").collect()) == [(2, "late"), (3, "late")]
    assert sorted((r.run, r.source, r.events, r.late, r.messages) for r in live.table(spark, "runs").collect()) == [
        (0, "stream", 1, 0, 1), (1, "stream", 3, 2, 1), (2, "retry", 1, 0, 1)]


def test_old_days_are_not_read(spark, tmp_path, capsys):
    live = LiveTriage(str(tmp_path / "out"), LEXICON, history_days=2)
    day = 86_400
    live.process(frame(spark, EVENTS[:1]), 0)
    live.process(frame(spark, [event(1, 1, 0, EVENTS[0]["text"]), event(7, 1, day, "انا محتاج شرح ضروري اليوم")]), 1)
    live.process(frame(spark, [event(8, 1, 5 * day, EVENTS[0]["text"])]), 2)     # the content is forgotten by now
    assert sorted((r.message_id, r.batch) for r in live.table(spark, "messages").collect()) == [(1, 0), (7, 1), (8, 2)]
    assert {r.message_id: r.reason for r in live.table(spark, "results").collect()}[8] == "keyword_found"
    # the read of a run lists only the days that count
    found = live._before(spark, "messages", 9, live._since(frame(spark, [event(8, 1, 5 * day, "x")])))
    assert {r.message_id for r in found.collect()} == {8}
    found.explain("formatted")
    assert "day" in next(line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line)


def test_state_keeps_the_last_row_and_survives_a_failed_run(spark, tmp_path):
    state = CurrentState(str(tmp_path / "s"), "k", 4)
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    read = lambda run, *keys: {r.k: r.v for r in state.read(spark, run, *keys).collect()}
    assert state.read(spark, 9) is None
    state.merge(rows(*[(k, f"a{k}") for k in range(30)]), 0)
    state.merge(rows((3, "b"), (99, "b"), (None, "b")), 1)
    state.merge(rows((3, "broken")), 2)          # this run fails later on, and is done once more
    assert read(2)[3] == "b"
    state.merge(rows((3, "c"), (4, "c")), 2)
    want = {k: f"a{k}" for k in range(30)} | {3: "c", 4: "c", 99: "b", None: "b"}
    assert read(3) == want
    part = read(3, rows((3, "")))
    assert part[3] == "c" and part.items() <= want.items() and len(part) < len(want)
    for run in range(3, 9):
        state.merge(rows((run, f"r{run}")), run)
    assert read(9) == want | {run: f"r{run}" for run in range(3, 9)}
    assert len(list((tmp_path / "s").glob("bucket=*/slot=*"))) <= 8


def test_live_stats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(e) for e in EVENTS), encoding="utf-8")
    rows = read_events_stream(spark, str(tmp_path / "in")).withColumns({"decision": F.lit("accept"), "confidence": F.lit(0.5)})
    seen = []
    start_live_stats(rows, lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"), True).awaitTermination(60)
    last = {(r["account_name"], r["window"]["start"].timestamp()): r for r in seen}
    hour = 1_700_000_000 // 3600 * 3600
    assert {k: (r["messages"], r["alerts"], r["accepted"], r["reviewed"], r["ignored"], r["avg_confidence"]) for k, r in last.items()} == {
        ("acct_0", hour): (1, 1, 1, 0, 0, 0.5), ("acct_1", hour): (5, 5, 5, 0, 0, 0.5)}
