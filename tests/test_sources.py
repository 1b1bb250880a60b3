import json
import random
from importlib.resources import files
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chatsieve.operators import lexicon_admin as L
from chatsieve.sources import logs, sinks
from chatsieve.sources.lexicon import lexicon_from_documents

FIXTURES = Path(__file__).parent / "fixtures"
DOC = {"ad_blockers": ["x.y", "q\"z"], "intent_verbs": {"t": {"_weight_hint": 0.9, "terms": ["go", "get"]}},
       "request_phrases": {"a": ["one"], "b": ["two"]}}


def test_log_entries(spark):
    body = ("stray line\n2024-01-01 10:00:00 | INFO     | main:1 | start\n2024-01-01 10:00:01 | ERROR | db:2 | boom\n"
            "Traceback\n  at x | y\n2024-01-01 10:00:02 | NOPE | a:1 | odd level\n")
    out = logs.last_entries(logs.entries_from_texts(spark.createDataFrame([("f", body)], "file string, body string")))
    rows = [(r["level"], r["source"], r["message"]) for r in out.collect()]
    assert rows == [("ERROR", "db:2", "boom\nTraceback\n  at x | y\n2024-01-01 10:00:02 | NOPE | a:1 | odd level"),
                    ("INFO", "main:1", "start")]


def test_log_entries_from_lines_without_a_file_in_one_row(spark):
    draw = [f"2024-01-01 10:00:{i % 60:02} | INFO | m:{i} | start {i}" if i % 3 else f"  more {i} | x" for i in range(400)]
    bodies = spark.createDataFrame([(f, "\n".join(["left", *draw[k:]])) for f, k in (("a", 0), ("b", 50))], "file string, body string")
    lines = [(f, n, x) for f, k in (("a", 0), ("b", 50)) for n, x in enumerate(["left", *draw[k:]])]
    rows = spark.createDataFrame(lines, "file string, line_no int, line string").repartition(4)
    got = logs.entries_from_lines(rows, ["line_no"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.entries_from_texts(bodies).collect()))


def test_insert_or_ignore(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "message_hash string, ts int")
    assert sinks.write_new_by_key(df, target, "message_hash", ["ts"]).count() == 2
    more = spark.createDataFrame([("b", 9), ("c", 4)], "message_hash string, ts int")
    assert sinks.write_new_by_key(more, target, "message_hash", ["ts"]).count() == 1
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def exported(lexicon):
    out, lines = {}, L.export_lexicon(lexicon).orderBy("category", "line_no").collect()
    for category in {r.category for r in lines}:
        out |= json.loads("\n".join(r.line for r in lines if r.category == category))
    return out


def test_export_gives_the_document_back(spark):
    docs = spark.createDataFrame([(json.dumps(DOC),)], "doc string")
    assert exported(lexicon_from_documents(docs)) == DOC


def test_edits(spark):
    docs = spark.createDataFrame([(json.dumps(DOC),)], "doc string")
    edits = [("ad_blockers", "add", None, " new ", 1), ("ad_blockers", "add", None, "new", 2),
             ("ad_blockers", "rename", "x.y", "new", 3), ("ad_blockers", "rename", "x.y", "xy", 4),
             ("ad_blockers", "delete", "new", None, 5), ("ad_blockers", "delete", "new", None, 6),
             ("nowhere", "add", None, "v", 7), ("ad_blockers", "add", None, "  ", 8)]
    frame = spark.createDataFrame(edits, "path string, action string, old string, new string, seq int")
    fresh, statuses = L.apply_lexicon_edits(lexicon_from_documents(docs), frame)
    assert {r["seq"]: r["status"] for r in statuses.collect()} == {
        1: "ok", 2: "already_exists", 3: "already_exists", 4: "ok", 5: "ok", 6: "not_found", 7: "bad_path", 8: "empty"}
    assert [r["term"] for r in fresh.filter("path = 'ad_blockers'").orderBy("pos").collect()] == ["xy", 'q"z']


def test_export_of_a_large_category_and_odd_names(spark, tmp_path):
    doc = {"request": {"a": {"b": [f"t{i}" for i in range(300)], "terms": ['q"\\', "é 日本", ""]}, "z": {"c": {"d": ["x"]}}, "y y": ["\n"]}, "ad_blockers": ["1"]}
    lexicon = lexicon_from_documents(spark.createDataFrame([(json.dumps(doc),)], "doc string")).repartition(7)
    assert exported(lexicon) == doc
    # lists whose order is mixed up still make one object each
    mixed = lexicon.withColumn("ord", F.when(F.col("path") == "request.a.terms", F.array(F.lit(9))).otherwise(F.col("ord")))
    assert exported(mixed) == doc
    L.write_lexicon(lexicon, str(tmp_path / "out"))
    text = "\n".join(f.read_text(encoding="utf-8").rstrip("\n") for f in sorted((tmp_path / "out" / "category=request").glob("part-*")))
    assert json.loads(text) == {"request": doc["request"]}
    assert L.export_lexicon(lexicon.limit(0)).count() == 0


def folded(items, edits):
    """Edits (action, old, new) over a list one after another."""
    statuses = []
    for action, old, new in edits:
        value = (new or "").strip()
        if action != "delete" and not value:
            status = "empty"
        elif items is None:
            status = "bad_path"
        elif action == "add":
            status = "already_exists" if value in items else "ok"
            items = items if value in items else [*items, value]
        elif old not in items:
            status = "not_found"
        elif action == "rename" and value != old and value in items:
            status = "already_exists"
        else:
            at, status = items.index(old), "ok"
            items = [*items[:at], *([value] if action == "rename" else []), *items[at + 1:]]
        statuses.append(status)
    return items, statuses


def test_edits_as_one_after_another(spark):
    draw = random.Random(5)
    paths = {f"request.l{i}": [draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))] for i in range(12)}
    asked = [(draw.choice([*paths, "nowhere"]), draw.choice(["add", "rename", "delete", "delete"]), draw.choice([*"abcdefgh", None]), draw.choice([*"abcdefgh", " c ", "", None]), s)
             for s in range(600)]
    asked = [(p, a, None if a == "add" else o, None if a == "delete" else n, s) for p, a, o, n, s in asked]
    asked += [("request.l3", "add" if s % 2 else "delete", None if s % 2 else "k", "k" if s % 2 else None, 1000 + s) for s in range(300)]
    rows = [(p, "request", p[8:], t, 0.7, i, [0, k]) for k, (p, items) in enumerate(paths.items()) for i, t in enumerate(items)]
    lexicon = spark.createDataFrame(rows, "path string, category string, grp string, term string, weight double, pos int, ord array<int>").repartition(3)
    fresh, statuses = L.apply_lexicon_edits(lexicon, spark.createDataFrame(asked, "path string, action string, old string, new string, seq long").repartition(3))
    want, said = {}, {}
    for p in [*paths, "nowhere"]:
        mine = [e for e in asked if e[0] == p]
        want[p], found = folded(paths.get(p), [e[1:4] for e in mine])
        said |= {e[4]: x for e, x in zip(mine, found, strict=True)}
    assert {r.seq: r.status for r in statuses.collect()} == said
    got = {p: [] for p in paths}
    for r in fresh.orderBy("path", "pos").collect():
        assert r.pos == len(got[r.path])
        got[r.path].append(r.term)
    assert got == {p: want[p] for p in paths}


def test_replace_needs_an_object(spark, tmp_path):
    L.replace_lexicon(spark.createDataFrame([(json.dumps(DOC),)], "doc string"), str(tmp_path), 1)
    with pytest.raises(ValueError):
        L.replace_lexicon(spark.createDataFrame([("[]",)], "doc string"), str(tmp_path), 2)


def test_documents_in_a_table_compile_as_on_the_driver(spark, tmp_path):
    from chatsieve.plans.lexicon import compile_documents, compile_json
    from chatsieve.sources.lexicon import documents, read_dialect, read_lexicon

    for text in ((FIXTURES / "lexicon_ar.json").read_text(encoding="utf-8"), files("chatsieve.lexicons").joinpath("latin.json").read_text(encoding="utf-8")):
        (tmp_path / "lexicon.json").write_text(text, encoding="utf-8")
        here, there = compile_json(text), compile_documents(documents(spark, str(tmp_path / "lexicon.json")))
        assert here.sets.keys() == there.sets.keys() and all(here.sets[k] == there.sets[k] for k in here.sets)
        assert (here.intent_weights, here.object_weights) == (there.intent_weights, there.object_weights)
        assert (here.distance_bands, here.length_bands, here.dialect) == (there.distance_bands, there.length_bands, there.dialect)
        assert {r.variant: r.canonical for r in read_dialect(spark, str(tmp_path / "lexicon.json")).collect()} == here.dialect
        assert read_lexicon(spark, str(tmp_path / "lexicon.json")).filter(F.col("path").startswith("intent_verbs")).count() >= len(here.sets["intent"])


def test_alert_export_as_csv(spark, tmp_path):
    alerts = spark.createDataFrame([(f"h{i}", i % 3, 7, "a", "k", "accept", 0.5, f'text, "{i}"\n' + "x" * 300, f"2024-01-0{i + 1} 00:00:00") for i in range(5)],
                                   "message_hash string, sender_id int, chat_id int, account_name string, keyword string, decision string, confidence double, alert_text string, at string")
    alerts = alerts.withColumn("ts", F.to_timestamp("at"))
    contacts = spark.createDataFrame([(0, "u0", "Ann", None, "l0"), (1, "u1", "", "", "l1")], "sender_id int, username string, first_name string, last_name string, last_message_link string")
    for limit in (None, 2):
        out = str(tmp_path / f"csv{limit}")
        sinks.export_alerts_csv(alerts, contacts, out, limit)
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(out).collect()
        assert sorted((r["id"] for r in rows), reverse=True) == ["h4", "h3", "h2", "h1", "h0"][:limit]
        assert all(r["time"] == f"2024-01-0{int(r['id'][1]) + 1} 00:00:00" for r in rows)
    assert {r["id"]: (r["sender_name"], r["username"]) for r in sinks.alert_export_rows(alerts, contacts).collect()} == {
        "h0": ("Ann", "u0"), "h1": (None, "u1"), "h2": (None, None), "h3": ("Ann", "u0"), "h4": (None, "u1")}
    assert {len(r["text"]) for r in sinks.alert_export_rows(alerts, contacts).collect()} == {200}


def test_repeated_messages_of_a_stream(spark, tmp_path):
    from chatsieve.operators.dedup import dedup_messages_stream

    source = tmp_path / "in"
    source.mkdir()
    for n, ids in enumerate(([1, 1, 2], [2, 3, 1])):
        rows = [{"chat_id": 5, "message_id": i, "text": f" Text {i} ", "ts": f"2024-01-01T00:0{i}:00Z"} for i in ids]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    stream = (spark.readStream.schema("chat_id long, message_id long, text string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
              .withWatermark("ts", "1 hour"))
    seen = []
    run = dedup_messages_stream(stream).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.message_id for r in seen) == [1, 2, 3]
