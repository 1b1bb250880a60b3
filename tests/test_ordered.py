import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatsieve.operators import monitoring, senders
from chatsieve.operators import ordered as O
from chatsieve.operators.admission import ScopeBudget


def hot_rows(spark, n=600, seed=3):
    rng = random.Random(seed)
    t, rows = 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([1, 5, 20, 90, 400])
        rows.append((1 if rng.random() < 0.6 else rng.randint(2, 9), t, i, rng.random() < 0.4))
    return rows, spark.createDataFrame(rows, "sender_id long, at double, id long, is_valid boolean").select(
        "sender_id", F.timestamp_seconds("at").alias("ts"), "id", "is_valid")


def replay(rows, base):
    rep, last, reps, allowed = {}, {}, {}, {}
    for sender, t, i, ok in rows:
        rep[sender] = min(100.0, rep.get(sender, 50.0) + 2) if ok else max(0.0, rep.get(sender, 50.0) - 1)
        reps[i] = rep[sender]
        if ok:
            wait = max(30, base * (1 - rep[sender] / 200))
            allowed[i] = sender not in last or t - last[sender] >= wait
            if allowed[i]:
                last[sender] = t
    return rep, reps, allowed


def test_reputation_and_cooldown_with_a_hot_sender(spark):
    rows, df = hot_rows(spark)
    rep, reps, allowed = replay(rows, 300.0)
    assert {r["sender_id"]: r["reputation_score"] for r in senders.reputation(df, ["ts", "id"]).collect()} == rep
    walked = senders.running_reputation(df, ["ts", "id"])
    assert {r["id"]: r["reputation"] for r in walked.collect()} == reps
    gate = senders.cooldown_gate(walked.filter("is_valid").drop("_chunk"), ["ts", "id"])
    assert {r["id"]: r["allowed"] for r in gate.collect()} == allowed


def test_scope_budget_equals_plain_counting():
    rng = random.Random(5)
    now, budget, sent, seen, level, level_at = 0.0, ScopeBudget(12, 120, 5), [], [], 5.0, None
    for i in range(4000):
        now += rng.choice([0, 0.5, 1, 2, 30])
        account = f"a{rng.randint(0, 3)}"
        level, level_at = (level if level_at is None else min(5.0, level + (now - level_at) / 5)), now
        want = sum(t >= now - 60 for t, _ in sent) < 12 and sum(t >= now - 3600 for t, _ in sent) < 120 and level >= 1.0 - 1e-9
        if want:
            seen = seen if account in seen else [*seen, account]
            want = sum(t >= now - 60 and a == account for t, a in sent) < max(1, 12 // len(seen))
        if i == 2000:
            budget = ScopeBudget(12, 120, 5, budget.saved())
        assert budget.admits(now, account) == want, i
        if want:
            level -= 1
            sent.append((now, account))
    assert 0 < len(sent) < 4000


@pytest.mark.parametrize("run", [1, 7, 4096])
def test_chunks_fold_in_runs(spark, run):
    rows, df = hot_rows(spark, 300)
    chunked = O.in_chunks(df, ["sender_id"], ["ts", "id"], 2)
    value = O.step(1.0, F.when(F.col("is_valid"), 2.0).otherwise(-1.0), 0.0, 100.0)
    steps = O.chunk_steps(chunked, ["sender_id"], ["ts", "id"], value, run)
    whole = O.carried_values(steps, ["sender_id"], 50.0)
    assert whole.count() == steps.count() and steps.agg(F.sum("n")).first()[0] == 300
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, O.carried_values(
        O.chunk_steps(chunked, ["sender_id"], ["ts", "id"], value), ["sender_id"], 50.0).collect()))


def test_look_back_windows_across_chunks(spark):
    rng = random.Random(11)
    rows = [("hot" if i % 4 else f"k{i % 3}", i, i, float(rng.randint(0, 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at long, id long, value double").select(
        "key", F.timestamp_seconds("at").alias("ts"), "id", "value")
    pdf = pd.DataFrame(rows, columns=["key", "at", "id", "value"])
    mean = pdf.groupby("key")["value"].rolling(100, min_periods=1).mean().droplevel(0)
    got = {r["id"]: r["rolling_mean"] for r in monitoring.rolling_mean(df, 100).collect()}
    assert all(abs(got[i] - mean[i]) < 1e-9 for i in range(400))
    z = {r["id"]: r for r in monitoring.zscore_anomalies(df, window=60, digits=None).collect()}
    for key, group in pdf.groupby("key"):
        values = list(zip(group["id"], group["value"]))
        for k, (i, v) in enumerate(values):
            prior = pd.Series([x for _, x in values[max(0, k - 60):k]])
            assert z[i]["sample_size"] == len(prior)
            if len(prior) >= 30:
                assert abs(z[i]["z_score"] - (v - prior.mean()) / prior.std(ddof=0)) < 1e-6


def test_constant_values_have_no_spread(spark):
    df = spark.createDataFrame([("k", i, i, 0.1) for i in range(80)], "key string, at long, id long, value double").select(
        "key", F.timestamp_seconds("at").alias("ts"), "id", "value")
    assert monitoring.zscore_anomalies(df).filter("std <> 0 OR is_anomaly").isEmpty()


def test_mark_first_with_one_hot_group(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"))
    firsts = {r["id"] for r in O.mark_first(df, ["k"], ["id"]).filter("is_first").collect()}
    assert firsts == {0, *range(3, 2000, 3)}
