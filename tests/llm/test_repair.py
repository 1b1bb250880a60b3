"""Repair of conversations, against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chatsieve.llm import repair
from chatsieve.llm.queries import op13_conversation_repair, repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 and text is not None else text
        row = conv, turn, "user" if draw == 4 else role, text
        yield from [row, row] if draw == 3 else [row]


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, by search; and the repaired rows."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", at, r, (*out, (name, ""))))
        if at < len(rows):
            (role, text), more = rows[at], 5 * (faults[at] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if faults[at] not in ("blank", "duplicate"):
                first = (role or "")[:1]
                if first and first in follow:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, first, (*out, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follow:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, r, (*out, (name, text))))


def brute(conversation):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (turn, role, text)."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", hashlib.md5((r[2] or "").encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = (text or "").strip(" \t\n\v\f\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [(r[1] or "")[:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = cheapest([r[1:] for r in rows], faults)
    text = "\n".join(f"{a}:{b}" for a, b in out)
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {r[0]: [] for r in rows}
    for r in damaged(rows):
        out[r[0]].append(r[1:])
    return {k: brute(v) for k, v in out.items()}


def found(spark, rows, chunk_rows=1024):
    return {r[0]: tuple(r)[1:] for r in repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_rows).collect()}


def drawn(draw, convs, longest):
    texts = ["Yes.", "No!", "", None, " \n", "well", "what? ", "a.b", "x.\n", "Hm…", "ok.\t", *(f"text {i}." for i in range(12))]
    roles = ["user", "assistant"] * 6 + ["system", "user", "assistant", "tool", None, "", "uncle", "System"]
    for c in range(convs):
        alternate = draw.random() < 0.5
        for t in range(draw.randint(1, longest)):
            role = ("user", "assistant")[t % 2] if alternate and draw.random() < 0.9 else draw.choice(roles)
            yield c, draw.choice([t, t, t, t + 1, None]), role, draw.choice(texts)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_cheapest_edits_as_by_search(spark, chunk):
    draw = random.Random(chunk)
    rows = [*drawn(draw, 250, 12), *((1000, t, ("user", "assistant")[t % 2], f"word {t}.") for t in range(120)), *((1001, t, "user", "same") for t in range(90)),
            (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (2000, 3, "system", "Only."), (2001, None, None, None)]
    rows += [(3000 + i, t, "user", "x.") for i in range(60) for t in [next(t for t in range(9999) if zlib.crc32(f"{3000 + i}:{t}".encode()) % 20 == 0)]]
    assert found(spark, rows, chunk) == expected(rows)


def test_chunks_join_in_rounds(spark):
    rows = [(1, t, random.Random(t).choice(["user", "assistant", "tool"]), f"{t}.") for t in range(700)]
    assert found(spark, rows, 2) == expected(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13_conversation_repair(spark, str(tmp_path)).collect() == []


def test_rows_come_out_repaired(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Me."), (2, 5, "system", "Be."), (2, 6, "assistant", "So."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 audit", "2 place")
    audits = repair.diagnosed(df)
    got = [tuple(r) for r in repair.repaired(df, audits).orderBy("conv_id", "place").collect()]
    assert [(r.conv_id, r.audit) for r in audits.orderBy("conv_id").collect()] == [(1, "DKK"), (2, "RK"), (3, "D")]
    assert got == [(1, 0, "user", "You?"), (1, 1, "assistant", "Me."), (2, 0, "user", "Be."), (2, 1, "assistant", "So.")]


def test_rules_shorten_and_change_nothing(spark):
    strings = ["uauauaua" * 20, "suauaXx", "", "x", "UAuauauao", "aaaa"]
    strings = [s.replace("X", "O") for s in strings]
    rows, grammar = repair.compressed(spark.createDataFrame([(s,) for s in strings], "kinds string"), max_rules=6, at_once=2)
    assert len(grammar.rules) == 6
    plain = repair.Grammar()
    for r in rows.collect():
        ways = [x and (x[0], repair.text_of(x[1])) for x in grammar.of(r.symbols)]
        assert ways == [x and (x[0], repair.text_of(x[1])) for x in plain.of([repair.KINDS.index(c) for c in r.kinds])]
        assert len(r.symbols) <= len(r.kinds)
    assert max(len(r.symbols) for r in rows.collect()) < 30
