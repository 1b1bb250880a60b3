"""Repair of the structure of conversations: cheapest edits by a min-plus dynamic program over a Re-Pair grammar of their rows.

The edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2). Insert an empty row of user or assistant (5) anywhere. A truncated
row that stays costs 5 more; a blank or repeated row must go. What remains must read `(s?(ua)+)?` in initials of roles. An audit is a string of
the edits' initials in order. Among the cheapest the least in ASCII order counts, and it determines the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of what was kept so far: nothing; ends in system; in user; in assistant. Nothing and assistant may end a conversation.
STATES, START, ACCEPTING = 4, 0, (0, 3)
#: Where a row of a role leads from a state.
_ROLES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Letters of row kinds: a row that must go; or by initial (`o`: any other role) a whole row, upper case a truncated one.
GONE, KINDS = "x", "xsuaoSUAO"
_NAMES = {2: "user", 3: "assistant"}


def text_of(rope: str | tuple) -> str:
    """A rope is a string or a pair of ropes."""
    parts, waiting = [], [rope]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            waiting += (x[1], x[0])
    return "".join(parts)


def better(a, b):
    """The cheaper entry; of equally cheap ones that with the lesser audit.

    The order holds under concatenation: of two audits over the same rows at the same cost none is the beginning of the other.
    """
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return min(a, b, key=lambda x: x[0])
    return a if text_of(a[1]) <= text_of(b[1]) else b


def product(x: list, y: list) -> list:
    """The min-plus product of two transfer matrices: rows of STATES entries, each a cost and an audit (a rope), or None: no way."""
    out: list = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            first = x[STATES * i + k]
            if first is None:
                continue
            for j in range(STATES):
                second = y[STATES * k + j]
                if second is not None:
                    at = STATES * i + j
                    made = first[0] + second[0], (first[1], second[1]) if first[1] and second[1] else first[1] or second[1]
                    out[at] = better(out[at], made)
    return out


def _matrix(ways: Iterator[tuple[int, int, int, str]]) -> list:
    out: list = [None] * (STATES * STATES)
    for i, j, cost, audit in ways:
        out[STATES * i + j] = better(out[STATES * i + j], (cost, audit))
    return out


def _inserts() -> list:
    """Any inserts between two rows."""
    one = _matrix((i, j, INSERT, "I") for r in "ua" for i, j in _ROLES[r].items())
    none = _matrix((i, i, 0, "") for i in range(STATES))
    once = [better(a, b) for a, b in zip(none, one, strict=True)]
    return product(once, once)


def kind_matrix(kind: str) -> list:
    """The transfer matrix of one row, inserts around it included."""
    ways = [(i, i, DELETE, "D") for i in range(STATES)]
    if kind != GONE:
        more = TRUNCATED if kind.isupper() else 0
        ways += [(i, j, KEEP + more, "K") for i, j in _ROLES.get(kind.lower(), {}).items()]
        ways += [(i, j, REROLE + more, "R") for r in "ua" for i, j in _ROLES[r].items()]
    return product(product(_INSERTS, _matrix(iter(ways))), _INSERTS)


_INSERTS = _inserts()


class Grammar:
    """Symbols of row kinds and of Re-Pair rules (a rule: two symbols), each with its transfer matrix, made bottom-up and once."""

    def __init__(self):
        self.matrices = [kind_matrix(x) for x in KINDS]
        self.rules: list[tuple[int, int]] = []

    def add(self, left: int, right: int) -> None:
        self.rules.append((left, right))
        self.matrices.append(product(self.matrices[left], self.matrices[right]))

    def of(self, symbols: list[int]) -> list:
        out = _INSERTS
        for x in symbols:
            out = product(out, self.matrices[x])
        return out


def replaced(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """Pairs from left to right by the symbols of their rules."""
    out, at = [], 0
    while at < len(symbols):
        new = rules.get((symbols[at], symbols[at + 1])) if at + 1 < len(symbols) else None
        out.append(symbols[at] if new is None else new)
        at += 1 if new is None else 2
    return out


def compressed(sequences: DataFrame, max_rules: int = 2048, at_once: int = 256, rounds: int = 64) -> tuple[DataFrame, Grammar]:
    """Re-Pair over the distinct strings of column `kinds`: (kinds, symbols) and the grammar.

    A round counts neighbouring pairs in tasks, gives the `at_once` most frequent ones that come twice or more a rule each, and rewrites all
    sequences. It ends when no pair comes twice, or at `max_rules` or `rounds`: sequences then stay longer, and their results the same. So the
    grammar that goes to the tasks has a bounded size.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[KINDS.index(x) for x in s] for s in batch.column(0).to_pylist()], pa.list_(pa.int32()))],
                                             names=["kinds", "symbols"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for symbols in batch.column(0).to_pylist():
                counts.update(zip(symbols, symbols[1:]))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in counts], pa.int32()), pa.array([p[1] for p in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                                             names=["left", "right", "n"])

    grammar = Grammar()
    rows = staged(sequences.select("kinds").distinct().mapInArrow(first, "kinds string, symbols array<int>"))
    for _ in range(rounds):
        counted = rows.select("symbols").mapInArrow(pairs, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 1")
        best = counted.orderBy(F.desc("n"), "left", "right").limit(max(0, min(at_once, max_rules - len(grammar.rules)))).collect()
        if not best:
            break
        new = {(r["left"], r["right"]): len(grammar.matrices) + i for i, r in enumerate(best)}
        for left, right in new:
            grammar.add(left, right)
        rows = staged(rows.mapInArrow(_rewrite(new), "kinds string, symbols array<int>"))
    return rows, grammar


def _rewrite(new: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([replaced(s, new) for s in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
                                             names=["kinds", "symbols"])

    return run


WAYS = "array<struct<cost:long,audit:string>>"
_WAYS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def diagnosed(rows: DataFrame, ids: DataFrame | None = None, chunk_rows: int = 1024) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text) and of `ids` (conv_id): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit.

    Rows of a conversation go by turn (null first), then role, then a digest of the text. A row's first fault counts: blank (no character but
    white space, null too), duplicate (its role and text came earlier), truncated (the last character that isn't white space is none of
    `.!?`). gaps: turns that lack between the least and the greatest; illegal: neighbours whose initials aren't su, ua or au.

    Rows stream through the tasks in order, and leave as strings of row kinds, `chunk_rows` at most. Each distinct string is solved once: written
    in symbols of a grammar over all of them, it is the product of the symbols' matrices. Chunks of a long conversation are joined in rounds
    of 16. So a conversation of any length is never held, but its rows pass one task in order, and its audit is one value.

    Null conv_id: a conversation. Equal rows: the later ones are duplicates. Null role: no initial. No rows: zeros and an empty audit. Empty
    tables: no rows. Other columns of `rows` don't matter.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    text = F.coalesce("text", F.lit(""))
    facts = rows.select(
        "conv_id", "turn", "role", F.md5(text.cast("binary")).alias("digest"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    again = (facts.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
             .agg(F.count("*").alias("n"), F.min(turn).alias("first")).where("n > 1"))
    known = (facts.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("role").eqNullSafe(F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
             .select("conv_id", F.lit(True).alias("live"), "turn", "role", "digest", "blank", "truncated", F.col("n").isNotNull().alias("again"),
                     F.col("first.turn").alias("first")))
    marks = (rows.limit(0) if ids is None else ids).select("conv_id").distinct()
    marks = marks.select("conv_id", F.lit(False).alias("live"), *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns[2:]))
    ordered = known.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "live", "turn", "role", "digest")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    chunks = staged(ordered.mapInArrow(_scan(chunk_rows), f"conv_id {id_type}, chunk long, last boolean, kinds string, " + ", ".join(f"{c} long" for c in STATS)))
    symbols, grammar = compressed(chunks)
    solved = staged(symbols.mapInArrow(_evaluate(grammar), f"kinds string, ways {WAYS}"))
    ways = chunks.join(solved, "kinds").select("conv_id", "chunk", "last", "ways")
    best = F.array_min(F.array(*(F.get("ways", F.lit(STATES * START + j)) for j in ACCEPTING)))
    alone = F.col("last") & (F.col("chunk") == 0)
    whole = ways.where(alone).unionByName(_joined(ways.where(~alone), id_type)).select(F.col("conv_id").alias("_conv"), best.alias("best"))
    return (chunks.where("last").join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select("conv_id", *STATS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")))


def _joined(parts: DataFrame, id_type: str, at_once: int = 16) -> DataFrame:
    """The matrices of conversations of several chunks: products of `at_once` neighbours, again and again."""
    def join(key, pdf):
        import pandas as pd

        out = None
        for entries in pdf.sort_values("chunk")["ways"]:
            matrix = [None if x is None else (x["cost"], x["audit"]) for x in entries]
            out = matrix if out is None else product(out, matrix)
        ways = [None if x is None else {"cost": x[0], "audit": text_of(x[1])} for x in out]
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "chunk": [key[1]], "last": [True], "ways": [ways]})

    parts = staged(parts)
    while parts.where("chunk > 0").limit(1).count():
        group = F.floor(F.col("chunk") / at_once).cast("long")
        parts = staged(parts.groupBy("conv_id", group).applyInPandas(join, f"conv_id {id_type}, chunk long, last boolean, ways {WAYS}"))
    return parts


def _evaluate(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [[None if x is None else {"cost": x[0], "audit": text_of(x[1])} for x in grammar.of(s)] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ways, _WAYS)], names=["kinds", "ways"])

    return run


def _scan(chunk_rows: int):
    """Rows in order -> strings of row kinds; the last one of each conversation carries its statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, id_type, conv, kinds = [], pa.null(), None, None
        chunk = low = high = turns = 0
        stats: Counter = Counter()
        before = None

        def put(last: bool) -> None:
            gaps = high - low + 1 - turns if last and turns else 0
            made.append((conv, chunk, last, "".join(kinds), gaps, *(stats[c] if last else 0 for c in STATS[1:])))

        def flushed() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * len(STATS)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)],
                                               names=["conv_id", "chunk", "last", "kinds", *STATS])
            made.clear()
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, live, turn, role, digest, blank, truncated, again, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kinds is None or conv_id != conv:
                    if kinds is not None:
                        put(True)
                    conv, kinds, chunk, turns, before = conv_id, [], 0, 0, None
                    stats.clear()
                if not live:
                    continue
                if len(kinds) == chunk_rows:
                    put(False)
                    kinds, chunk = [], chunk + 1
                initial, row = (role or "")[:1], (turn, role, digest)
                if before and before[1] + initial not in _LEGAL:
                    stats["illegal"] += 1
                if turn is not None and (not before or before[0][0] != turn):
                    low, high, turns = low if turns else turn, turn, turns + 1
                kind = initial if initial in ("s", "u", "a") else "o"
                if blank or again and (turn != first or before and before[0] == row):
                    stats["blank" if blank else "duplicate"] += 1
                    kind = GONE
                elif truncated:
                    stats["truncated"] += 1
                    kind = kind.upper()
                kinds.append(kind)
                before = row, initial
            if len(made) > 5_000:
                yield flushed()
        if kinds is not None:
            put(True)
        if made:
            yield flushed()

    return run


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. audits: (conv_id, audit) as `diagnosed` gives them, for the same rows."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, audits).mapInArrow(_rows_out, f"conv_id {id_type}, place long, role string, text string")


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the repaired rows as `role:text`, joined by newlines.

    A digest takes a conversation's rows one after another, so they pass one task in order; none is held.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, audits).mapInArrow(_digests_out, f"conv_id {id_type}, repaired_sha256 string")


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one task."""
    text = F.coalesce("text", F.lit(""))
    some = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(some.schema[c].dataType).alias(c) for c in ("turn", "role", "digest")),
                          F.col("audit").alias("text"))
    return some.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text")


class _Replay:
    """Applies an audit to the rows it was made for."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def _new(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return _NAMES[self.state]

    def row(self, role: str | None, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._new(), text
        elif edit == "K":
            self.state = _ROLES[role[:1]][self.state]
            yield role, text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(`begin`, conv_id, None), then (`row`, role, text) of its repaired rows, conversation by conversation; (None, type of ids, None) after a batch."""
    replay = None
    for batch in batches:
        for conv_id, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if replay:
                    yield from (("row", *x) for x in replay.inserted())
                replay = _Replay(text)
                yield "begin", conv_id, None
            else:
                yield from (("row", *x) for x in replay.row(role, text))
        yield None, batch.column(0).type, None
    if replay:
        yield from (("row", *x) for x in replay.inserted())


def _rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, conv, place, id_type = [], None, 0, None

    def flushed() -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text"])
        rows.clear()
        return batch

    for what, a, b in _replayed(batches):
        if what == "begin":
            conv, place = a, 0
        elif what == "row":
            rows.append((conv, place, a, b))
            place += 1
        else:
            id_type = a
            if rows:
                yield flushed()
    if rows:
        yield flushed()


def _digests_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, current, id_type = [], None, None

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], id_type), pa.array([x[1].hexdigest() for x in done], pa.string())],
                                           names=["conv_id", "repaired_sha256"])
        done.clear()
        return batch

    for what, a, b in _replayed(batches):
        if what == "begin":
            current = [a, hashlib.sha256(), ""]
            done.append(current)
        elif what == "row":
            current[1].update(f"{current[2]}{a}:{b}".encode())
            current[2] = "\n"
        else:
            id_type = a
            if len(done) > 1:
                done.pop()  # the last one may go on
                yield flushed()
                done.append(current)
    if done:
        yield flushed()


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` (conv_id, turn, role, text) with faults, drawn by crc32 of `conv_id:turn` (null: one space) modulo 20.

    0: the row is missing, 1: its text is empty, 2: its text lacks `.!?`, 3: it comes twice, 4: its role is user.
    """
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")
