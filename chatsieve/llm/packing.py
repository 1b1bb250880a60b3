"""Packing of token ids into sequences of a fixed size: bounded-space online packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.bytelevel import default_file, library_encoder, little_endian
from chatsieve.llm.common import small_batches, staged, texts

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, place long"
#: Sequences made of what partitions leave over are numbered from here.
LEFTOVER_SEQUENCES = 1 << 62


class OpenWindows:
    """At most `room` windows of `size` ids stand open; a piece goes where it leaves the least space."""

    def __init__(self, size: int, room: int):
        self.size, self.room, self.open = size, room, []

    def place(self, piece: tuple, length: int, cut) -> Iterator[list]:
        """Adds a piece; yields windows that it fills. cut(piece, n): the first n ids of the piece and the rest."""
        while length >= self.size:
            head, piece = cut(piece, self.size)
            length -= self.size
            yield [head]
        while length:
            fits = [w for w in self.open if self.size - w[0] >= length]
            if not fits and len(self.open) < self.room:
                fits = [[0, []]]
                self.open.append(fits[0])
            if fits:
                window = max(fits, key=lambda w: w[0])
                window[1].append(piece)
                window[0] += length
                length = 0
            else:  # the fullest is emitted; the piece's head fills it up
                window = max(self.open, key=lambda w: w[0])
                space = self.size - window[0]
                head, piece = cut(piece, space)
                window[1].append(head)
                window[0], length = self.size, length - space
            if window[0] == self.size:
                self.open.remove(window)
                yield window[1]


def pack_sequences(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 1, size: int = 2048, open_windows: int = 16,
                   id_col: str = "doc_id", text_col: str = "text", kept_pieces: int = 1_000_000) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids, then `end_id`. Each partition packs by itself, online: whole windows are cut off documents of `size` ids or more;
    the rest goes to the open window where it fits best; when it fits in none of `open_windows`, the fullest is filled with its head and
    emitted. Windows that are still open at the end of a partition are strung together over all partitions by running sums and cut at
    multiples of `size`, so only the last sequence of all is shorter than `size`. Each task keeps `open_windows` windows in memory.

    Null or empty text: the end id alone. Null and repeated ids: each row is a document of its own. Empty table: no rows. Other columns of
    `docs` don't matter. Ties between windows: the one opened first. kept_pieces: words that a worker remembers, some 300 bytes each.
    """
    path = tokenizer_file or default_file()
    end = little_endian([end_id])

    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:4 * n], total), (doc, start + n, ids[4 * n:], total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, part = library_encoder(path, kept_pieces), OpenWindows(size, open_windows), TaskContext.get().partitionId()
        rows, made, held = [], 0, 0

        def put(pieces: list, sequence: int | None, place: int) -> int:
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, total, sequence, at if sequence is not None else None, part, place + at))
                at += n
            return at

        for batch in small_batches(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for window in windows.place((doc, 0, ids, n), n, cut):
                    held += put(window, part << 40 | made, 0)
                    made += 1
                if held > 2_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
        place = 0
        for window in windows.open:
            place += put(window[1], None, place)
        if rows:
            yield _batch(rows)

    packed = staged(texts(docs, id_col, text_col).mapInArrow(pack, PIECES))
    whole = packed.where("sequence_id is not null").drop("part", "place")
    return whole.unionByName(_merged(packed.where("sequence_id is null"), size))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part", "place"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _merged(left: DataFrame, size: int) -> DataFrame:
    """Pieces of open windows, end to end over all partitions, cut at multiples of `size`. One row per partition meets in one task."""
    sums = left.groupBy("part").agg(F.sum("length").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    first, last = F.col("at"), F.col("at") + F.col("length") - 1
    cuts = (left.join(base, "part").withColumn("at", F.col("base") + F.col("place"))
            .withColumn("k", F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))))
    begin = F.greatest(F.col("k") * size, first)
    n = F.least((F.col("k") + 1) * size, last + 1) - begin
    return cuts.select(
        "doc_id", (F.col("start") + begin - first).alias("start"), n.alias("length"),
        F.substring(F.col("ids"), (4 * (begin - first) + 1).cast("int"), (4 * n).cast("int")).alias("ids"), "doc_tokens",
        (F.lit(LEFTOVER_SEQUENCES) + F.col("k")).alias("sequence_id"), (begin - F.col("k") * size).alias("offset"))
