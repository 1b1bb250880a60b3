"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record: the payload's length (8 bytes), the masked checksum of these 8 bytes (4), the payload, its masked checksum (4), all little-endian.
A payload: the width of an id in bytes (1: 2 or 4), whether there is a doc_id (1), the doc_id (8, signed), the ids. A mask rotates a
checksum (CRC-32) right by 15 bits and adds a constant, so that a checksum over bytes that hold checksums stays meaningful.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.bytelevel import default_file, library_encoder, little_endian
from chatsieve.llm.common import shared_folder, small_batches, staged, texts

INDEX = "file string, part long, position long, record_bytes long, doc_id long, start_in_file long, n_tokens long"
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<BBq")


class BrokenRecord(ValueError):
    """A record whose length or payload doesn't agree with its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit. They take 16 bits each where all fit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or wide.max() < 1 << 16
    payload = _PAYLOAD.pack(2 if narrow else 4, doc_id is not None, doc_id or 0) + (wide.astype("<u2").tobytes() if narrow else ids)
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframed(record: bytes) -> tuple[int | None, bytes]:
    """doc_id and ids as little-endian unsigned 32-bit bytes of one whole record."""
    if len(record) < _HEAD.size + 4 + _PAYLOAD.size:
        raise BrokenRecord("a record ends early")
    length, crc = _HEAD.unpack_from(record)
    if masked(record[:8]) != crc or len(record) != _HEAD.size + length + 4:
        raise BrokenRecord("a record's length is broken")
    payload = record[_HEAD.size:-4]
    if masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise BrokenRecord("a record's payload is broken")
    width, known, doc_id = _PAYLOAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size).astype("<u4").tobytes()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str | None = None, tokenizer_file: str | None = None, end_id: int = 0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's ids and `end_id` to record files in ascending doc_id order; returns the offset index, itself a Parquet table.

    The index: file, part (order of the files), position and record_bytes (place in the file), doc_id, start_in_file (ids before it in its
    file), n_tokens. Documents are range-partitioned on doc_id before they are encoded; each task writes one file, under a name with its
    attempt, and only files of tasks that ended well are in the index. So a lost executor leaves a stray file at most.

    Null or empty text: the end id alone. Null doc_id: first, and null again when read. Rows with one doc_id: in the order of their texts.
    Empty table: no file, empty index.
    """
    path = tokenizer_file or default_file()
    folder, end = folder or shared_folder(docs.sparkSession), little_endian([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        encode, task = library_encoder(path), TaskContext.get()
        part, out, at, total = task.partitionId(), None, 0, 0
        name = f"part-{part:06d}-{task.taskAttemptId()}.records"
        try:
            for batch in small_batches(batches, 1):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                    ids += end
                    record = framed(doc_id, ids)
                    out.write(record)
                    rows.append((name, part, at, len(record), doc_id, total, len(ids) // 4))
                    at += len(record)
                    total += len(ids) // 4
                if rows:
                    names = ["file", "part", "position", "record_bytes", "doc_id", "start_in_file", "n_tokens"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in
                                                      enumerate(zip(*rows, strict=True))], names=names)
        finally:
            if out is not None:
                out.close()

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = staged(ordered.mapInArrow(write, INDEX))
    return index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))


def read_records(index: DataFrame) -> DataFrame:
    """The records that `index` (of write_records, or any rows of it in any order) names: its columns file, part, position, start_in_file,
    and doc_id, ids as they stand in the files. A record whose checksums don't agree raises BrokenRecord."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        try:
            for batch in batches:
                rows, size = [], 0
                for file, part, position, n, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != opened:
                        if source is not None:
                            source.close()
                        store, place = _filesystem(file)
                        source, opened = store.open_input_file(place), file
                    source.seek(position)
                    doc_id, ids = unframed(source.read(n))
                    rows.append((file, part, position, start, doc_id, ids))
                    size += len(ids)
                    if size > 8_000_000:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)
        finally:
            if source is not None:
                source.close()

    asked = index.select("file", "part", "position", "record_bytes", "start_in_file")
    return (asked.repartitionByRange("part", "position").sortWithinPartitions("part", "position")
            .mapInArrow(read, "file string, part long, position long, start_in_file long, doc_id long, ids binary"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["file", "part", "position", "start_in_file", "doc_id", "ids"])


def file_starts(index: DataFrame) -> DataFrame:
    """(part, base): ids in all files before each file. One row per file meets in one task."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def ids_of(packed: bytes) -> list[int]:
    return array("I", packed).tolist()
