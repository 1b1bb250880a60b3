"""Removal of word runs that were seen before, by compaction of a De Bruijn graph of word k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import small_batches, staged, texts

#: Bits of a filter, a fixed size: 16 MB. Filters only spare work; a full one costs time, not rows.
FILTER_BITS, PARTS = 1 << 27, 256
_NO_ID, _PLACES = -1 << 63, 1 << 24
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def gram_keys(keys: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """64-bit keys of all runs of n words, by doubling the runs' length."""
    out, done, power, size = None, 0, keys, 1
    while True:
        if n & size and out is None:
            out, done = power, size
        elif n & size:  # the longer run stands in front
            count = len(keys) - done - size + 1
            out, done = power[:count] * np.uint64(pow(base, done, 1 << 64)) + out[size:size + count], done + size
        if size * 2 > n:
            return _mixed(out)
        power, size = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:], size * 2


def words_of(text: str) -> list[bytes]:
    """Words between white space (space, tab to carriage return), unchanged."""
    return text.encode("utf-8", "surrogatepass").split()


def anchors_of(keys: np.ndarray, k: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text's windows of k words: keys, and the place of each window's anchor among them.

    A window's anchor is the least of its runs of `inner` words by the first 40 bits of their keys, the first of equal ones. Equal windows have
    equal anchors; windows next to each other mostly share one.
    """
    runs, wide = gram_keys(keys, inner), k - inner + 1
    count = len(runs) - wide + 1
    low = []
    for begin in range(0, count, _PLACES - wide):  # places take the other 24 bits
        part = runs[begin:min(begin + _PLACES - wide, count) + wide - 1]
        least, size = (part & ~np.uint64(_PLACES - 1)) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        windows = len(part) - wide + 1
        low.append((np.minimum(least[:windows], least[wide - size:][:windows]) & np.uint64(_PLACES - 1)).astype(np.int64) + begin)
    at = np.concatenate(low)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    return runs[at[new]], np.cumsum(new) - 1


def digest_of(words: list[bytes]) -> tuple[str, int]:
    """SHA-256 of the words joined by one space, and 63 bits of it."""
    h = hashlib.sha256(b" ".join(words))
    return h.hexdigest(), int.from_bytes(h.digest()[:8], "big") >> 1


def _slots(values: np.ndarray) -> np.ndarray:
    return (_mixed(values.astype(np.uint64, copy=False)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _row_keys(doc_ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return doc_ids.view(np.uint64) * np.uint64(_BASE) + ties.view(np.uint64)


class Filter:
    """A set of numbers as a bitmap of fixed size: holds all it was given, and few others as long as it isn't full."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, rows: DataFrame, *columns: str) -> Filter:
        """Of one long column, or of two together. Each part of the bitmap is made by a task; the driver gets `FILTER_BITS` bits at most."""
        size = FILTER_BITS // PARTS

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [c.fill_null(_NO_ID).to_numpy(zero_copy_only=False) for c in batch.columns]
                slots = _slots(values[0].view(np.uint64) if len(values) == 1 else _row_keys(*values))
                yield pa.RecordBatch.from_arrays([pa.array(slots // size, pa.int32()), pa.array(slots % size, pa.int32())], names=["part", "slot"])

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                of, slots = (c.to_numpy() for c in batch.columns)
                for part in np.unique(of):
                    parts.setdefault(int(part), np.zeros(size, bool))[slots[of == part]] = True
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()])],
                                                 names=["part", "bits"])

        made = (rows.select(*columns).mapInArrow(placed, "part int, slot int").repartition("part")
                .mapInArrow(marked, "part int, bits binary").collect())
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for row in made:
            bits[row["part"] * size // 8:(row["part"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
        return cls(bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        slots = _slots(values)
        return (self.bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def remove_repeats(docs: DataFrame, k: int = 20, inner: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (start and length of what goes; merged, ascending).

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a run of k words that covers it also starts earlier: in a document with a smaller doc_id,
    or before it in the same one. Runs are judged on the whole input.

    Runs of k words are the edges of a De Bruijn graph. Edges that come once can't matter; most are left out unseen, as the least run of
    `inner` words in them (their anchor) comes once. An edge links to the next one if all its occurrences go on alike and all occurrences of
    the next one are preceded alike (the border of a text counts as one more way to go on). So the occurrences of linked edges match one to
    one, and a path of them lies whole in the document where it was seen first: sorting edges by that place compacts every path at once.
    A join of the paths' first edges with their occurrences then gives the source coordinates of all repeated spans; each but the first goes.
    Edges are told apart by 96 bits of hash. Documents of equal words are one document in the graph.

    Null text: no words. Null doc_id: before all others. Rows with one doc_id: in the order of a digest of their words; equal rows: one counts
    as the first. Texts of fewer than k words lose nothing. Empty table: no rows. Other columns of `docs` don't matter.
    """
    rows = texts(docs, id_col, text_col)
    meta = staged(rows.mapInArrow(_cut(k, inner), "doc_id long, tie long, n_words long, sha string, anchors array<long>"))
    first = meta.groupBy("sha").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    known = staged(meta.groupBy("doc_id", "tie", "n_words", "sha").agg(F.count("*").alias("rows")).join(first, "sha")
                   .withColumn("original", F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).drop("first"))
    originals = known.where(F.col("original") & (F.col("n_words") >= k))
    original = Filter.of(originals, "doc_id", "tie")
    often = meta.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    anchors = Filter.of(often, "anchor")

    place = F.struct("doc_id", "tie", "at")
    same_before, same_after = F.min("before") == F.max("before"), F.min("after") == F.max("after")
    edges = staged(rows.mapInArrow(_edges(k, inner, original, anchors), EDGES)
                   .groupBy("edge", "check").agg(F.min(place).alias("place"), F.count("*").alias("n"), same_before.alias("joined"), same_after.alias("joins"))
                   .where("n > 1").select("edge", "check", "place.*", "joined", "joins"))
    paths = staged(_paths(edges))
    heads = Filter.of(paths, "edge")
    seen = rows.mapInArrow(_edges(k, inner, original, None, heads), EDGES).select("edge", "check", "doc_id", "tie", "at")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")) & (F.col("at") == F.col("first.at"))
    later = (seen.join(paths, ["edge", "check"]).where(~is_first)
             .select("doc_id", "tie", F.struct("at", (F.col("length") + k - 1).alias("n")).alias("span")).distinct())
    spans = staged(later.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list("span")).alias("spans")))
    return _result(rows, known, spans, k)


EDGES = "edge long, check int, doc_id long, tie long, at long, before int, after int"


def _paths(edges: DataFrame) -> DataFrame:
    """(edge, check) of each path's first edge, `first`: its first place, and the path's length in edges."""
    here = Window.partitionBy("doc_id", "tie").orderBy("at")
    follows = (F.lag("at").over(here) == F.col("at") - 1) & F.lag("joins").over(here) & F.col("joined")
    counted = (edges.withColumn("head", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
               .withColumn("path", F.sum("head").over(here)))
    whole = counted.groupBy("doc_id", "tie", "path").agg(F.min(F.struct("at", "edge", "check")).alias("h"), F.count("*").alias("length"))
    return whole.select("h.edge", "h.check", F.struct("doc_id", "tie", "h.at").alias("first"), "length")


def _cut(k: int, inner: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            ties, sizes, shas, anchors = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sha, tie = digest_of(words)
                ties.append(tie)
                sizes.append(len(words))
                shas.append(sha)
                found = np.empty(0, np.int64)
                if len(words) >= k:
                    found = anchors_of(word_keys(words), k, inner)[0].view(np.int64)
                anchors.append(found)
            ends = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(anchors) if anchors else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ties, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), lists],
                                             names=["doc_id", "tie", "n_words", "sha", "anchors"])

    return run


def _edges(k: int, inner: int, original: Filter, anchors: Filter | None, heads: Filter | None = None):
    """Occurrences of edges in originals: those with an anchor in `anchors`, or those in `heads`. before, after: the words beside them, 0 at a border."""
    names = ["edge", "check", "doc_id", "tie", "at", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1_000_000):
            found: list[list[np.ndarray]] = []
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                tie = digest_of(words)[1]
                if len(words) < k or not original.holds(_row_keys(ids[row:row + 1], np.array([tie])))[0]:
                    continue
                keys = word_keys(words)
                if anchors is not None:
                    values, of = anchors_of(keys, k, inner)
                    at = np.flatnonzero(anchors.holds(values)[of])
                    edges = gram_keys(keys, k)[at] if len(at) else keys[:0]
                else:
                    edges = gram_keys(keys, k)
                    at = np.flatnonzero(heads.holds(edges))
                    edges = edges[at]
                if not len(at):
                    continue
                checks = (gram_keys(keys, k, _BASE_2)[at] >> np.uint64(32)).astype(np.uint32)
                beside = np.concatenate(([0], (keys >> np.uint64(32) | np.uint64(1)).astype(np.uint32), [0])).astype(np.uint32)
                found.append([edges.view(np.int64), checks.view(np.int32), np.full(len(at), row), np.full(len(at), tie), at,
                              beside[at].view(np.int32), beside[at + k + 1].view(np.int32)])
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                columns[2] = batch.column(0).take(columns[2])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _result(rows: DataFrame, known: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """A row for each input row. Only documents that lose a part of their words are cut again."""
    out = "doc_id long, tie long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            made = []
            for doc_id, text, tie, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if digest_of(words)[1] != tie:  # another text under the same doc_id
                    continue
                steps = np.zeros(len(words) + 1, np.int64)
                for span in found:
                    steps[span["at"]] += 1
                    steps[span["at"] + span["n"]] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                borders = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                kept = digest_of([words[i] for i in np.flatnonzero(~gone)])[0]
                made.append((doc_id, tie, int(gone.sum()), kept, [{"start": a, "length": b - a} for a, b in borders.tolist()]))
            if made:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)],
                                                 names=["doc_id", "tie", "n_removed", "kept_sha256", "spans"])

    asked = spans.select(F.col("doc_id").alias("_id"), "tie", "spans")
    cuts = (rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "tie", "spans").mapInArrow(cut, out)
            .dropDuplicates(["doc_id", "tie"]))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "n_removed", "kept_sha256", "spans")
    both = known.join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    copied, nothing = F.col("n_words") >= k, F.array().cast("array<struct<start:long,length:long>>")
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    whole = copied & (~F.col("original") | (F.col("copy") > 1))
    return each.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"))))
        .otherwise(F.coalesce("spans", nothing)).alias("spans"))
