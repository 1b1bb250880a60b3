"""Join of documents on the Jaccard similarity of their word n-grams, with signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import small_batches, staged, texts
from chatsieve.llm.graph import components
from chatsieve.llm.lm import words_of

SIGNATURE_BITS = 1024
#: Buckets of the frequency sketch, and parts in which it is summed.
BUCKETS, PARTS = 1 << 20, 64
#: Blocks of up to so many rows are compared pair by pair.
FEW = 8
#: So many of a node's keys go with it into each of its blocks.
KEPT_KEYS = 16
_M1, _M2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit keys of the distinct n-grams of words; with fewer than n words, of the whole sequence; none without words."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.int64)
    keys = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8").astype(np.uint64)
    h = np.full(max(1, len(w) - n + 1), min(n, len(w)), np.uint64)
    for k in range(min(n, len(w))):
        h = h * _BASE + keys[k:k + len(h)]
    return np.unique(_mixed(h).view(np.int64))


def signature(keys: np.ndarray, size: int = SIGNATURE_BITS) -> bytes:
    """Bitmap of a set: the bit that each key's low bits name. `size` is a power of two."""
    bits = np.zeros(size, np.uint8)
    bits[keys & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def bitmap(keys: np.ndarray) -> bytes:
    """A signature with at least one bit for each key."""
    return signature(keys, max(SIGNATURE_BITS, 1 << (len(keys) - 1).bit_length()))


def greatest_overlap(x: bytes, size_x: int, y: bytes, size_y: int) -> int:
    """An upper bound of the overlap of two sets by their bitmaps: a bit that only one has stands for a key that only it has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):  # low bits name the place, so halves fold onto each other
        if len(a) > len(b):
            a = a[:len(a) // 2] | a[len(a) // 2:]
        else:
            b = b[:len(b) // 2] | b[len(b) // 2:]
    return min(size_x - int(np.bitwise_count(a & ~b).sum()), size_y - int(np.bitwise_count(b & ~a).sum()))


def needed(a, b, percent: int):
    """The least overlap at which sets of sizes a and b reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass
class SignatureTree:
    """Levels of nodes, leaves first. A node holds the OR of its bitmaps, the range of its set sizes, the most keys that share bits in one of
    its sets, and its component if it has only one (else -1). `fan` nodes of one level make one of the next."""

    levels: list[tuple[np.ndarray, ...]]
    fan: int

    @classmethod
    def of(cls, sizes: np.ndarray, bitmaps: np.ndarray, groups: np.ndarray, fan: int = 8) -> SignatureTree:
        """sizes ascending; bitmaps: one row of 64-bit words per set; groups: a number per component."""
        slack = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        levels = [(sizes, sizes, bitmaps, slack, groups)]
        while len(levels[-1][0]) > 1:
            low, high, bits, slack, own = levels[-1]
            at = np.arange(0, len(low), fan)
            same = np.minimum.reduceat(own, at)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(bits, at),
                           np.maximum.reduceat(slack, at), np.where(same == np.maximum.reduceat(own, at), same, -1)))
        return cls(levels, fan)

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets of different components whose greatest possible overlap reaches the similarity: dual traversal from the root."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            kept = [self._possible(depth, a[i:i + 200_000], b[i:i + 200_000], percent) for i in range(0, len(a), 200_000)]
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*kept, strict=True)) if kept else (a[:0], b[:0])
            if depth:
                below = len(self.levels[depth - 1][0])
                step = np.arange(self.fan)
                x = np.repeat(a[:, None] * self.fan + step, self.fan, axis=1).ravel()
                y = np.tile(b[:, None] * self.fan + step, (1, self.fan)).ravel()
                inside = (x <= y) & (y < below) & (x < below)
                a, b = x[inside], y[inside]
        return a, b

    def _possible(self, depth: int, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, bits, slack, own = self.levels[depth]
        keep = ((own[a] != own[b]) | (own[a] == -1)) & (low[b] * percent <= 100 * high[a]) & (low[a] * percent <= 100 * high[b])
        if depth == 0:
            keep &= a != b
        a, b = a[keep], b[keep]
        common = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
        keep = common + np.minimum(slack[a], slack[b]) >= needed(low[a], low[b], percent)
        return a[keep], b[keep]


def _sets_of(n: int):
    """(doc_id, node, n_shingles, bitmap) per row; at the end of a task its counts of keys by bucket, a part per row."""
    names = ["doc_id", "node", "n_shingles", "bitmap", "part"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches, 1):
            rows, all_keys = [], [np.empty(0, np.int64)]
            for text in batch.column(1).to_pylist():
                keys = shingle_set(text, n)
                rows.append((node_of(keys), len(keys), bitmap(keys) if len(keys) else None, None))
                all_keys.append(keys)
            seen += np.bincount(bucket_of(np.concatenate(all_keys)), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))],
                                             names=names)
        parts = np.minimum(seen, 65_535).astype("<u2").reshape(PARTS, -1)
        none = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([x.tobytes() for x in parts], pa.binary()),
                                          pa.array(range(PARTS), pa.int32())], names=names)

    return run


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> 40) & (BUCKETS - 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts) of all tasks, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         names=["part", "counts"])


def frequency_sketch(all_rows: DataFrame) -> np.ndarray:
    """How many keys of all documents fall in each of `BUCKETS` buckets: a table of fixed size, summed by parts on the executors."""
    parts = (all_rows.where("part is not null").select("part", F.col("bitmap").alias("counts")).repartition("part")
             .mapInArrow(_summed, "part int, counts binary").toPandas().sort_values("part"))
    return np.frombuffer(b"".join(parts["counts"]), np.int64) if len(parts) else np.zeros(BUCKETS, np.int64)


def node_of(keys: np.ndarray) -> int | None:
    """One number for each distinct set (64 bits; two sets share one with a chance of 2**-64); none for the empty set."""
    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63) if len(keys) else None


class _Order:
    """Keys of sparse buckets first, then by value. Keys that many documents hold fill their buckets, so they come last."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = np.minimum(sketch, (1 << 30) - 1)

    def prefix(self, keys: np.ndarray, percent: int) -> np.ndarray:
        """The first keys in this order, as many that a set as similar as asked must share one of them. keys: ascending."""
        if not len(keys):
            return keys
        count = len(keys) - -(-percent * len(keys) // 100) + 1
        return keys[np.argsort(self.sketch[bucket_of(keys)], kind="stable")[:count]]


def _prefixes(n: int, percent: int, order: _Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            seen, heads, nodes = set(), [], []
            for text in batch.column(0).to_pylist():
                keys = shingle_set(text, n)
                node = node_of(keys)
                if node is not None and node not in seen:
                    seen.add(node)
                    heads.append(order.prefix(keys, percent))
                    nodes.append(node)
            if heads:
                sizes = [len(x) for x in heads]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))],
                                                 names=["shingle", "node"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b: nodes) whose sets really are that similar. Sets are made anew, for the documents concerned alone.

    A bitmap over document ids, of fixed size, keeps most other texts from being cut; the join after it is exact.
    """
    slots = 1 << 21
    concerned = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id"), "node"))
    slot = F.pmod(F.xxhash64("first_id"), F.lit(slots)).cast("int")
    marked = concerned.where("first_id is not null").select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    bitmap = np.zeros(slots, bool)
    bitmap[marked] = True
    bitmap = np.packbits(bitmap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            at = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = (at < 0) | ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            made = {}
            for text in batch.column(1).filter(pa.array(wanted)).to_pylist():
                keys = shingle_set(text, n)
                made[node_of(keys)] = keys
            made.pop(None, None)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(list(made.values()), pa.list_(pa.int64()))],
                                                 names=["node", "keys"])

    slotted = docs.select(F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(slots))).alias("slot"), "text")
    sets = staged(slotted.mapInArrow(cut, "node long, keys array<long>").join(concerned.select("node"), "node", "left_semi")
                  .dropDuplicates(["node"]))
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sizes, then bitmaps allow the similarity."""
    size, bits = nodes.select("node", "n_shingles"), nodes.select("node", "bitmap")
    fit = (pairs.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
           .where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent))
    both = fit.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b").select("a", "b", "bits_a", "size_a", "bits_b", "size_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            keep = pa.array([greatest_overlap(x, m, y, n) >= needed(m, n, percent) for x, m, y, n in zip(*cols, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to `size` bits: low bits name the place, so halves fold onto each other."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 64 > size:
        words = words[:len(words) // 2] | words[len(words) // 2:]
    return words


def greatest_overlaps(bitmaps: list[bytes], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`greatest_overlap` of many pairs (i, j)."""
    lengths = np.array([len(x) for x in bitmaps])
    least, most = np.minimum(lengths[i], lengths[j]), np.empty(len(i), np.int64)
    for n in np.unique(least):
        chosen = np.flatnonzero(least == n)
        rows = np.unique(np.concatenate((i[chosen], j[chosen])))
        words = np.stack([folded(bitmaps[r], int(n) * 8) for r in rows])
        for begin in range(0, len(chosen), step := max(1, 8_000_000 // int(n))):
            some = chosen[begin:begin + step]
            a, b = i[some], j[some]
            x, y = words[np.searchsorted(rows, a)], words[np.searchsorted(rows, b)]
            most[some] = np.minimum(sizes[a] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), sizes[b] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return most


def nearest(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are the likeliest of one of their ends."""
    ends, pair = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, -likeness[pair], ends))
    first = order[np.flatnonzero(np.concatenate(([True], ends[order][1:] != ends[order][:-1])))] if len(order) else order
    return np.unique(pair[first])


def elsewhere(keys: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair (i, j) share one of their `keys` (a matrix) that is below `own`, the key of the block they meet in."""
    out = np.empty(len(i), bool)
    for begin in range(0, len(i), 20_000):
        a, b = i[begin:begin + 20_000], j[begin:begin + 20_000]
        x = keys[a]
        met = (x[:, :, None] == keys[b][:, None, :]).any(2)
        out[begin:begin + 20_000] = (met & (x < own[a][:, None])).any(1)
    return out


def _tree_pairs(percent: int, nearest_only: bool):
    """Sorted rows (block, shingle, part, crossed, keys, node, n_shingles, bitmap, component): candidate pairs of each block, by its signature tree,
    then by whole bitmaps; with `nearest_only`, for each node the likeliest one of its block.

    keys: the least `KEPT_KEYS` of the node's blocks. Pairs are made where their least common one is the block's, so not once for each block that
    they share; those whose least common one isn't among both lists are made in each. crossed: of the pairs of two parts, those of one part aside,
    as these meet in the part's own block.
    """
    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block = rows.column("block").to_numpy()
        node, size, own, shingle, part, crossed = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "component", "shingle", "part", "crossed"))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), KEPT_KEYS)
        bitmaps = rows.column("bitmap").to_pylist()
        bits = np.stack([folded(x, SIGNATURE_BITS) for x in bitmaps])
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        counts = np.diff(cuts)
        found: dict[tuple[int, int], None] = {}

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            if not len(i):
                return
            here = ~crossed[i] | (part[i] != part[j])
            i, j = i[here], j[here]
            most = greatest_overlaps(bitmaps, size, i, j)
            allowed = np.flatnonzero(most >= needed(size[i], size[j], percent))
            if nearest_only:
                allowed = allowed[nearest(i[allowed], j[allowed], most[allowed] / (size[i] + size[j] - most)[allowed])]
            i, j = i[allowed], j[allowed]
            here = ~elsewhere(keys, shingle, i, j)
            i, j = i[here], j[here]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            found.update(dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)))

        # blocks of a few rows have no use for a tree: all their pairs at once, by the same bounds
        leaves = SignatureTree([(size, size, bits, size - np.bitwise_count(bits).sum(1, dtype=np.int64), own)], 1)
        few = np.repeat(counts <= FEW, counts)
        for k in range(1, FEW):
            i = np.flatnonzero(few[:-k] & (block[:-k] == block[k:]))
            keep(*leaves._possible(0, i, i + k, percent))
        for begin, end in zip(cuts[:-1][counts > FEW], cuts[1:][counts > FEW], strict=True):
            some = begin + np.argsort(size[begin:end], kind="stable")
            numbers = np.unique(own[some], return_inverse=True)[1]
            i, j = SignatureTree.of(size[some], bits[some], numbers).pairs(percent)
            keep(some[i], some[j])
            if len(found) > 200_000:
                yield _pair_batch(found)
                found.clear()
        if found:
            yield _pair_batch(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            block = batch.column(batch.schema.get_field_index("block")).to_numpy()
            cut = int(np.flatnonzero(block == block[-1])[0])
            if cut:
                held.append(batch.slice(0, cut))
                yield from of(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def _pair_batch(found: dict) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _mixed_pairs(blocks: DataFrame, grouped: DataFrame, nodes: DataFrame, percent: int, block_rows: int, nearest_only: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a block and may be similar."""
    labelled = blocks.select("shingle", "node").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    rows = labelled.join(mixed.select("shingle", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")), "shingle")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    none = F.array_repeat(F.lit((1 << 63) - 1), KEPT_KEYS)
    keys = rows.groupBy("node").agg(F.slice(F.concat(F.array_sort(F.collect_list("shingle")), none), 1, KEPT_KEYS).alias("keys"))
    rows = (rows.select("shingle", "node", "component", part.alias("part"), other.alias("other"))
            .withColumn("block", F.xxhash64("shingle", F.least("part", "other"), F.greatest("part", "other")))
            .join(keys, "node").join(nodes.select("node", "n_shingles", "bitmap"), "node")
            .select("block", "shingle", "part", (F.col("part") != F.col("other")).alias("crossed"), "keys", "node", "n_shingles", "bitmap", "component"))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_tree_pairs(percent, nearest_only), "a long, b long").distinct()


def _second_pivots(apart_from_pivot: DataFrame, first: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b): for each node b the pivot a of most of its blocks, of those in other components than b and not yet compared in `first`.

    One pair for a node at most, so that their number grows with the nodes, not with the members of their blocks.
    """
    met = apart_from_pivot.groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    for end in ("a", "b"):
        met = met.join(own.toDF(end, f"of_{end}"), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    # a pair whose ends are together by now needs no comparison, nor does one that was compared
    left = met.where("of_a <> of_b").join(first.select("b", F.col("a").alias("compared")), "b").where("a <> compared")
    return left.groupBy("b").agg(F.max(F.struct("n", "a"))["a"].alias("a")).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, block_rows: int = 512,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included).

    Documents link when their sets of word n-grams have a Jaccard similarity of `percent` / 100 or more; compared in whole numbers, exactly.

    1. Equal sets become one node. All keys are counted in a sketch of fixed size; keys of full buckets, as those that many documents
       hold, are ranked last (the order decides cost alone, never the result).
    2. Similar sets share a key among the first of each in that order; these keys make blocks, those of equal members one. Which keys are shared is a minimum and a
       maximum per key, so a key in all documents is no load on one task.
    3. Each node is compared with the first node of all its blocks; then with the first node of most of its blocks among those that are still in
       different components. Most near copies are linked by now.
    4. Blocks that hold more than one component get signature trees: dual traversal finds pairs across components whose bitmaps and sizes
       allow the similarity; these are compared exactly. Blocks beyond `block_rows` are cut into parts, and all pairs of parts compared.
       First each node's likeliest pair of a block, then all pairs that this leaves in different components. A pair is made in the first of
       the blocks that both are in, as far as the keys that a node brings along tell.
    Pairs inside one component need no comparison, as they can't change it. So no link that matters is lost, and none is assumed.

    Null or empty text, or white space alone: n_shingles 0, linked with nothing. Null doc_id: takes part, gets the smallest known id of its
    component, else null. Repeated rows: one row each. Empty table: no rows. Other columns of `docs` don't matter.
    """
    plain = texts(docs, id_col, text_col)
    all_rows = staged(plain.mapInArrow(_sets_of(n), "doc_id long, node long, n_shingles long, bitmap binary, part int"))
    sets = all_rows.where("part is null").select("doc_id", "node", "n_shingles")
    order = _Order(frequency_sketch(all_rows))
    nodes = staged(all_rows.where("part is null and node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n_shingles", "bitmap"))))

    prefixes = staged(plain.select("text").mapInArrow(_prefixes(n, percent, order), "shingle long, node long"))
    shared = (prefixes.groupBy("shingle").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
              .where("pivot <> last").select("shingle", "pivot"))
    met = staged(prefixes.join(shared, "shingle").distinct())
    # keys that the same nodes share make the same block: one is enough (sets go by 128 bits of hash)
    alike = met.groupBy("shingle").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"))
    blocks = staged(met.join(alike.groupBy("x", "y", "n").agg(F.min("shingle").alias("shingle")).select("shingle"), "shingle", "left_semi"))
    apart_from_pivot = blocks.where("pivot <> node")
    first = apart_from_pivot.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    near = staged(_plausible(first, nodes, percent))
    links = staged(_verified(near, plain, nodes, n, percent))
    own = components(links)
    apart = _second_pivots(apart_from_pivot, first, own)
    rest = staged(_plausible(apart, nodes, percent))
    links = staged(links.unionByName(_verified(rest, plain, nodes, n, percent)))
    near = near.unionByName(rest)

    for nearest_only in (True, False):
        # staged, as the join would else be put before the distinct and meet a pair once for each of its blocks
        found = staged(_mixed_pairs(blocks, components(links), nodes, percent, block_rows, nearest_only))
        pairs = staged(found.join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        links = staged(links.unionByName(_verified(pairs, plain, nodes, n, percent)))
        near = near.unionByName(pairs)
    grouped = staged(components(links))

    named = grouped.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = (nodes.select("node", "first_id").join(grouped, "node", "left").join(named, "component", "left")
               .select("node", F.coalesce("component_id", "first_id").alias("component_id")))
    return sets.join(by_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, of which each component keeps the document with its smallest id. Rows without id stay; rows that repeat an id
    are one document and stay or go together."""
    gone = jaccard_components(docs, n, percent, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
