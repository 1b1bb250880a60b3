"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import staged
from chatsieve.llm.graph import components

_BLOCK = 256


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares within range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(seed: int, bits: int):
    """Adds the concatenated random hashes of a pass: the sides of `bits` random planes, as one number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node, vectors = batch.column(0), batch.column(1)
            sizes = vectors.value_lengths().to_numpy()
            key = np.zeros(len(node), np.int64)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, int(d))).standard_normal((d, bits))
                mine = np.flatnonzero(sizes == d)
                sides = (unit_rows(vectors.take(pa.array(mine))) @ planes[d]) > 0
                key[mine] = sides @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([node, vectors, pa.array(sizes, pa.int32()), pa.array(key)], names=["node", "vector", "dim", "key"])

    return run


def _neighbours(threshold: float, window: int):
    """Sorted rows (node, vector, dim): links within `window` places, without those that two other links imply to be in one component.

    The first and the last `window` rows of a partition are given out too, with the number of the border that they lie at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_x, kept_n = None, np.empty(0, np.int64)
        head_x, head_n, part = [], [], TaskContext.get().partitionId()
        for batch in batches:
            nodes, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1], True])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(begin, end, _BLOCK):
                    x, n = unit_rows(batch.column(1).slice(i, min(_BLOCK, end - i))), nodes[i:min(i + _BLOCK, end)]
                    if len(head_n) < window and (not head_x or len(head_x[0]) == x.shape[1]):
                        head_x, head_n = [*head_x, *x][:window], [*head_n, *n][:window]
                    if kept_x is not None and kept_x.shape[1] == x.shape[1]:
                        x, n = np.concatenate((kept_x, x)), np.concatenate((kept_n, n))
                    old = len(n) - min(_BLOCK, end - i)
                    place = np.arange(len(n))
                    near = (x @ x.T >= threshold) & (np.abs(place[:, None] - place) <= window)
                    before = near & (place[:, None] > place)
                    closest = np.where(before.any(1), len(n) - 1 - before[:, ::-1].argmax(1), 0)
                    implied = near[closest] & (place[None, :] != closest[:, None])
                    a, b = np.nonzero(before & ~implied)
                    new = a >= old
                    if new.any():
                        yield _found(n[a[new]], n[b[new]])
                    kept_x, kept_n = x[-window:], n[-window:]
        if kept_x is not None:
            yield _found(np.array(head_n), np.arange(len(head_n)) + window, part - 1, head_x)
            yield _found(kept_n, np.arange(len(kept_n)) + window - len(kept_n), part, kept_x)

    return run


_FOUND = "a long, b long, border long, vector array<double>"


def _found(a: np.ndarray, b: np.ndarray, border: int | None = None, vectors=None) -> pa.RecordBatch:
    """Links, or rows at a border: node, place (the border is between `window` - 1 and `window`), border, unit vector."""
    return pa.RecordBatch.from_arrays([
        pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([border] * len(a), pa.int64()),
        pa.array([None] * len(a) if vectors is None else [x.tolist() for x in vectors], pa.list_(pa.float64()))], names=["a", "b", "border", "vector"])


def _across(threshold: float, window: int):
    """Rows at the borders: links within `window` places between both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["border"]):
            sizes = rows.column("vector").combine_chunks().value_lengths().to_numpy()
            if len(np.unique(sizes)) > 1:
                continue
            x, node, place = unit_rows(rows.column("vector").combine_chunks()), rows.column("a").to_numpy(), rows.column("b").to_numpy()
            left, right = place < window, place >= window
            i, j = np.nonzero((x[right] @ x[left].T >= threshold) & (place[right][:, None] - place[left] <= window))
            yield pa.RecordBatch.from_arrays([pa.array(node[right][i]), pa.array(node[left][j])], names=["a", "b"])

    return run


def chance_of_pass(rows: int, threshold: float, window: int) -> float:
    """Chance that one pass brings a pair at the threshold within `window` places: it must agree on the leading sides that leave about `window` rows."""
    return (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(1, rows) / window))


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has been compared with chance `recall`; about 12 at least."""
    chance = chance_of_pass(rows, threshold, window)
    return 12 if chance >= 1 else max(12, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.flatnonzero(np.r_[False, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
        cuts = [0, *change.tolist(), len(batch)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[begin] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, chunk): mean direction, greatest angle to it, number of vectors that its rows stand for."""
    for rows in _runs(batches, ["component", "chunk"]):
        x = unit_rows(rows.column("vector").combine_chunks())
        mean = x.sum(0)
        mean = mean / max(np.sqrt(mean @ mean), 1e-300)
        radius = float(np.arccos(np.clip(x @ mean, -1, 1)).max())
        yield pa.RecordBatch.from_arrays([
            pa.array([rows.column("component")[0].as_py()]), pa.array([rows.column("chunk")[0].as_py()], pa.int32()),
            pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([int(np.sum(rows.column("copies").to_numpy()))])],
            names=["component", "chunk", "mean", "radius", "copies"])


def _block_counts(threshold: float):
    """Rows of one chunk (side 0) and of another or the same (side 1): how many vectors of side 1 each row of side 0 links with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["component", "one", "other"]):
            side = rows.column("side").to_numpy()
            x, copies = unit_rows(rows.column("vector").combine_chunks()), rows.column("copies").to_numpy()
            n = ((x[side == 0] @ x[side == 1].T) >= threshold) @ copies[side == 1]
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("node").to_numpy()[side == 0]), pa.array(n.astype(np.int64))], names=["node", "n"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 48, bits: int = 60, seed: int = 11,
                           chunk_rows: int = 128, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors become one node with a number of copies. Each pass sorts the nodes by the concatenated sides of random planes, range-
    partitioned, and compares each with the `window` nodes before it, also across the border of a partition (of at least `window` nodes);
    verified links of all passes are united to components. passes: by default as many as the number of nodes asks for `recall` of the pairs
    at the threshold (closer ones are found more often); that reckoning takes the planes to cut the nodes evenly, so a quarter as many
    passes follow, again and again, until the components that they still unite tell that no more than 1 - recall are missing. What is
    missing stays unfound. All pairs within a component are then counted:
    a component is cut into chunks, and a pair of chunks counts whole if the angles of its vectors to their means prove all pairs linked
    (or none), by matrix products else. So n_links is exact within components, and no pair is written out.

    Null, zero, null-holding or non-finite vectors: no links, a component of their own. Vectors of different lengths never link. Null id:
    the row takes part; its component_id is the smallest known id, else null. Repeated rows are copies of each other. Empty table: no rows.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(v)).alias("node"))
    ids = rows.select("vec_id", "node")
    nodes = staged(rows.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")))

    def found(k: int) -> DataFrame:
        keyed = nodes.select("node", "vector").mapInArrow(_keys(seed + k, bits), "node long, vector array<double>, dim int, key long")
        ordered = keyed.repartitionByRange("dim", "key", "node").sortWithinPartitions("dim", "key", "node").select("node", "vector", "dim")
        rows = staged(ordered.mapInArrow(_neighbours(threshold, window), _FOUND))
        borders = rows.where("border is not null").repartition("border").sortWithinPartitions("border", "b")
        return rows.where("border is null").select("a", "b").unionByName(borders.mapInArrow(_across(threshold, window), "a long, b long"))

    count = nodes.count()
    done = passes if passes is not None else passes_for(count, threshold, window, recall)
    grouped = staged(components(reduce(DataFrame.unionByName, map(found, range(done)))))
    more, chance = max(1, done // 4), chance_of_pass(count, threshold, window)
    while passes is None and chance < 1:
        of = lambda end: grouped.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        late = reduce(DataFrame.unionByName, map(found, range(done, done + more)))
        late = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        late = staged(late.where("a <> b").distinct())
        done += more
        united = staged(components(late))
        new = united.where("node <> component").count()
        if new:
            roots = grouped.select("node", F.col("component").alias("root")).unionByName(
                united.select("node", F.col("node").alias("root")).join(grouped.select("node"), "node", "left_anti"))
            grouped = staged(roots.join(united.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("component", "root").alias("component")))
        left = (1 - chance) ** more
        if new * left / (1 - left) <= (1 - recall) * grouped.where("node <> component").count():
            break

    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / F.greatest(F.lit(float(chunk_rows)), F.sqrt("size"))).cast("int")
    members = staged(grouped.join(sizes, "component").join(nodes.select("node", "vector", "copies"), "node").select(
        "component", "node", "vector", "copies", F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int").alias("chunk")))
    balls = staged(members.repartition("component", "chunk").sortWithinPartitions("component", "chunk").mapInArrow(
        _balls, "component long, chunk int, mean array<double>, radius double, copies long"))
    two = (balls.select("component", F.col("chunk").alias("one"), F.col("mean").alias("m1"), F.col("radius").alias("r1")).join(
        balls.select("component", F.col("chunk").alias("other"), F.col("mean").alias("m2"), F.col("radius").alias("r2"), "copies"), "component"))
    cosine = F.aggregate(F.zip_with("m1", "m2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    limit, margin = float(np.arccos(threshold)), 1e-6
    judged = staged(two.select("component", "one", "other", "copies", F.when(angle + F.col("r1") + F.col("r2") <= limit - margin, "all").when(
        angle - F.col("r1") - F.col("r2") >= limit + margin, "none").otherwise("some").alias("verdict")).where("verdict <> 'none'"))
    whole = judged.where("verdict = 'all'").groupBy("component", F.col("one").alias("chunk")).agg(F.sum("copies").alias("n"))
    some = judged.where("verdict = 'some'").select("component", "one", "other")
    sided = (members.join(some.withColumnRenamed("one", "chunk"), ["component", "chunk"]).select(
        "component", F.col("chunk").alias("one"), "other", F.lit(0).alias("side"), "node", "vector", "copies").unionByName(
        members.join(some.withColumnRenamed("other", "chunk"), ["component", "chunk"]).select(
            "component", "one", F.col("chunk").alias("other"), F.lit(1).alias("side"), "node", "vector", "copies")))
    by_block = (sided.repartition("component", "one", "other").sortWithinPartitions("component", "one", "other", "side")
                .mapInArrow(_block_counts(threshold), "node long, n long"))
    counted = (by_block.unionByName(members.join(whole, ["component", "chunk"]).select("node", "n")).groupBy("node").agg(F.sum("n").alias("n")))

    named = grouped.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = (nodes.select("node", "first_id", "copies").join(grouped, "node", "left").join(named, "component", "left").join(counted, "node", "left")
             .select("node", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    linked = ids.where("node is not null").join(facts, "node").select("vec_id", "n_links", "component_id")
    alone = ids.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
