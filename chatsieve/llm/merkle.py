"""A Merkle manifest of a dataset: one root, and for every row a proof, by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import staged

#: Children of a node.
FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
_AT_ONCE = 2_000


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields one after another: `-` for null, else UTF-8 byte count, `:`, value."""
    def written(x: Column) -> Column:
        x = x.cast("string")
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))

    return F.sha2(F.concat(*map(written, fields)).cast("binary"), 256)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, leaf, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


class Sweep:
    """Time-forward processing of the tree over at most FAN ** height digests.

    A node's label is (place of the last leaf below it, level): children come before their parents. Nodes send along the edges through a
    priority queue ordered by the receiver's label: digests upwards in ascending order, then proof suffixes downwards in descending order.
    The queue never holds more than FAN messages for each level.
    """

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        self.children: dict[tuple[int, int], list[str]] = {}

    def label(self, level: int, index: int) -> tuple[int, int]:
        return min((index + 1) * FAN ** level, len(self.leaves)) - 1, level

    def forward(self) -> str:
        """The digest at the top."""
        queue: list[tuple] = []
        top = self.leaves[0]
        for place, leaf in enumerate(self.leaves):
            if self.height:
                heapq.heappush(queue, (self.label(1, place // FAN), place, leaf))
            while queue and queue[0][0][0] <= place:
                label, received = queue[0][0], []
                while queue and queue[0][0] == label:
                    _, child, value = heapq.heappop(queue)
                    received.append(value)
                level, index = label[1], child // FAN
                self.children[level, index] = received
                top = hashlib.sha256("".join(received).encode()).hexdigest()
                if level < self.height:
                    heapq.heappush(queue, (self.label(level + 1, index // FAN), index, top))
        return top

    def backward(self, above: list[tuple[str, str]]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """(place, proof) of every leaf, the last one first; after `forward`. `above` ends each proof."""
        def message(level: int, index: int, suffix: tuple | None) -> tuple:
            last, _ = self.label(level, index)
            return -last, -level, index, suffix

        queue = [message(self.height, 0, None)]
        while queue:
            _, level, index, suffix = heapq.heappop(queue)
            if not level:
                proof = []
                while suffix:
                    step, suffix = suffix
                    proof.append(step)
                yield index, proof + above
                continue
            children = self.children[-level, index]
            for at in range(len(children)):
                step = "".join(children[:at]), "".join(children[at + 1:])
                heapq.heappush(queue, message(-level - 1, FAN * index + at, (step, suffix)))


def height_of(n: int, levels: int) -> int:
    """Levels that one round raises in a tree of n nodes."""
    height = 0
    while height < levels and FAN ** height < n:
        height += 1
    return height


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None, id_col: str = "doc_id",
             tree_col: str = "source", levels: int = 7) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, claimed, subroot, root (lowercase hex SHA-256) and proof.

    A row's leaf is `leaf_digest` of its fields; `claimed` is the same with the fields in `claims` put in place, to be verified. In every tree
    (a value of `tree_col`; null is one) leaves ascend by id; while there are several nodes, every 3 consecutive ones (fewer at the end, even
    one) become the digest of their digests. The subroots, ordered by tree (null first, then bytewise), give the root likewise.
    proof: for each level from the leaf up to the root, the siblings before and after it, as text.

    A round raises blocks of 3 ** `levels` nodes, each by one sweep in a task, so a large tree is spread over tasks and the rounds grow with the
    logarithm of the rows. What a block sends out of itself travels as a row of the next round. The same blocks are swept back from the root.

    Null fields: `-`. Null ids: before all others. Rows with one id in a tree: in the order of their leaves; equal rows are neighbours.
    Empty table: no rows. Other columns of `docs` don't matter.
    """
    leaf, claimed = (leaf_digest(*(given.get(c, F.col(c)) for c in fields)) for given in ({}, claims or {}))
    rows = staged(docs.select(F.col(tree_col).cast("string").alias("tree"), leaf.alias("value"), F.col(id_col).alias("id"), claimed.alias("claimed")))
    trees = _raised(_ranked(rows, "id", "value"), levels)
    tops = _raised(_ranked(trees[-1].select(F.lit(None).cast("string").alias("tree"), "value", F.col("tree").alias("id"), F.lit("").alias("claimed")), "id"), levels)
    root = tops[-1].select("value").first()
    above = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("tree"), F.lit(0).cast("long").alias("block"),
                                              F.array().cast(STEPS).alias("above"), F.lit("").alias("subroot"))
    for nodes in reversed(tops[:-1] or tops):
        found = staged(_lowered(nodes, above, levels))
        above = found.select("tree", F.col("place").alias("block"), F.col("proof").alias("above"), "subroot")
    above = found.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("proof").alias("above"), F.col("value").alias("subroot"))
    for nodes in reversed(trees[1:-1]):
        above = staged(_lowered(nodes, above, levels)).select("tree", F.col("place").alias("block"), F.col("proof").alias("above"), "subroot")
    return _lowered(trees[0], above, levels).select(F.col("id").alias("doc_id"), F.col("value").alias("leaf"), "claimed", "subroot",
                                            F.lit(root["value"] if root else None).cast("string").alias("root"), "proof")


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with place (from 0, by `order` within its tree) and n (rows of its tree). One row per range and tree carries the places on."""
    ranged = staged(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33)))
    parts = ranged.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("range")) - F.col("rows")
    parts = parts.select(F.col("tree").alias("_tree"), F.col("range").alias("_range"), "first", before.alias("before"), F.sum("rows").over(tree).alias("n"))
    both = ranged.join(parts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("range") == F.col("_range")))
    return staged(both.select("tree", (F.col("row") - F.col("first") + F.col("before")).alias("place"), "n", "value", "id", "claimed"))


def _raised(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each round: (tree, place, n, value, ..), the first as given, the last with one node in each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        kinds = "tree string, place long, n long, value string"
        rounds.append(staged(_in_blocks(rounds[-1].select("tree", "place", "n", "value", _block(levels))).mapInArrow(_raise(levels), kinds)
                             .select("*", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("claimed"))))
    return rounds


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / FAN ** levels).alias("block")


def _in_blocks(nodes: DataFrame, *kind: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *kind, "place")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after another; their number is bounded by the block's size."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _raise(levels: int):
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for rows in _blocks(batches):
            height = height_of(rows[0]["n"], levels)
            made.append({"tree": rows[0]["tree"], "place": rows[0]["block"], "n": -(-rows[0]["n"] // FAN ** height),
                         "value": Sweep([row["value"] for row in rows], height).forward()})
            if len(made) >= _AT_ONCE:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


def _lowered(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """`nodes` with proof and subroot. above: (tree, block, above, subroot) for each block of nodes; it comes to its block as one more row."""
    id_type = nodes.schema["id"].dataType.simpleString()

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, schema = [], None

        def types(batch: pa.RecordBatch) -> pa.Schema:
            steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            return pa.schema([*((c, batch.schema.field(c).type) for c in ("tree", "place", "value", "id", "claimed", "subroot")), ("proof", steps)])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or types(batch)
                yield batch

        for head, *rows in _blocks(watched()):
            if not rows:  # an empty table
                continue
            sweep = Sweep([row["value"] for row in rows], height_of(rows[0]["n"], levels))
            sweep.forward()
            for at, proof in sweep.backward([(step["left"], step["right"]) for step in head["above"]]):
                made.append({c: rows[at][c] for c in ("tree", "place", "value", "id", "claimed")}
                            | {"subroot": head["subroot"], "proof": [{"left": left, "right": right} for left, right in proof]})
            if len(made) >= _AT_ONCE:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    one = nodes.select("tree", _block(levels), F.lit(1).alias("kind"), "place", "n", "value", "id", "claimed",
                       F.lit(None).cast(STEPS).alias("above"), F.lit(None).cast("string").alias("subroot"))
    other = above.select("tree", "block", F.lit(0).alias("kind"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("place", "n", "value", "id", "claimed")),
                         "above", "subroot")
    return _in_blocks(one.unionByName(other), "kind").mapInArrow(
        lower, f"tree string, place long, value string, id {id_type}, claimed string, subroot string, proof {STEPS}")
