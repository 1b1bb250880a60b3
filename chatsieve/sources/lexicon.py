"""Reading keyword lexicons (nested JSON documents) into tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve.config import DEFAULT_TERM_WEIGHT, LEXICON_CATEGORIES

WALKED = (T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("ord", T.ArrayType(T.IntegerType())),
          T.StructField("hint", T.DoubleType()), T.StructField("node", T.StringType()))


def _hint(node: dict) -> float | None:
    value = node.get("_weight_hint")
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def _walked(text: str | None) -> Iterator[tuple[list[str], list[int], float | None, str]]:
    """(parts, ord, hint, node) of every member of a JSON document, however deep; its members that aren't known categories are left out."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return
    open_ = [([], [], root)] if isinstance(root, dict) else []
    while open_:
        parts, order, node = open_.pop()
        for i, (key, child) in enumerate(node.items()):
            if key.startswith("_") or child is None or (not parts and key not in LEXICON_CATEGORIES):
                continue
            path, at = [*parts, key], [*order, i]
            yield path, at, _hint(node), child if isinstance(child, str) else json.dumps(child, ensure_ascii=False)
            if isinstance(child, dict):
                open_.append((path, at, child))


def walk_documents(docs: DataFrame, doc: str = "doc", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every (path, node) of the JSON objects in column `doc`, metadata keys skipped; one pass over the documents.

    `ord` holds the position of each path part among its siblings, so that sorting by it
    gives document order. `hint` is the `_weight_hint` of the enclosing object.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.float64(), pa.string()]
        for batch in batches:
            rows = [(i, *row) for i, text in enumerate(batch.column(len(keys)).to_pylist()) for row in _walked(text)]
            if rows:
                at, *columns = zip(*rows, strict=True)
                picked = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*picked, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))],
                                                 names=[*keys, "parts", "ord", "hint", "node"])

    chosen = docs.select(*keys, doc)
    schema = T.StructType([*(chosen.schema[k] for k in keys), *WALKED])
    return chosen.mapInArrow(walk, schema)


def lexicon_from_documents(docs: DataFrame, doc: str = "doc", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per term of every list of strings in the documents.

    Lists holding anything but strings are not term lists and are skipped.
    """
    is_strings = F.expr(
        "schema_of_variant(try_parse_json(node)) IN ('ARRAY<STRING>', 'ARRAY<VOID>')")
    lists = walk_documents(docs, doc, keys).filter(F.ltrim("node").startswith("[") & is_strings)
    return lists.select(
        *keys, F.array_join("parts", ".").alias("path"), F.col("parts")[0].alias("category"),
        F.array_join(F.slice("parts", 2, F.size("parts")), ".").alias("grp"), "ord",
        F.coalesce("hint", F.lit(DEFAULT_TERM_WEIGHT)).alias("weight"),
        F.posexplode(F.from_json("node", "array<string>")).alias("pos", "term"),
    ).select(*keys, "path", "category", "grp", "term", "weight", "pos", "ord")


def numbers_from_documents(docs: DataFrame, root: str, leaf: str | None, doc: str = "doc") -> DataFrame:
    """(key, value, pos) for numeric members under `root`, in document order.

    With `leaf` the members are objects and the number is their field of that name.
    """
    prefix = root.split(".")
    nodes = walk_documents(docs, doc).filter(
        (F.array_join(F.slice("parts", 1, len(prefix)), ".") == root) & (F.size("parts") == len(prefix) + 1))
    value = F.col("node") if leaf is None else F.get_json_object("node", f"$.{leaf}")
    return nodes.withColumn("raw", value).select(
        F.element_at("parts", -1).alias("key"), F.expr("try_cast(raw AS double)").alias("value"),
        F.element_at("ord", -1).alias("pos"),
    )


def dialect_from_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(variant, canonical) pairs; a later region overrides an earlier one."""
    regions = walk_documents(docs, doc).filter(
        (F.col("parts")[0] == "dialect_mapping") & (F.size("parts") == 2) & F.ltrim("node").startswith("{"))
    pairs = regions.select("ord", F.posexplode(F.from_json("node", "map<string,string>")).alias("i", "variant", "canonical"))
    return pairs.groupBy("variant").agg(
        F.max_by("canonical", F.struct("ord", "i")).alias("canonical"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_from_documents(documents(spark, path))


def read_dialect(spark: SparkSession, path: str) -> DataFrame:
    return dialect_from_documents(documents(spark, path))
