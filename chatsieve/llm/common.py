"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which all executors share. Only where that is unset (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="chatsieve-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/chatsieve-{uuid.uuid4().hex}"


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """`df` written as Parquet in a shared folder and read back: its lineage is cut and lost executors cost no recomputation. compression: by a codec
    other than the session's."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text counts as the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_of_id(column) -> F.Column:
    """crc32 of an id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column `text` take at most `limit` bytes, or are a single one. It bounds a task's memory."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
