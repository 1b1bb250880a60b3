"""Parsing log files whose entries may run over several lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsieve.config import LOG_LEVELS
from chatsieve.operators.ordered import in_chunks

_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*\|\s*([A-Z]+)\s*\|\s*([^|]*?)\s*\|\s?(.*)$"


def entries_from_texts(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """(file, entry, time, level, source, message), continuation lines attached.

    `files` has one row per log file; such files are rotated at a fixed size, so one file
    is a bounded unit of work. Lines before the first entry of a file are dropped.
    """
    lines = files.select(F.col(file).alias("file"), F.posexplode(
        F.split(F.regexp_replace(body, r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))
    per_file = Window.partitionBy("file").orderBy("line_no")
    lines = _with_starts(lines).withColumn("entry", F.sum(F.col("starts").cast("int")).over(per_file))
    return _entries(lines, ["line_no"])


def entries_from_lines(lines: DataFrame, order: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """As `entries_from_texts`, from one row per line, in the order of the columns `order`.

    A file may have any size: entry starts are counted within chunks, then over the chunks of a file, so no file meets in one row or task.
    """
    rows = in_chunks(_with_starts(lines.select(F.col(file).alias("file"), *order, F.col(line).alias("line"))), ["file"], order)
    counts = rows.groupBy("file", "_chunk").agg(F.sum(F.col("starts").cast("int")).alias("n"))
    so_far = Window.partitionBy("file").orderBy("_chunk")
    before = counts.select("file", "_chunk", (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    within = Window.partitionBy("file", "_chunk").orderBy(*order)
    numbered = rows.withColumn("entry", F.sum(F.col("starts").cast("int")).over(within)).join(before, ["file", "_chunk"])
    return _entries(numbered.withColumn("entry", F.col("entry") + F.col("before")), order)


def _with_starts(lines: DataFrame) -> DataFrame:
    return lines.withColumn("starts", F.coalesce(F.regexp_extract("line", _LINE, 2).isin(*LOG_LEVELS), F.lit(False)))


def _entries(lines: DataFrame, order: list[str]) -> DataFrame:
    lines = lines.filter("entry > 0")
    text = F.when(F.col("starts"), F.regexp_extract("line", _LINE, 4)).otherwise(F.col("line"))
    head = lambda i: F.max(F.when(F.col("starts"), F.trim(F.regexp_extract("line", _LINE, i))))
    return lines.groupBy("file", "entry").agg(
        head(1).alias("time"), head(2).alias("level"), head(3).alias("source"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(*order, text.alias("text")))), lambda r: r["text"]), "\n",
        ).alias("message"))


def last_entries(entries: DataFrame, n: int = 200, level: str | None = None) -> DataFrame:
    """The last n entries in file and line order, optionally of one level."""
    if level and level.upper() in LOG_LEVELS:
        entries = entries.filter(F.col("level") == level.upper())
    return entries.orderBy(F.desc("file"), F.desc("entry")).limit(n)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("body"))
    return entries_from_texts(files)
