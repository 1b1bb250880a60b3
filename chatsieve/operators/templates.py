"""Boost phrases built from slot lists and slot patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.config import TEMPLATE_PATTERNS


def expand_templates(slots: DataFrame, patterns: DataFrame) -> DataFrame:
    """`phrase` rows: every filling of each supported pattern, without repeats.

    `slots` has (tag, term) with tags such as `need`; `patterns` has (pattern). Both are
    lexicon tables. Patterns outside the supported list yield nothing. The slot lists are
    joined by tag, so each pattern part is an equi-join with its slot list.
    """
    wanted = patterns.select(
        F.split(F.trim(F.regexp_replace("pattern", r"\s+", " ")), " ").alias("tags")
    ).filter(F.array_join("tags", " ").isin(*TEMPLATE_PATTERNS)).distinct()
    filler = slots.select(F.concat(F.lit("<"), "tag", F.lit(">")).alias("tag"), "term").distinct()

    def fill(acc: DataFrame, i: int) -> DataFrame:
        part = filler.select(F.col("tag").alias("slot_tag"), F.col("term").alias(f"t{i}"))
        # get() is null past the end: two-slot patterns keep a null third word
        needed = F.get("tags", F.lit(i))
        joined = acc.withColumn("need", needed).join(part, F.col("need") == F.col("slot_tag"), "left")
        return joined.filter(F.col("need").isNull() | F.col(f"t{i}").isNotNull()).drop("need", "slot_tag")

    filled = reduce(fill, range(3), wanted)
    return filled.select(F.concat_ws(" ", "t0", "t1", "t2").alias("phrase")).distinct()
