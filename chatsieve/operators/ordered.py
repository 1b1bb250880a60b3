"""Ordered work per key when one key may hold a large share of the rows.

Rows are range-partitioned by (key, order), so a large key spreads over many tasks as
consecutive chunks. What one chunk needs from the earlier ones travels in tables with
one row per (key, chunk).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names, so that re-reads agree."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        # Only a session without any setting (a local test) gets a folder of its own.
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chatsieve-ckpt-"))
    return df.checkpoint(eager=True)


def mark_first(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_first") -> DataFrame:
    """Flag the first row of each key group, in two steps so that no large group meets.

    The order columns must tell rows apart. First each group is ranked within salts; all
    but one row per (group, salt) are then known to be later ones and stay spread out. Only
    the at most one-per-salt leaders of a group are ranked against each other.
    """
    salts = shuffle_width(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    led = salted.withColumn("_lead", F.row_number().over(within) == 1)
    led = led.withColumn("_slot", F.when(F.col("_lead"), F.lit(-1)).otherwise(F.col("_salt")))
    across = Window.partitionBy(*keys, "_slot").orderBy(*order)
    ranked = led.withColumn(flag, F.col("_lead") & (F.row_number().over(across) == 1))
    return ranked.drop("_salt", "_lead", "_slot")


def in_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add `_chunk`, increasing with (keys, order), and make the assignment stable."""
    n = chunks or shuffle_width(df.sparkSession)
    spread = df.repartitionByRange(n, *keys, *order)
    return stable(spread.withColumn("_chunk", F.spark_partition_id()))


def with_preceding(df: DataFrame, keys: list[str], order: list[str], depth: int) -> DataFrame:
    """Give every (key, chunk) also the `depth` rows before it, marked `_halo`.

    Window functions over (keys, _chunk) that look back at most `depth` rows are then exact
    for the rows with `_halo` false. `df` comes from `in_chunks`.
    """
    sizes = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_chunk")
    ends = sizes.withColumn("_end", F.sum("_n").over(so_far)).withColumn("_begin", F.col("_end") - F.col("_n"))
    spans = ends.withColumn("_next", F.lead("_chunk").over(so_far))
    # Keys within one chunk, the usual case, need nothing from elsewhere.
    split = spans.filter((F.col("_begin") > 0) | F.col("_next").isNotNull())
    takers = split.filter(F.col("_begin") > 0).select(
        *keys, F.col("_chunk").alias("_to"), F.col("_begin").alias("_to_begin"))
    givers = split.filter(F.col("_next").isNotNull()).select(
        *keys, "_chunk", "_end",
    ).join(takers, keys).filter(
        (F.col("_to") > F.col("_chunk")) & (F.col("_end") > F.col("_to_begin") - depth)
    ).select(*keys, "_chunk", "_end", "_to", "_to_begin")
    back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    lent_from = givers.select(*keys, "_chunk").distinct()
    tails = df.join(lent_from, [*keys, "_chunk"], "left_semi").withColumn(
        "_back", F.row_number().over(back)).filter(F.col("_back") <= depth)
    halo = tails.join(givers, [*keys, "_chunk"]).filter(
        F.col("_to_begin") - (F.col("_end") - F.col("_back")) <= depth
    ).withColumn("_chunk", F.col("_to")).select(*df.columns, F.lit(True).alias("_halo"))
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """Add `name`: the row's number within its key by `order`, from 0. A large key is numbered chunk by chunk."""
    rows = in_chunks(df, keys, order, chunks)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_n")
    nth = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    joined = rows.withColumn("_nth", nth).join(sizes.select(*keys, "_chunk", before.alias("_before")), [*keys, "_chunk"])
    return joined.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_nth", "_before", "_chunk")


# --- folds of clamped affine steps -----------------------------------------
# A step x -> min(hi, max(lo, a*x + b)) with a > 0 composes with another one to a step of
# the same form, so each chunk folds to one step and the chunks fold in order.
_WIDE = 1e300  # "no clamp yet"; finite, so that a slope that underflows to 0 stays harmless


def _compose(first: Column, then: Column) -> Column:
    def clamp(x: Column) -> Column:
        return F.least(then["hi"], F.greatest(then["lo"], x))
    return F.struct(
        (then["a"] * first["a"]).alias("a"),
        (then["a"] * first["b"] + then["b"]).alias("b"),
        clamp(then["a"] * first["lo"] + then["b"]).alias("lo"),
        clamp(then["a"] * first["hi"] + then["b"]).alias("hi"),
    )


def _fold(steps: Column) -> Column:
    identity = F.struct(
        F.lit(1.0).alias("a"), F.lit(0.0).alias("b"),
        F.lit(-_WIDE).alias("lo"), F.lit(_WIDE).alias("hi"))
    return F.aggregate(steps, identity, lambda acc, s: _compose(acc, s["step"]))


def step(a: Column | float, b: Column | float, lo: float, hi: float) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(as_col(a).alias("a"), as_col(b).alias("b"), as_col(lo).alias("lo"), as_col(hi).alias("hi"))


def apply_step(x: Column, s: Column) -> Column:
    return F.least(s["hi"], F.greatest(s["lo"], s["a"] * x + s["b"]))


def chunk_steps(df: DataFrame, keys: list[str], order: list[str], value: Column, run: int = 4096) -> DataFrame:
    """(keys, _chunk, step, n): each chunk's rows folded in order to one step.

    Runs of `run` rows are folded first, then the runs of a chunk, so no array holds a chunk's rows.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    rows = df.withColumn("_run", F.floor((nth - 1) / run)).select(*keys, "_chunk", "_run", F.struct(*order, value.alias("step")).alias("row"))
    runs = rows.groupBy(*keys, "_chunk", "_run").agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.count(F.lit(1)).alias("n")).select(
        *keys, "_chunk", "_run", _fold(F.col("rows")).alias("step"), "n")
    folded = runs.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_run", "step"))).alias("rows"), F.sum("n").alias("n"))
    return folded.select(*keys, "_chunk", _fold(F.col("rows")).alias("step"), "n")


def fold_steps(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """(keys, step, n): all rows of each key folded in order to one step."""
    partial = chunk_steps(in_chunks(df, keys, order), keys, order, value)
    return partial.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_chunk", "step"))).alias("rows"), F.sum("n").alias("n")
    ).select(*keys, _fold(F.col("rows")).alias("step"), "n")


def carried_values(
    steps: DataFrame, keys: list[str], start: float, starts: DataFrame | None = None
) -> DataFrame:
    """(keys, _chunk, carried): the value with which each chunk begins.

    A key begins at its value in `starts` (keys, start), else at `start`.
    `steps` has one row per (key, chunk), so a key's list is as long as its chunks are many.
    """
    chunks = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "step"))).alias("rows"))
    empty = F.array().cast("array<struct<chunk:int,carried:double>>")
    chunks = chunks.withColumn("start", F.lit(None).cast("double")) if starts is None else chunks.join(
        starts.select(*keys, "start"), keys, "left")
    begin = F.struct(F.coalesce("start", F.lit(start)).alias("x"), empty.alias("out"))
    walked = F.aggregate("rows", begin, lambda acc, r: F.struct(
        apply_step(acc["x"], r["step"]).alias("x"),
        F.array_append(acc["out"], F.struct(r["_chunk"].alias("chunk"), acc["x"].alias("carried"))).alias("out")))
    return chunks.select(*keys, F.explode(walked["out"]).alias("c")).select(
        *keys, F.col("c.chunk").alias("_chunk"), "c.carried")


def sessions(chunked: DataFrame, keys: list[str], order: list[str], ts: str, gap_seconds: float) -> DataFrame:
    """Add `session`: it rises where at least the gap lies between a key's successive rows."""
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    chunk_first = chunked.groupBy(*keys, "_chunk").agg(F.max(ts).alias("_last_ts"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = chunk_first.select(*keys, "_chunk", F.lag("_last_ts").over(across).alias("_before"))
    rows = chunked.join(before, [*keys, "_chunk"])
    previous = F.coalesce(F.lag(ts).over(within), "_before")
    seconds = (F.unix_micros(ts) - F.unix_micros(previous)) / 1e6
    rows = rows.withColumn("_opens", (previous.isNull() | (seconds >= gap_seconds)).cast("int"))
    opened = rows.groupBy(*keys, "_chunk").agg(F.sum("_opens").alias("_n"))
    offset = opened.select(*keys, "_chunk", (F.sum("_n").over(across) - F.col("_n")).alias("_offset"))
    running = F.sum("_opens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offset, [*keys, "_chunk"]).withColumn(
        "session", F.col("_offset") + running).drop("_before", "_opens", "_offset")


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key. A table of counts per key and hour first tells from
    which hour on they lie, so that older rows never shuffle; the rest is ranked within
    salts before the winners are ranked against each other."""
    ts = order[0]
    hours = df.groupBy(*keys, F.date_trunc("hour", ts).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("_hour"))
    later = F.sum("_n").over(newest_first) - F.col("_n")
    since = hours.withColumn("_later", later).filter(F.col("_later") < n).groupBy(*keys).agg(
        F.min("_hour").alias("_since"))
    late = df.join(since, keys).filter(F.col(ts) >= F.col("_since")).drop("_since")
    late = late.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(shuffle_width(df.sparkSession))))
    down = [F.desc(c) for c in order]
    for group in ([*keys, "_salt"], keys):
        late = late.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*down))).filter(
            F.col("_rank") <= n)
    return late.drop("_salt", "_rank")
