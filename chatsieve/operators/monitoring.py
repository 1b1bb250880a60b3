"""Latency, anomaly, growth and health analytics over metric samples.

Samples are (key, ts, id, value). Look-back windows run per (key, chunk) with the rows
before the chunk lent to it, so that one very busy key spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.operators import ordered as O
from chatsieve.operators.bounds import broadcast_if_small

_ORDER = ["ts", "id"]


def latency_percentiles(samples: DataFrame, window: int = 2000, keys: DataFrame | None = None) -> DataFrame:
    """Nearest-rank p50/p95/p99, mean and count over the last samples of each key.

    With `keys`, keys without samples get zeros.
    """
    last = O.newest_per_key(samples, ["key"], _ORDER, window)
    stats = last.groupBy("key").agg(
        *[F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)"), 3).alias(n)
          for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))],
        F.round(F.avg("value"), 3).alias("mean"), F.count(F.lit(1)).alias("count"))
    if keys is None:
        return stats
    return keys.select("key").join(stats, "key", "left").fillna(0).fillna(0.0)


def _chunk_window() -> Window:
    return Window.partitionBy("key", "_chunk").orderBy(*_ORDER)


def zscore_anomalies(
    samples: DataFrame, window: int = 2000, z: float = 3.5, min_samples: int = 30,
    digits: int | None = 3,
) -> DataFrame:
    """Add mean, std, z_score, sample_size and is_anomaly of each sample against the up to
    `window` samples before it. Sums run along and are subtracted, so the cost per row does
    not depend on the window; values are centred first to keep that accurate."""
    df = O.with_preceding(O.in_chunks(samples.select("key", *_ORDER, "value"), ["key"], _ORDER),
                          ["key"], _ORDER, window + 1)
    w = _chunk_window()
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_c", F.avg("value").over(Window.partitionBy("key", "_chunk")))
    df = df.withColumns({
        "_d": F.col("value") - F.col("_c"),
        "_i": F.row_number().over(w),
        "_changed": F.coalesce(F.col("value") != F.lag("value").over(w), F.lit(False)),
    })
    df = df.withColumns({
        "_s": F.sum("_d").over(running), "_q": F.sum(F.col("_d") * F.col("_d")).over(running),
        "_last_change": F.max(F.when(F.col("_changed"), F.col("_i"))).over(running),
    })
    prior = lambda c: F.lag(c).over(w) - F.coalesce(F.lag(c, window + 1).over(w), F.lit(0.0))
    n = F.least(F.col("_i") - 1, F.lit(window))
    df = df.withColumns({
        "sample_size": n, "_ps": prior("_s"), "_pq": prior("_q"), "_pc": F.lag("_last_change").over(w)})
    # All prior values equal: the last change lies at or before the window's first row.
    constant = F.col("_pc").isNull() | (F.col("_pc") <= F.col("_i") - F.col("sample_size"))
    enough = F.col("sample_size") >= min_samples
    mean = F.when(enough, F.col("_ps") / F.col("sample_size"))
    df = df.withColumn("_m", mean)
    spread = F.sqrt(F.greatest(F.col("_pq") / F.col("sample_size") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    df = df.withColumn("_std", F.when(enough & ~constant, spread).otherwise(0.0))
    df = df.withColumn("_z", F.when(
        F.col("_std") > 0, (F.col("_d") - F.col("_m")) / F.col("_std")).otherwise(0.0))
    shown = lambda c: c if digits is None else F.round(c, digits)
    return df.filter(~F.col("_halo")).select(
        "key", *_ORDER, "value",
        shown(F.when(enough, F.col("_c") + F.col("_m")).otherwise(F.col("value"))).alias("mean"),
        shown(F.col("_std")).alias("std"), shown(F.col("_z")).alias("z_score"), "sample_size",
        (F.abs("_z") >= z).alias("is_anomaly"))


def rolling_mean(samples: DataFrame, n: int = 100) -> DataFrame:
    """Add `rolling_mean` over the last n samples of each key."""
    df = O.with_preceding(O.in_chunks(samples.select("key", *_ORDER, "value"), ["key"], _ORDER),
                          ["key"], _ORDER, n - 1)
    mean = F.avg("value").over(_chunk_window().rowsBetween(-(n - 1), 0))
    return df.withColumn("rolling_mean", mean).filter(~F.col("_halo")).drop("_halo", "_chunk")


def sustained_growth(samples: DataFrame, n: int = 5, ratio: float = 1.5, slack: float = 0.98) -> DataFrame:
    """Add baseline, peak, elevated and growing.

    The baseline is the key's first sample. Growing: the last n samples all exceed
    baseline * ratio and each is at least `slack` times the one before it.
    """
    chunked = O.in_chunks(samples.select("key", *_ORDER, "value"), ["key"], _ORDER)
    first = chunked.groupBy("key").agg(F.min_by("value", F.struct(*_ORDER)).alias("baseline"))
    tops = chunked.groupBy("key", "_chunk").agg(F.max("value").alias("_top"))
    earlier = Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("key", "_chunk", F.max("_top").over(earlier).alias("_peak_before"))
    w = _chunk_window()
    df = O.with_preceding(chunked, ["key"], _ORDER, n)
    df = df.join(broadcast_if_small(first), "key").join(tops, ["key", "_chunk"])
    above = (F.col("baseline") > 0) & (F.col("value") > F.col("baseline") * ratio)
    df = df.withColumns({
        "elevated": above, "_held": F.coalesce(F.col("value") >= F.lag("value").over(w) * slack, F.lit(False)),
        "peak": F.greatest(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_peak_before")),
    })
    growing = (
        (F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n)
        & F.bool_and("elevated").over(w.rowsBetween(-(n - 1), 0))
        & F.bool_and("_held").over(w.rowsBetween(-(n - 2), 0)))
    return df.withColumn("growing", growing).filter(~F.col("_halo")).select(
        "key", *_ORDER, "value", "baseline", "peak", "elevated", "growing")


def health_rollup(
    status: DataFrame, database: str = "database", client: str = "main_client", min_ratio: float = 0.5,
    queue: DataFrame | None = None, queue_capacity: int = 1000,
) -> DataFrame:
    """Per check time: component counts, healthy flag, consecutive unhealthy checks.

    `status` is (scope, check_time, component, ok). Healthy: the database is ok, the main
    client is up, and of the other components at least max(1, total * min_ratio) are up.
    With `queue` (scope, check_time, queue_size), also that size and queue_ok: below the capacity; a check without a size is
    ok. The queue doesn't decide whether a check is healthy.
    """
    part = F.col("component")
    other = ~part.isin(database, client)
    checks = status.groupBy("scope", "check_time").agg(
        F.coalesce(F.bool_or(F.when(part == database, F.col("ok"))), F.lit(False)).alias("database_ok"),
        F.coalesce(F.bool_or(F.when(part == client, F.col("ok"))), F.lit(False)).alias("client_up"),
        F.count_if(other & F.col("ok")).alias("monitors_up"),
        F.count_if(other).alias("monitors_total"))
    enough = F.col("monitors_up") >= F.greatest(F.lit(1.0), F.col("monitors_total") * min_ratio)
    checks = checks.withColumn("healthy", F.col("database_ok") & F.col("client_up") & enough)
    if queue is not None:
        sizes = queue.groupBy("scope", "check_time").agg(F.max("queue_size").alias("queue_size"))
        checks = checks.join(sizes, ["scope", "check_time"], "left").withColumn(
            "queue_ok", F.coalesce(F.col("queue_size") < queue_capacity, F.lit(True)))
    # One row per check from here on.
    w = Window.partitionBy("scope").orderBy("check_time")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    streak = F.count(F.lit(1)).over(
        Window.partitionBy("scope", "_island").orderBy("check_time").rowsBetween(Window.unboundedPreceding, 0))
    islands = checks.withColumn("_island", F.sum(F.col("healthy").cast("int")).over(running))
    # The healthy check that opens an island is not part of the streak after it.
    opened = (F.col("_island") > 0).cast("int")
    return islands.withColumn("consecutive_unhealthy", streak - opened).drop("_island")
