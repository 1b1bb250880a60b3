"""Tables that hold the current row of each key, for jobs that run again and again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.sources.sinks import read_if_any


@dataclass(frozen=True)
class CurrentState:
    """A Parquet table under `path`: the current row per key, by bucket of the key, each bucket in two slots.

    A run reads the buckets its own keys fall in, merges, and writes these buckets anew to the slot that doesn't hold their last version. So
    what a run reads and writes follows from its keys and from how many keys there are, not from how many runs came before; a run that fails
    leaves the last version as it was, and is repeated on it. Rows carry the number of the run that wrote them; runs with numbers up from
    the one that reads don't count.
    """

    path: str
    key: str
    buckets: int = 256

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession, run: int, touched: list[int] | None) -> tuple[DataFrame | None, dict[int, int]]:
        """The table and the slot of each bucket's last version before `run`. At most two rows a bucket reach the driver."""
        table = read_if_any(spark, self.path)
        if table is None:
            return None, {}
        if touched is not None:
            table = table.filter(F.col("bucket").isin(touched))
        found = table.filter(F.col("run") < run).groupBy("bucket").agg(F.max_by("slot", "run").alias("slot")).collect()
        return table, {r["bucket"]: r["slot"] for r in found}

    def read(self, spark: SparkSession, run: int, keys: DataFrame | None = None) -> DataFrame | None:
        """The current rows before `run`, those of the buckets of `keys` or all; None while there are none."""
        table, slots = self._versions(spark, run, None if keys is None else self.touched(keys))
        if not slots:
            return None
        current = [F.col("bucket").isin([b for b, s in slots.items() if s == slot]) & (F.col("slot") == slot) for slot in (0, 1)]
        return table.filter(current[0] | current[1]).drop("bucket", "slot", "run")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most `buckets` numbers."""
        return sorted(r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect())

    def merge(self, rows: DataFrame, run: int) -> None:
        """Put `rows`, one per key, in place of what their keys had before `run`."""
        spark, buckets = rows.sparkSession, self.touched(rows)
        old = self.read(spark, run, rows)
        if old is not None:
            new = rows.select(F.col(self.key).alias("_new"))
            rows = rows.unionByName(old.join(new, F.col(self.key).eqNullSafe(F.col("_new")), "left_anti"))
        bucketed = rows.withColumn("bucket", self._bucket())
        _, slots = self._versions(spark, run, buckets)
        taken = [b for b, s in slots.items() if s == 0]
        slotted = bucketed.withColumn("slot", F.when(F.col("bucket").isin(taken), 1).otherwise(0)).withColumn("run", F.lit(run).cast("long"))
        (slotted.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "slot").parquet(self.path))
