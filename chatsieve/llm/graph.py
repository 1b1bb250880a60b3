"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import staged

#: Up to so many links, a step is one task: shuffles of so little cost the driver and the cluster a task for each partition, whatever their rows.
FEW_LINKS = 50_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest node that can be reached.

    Large-star and small-star steps alternate until every node hangs on its smallest one. Each step is a minimum per node (combined before
    the shuffle) and an equi-join whose hot keys Spark may split. No link or label passes through the driver, only counts do.
    Up to `FEW_LINKS` links, and so of bounded size, a step is made by one task without a shuffle.
    Links with a null end or with equal ends are left out. Raises if `rounds` don't suffice; they grow with the logarithm of the longest chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a is not null and b is not null and a <> b").distinct())
    before = _mark(edges)
    few = before[0] <= FEW_LINKS  # a step makes no more links than it is given
    edges = _together(edges, few)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = _together(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
        least = _merged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), few)
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = _merged(large.groupBy("a").agg(F.min("b").alias("m")), few)
        small = large.join(low, "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = _together(staged(_together(edges, few).distinct()), few)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: {rounds} rounds don't suffice")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def _together(df: DataFrame, few: bool) -> DataFrame:
    return df.coalesce(1) if few else df


def _merged(df: DataFrame, few: bool) -> DataFrame:
    """For a join inside one task: a broadcast would collect its side on the driver."""
    return df.hint("merge") if few else df


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest, to see whether a step changed anything."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
