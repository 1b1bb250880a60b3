"""Size checks for the few small tables that reach the driver or are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Rows a configuration-like table (lexicon, dialect map, bands) may have on the driver.
DRIVER_ROWS = 20_000
# Rows a narrow table may have to be broadcast; beyond it Spark picks the join.
BROADCAST_ROWS = 1_000_000


class TooLarge(ValueError):
    """A table meant to be small is not."""


def try_collect(df: DataFrame, limit: int = DRIVER_ROWS) -> list[Row] | None:
    """The rows, or None when there are more than `limit` of them."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def collect_bounded(df: DataFrame, what: str, limit: int = DRIVER_ROWS) -> list[Row]:
    rows = try_collect(df, limit)
    if rows is None:
        raise TooLarge(f"{what} has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow table whose row count is checked first."""
    counted = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return F.broadcast(df) if counted <= limit else df
