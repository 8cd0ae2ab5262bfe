"""Broadcasting behind a check of the size, and writing down what is used several times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.session import shared_folder

# A side of at most this many short rows is sent to every executor whole.
BROADCAST_ROWS = 500_000


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count no further than the limit."""
    return side.limit(rows + 1).count() <= rows


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it is small; else leave the join to be shuffled."""
    return F.broadcast(side) if small_enough(side, rows) else side


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced result to the shared folder and go on from there.

    For a result that is much smaller than its input and used more than once. Unlike a cache
    it outlives the executors that made it.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
