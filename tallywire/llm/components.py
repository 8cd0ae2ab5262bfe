"""Connected components of links, by alternating stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.plans.sizes import settled

# Arcs a task writes, about; small results are not spread over many files.
PER_FILE = 100_000


def _pointed(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with ``m``, the lowest of u and its neighbours.

    A node may hold a third of all arcs: the minimum is combined before the shuffle, and the
    join has one row per node on one side, so Spark can split its other side where it is skewed.
    """
    low = arcs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return arcs.join(low, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per linked node: ``node`` and ``component``, the lowest node it is linked to.

    Links are undirected and may repeat; a link with a null end or to itself counts for
    nothing. Each round lets every node point its higher neighbours, and then its lower ones,
    at the lowest of them, until every node has one arc, to a node without any; rounds grow
    with the logarithm of the longest chain. Rounds are written to the shared folder, so no
    lineage builds up.
    """
    ends = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    ends = ends.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    arcs = settled(ends.distinct(), "links")
    files = 8 + arcs.count() // PER_FILE
    while not _is_forest(arcs):
        both = arcs.union(arcs.select("v", "u"))
        large = _pointed(both).filter("v > u AND v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = settled(large.coalesce(files), "large")
        small = _pointed(large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v")
        arcs = settled(small.filter("u <> v").distinct().coalesce(files), "small")
    to = arcs.toDF("node", "component")
    return to.union(arcs.select("v", "v").distinct())


def _is_forest(arcs: DataFrame) -> bool:
    """Whether all nodes with an arc have one, to a node without."""
    roles = arcs.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(
        arcs.select("v", F.lit(0)).distinct()
    )
    odd = roles.groupBy("n").agg(F.count("*").alias("k"), F.sum("up").alias("up"))
    return odd.filter("k > 1 AND up > 0").isEmpty()
