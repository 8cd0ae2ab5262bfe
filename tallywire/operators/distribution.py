"""Duration distributions: count, extremes, mean and power-of-two buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.buckets import BUCKETS, bucket_percentile, log2_bucket

PERCENTILES = (0.5, 0.9, 0.99)


def tally(ms: str) -> dict[str, Column]:
    """What is kept of the samples of one bucket."""
    return {
        "n": F.count(ms),
        "total": F.sum(ms),
        "low": F.min(ms),
        "high": F.max(ms),
    }


def folded(where: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates that fold bucket tallies (bucket, n, total, low, high) into a distribution.

    The input has one row per group and bucket, so at most BUCKETS entries are listed.
    """
    def pick(value: Column) -> Column:
        return value if where is None else F.when(where, value)

    zero = F.lit(0)
    entry = F.struct(F.col("bucket"), F.col("n"))
    return [
        F.coalesce(F.sum(pick(F.col("n"))), zero).alias(f"{prefix}count"),
        F.coalesce(F.sum(pick(F.col("total"))), zero).alias(f"{prefix}total_ms"),
        F.coalesce(F.min(pick(F.col("low"))), zero).alias(f"{prefix}min_ms"),
        F.coalesce(F.max(pick(F.col("high"))), zero).alias(f"{prefix}max_ms"),
        F.map_from_entries(F.collect_list(pick(entry))).alias(f"{prefix}filled"),
    ]


def unfolded(df: DataFrame, *prefixes: str) -> DataFrame:
    """Replace the filled buckets ``folded`` found by all BUCKETS of them, and add the mean."""
    def dense(prefix: str) -> Column:
        filled, zero = F.col(f"{prefix}filled"), F.lit(0).cast("bigint")
        numbers = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
        return F.transform(numbers, lambda i: F.coalesce(filled[i], zero))

    out = df
    for prefix in prefixes or ("",):
        out = out.withColumns(
            {f"{prefix}buckets": dense(prefix), f"{prefix}mean_ms": mean(prefix)}
        ).drop(f"{prefix}filled")
    return out


def distribution(df: DataFrame, by: Sequence[str], ms: str) -> DataFrame:
    """One row per group; one row in all when ``by`` is empty. NULL durations are left out.

    Samples are counted per (group, bucket) first, so a large group reaches the second step
    as at most one row per bucket.
    """
    per_bucket = (
        df.filter(F.col(ms).isNotNull())
        .groupBy(*by, log2_bucket(F.col(ms)).alias("bucket"))
        .agg(*[c.alias(n) for n, c in tally(ms).items()])
    )
    return unfolded(per_bucket.groupBy(*by).agg(*folded()))


def mean(prefix: str = "") -> Column:
    count, total = F.col(f"{prefix}count"), F.col(f"{prefix}total_ms")
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def percentile(p: float, prefix: str = "") -> Column:
    named = {c: F.col(f"{prefix}{c}") for c in ("buckets", "count", "min_ms", "max_ms")}
    return bucket_percentile(named["buckets"], named["count"], named["min_ms"], named["max_ms"], p)


def with_percentiles(dist: DataFrame, ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """Add p50_ms, p90_ms, ... estimated from the buckets."""
    return dist.withColumns({f"p{round(p * 100)}_ms": percentile(p) for p in ps})


def exact_percentiles(
    df: DataFrame, by: Sequence[str], ms: str, ps: Sequence[float] = PERCENTILES
) -> DataFrame:
    """Percentiles from all samples, for comparison with the estimates.

    Equal durations are counted first. The buckets of a group, 32 at most, tell in which of
    them a rank lies, and only those are gone through in order. Between two ranks the
    percentile is interpolated.
    """
    rows = df.filter(F.col(ms).isNotNull())
    values = rows.groupBy(*by, log2_bucket(F.col(ms)).alias("bucket"), F.col(ms).alias("value"))
    values = values.agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    total = F.sum("n").over(group)
    buckets = values.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.select(
        *[F.col(c).alias(f"_{c}") for c in (*by, "bucket")],
        (F.sum("n").over(group.orderBy("bucket")) - F.col("n")).alias("before"),
        "n",
        total.alias("total"),
    )
    last = F.col("total") - 1
    ranks = [
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), whole(last * p).alias("rank"))
        for i, p in enumerate(ps)
        for side, whole in enumerate((F.floor, F.ceil))
    ]
    here = lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n"))
    buckets = buckets.withColumn("ranks", F.filter(F.array(*ranks), here)).drop("n")
    buckets = buckets.filter(F.size("ranks") > 0)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "bucket")]
    found = values.join(buckets, reduce(and_, same))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bucket").orderBy("value"))
    found = found.withColumn("upto", upto).withColumn("r", F.explode("ranks"))
    passed = F.col("upto") - F.col("n")
    found = found.filter((F.col("r.rank") < F.col("upto")) & (F.col("r.rank") >= passed))

    def at(i: int, side: int) -> Column:
        return F.max(F.when((F.col("r.i") == i) & (F.col("r.side") == side), F.col("value")))

    def between(i: int, p: float) -> Column:
        place = (F.max("total") - 1) * F.lit(p)
        part = place - F.floor(place)
        return at(i, 0) * (1 - part) + at(i, 1) * part

    return found.groupBy(*by).agg(
        *[between(i, p).alias(f"p{round(p * 100)}_ms") for i, p in enumerate(ps)]
    )


def merge_tallies(tallies: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bucket tallies of finer groups summed to one per coarser group and bucket."""
    return tallies.groupBy(*by, "bucket").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def merge_distributions(dists: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fold distributions into one per group; empty ones change nothing."""
    sums = dists.filter(F.col("count") > 0)
    # The figures of a distribution as a whole go in as a bucket of their own, without samples.
    entries = sums.select(
        *by, "total_ms", "min_ms", "max_ms", F.posexplode("buckets").alias("bucket", "n")
    ).filter(F.col("n") > 0)
    whole = sums.select(
        *by, "total_ms", "min_ms", "max_ms",
        F.lit(-1).alias("bucket"), F.lit(0).cast("bigint").alias("n"),
    )
    parts = entries.withColumns(
        {c: F.lit(None).cast("bigint") for c in ("total_ms", "min_ms", "max_ms")}
    ).unionByName(whole)
    tallies = merge_tallies(
        parts.withColumnsRenamed({"total_ms": "total", "min_ms": "low", "max_ms": "high"}), by
    )
    return unfolded(tallies.groupBy(*by).agg(*folded()))
