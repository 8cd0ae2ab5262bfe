"""Power-of-two duration buckets and percentiles read from them.

Bucket i holds [2**i - 1, 2**(i+1) - 1) milliseconds; the last one has no upper end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


def log2_bucket(ms: Column) -> Column:
    """floor(log2(ms + 1)), at most 31; integer-exact."""
    return F.least(F.length(F.bin(ms + 1)) - 1, F.lit(BUCKETS - 1)).cast("int")


def bucket_low(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bucket) - 1


def bucket_edges(spark: SparkSession) -> DataFrame:
    bucket = F.col("id").cast("int")
    return spark.range(BUCKETS).select(
        bucket.alias("bucket"),
        bucket_low(bucket).alias("low_ms"),
        F.when(F.col("id") < BUCKETS - 1, bucket_low(bucket + 1)).alias("high_ms"),
    )


def bucket_percentile(
    buckets: Column, count: Column, low: Column, high: Column, p: float
) -> Column:
    """Estimate percentile ``p`` inside the bucket it falls in, kept within [low, high].

    NULL where there are no samples.
    """
    target = F.greatest(F.ceil(count.cast("double") * F.lit(float(min(max(p, 0.0), 1.0)))), F.lit(1))
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("seen"),
        F.lit(0).alias("next"),
        F.lit(-1).alias("hit"),
        zero.alias("ahead"),
        zero.alias("held"),
    )

    def step(s, n):
        found = (s["hit"] < 0) & (s["seen"] + n >= target)
        return F.struct(
            (s["seen"] + n).alias("seen"),
            (s["next"] + 1).alias("next"),
            F.when(found, s["next"]).otherwise(s["hit"]).alias("hit"),
            F.when(found, s["seen"]).otherwise(s["ahead"]).alias("ahead"),
            F.when(found, n).otherwise(s["held"]).alias("held"),
        )

    def place(s):
        edge = bucket_low(s["hit"])
        width = F.when(s["hit"] == BUCKETS - 1, edge).otherwise(bucket_low(s["hit"] + 1) - edge)
        share = (target - s["ahead"]).cast("double") / s["held"].cast("double")
        inside = edge + (width.cast("double") * share).cast("bigint")
        return F.when(s["hit"] >= 0, F.least(F.greatest(inside, low), high)).otherwise(high)

    return F.when(count > 0, F.aggregate(buckets, start, step, place))
