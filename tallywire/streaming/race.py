"""The relay race as it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.operators.relay import ORDER, relay_race
from tallywire.plans import skew

COLUMNS = ["item", "peer_id", "ts_ms", *ORDER, "delivery", "size"]


class RaceStep:
    """The race of released rows after what earlier ones made known.

    All that later rows can tell of an item's past is its first time, and whether it was
    announced and delivered. That is kept as one row per item, and comes back as at most two
    rows in front of the item's others. An item is forgotten ``keep_ms`` after its last row.
    """

    columns = COLUMNS

    def __init__(
        self, keep_ms: int, hot_rows: int = skew.HOT_ROWS, bits: int = skew.SPLIT_BITS
    ) -> None:
        self.keep_ms, self.hot_rows, self.bits = keep_ms, hot_rows, bits

    def run(self, ready: DataFrame, kept: DataFrame | None, now: int):
        known = ready.groupBy("item").agg(
            F.lit(1).alias("age"),
            F.min_by("ts_ms", F.struct(*ORDER)).alias("first_ts"),
            F.bool_or(~F.col("delivery")).alias("announced"),
            F.bool_or("delivery").alias("delivered"),
            F.max("ts_ms").alias("last_ts"),
        )
        # Places 0 and 1 are for what is known; rows come after them.
        rows = ready.withColumn("pos", F.col("pos") + 2)
        if kept is not None:
            rows = rows.unionByName(self._recalled(kept, ready))
            known = known.unionByName(kept.withColumn("age", F.lit(0)))
        race = relay_race(rows, self.hot_rows, self.bits).filter("pos >= 2")
        known = known.groupBy("item").agg(
            F.min_by("first_ts", "age").alias("first_ts"),
            F.bool_or("announced").alias("announced"),
            F.bool_or("delivered").alias("delivered"),
            F.max("last_ts").alias("last_ts"),
        )
        live = known.filter(F.col("last_ts") + self.keep_ms > now)
        return race.withColumn("pos", F.col("pos") - 2), live

    def _recalled(self, kept: DataFrame, ready: DataFrame) -> DataFrame:
        met = kept.join(ready.select("item").distinct(), "item", "left_semi")
        places = F.array_compact(
            F.array(F.when(F.col("announced"), F.lit(0)), F.when(F.col("delivered"), F.lit(1)))
        ).cast("array<bigint>")
        met = met.select("item", "first_ts", F.explode(places).alias("pos"))
        return met.select(
            "item",
            F.lit(None).cast("bigint").alias("peer_id"),
            F.col("first_ts").alias("ts_ms"),
            "pos",
            F.lit(0).cast("bigint").alias("item_no"),
            (F.col("pos") == 1).alias("delivery"),
            F.lit(None).cast("bigint").alias("size"),
        )


def stream_known_items(rows: DataFrame) -> DataFrame:
    """Every item once, when it is first heard of; built-in de-duplication, no Python."""
    return rows.select("item", "ts").dropDuplicatesWithinWatermark(["item"]).select("item")
