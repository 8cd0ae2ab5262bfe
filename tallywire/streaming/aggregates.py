"""Running counts over time, and the running peer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.labels import CONN_TYPES
from tallywire.functions.taxonomy import LIFECYCLE, is_lifecycle, is_message
from tallywire.operators.peers import of_peers


def stream_timeline(events: DataFrame, width_ms: int) -> DataFrame:
    """Counts per bin and kind; ``events`` has an event time ``ts`` with a watermark."""
    return (
        events.groupBy(F.window("ts", f"{width_ms} milliseconds").alias("w"), "event_group", "kind")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.unix_millis("w.start").alias("bin_start_ms"), "event_group", "kind", "cnt")
    )


def stream_peers(events: DataFrame) -> DataFrame:
    """The peer table so far, by the rules of ``peer_table``.

    Address, type and network are each the last one that was told, by position, whichever
    order events arrive in.
    """
    shown = (is_message() | is_lifecycle()) & (F.col("kind") != "misbehaving")
    inbound = is_message() & F.col("inbound")
    outbound = is_message() & ~F.col("inbound")

    def last(column: str, told):
        told = told & F.col(column).isNotNull()
        return F.max(F.when(told, F.struct("pos", column))).alias(f"last_{column}")

    lifecycle = [F.col(f"n_{k}") for k in LIFECYCLE]
    return (
        of_peers(events)
        .groupBy("peer_id")
        .agg(
            last("addr", shown),
            last("conn_type", shown),
            last("network", shown & is_lifecycle()),
            F.min("ts_ms").alias("first_seen"),
            F.max("ts_ms").alias("last_seen"),
            F.min("pos").alias("first_pos"),
            F.count_if(inbound).alias("messages_in"),
            F.count_if(outbound).alias("messages_out"),
            F.coalesce(F.sum(F.when(inbound, F.col("size"))), F.lit(0)).alias("bytes_in"),
            F.coalesce(F.sum(F.when(outbound, F.col("size"))), F.lit(0)).alias("bytes_out"),
            *[
                F.count_if(is_lifecycle() & (F.col("kind") == k)).alias(f"n_{k}")
                for k in LIFECYCLE
            ],
        )
        .withColumn("lifecycle_events", sum(lifecycle[1:], lifecycle[0]))
        .select(
            "peer_id",
            F.col("last_addr.addr").alias("addr"),
            known_type(F.col("last_conn_type.conn_type")).alias("conn_type"),
            F.col("last_network.network").alias("network"),
            "first_seen",
            "last_seen",
            "first_pos",
            (F.col("last_seen") - F.col("first_seen")).alias("duration_ms"),
            "messages_in",
            "messages_out",
            "bytes_in",
            "bytes_out",
            *[f"n_{k}" for k in LIFECYCLE],
            "lifecycle_events",
            (F.col("messages_in") + F.col("messages_out") + F.col("lifecycle_events")).alias(
                "events"
            ),
        )
    )


def known_type(name: Column) -> Column:
    """A type that has no name here is unknown, and none stays none."""
    known = F.when(name.isin(*CONN_TYPES), name).otherwise(F.lit("unknown"))
    return F.when(name.isNotNull(), known)
