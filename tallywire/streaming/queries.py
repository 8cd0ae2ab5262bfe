"""The streaming operators run over the given tables as file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.sources import adapters as adapt
from tallywire.streaming.aggregates import stream_peers, stream_timeline
from tallywire.streaming.keyed import KeyedStep
from tallywire.streaming.ordered import run_ordered
from tallywire.streaming.pairing import PairingStep
from tallywire.streaming.race import RaceStep, stream_known_items
from tallywire.streaming.run import (
    run_appending,
    run_updating,
    stream_raw,
    stream_table,
    with_event_time,
)

HOUR = 3_600_000
DAY = 24 * HOUR


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return stream_table(spark, path, spark.read.parquet(path).schema)


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    m = adapt.messages_from_activity(_stream(spark, folder, "events"))
    return with_event_time(m, "1 hour")


def _shipments(spark: SparkSession, folder: str) -> DataFrame:
    return adapt.race_from_shipments(_stream(spark, folder, "lineitem"))


def q_stream_timeline(spark, folder):
    counts = stream_timeline(_messages(spark, folder), 6 * HOUR)
    return run_updating(spark, counts, "timeline", ["bin_start_ms", "event_group", "kind"])


def q_stream_peers(spark, folder):
    return run_updating(spark, stream_peers(_messages(spark, folder)), "peers", ["peer_id"])


def q_stream_pairing(spark, folder):
    m = adapt.messages_from_activity(_stream(spark, folder, "events"))
    run = run_ordered(m, PairingStep(adapt.ACTIVITY_RULES), "pairing", HOUR)
    return run.drained().filter(F.col("event") == "tie").drop("event", "fate")


def q_stream_keyed_pairs(spark, folder):
    m = adapt.with_keys(adapt.messages_from_activity(_stream(spark, folder, "events")))
    return run_ordered(m, KeyedStep(adapt.ACTIVITY_RULES), "keyed", HOUR).drained()


def q_stream_request_fate(spark, folder):
    """What is certain an hour before the last event."""
    m = adapt.messages_from_activity(_stream(spark, folder, "events"))
    run = run_ordered(m, PairingStep(adapt.ACTIVITY_RULES), "fates", HOUR)
    fates = run.table().filter(F.col("event") == "fate")
    return fates.select("rule", "peer_id", "inbound", "request_pos", "fate")


def q_stream_race(spark, folder):
    """What is certain two days before the last shipment."""
    step = RaceStep(20 * 365 * DAY, bits=adapt.SHIP_DAY_BITS)
    return run_ordered(_shipments(spark, folder), step, "race", 2 * DAY).table()


def q_stream_known_items(spark, folder):
    # Shipments are in no order of time at all, so nothing may count as late.
    rows = with_event_time(_shipments(spark, folder), f"{20 * 365} days")
    return run_appending(spark, stream_known_items(rows), "items")


RAW = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def q_stream_archive(spark, folder):
    """Pairing over raw files, whose records get their place from the ledger of files."""
    raw = stream_raw(spark, f"{folder}/events.parquet", schema=RAW)
    m = adapt.messages_from_activity(raw, keep=["file_path", "record_no"]).drop("pos")
    run = run_ordered(m, PairingStep(adapt.ACTIVITY_RULES), "archive", HOUR, numbered=True)
    return run.drained().filter(F.col("event") == "tie").drop("event", "fate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
