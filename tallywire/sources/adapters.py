"""Other tables read as wire events, so that every operator runs on them too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.labels import CONN_TYPES
from tallywire.functions.taxonomy import category_of, label_of
from tallywire.operators.rules import Rule

HOUR = 3_600_000

# Pairing rules for the activity table: each event type answers at most one other.
ACTIVITY_RULES = (
    Rule("view", ("click",), optional=True, window_ms=12 * HOUR),
    Rule("click", ("purchase",), window_ms=24 * HOUR),
    Rule("purchase", ("view",), multi=True, window_ms=48 * HOUR),
)
# The same with one reply claimed by two rules.
CONTENDED_RULES = (
    Rule("view", ("click",), window_ms=12 * HOUR),
    Rule("purchase", ("click", "view"), multi=True, window_ms=48 * HOUR),
)
# Networks for the addresses ``messages_from_activity`` makes; 10.3.0.0/16 stays unmapped.
PREFIXES = [
    ("10.0.0.0/16", 64500),
    ("10.1.0.0/16", 64501),
    ("10.1.0.0/25", 64511),
    ("10.2.0.0/16", 0),
]


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970; a timestamp without zone is read in the session's zone."""
    return F.unix_millis(ts.cast("timestamp"))


def messages_from_activity(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """An activity table (users acting over time) as messages and connection events."""
    # One number in a flat object: cheaper to pick out than to parse the text.
    k = F.regexp_extract("props", r'"k"\s*:\s*(-?[0-9]+)', 1).try_cast("bigint")
    user = F.col("user_id")
    message = F.col("event_type").isin("view", "click", "purchase")
    ended = F.element_at(
        F.array(F.lit("closed"), F.lit("inbound_evicted"), F.lit("misbehaving")),
        (F.col("k") % 3 + 1).cast("int"),
    )
    opened = F.when(F.col("k") % 2 == 0, "inbound").otherwise("outbound")
    kind = F.when(message, F.col("event_type")).when(F.col("event_type") == "signup", opened)
    labels = F.array(*[F.lit(c) for c in CONN_TYPES])
    lasting = F.col("kind").isin("closed", "inbound_evicted")
    address = F.concat(
        F.lit("10."), (user % 4).cast("string"), F.lit(".0."), (user % 251).cast("string"),
        F.lit(":8333"),
    )
    base = events.select(
        F.col("event_id").alias("pos"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        user.alias("peer_id"),
        "event_type",
        k.alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        address.alias("address"),
        *keep,
    ).withColumns(
        {
            "event_group": F.when(message, "message").otherwise("connection"),
            "kind": kind.otherwise(ended),
        }
    )
    is_message = F.col("event_group") == "message"
    known = F.col("kind") != "misbehaving"
    return base.select(
        "pos",
        "ts_ms",
        "peer_id",
        category_of(F.col("event_group")).alias("category"),
        "event_group",
        "kind",
        label_of(F.col("event_group"), F.col("kind")).alias("label"),
        F.when(known, F.col("address")).alias("addr"),
        F.when(known, F.element_at(labels, (F.col("k") % 5 + 1).cast("int"))).alias("conn_type"),
        F.when(~is_message & known, F.lit(1)).alias("network"),
        # Never NULL for a message, so asking whether there is a direction needs no k.
        F.when(is_message, F.coalesce(F.col("k") % 2 == 0, F.lit(False))).alias("inbound"),
        F.when(is_message, F.col("cents")).alias("size"),
        F.when(lasting, F.expr("ts_ms div 1000") - F.col("k") * 60).alias("established_s"),
        F.when(F.col("kind").isin("inbound", "outbound"), F.col("k")).alias("existing_connections"),
        F.when(~known, F.concat(F.lit("k="), F.col("k").cast("string"))).alias("misbehaviour"),
        "k",
        *keep,
    )


def with_keys(messages: DataFrame) -> DataFrame:
    """Let messages name the tens of their k and, if it is odd, its ones; every third nothing."""
    name = lambda sort, number: F.encode(
        F.concat(F.lit(sort), F.lpad(number.cast("string"), 7, "0")), "utf-8"
    )
    tens, ones = name("t", F.expr("k div 10")), name("u", F.expr("k % 10"))
    none = F.array().cast("array<binary>")
    keys = F.when(F.expr("k % 3 = 0"), none).when(F.expr("k % 2 = 1"), F.array(tens, ones))
    return messages.withColumn("keys", keys.otherwise(F.array(tens)))


# A shipment's position is its day above its order and line number.
SHIP_DAY_BITS = 43


def race_from_shipments(lineitem: DataFrame) -> DataFrame:
    """Shipments as a relay race: parts are items, suppliers peers, returns deliveries."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    delivery = F.col("l_returnflag") == "R"
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
    quantity = F.col("l_quantity").cast("bigint")
    pos = F.shiftleft(day, SHIP_DAY_BITS) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    tie = (F.col("l_suppkey") * 4 + flag.otherwise(2)) * 1024 + quantity
    return lineitem.select(
        F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("peer_id"),
        epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        pos.alias("pos"),
        tie.alias("item_no"),
        delivery.alias("delivery"),
        F.when(delivery, quantity).alias("size"),
    )


def wire_from_shipments(lineitem: DataFrame) -> DataFrame:
    """Shipments as wire messages: an inventory of one item, or for returns the transaction.

    A part is known by two hashes, and every third part is announced by its second one.
    """
    race = race_from_shipments(lineitem)
    number = F.lpad(F.col("item").cast("string"), 40, "0")
    first, second = (F.encode(F.concat(F.lit(x), number), "utf-8") for x in "tw")
    by_second = F.col("item") % 3 == 0
    entry = F.struct(
        F.when(by_second, "wtx").otherwise("tx").alias("type"),
        F.when(by_second, second).otherwise(first).alias("hash"),
    )
    delivery = F.col("delivery")
    return race.select(
        "pos",
        "ts_ms",
        "peer_id",
        F.lit("message").alias("event_group"),
        F.when(delivery, "tx").otherwise("inv").alias("kind"),
        F.lit(True).alias("inbound"),
        F.when(~delivery, F.array(entry)).alias("items"),
        F.when(delivery, first).alias("txid"),
        F.when(delivery, second).alias("wtxid"),
        "size",
    )


def agents_from_customers(messages: DataFrame, customer: DataFrame) -> DataFrame:
    """Client names per peer, in the form ``peer_agents`` gives: the customer's segment."""
    named = customer.select(
        F.col("c_custkey").alias("peer_id"),
        F.col("c_mktsegment").alias("user_agent"),
        F.lit("version").alias("agent_source"),
    )
    return messages.select("peer_id").distinct().join(named, "peer_id")


def prefix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREFIXES, "prefix string, asn bigint")
