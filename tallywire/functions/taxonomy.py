"""Category, group, kind and label of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"

# The groups in display order, with the category each belongs to.
GROUP_CATEGORY = {
    "message": "ebpf",
    "connection": "ebpf",
    "mempool": "ebpf",
    "validation": "ebpf",
    "rpc": "rpc",
    "p2p": "p2p",
    "log": "log",
    "ipc": "ipc",
}
GROUPS = tuple(GROUP_CATEGORY)

# The sub-arms known in each group other than messages.
KNOWN_SUBS = {
    "connection": ["closed", "inbound_evicted", "inbound", "outbound", "misbehaving"],
    "mempool": ["added", "replaced", "removed", "rejected"],
    "validation": ["block_connected"],
    "rpc": [
        "peer_infos", "mempool_info", "uptime", "net_totals", "memory_info", "addrman_info",
        "chain_tx_stats", "network_info", "blockchain_info", "orphan_txs", "addrman",
        "estimate_smart_fee",
    ],
    "p2p": [
        "ping_duration", "address_announcement", "inventory_announcement",
        "feefilter_announcement",
    ],
    "log": [
        "unknown_log_message", "block_connected", "block_checked", "saw_new_header",
        "compact_block_reconstructed",
    ],
    "ipc": ["block_tip"],
}

# The connection lifecycle kinds, in the order counters are reported.
LIFECYCLE = ("inbound", "outbound", "closed", "inbound_evicted", "misbehaving")


def category_of(group: Column) -> Column:
    pairs = [F.lit(x) for pair in GROUP_CATEGORY.items() for x in pair]
    return F.create_map(*pairs)[group]


def label_of(group: Column, kind: Column) -> Column:
    return F.when(group == "message", kind).otherwise(F.concat_ws(" ", group, kind))


def classify(df: DataFrame) -> DataFrame:
    """Add category, event_group, kind and label; keep direction and size to messages.

    A message is known by its wire command, whatever that is. Every other event is known by
    its sub-arm, or as ``(unknown)`` where that is missing or new.
    """
    arm = F.col("arm")
    bare = F.regexp_replace(arm, r"^ebpf\.", "")
    group = F.when(bare.isin(*GROUPS), bare).otherwise("message")
    known = F.lit(False)
    for name, subs in KNOWN_SUBS.items():
        known = known | ((F.col("event_group") == name) & F.col("sub").isin(*subs))
    is_message = arm == "ebpf.message"
    kind = (
        F.when(is_message, F.coalesce("command", F.lit(UNKNOWN)))
        .when(F.col("event_group") == "message", F.lit(UNKNOWN))
        .otherwise(F.when(known, F.col("sub")).otherwise(UNKNOWN))
    )
    return (
        df.withColumn("event_group", F.coalesce(group, F.lit("message")))
        .withColumns({"category": category_of(F.col("event_group")), "kind": kind})
        .withColumns(
            {
                "label": label_of(F.col("event_group"), F.col("kind")),
                "inbound": F.when(is_message, F.col("inbound")),
            }
        )
    )


def is_message() -> Column:
    """A directed message of a peer."""
    return (
        (F.col("event_group") == "message")
        & F.col("inbound").isNotNull()
        & F.col("peer_id").isNotNull()
    )


def is_lifecycle() -> Column:
    """A connection event of a peer."""
    return (
        (F.col("event_group") == "connection")
        & F.col("kind").isin(*LIFECYCLE)
        & F.col("peer_id").isNotNull()
    )


def row_size() -> Column:
    """The size an event row shows."""
    return F.when(is_message(), F.coalesce("size", F.lit(0))).otherwise(F.lit(0))
