"""What a message carried: a short text, and the keys it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inventory item types in the order they are listed.
ITEM_TYPES = [
    "tx", "wtx", "witness tx", "block", "witness block", "cmpctblock", "unknown", "malformed",
]
INVENTORY = ["inv", "getdata", "notfound"]
# Commands with a detail text, and commands that name keys.
DETAIL_COMMANDS = [
    *INVENTORY, "addr", "addrv2", "headers", "cmpctblock", "getblocktxn", "blocktxn",
]
KEY_COMMANDS = [
    *INVENTORY, "tx", "block", "merkleblock", "cmpctblock", "getblocktxn", "blocktxn",
    "ping", "pong",
]
TRANSACTION_ITEMS = ["tx", "wtx", "witness tx"]
MIN_HASH = 8  # shorter byte strings are not hashes


def has_detail(command: Column) -> Column:
    return command.isin(*DETAIL_COMMANDS)


def has_keys(command: Column) -> Column:
    return command.isin(*KEY_COMMANDS)


def _item_type(item: Column) -> Column:
    named = item["type"].isin(*ITEM_TYPES)
    return F.when(named, item["type"]).otherwise("malformed")


def _times(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f"x {noun}"))


def inventory_text(items: Column) -> Column:
    def counted(name: str) -> Column:
        n = F.size(F.filter(items, lambda i: _item_type(i) == name))
        return F.when(n > 0, _times(n, name))

    parts = F.array_compact(F.array(*[counted(t) for t in ITEM_TYPES]))
    return F.when(F.size(parts) == 0, "empty").otherwise(F.concat_ws(", ", parts))


def detail_text() -> Column:
    """Counts of what a message carried; NULL where the size says it all or no body is there."""
    command = F.col("kind")

    def body(name: str, n: str, noun: str):
        return (command == name) & F.col(n).isNotNull(), _times(F.col(n), noun)

    text = F.when(
        command.isin(*INVENTORY) & F.col("items").isNotNull(), inventory_text(F.col("items"))
    )
    for name, n, noun in [
        ("addr", "n_addresses", "address"),
        ("addrv2", "n_addresses", "address"),
        ("headers", "n_headers", "header"),
        ("getblocktxn", "n_indexes", "index"),
        ("blocktxn", "n_txs", "transaction"),
    ]:
        text = text.when(*body(name, n, noun))
    compact = F.concat_ws(
        ", ", _times(F.col("n_short_ids"), "short id"), _times(F.col("n_txs"), "prefilled")
    )
    text = text.when(
        (command == "cmpctblock") & F.col("n_short_ids").isNotNull() & F.col("n_txs").isNotNull(),
        compact,
    )
    return F.when(F.col("event_group") == "message", text)


def named_keys() -> Column:
    """Sorted, distinct keys a message names; an empty array where it names none.

    The type of an item plays no part, and items that could not be read name nothing.
    """
    command = F.col("kind")
    none = F.array().cast("array<binary>")
    readable = F.filter("items", lambda i: _item_type(i) != "malformed")
    from_items = F.transform(readable, lambda i: i["hash"])
    raw = (
        F.when(command.isin(*INVENTORY), from_items)
        .when(command == "tx", F.array("txid", "wtxid"))
        .when(
            command.isin("block", "merkleblock", "cmpctblock", "getblocktxn", "blocktxn"),
            F.array("block_hash"),
        )
        .when(command.isin("ping", "pong"), F.array("nonce"))
    )
    whole = F.filter(raw, lambda k: F.length(k) >= MIN_HASH)
    keys = F.array_sort(F.array_distinct(whole))
    return F.when(F.col("event_group") == "message", F.coalesce(keys, none)).otherwise(none)


def carried_detail(df: DataFrame) -> DataFrame:
    return df.withColumn("detail", detail_text())


def carried_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("keys", named_keys())
