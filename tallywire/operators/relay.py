"""The relay race: who announced each item first, and what duplicate deliveries cost.

Only messages that came in count. An item's rows are ordered by (pos, item_no), the place of
the message in the archive and the place of the item in the message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.buckets import log2_bucket
from tallywire.functions.labels import ratio
from tallywire.functions.payload import MIN_HASH, TRANSACTION_ITEMS
from tallywire.functions.taxonomy import is_message
from tallywire.operators.distribution import (
    folded,
    merge_tallies,
    percentile,
    tally,
    unfolded,
    with_percentiles,
)
from tallywire.plans import skew

ORDER = ["pos", "item_no"]

def announcements(df: DataFrame) -> DataFrame:
    """One row per transaction announced by an incoming inventory message."""
    return (
        df.filter(is_message() & F.col("inbound") & (F.col("kind") == "inv"))
        .select("pos", "ts_ms", "peer_id", F.posexplode("items").alias("item_no", "entry"))
        .filter(F.col("entry.type").isin(*TRANSACTION_ITEMS))
        .filter(F.length("entry.hash") >= MIN_HASH)
        .select("pos", F.col("item_no").cast("bigint"), "ts_ms", "peer_id", F.col("entry.hash").alias("item"))
    )


def transaction_deliveries(df: DataFrame) -> DataFrame:
    """Incoming transactions; those without a hash say nothing and are left out."""
    wtxid = F.when(F.length("wtxid") >= MIN_HASH, F.col("wtxid"))
    return df.filter(
        is_message() & F.col("inbound") & (F.col("kind") == "tx") & (F.length("txid") >= MIN_HASH)
    ).select(
        "pos",
        F.lit(0).cast("bigint").alias("item_no"),
        "ts_ms",
        "peer_id",
        "txid",
        wtxid.alias("wtxid"),
        "size",
    )


def with_item(
    delivered: DataFrame, announced: DataFrame, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """Decide which of its two hashes a delivery counts under, as ``item``.

    The txid if that is known by then, else the wtxid if that is, else the txid. A hash is
    known from its first announcement on, and a txid also from a delivery that was put under
    it. Everything is found per transaction, one row each, and then joined back.
    """
    known = announced.groupBy("item").agg(F.min("pos").alias("at"))
    by_txid = known.select(F.col("item").alias("txid"), F.col("at").alias("txid_at"))
    by_wtxid = known.select(F.col("item").alias("wtxid"), F.col("at").alias("wtxid_at"))
    transactions = (
        delivered.groupBy("txid", "wtxid")
        .agg(F.min("pos").alias("delivered_at"))
        .join(by_txid, "txid", "left")
    )
    # Transactions without a second hash go around its join, where they would be one key.
    with_second = transactions.filter(F.col("wtxid").isNotNull()).join(by_wtxid, "wtxid", "left")
    transactions = transactions.filter(F.col("wtxid").isNull()).unionByName(
        with_second, allowMissingColumns=True
    )
    # The first delivery opened an entry under the txid unless a hash was known before it.
    unknown = ~(
        F.coalesce(F.col("txid_at") < F.col("delivered_at"), F.lit(False))
        | F.coalesce(F.col("wtxid_at") < F.col("delivered_at"), F.lit(False))
    )
    entered = F.least("txid_at", F.when(unknown, F.col("delivered_at")))
    facts = transactions.select(
        "txid", F.coalesce("wtxid", F.lit(b"")).alias("_w"), entered.alias("entered"), "wtxid_at"
    )
    keyed = delivered.withColumn("_w", F.coalesce("wtxid", F.lit(b"")))
    joined = skew.salted_join(keyed, facts, ["txid", "_w"], "left", hot_rows=hot_rows)
    under_txid = F.coalesce(F.col("entered") < F.col("pos"), F.lit(False))
    under_wtxid = F.coalesce(F.col("wtxid_at") < F.col("pos"), F.lit(False))
    item = F.when(~under_txid & under_wtxid, F.col("wtxid")).otherwise(F.col("txid"))
    return joined.withColumn("item", item).drop("_w", "entered", "wtxid_at")


def relay_rows(announced: DataFrame, delivered: DataFrame) -> DataFrame:
    """Announcements and deliveries of items as one table."""
    base = ["item", "peer_id", "ts_ms", *ORDER]
    a = announced.select(
        *base, F.lit(False).alias("delivery"), F.lit(None).cast("bigint").alias("size")
    )
    return a.unionByName(delivered.select(*base, F.lit(True).alias("delivery"), "size"))


def relay_events(df: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """The relay rows of a table of wire events."""
    announced = announcements(df)
    return relay_rows(announced, with_item(transaction_deliveries(df), announced, hot_rows))


def race_of_events(
    df: DataFrame, hot_rows: int = skew.HOT_ROWS, bits: int = skew.SPLIT_BITS
) -> DataFrame:
    """The race of a table of wire events.

    Busy items are looked for among the hashes as they stand in the messages, which saves
    settling the deliveries' hashes twice.
    """
    delivered = transaction_deliveries(df)
    hashes = announcements(df).select("item")
    for name in ("txid", "wtxid"):
        hashes = hashes.union(delivered.select(name))
    return relay_race(relay_events(df, hot_rows), hot_rows, bits, counted=hashes)


def relay_race(
    rows: DataFrame,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Every relay row with its outcome; ``counted`` holds items to find busy ones among.

    ``first``: the announcement that made the item known. ``late``: any other announcement,
    ``lag_ms`` behind the item's first row. ``duplicate``: a delivery after another one.
    ``held_ms``: for the first delivery of an announced item, how long after its first row.
    """
    rows, split = skew.with_split(
        rows, ["item"], hot_rows=hot_rows, bits=bits, counted=counted
    )
    in_split = Window.partitionBy("item", "split").orderBy(*ORDER)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, -1)
    delivery = F.col("delivery")
    zero = F.lit(0).cast("bigint")
    counted = rows.withColumns(
        {
            "first_ts": F.first("ts_ms").over(in_split),
            "d": F.coalesce(F.count_if(delivery).over(so_far), zero),
            "a": F.coalesce(F.count_if(~delivery).over(so_far), zero),
        }
    )
    if split:
        before = skew.before(["item"])
        # Only split items get here, so ordering by a struct is no burden.
        states = skew.carry_states(
            rows,
            ["item"],
            [
                F.min_by("ts_ms", F.struct(*ORDER)).alias("ts"),
                F.count_if(delivery).alias("n_d"),
                F.count_if(~delivery).alias("n_a"),
            ],
            {
                "ts_before": F.first("ts").over(before),
                "d_before": F.sum("n_d").over(before),
                "a_before": F.sum("n_a").over(before),
            },
        )
        counted = counted.join(states, ["item", "split"], "left").withColumns(
            {
                "first_ts": F.coalesce("ts_before", "first_ts"),
                "d": F.col("d") + F.coalesce("d_before", zero),
                "a": F.col("a") + F.coalesce("a_before", zero),
            }
        )
    deliveries, announced = F.col("d"), F.col("a")
    since = F.greatest(F.col("ts_ms") - F.col("first_ts"), zero)
    opens = (deliveries + announced) == 0
    return counted.select(
        "item",
        "peer_id",
        "ts_ms",
        *ORDER,
        "delivery",
        "size",
        (~delivery & opens).alias("first"),
        (~delivery & ~opens).alias("late"),
        F.when(~delivery & ~opens, since).alias("lag_ms"),
        (delivery & (deliveries > 0)).alias("duplicate"),
        F.when(delivery & (deliveries == 0) & (announced > 0), since).alias("held_ms"),
    )


def announcement_race(race: DataFrame) -> DataFrame:
    """The announcements alone, first and late."""
    return race.filter(~F.col("delivery")).select(
        "item", "peer_id", "ts_ms", *ORDER, "first", "late", "lag_ms"
    )


def delivery_waste(race: DataFrame) -> DataFrame:
    """The deliveries alone, with what was wasted on items already held."""
    wasted = F.when(F.col("duplicate"), F.col("size")).otherwise(F.lit(0))
    return race.filter("delivery").select(
        "item", "peer_id", "ts_ms", *ORDER, "size", "duplicate", wasted.alias("wasted"), "held_ms"
    )


def relay_tallies(race: DataFrame) -> DataFrame:
    """The race reduced to one row per peer, measure and duration bucket.

    The scorecard, the totals and the distributions all come from these few rows, so the
    race is computed once for each of them and a busy peer shrinks before it is shuffled.
    """
    measure = F.when(F.col("late"), "lag").when(F.col("held_ms").isNotNull(), "held")
    unheralded = F.col("delivery") & ~F.col("duplicate") & F.col("held_ms").isNull()
    sums = {
        "first": F.count_if("first"),
        "late": F.count_if("late"),
        "delivered": F.count_if("delivery"),
        "duplicate": F.count_if("duplicate"),
        "unheralded": F.count_if(unheralded),
        "delivered_bytes": F.coalesce(F.sum(F.when(F.col("delivery"), F.col("size"))), F.lit(0)),
        "duplicate_bytes": F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("size"))), F.lit(0)),
    }
    samples = race.withColumns({"measure": measure, "ms": F.coalesce("lag_ms", "held_ms")})
    return samples.groupBy("peer_id", "measure", log2_bucket(F.col("ms")).alias("bucket")).agg(
        *[c.alias(n) for n, c in {**sums, **tally("ms")}.items()]
    )


def relay_scorecard(tallies: DataFrame) -> DataFrame:
    """One row per peer with any relay record: wins, lags, deliveries and waste."""
    summed = ["first", "late", "delivered", "duplicate", "duplicate_bytes"]
    out = tallies.groupBy("peer_id").agg(
        *[F.sum(c).alias(c) for c in summed],
        *folded(F.col("measure") == "lag", "lag_"),
        *folded(F.col("measure") == "held", "held_"),
    )
    return unfolded(out, "lag_", "held_").select(
        "peer_id",
        "first",
        "late",
        ratio(F.col("first"), F.col("first") + F.col("late")).alias("win_ratio"),
        percentile(0.5, "lag_").alias("lag_p50_ms"),
        percentile(0.9, "lag_").alias("lag_p90_ms"),
        "delivered",
        "duplicate",
        "duplicate_bytes",
        percentile(0.5, "held_").alias("held_p50_ms"),
    )


def sorted_scorecard(
    card: DataFrame, sort: str = "first", descending: bool = True, limit: int | None = None
) -> DataFrame:
    """The scorecard by one column; equal peers by id, rising when the column falls."""
    key = {
        "late": F.col("late"),
        "win": F.coalesce("win_ratio", F.lit(-1.0)),
        "lag": F.coalesce("lag_p50_ms", F.lit(0)),
        "delivered": F.col("delivered"),
        "duplicate": F.col("duplicate"),
        "duplicateBytes": F.col("duplicate_bytes"),
    }.get(sort, F.col("first"))
    peer = F.col("peer_id")
    order = [key.desc(), peer.asc()] if descending else [key.asc(), peer.desc()]
    out = card.orderBy(*order)
    return out if limit is None else out.limit(limit)


def with_peer_identity(card: DataFrame, peers: DataFrame) -> DataFrame:
    return card.join(peers.select("peer_id", "addr", "conn_type"), "peer_id", "left")


def relay_totals(tallies: DataFrame) -> DataFrame:
    """One row over the whole archive.

    Every item has exactly one row that nothing precedes, so the number of items is the
    number of first announcements and of deliveries of items neither announced nor held.
    """
    sums = tallies.agg(
        F.coalesce(F.sum(F.col("first") + F.col("unheralded")), F.lit(0)).alias("items"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(n)
            for n, c in {
                "announcements": F.col("first") + F.col("late"),
                "first_announcers": F.col("first"),
                "late_announcements": F.col("late"),
                "deliveries": F.col("delivered"),
                "duplicate_deliveries": F.col("duplicate"),
                "delivered_bytes": F.col("delivered_bytes"),
                "duplicate_bytes": F.col("duplicate_bytes"),
            }.items()
        ],
    )
    useful = F.col("deliveries") - F.col("duplicate_deliveries")
    return sums.withColumns(
        {
            "wasted_share": ratio(F.col("duplicate_bytes"), F.col("delivered_bytes")),
            "duplicate_factor": ratio(F.col("deliveries"), useful),
        }
    )


def relay_distributions(tallies: DataFrame) -> DataFrame:
    """The lags and the heard-to-held times of the whole archive, one row each."""
    name = F.when(F.col("measure") == "held", "heard_to_held").otherwise(F.col("measure"))
    named = tallies.filter(F.col("measure").isNotNull()).withColumn("measure", name)
    merged = merge_tallies(named, ["measure"]).groupBy("measure").agg(*folded())
    return with_percentiles(unfolded(merged))
