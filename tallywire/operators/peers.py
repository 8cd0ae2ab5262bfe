"""Per-peer statistics, client names, lifecycles and connection durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.buckets import log2_bucket
from tallywire.functions.labels import CONN_TYPES, share
from tallywire.functions.taxonomy import LIFECYCLE, is_lifecycle, is_message
from tallywire.operators.distribution import folded, tally, unfolded, with_percentiles
from tallywire.plans import skew

RECENT = 8

# Sort names of the peer page and the columns they stand for.
SORT_COLUMNS = {
    "id": "peer_id",
    "firstSeen": "first_seen",
    "lastSeen": "last_seen",
    "duration": "duration_ms",
    "messagesIn": "messages_in",
    "messagesOut": "messages_out",
    "bytesIn": "bytes_in",
    "bytesOut": "bytes_out",
    "events": "events",
}


def of_peers(df: DataFrame) -> DataFrame:
    """The events that belong to a peer."""
    return df.filter(is_message() | is_lifecycle())


def _identity() -> Column:
    """Whether an event tells a peer's address and connection type; misbehaving does not."""
    return F.col("kind") != "misbehaving"


def last_addresses(df: DataFrame) -> DataFrame:
    """(peer_id, addr) with the last known address of every peer that has one."""
    return (
        of_peers(df)
        .filter(_identity() & F.col("addr").isNotNull())
        .groupBy("peer_id", "addr")
        .agg(F.max("pos").alias("last_pos"))
        .groupBy("peer_id")
        .agg(F.max_by("addr", "last_pos").alias("addr"))
    )


def peer_table(df: DataFrame) -> DataFrame:
    """One row per peer."""
    return merged_peers(peer_parts(df))


def peer_parts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a peer table needs of events, per (peer, address) and ``by``.

    A peer is seen with few addresses, so events are reduced per (peer, address) first. That
    pass keeps fixed-width numbers only, which lets it aggregate in place, without sorting,
    and shrinks a busy peer before the shuffle. The last address is picked from what is left.
    """
    pos = F.col("pos")
    codes = F.create_map(*[F.lit(x) for n, c in enumerate(CONN_TYPES) for x in (c, n)])
    unknown = CONN_TYPES.index("unknown")
    conn_code = F.coalesce(codes[F.col("conn_type")], F.lit(unknown))
    typed = _identity() & F.col("conn_type").isNotNull()
    placed = is_lifecycle() & _identity() & F.col("network").isNotNull()
    inbound = is_message() & F.col("inbound")
    outbound = is_message() & ~F.col("inbound")
    counters = {
        "messages_in": F.count_if(inbound),
        "messages_out": F.count_if(outbound),
        "bytes_in": F.coalesce(F.sum(F.when(inbound, F.col("size"))), F.lit(0)),
        "bytes_out": F.coalesce(F.sum(F.when(outbound, F.col("size"))), F.lit(0)),
    }
    for kind in LIFECYCLE:
        counters[f"n_{kind}"] = F.count_if(is_lifecycle() & (F.col("kind") == kind))
    return (
        of_peers(df)
        .groupBy(*by, "peer_id", F.when(_identity(), F.col("addr")).alias("addr"))
        .agg(
            F.min("ts_ms").alias("first_seen"),
            F.max("ts_ms").alias("last_seen"),
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
            F.max(F.when(typed, pos)).alias("conn_pos"),
            F.max_by(conn_code, F.when(typed, pos)).alias("conn_code"),
            F.max(F.when(placed, pos)).alias("network_pos"),
            F.max_by("network", F.when(placed, pos)).alias("network"),
            *[c.alias(n) for n, c in counters.items()],
        )
    )


COUNTERS = ("messages_in", "messages_out", "bytes_in", "bytes_out", *[f"n_{k}" for k in LIFECYCLE])
POSITIONS = ("first_pos", "last_pos", "conn_pos", "network_pos")


def merged_peers(parts: DataFrame) -> DataFrame:
    """The peer table from parts of any stretches of the archive, each event in one of them."""
    labels = F.array(*[F.lit(c) for c in CONN_TYPES])
    lifecycle = sum((F.col(f"n_{k}") for k in LIFECYCLE[1:]), F.col(f"n_{LIFECYCLE[0]}"))
    return (
        parts.groupBy("peer_id")
        .agg(
            F.max_by("addr", F.when(F.col("addr").isNotNull(), F.col("last_pos"))).alias("addr"),
            F.max_by("conn_code", "conn_pos").alias("conn_code"),
            F.max_by("network", "network_pos").alias("network"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min("first_pos").alias("first_pos"),
            *[F.sum(n).alias(n) for n in COUNTERS],
        )
        .withColumns(
            {
                "conn_type": F.get(labels, F.col("conn_code")),
                "duration_ms": F.col("last_seen") - F.col("first_seen"),
                "lifecycle_events": lifecycle,
                "events": F.col("messages_in") + F.col("messages_out") + lifecycle,
            }
        )
        .drop("conn_code")
    )


def peers_page(
    peers: DataFrame, sort: str = "id", descending: bool = False, offset: int = 0, limit: int = 100
) -> DataFrame:
    """One page of the peer table; peers equal in the sort column come by rising id."""
    column = F.col(SORT_COLUMNS.get(sort, "peer_id"))
    ordered = column.desc() if descending else column.asc()
    return peers.orderBy(ordered, F.col("peer_id").asc()).offset(offset).limit(limit)


def command_mix(df: DataFrame, peer_id: int | None = None) -> DataFrame:
    """Messages and bytes per peer, command and direction."""
    messages = df.filter(is_message())
    if peer_id is not None:
        messages = messages.filter(F.col("peer_id") == peer_id)
    inbound = F.col("inbound")
    return (
        messages.groupBy("peer_id", F.col("kind").alias("command"))
        .agg(
            F.count_if(inbound).alias("inbound"),
            F.count_if(~inbound).alias("outbound"),
            F.coalesce(F.sum(F.when(inbound, F.col("size"))), F.lit(0)).alias("inbound_bytes"),
            F.coalesce(F.sum(F.when(~inbound, F.col("size"))), F.lit(0)).alias("outbound_bytes"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def lifecycle_counts(df: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in LIFECYCLE]
    return (
        df.filter(is_lifecycle())
        .groupBy("peer_id")
        .agg(*counts, F.count(F.lit(1)).alias("lifecycle_events"))
    )


def lifetime_ms() -> Column:
    """How long an ended connection lasted; an establishment in the future counts as 0."""
    ended = is_lifecycle() & F.col("kind").isin("closed", "inbound_evicted")
    return F.when(
        ended & F.col("established_s").isNotNull(),
        F.greatest(F.col("ts_ms") - F.col("established_s") * 1000, F.lit(0)),
    )


def with_lifetime(df: DataFrame) -> DataFrame:
    return df.withColumn("lifetime_ms", lifetime_ms())


def recent_lifecycle(df: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` lifecycle events of every peer.

    The rank filter is applied on both sides of the shuffle, so a peer sends at most ``n``
    rows per map task.
    """
    newest = Window.partitionBy("peer_id").orderBy(F.col("pos").desc())
    return (
        with_lifetime(df.filter(is_lifecycle()))
        .withColumn("newness", F.row_number().over(newest))
        .filter(F.col("newness") <= n)
        .select(
            "peer_id",
            "pos",
            "newness",
            "ts_ms",
            "kind",
            (F.col("established_s") * 1000).alias("established_at"),
            "lifetime_ms",
            "existing_connections",
            F.col("misbehaviour").alias("message"),
        )
    )


def peer_agents(df: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """What each peer calls itself, and which source said so.

    The first non-empty name of an inbound ``version`` message counts; without one, the first
    name in a poll made after the peer was first seen. A poll brings no new peers.
    """
    peers = peer_table(df) if peers is None else peers
    named = F.col("user_agent").isNotNull() & (F.col("user_agent") != "")
    versions = (
        df.filter(is_message() & F.col("inbound") & (F.col("kind") == "version") & named)
        .groupBy("peer_id", "user_agent")
        .agg(F.min("pos").alias("at"))
        .withColumn("polled", F.lit(1))
    )
    polls = (
        df.filter((F.col("event_group") == "rpc") & (F.col("kind") == "peer_infos"))
        .select("pos", F.explode("peer_infos").alias("info"))
        .select("pos", F.col("info.id").alias("peer_id"), F.col("info.subversion").alias("user_agent"))
        .filter(named)
    )
    polled = (
        skew.salted_join(polls, peers.select("peer_id", "first_pos"), ["peer_id"], "inner")
        .filter(F.col("pos") > F.col("first_pos"))
        .groupBy("peer_id", "user_agent")
        .agg(F.min("pos").alias("at"))
        .withColumn("polled", F.lit(2))
    )
    return (
        versions.unionByName(polled)
        .groupBy("peer_id")
        .agg(F.min(F.struct("polled", "at", "user_agent")).alias("best"))
        .select(
            "peer_id",
            F.col("best.user_agent").alias("user_agent"),
            F.when(F.col("best.polled") == 1, "version").otherwise("getpeerinfo").alias("agent_source"),
        )
    )


def with_agents(peers: DataFrame, agents: DataFrame) -> DataFrame:
    return peers.join(agents, "peer_id", "left")


def agent_census(peers: DataFrame, limit: int | None = None) -> DataFrame:
    """Peers per client name, commonest first, with their share of all peers."""
    counts = peers.groupBy("user_agent").agg(F.count(F.lit(1)).alias("peers"))
    total = counts.agg(F.sum("peers").alias("n")).scalar()
    rows = (
        counts.filter(F.col("user_agent").isNotNull())
        .withColumn("share", share(F.col("peers"), total))
        .orderBy(F.desc("peers"), "user_agent")
    )
    return rows if limit is None else rows.limit(limit)


def agent_totals(peers: DataFrame) -> DataFrame:
    """How many names there are, and how many peers have one."""
    counts = peers.groupBy("user_agent").agg(F.count(F.lit(1)).alias("n"))
    name = F.col("user_agent")
    return counts.agg(
        F.count("user_agent").alias("distinct_agents"),
        F.coalesce(F.sum(F.when(name.isNotNull(), F.col("n"))), F.lit(0)).alias("named"),
        F.coalesce(F.sum(F.when(name.isNull(), F.col("n"))), F.lit(0)).alias("unknown"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("peers"),
    )


def connection_durations(df: DataFrame, ending: str = "all") -> DataFrame:
    """How long connections lasted, per connection type and for one way of ending or both."""
    per_bucket = (
        _ended(df)
        .withColumn("ms", F.when(_chosen(ending), F.col("lifetime_ms")))
        .groupBy("conn_type", log2_bucket(F.col("lifetime_ms")).alias("bucket"))
        .agg(
            *[c.alias(n) for n, c in tally("ms").items()],
            F.count_if(~F.col("was_evicted")).alias("closed"),
            F.count_if("was_evicted").alias("evicted"),
        )
    )
    return _durations(per_bucket)


def _ended(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return (
        with_lifetime(df)
        .filter(F.col("lifetime_ms").isNotNull())
        .select(
            *keep,
            F.when(F.col("conn_type").isin(*CONN_TYPES), F.col("conn_type"))
            .otherwise("unknown")
            .alias("conn_type"),
            (F.col("kind") == "inbound_evicted").alias("was_evicted"),
            "lifetime_ms",
        )
    )


def _chosen(ending: str) -> Column:
    ways = {"closed": ~F.col("was_evicted"), "evicted": F.col("was_evicted")}
    return ways.get(ending, F.lit(True))


def duration_tallies(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bucket tallies of ended connections, per type, way of ending and ``by``."""
    bucket = log2_bucket(F.col("lifetime_ms")).alias("bucket")
    return (
        _ended(df, by)
        .groupBy(*by, "conn_type", "was_evicted", bucket)
        .agg(*[c.alias(n) for n, c in tally("lifetime_ms").items()])
    )


def merged_durations(tallies: DataFrame, ending: str = "all") -> DataFrame:
    """``connection_durations`` from tallies, of which a bucket may have several."""
    mine, gone = _chosen(ending), F.col("was_evicted")
    per_bucket = tallies.groupBy("conn_type", "bucket").agg(
        F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("n"),
        F.sum(F.when(mine, F.col("total"))).alias("total"),
        F.min(F.when(mine, F.col("low"))).alias("low"),
        F.max(F.when(mine, F.col("high"))).alias("high"),
        F.coalesce(F.sum(F.when(~gone, F.col("n"))), F.lit(0)).alias("closed"),
        F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("evicted"),
    )
    return _durations(per_bucket)


def _durations(per_bucket: DataFrame) -> DataFrame:
    folds = per_bucket.groupBy("conn_type").agg(
        *folded(), F.sum("closed").alias("closed"), F.sum("evicted").alias("evicted")
    )
    # A type with none of the chosen ending is left out.
    return with_percentiles(unfolded(folds.filter(F.col("count") > 0)))


def peer_detail(
    df: DataFrame, peer_id: int, agents: DataFrame | None = None, relay: DataFrame | None = None
) -> DataFrame:
    """Everything about one peer in one row; the peer filter reaches the scan.

    ``relay`` is a relay scorecard, which has to be computed over all peers.
    """
    mine = df.filter(F.col("peer_id") == peer_id)
    commands = command_mix(mine).groupBy("peer_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("total")).alias("rank"),
                    "command",
                    "inbound",
                    "outbound",
                    "inbound_bytes",
                    "outbound_bytes",
                    "total",
                )
            )
        ).alias("commands")
    )
    lifecycle = recent_lifecycle(mine).groupBy("peer_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "ts_ms", "kind", "established_at", "lifetime_ms",
                    "existing_connections", "message",
                )
            )
        ).alias("lifecycle")
    )
    out = peer_table(mine).join(commands, "peer_id", "left").join(lifecycle, "peer_id", "left")
    out = out.withColumn("commands", F.transform("commands", lambda c: c.dropFields("rank")))
    out = out.withColumn("lifecycle_cap", F.lit(RECENT))
    if agents is not None:
        out = out.join(agents.filter(F.col("peer_id") == peer_id), "peer_id", "left")
    if relay is not None:
        row = relay.filter(F.col("peer_id") == peer_id)
        fields = [c for c in row.columns if c != "peer_id"]
        packed = row.select("peer_id", F.struct(*fields).alias("relay"))
        out = out.join(packed, "peer_id", "left")
    return out
