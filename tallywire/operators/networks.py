"""Grouping peers by the network (autonomous system) their address belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.address import ip_hex, last_address, mask, peer_ip
from tallywire.functions.labels import ratio
from tallywire.functions.taxonomy import LIFECYCLE
from tallywire.plans import skew

# Labels of the networks that are no autonomous system, in listing order.
UNMAPPED, ANONYMISING, UNKNOWN = "unmapped IP", "Tor / I2P / CJDNS", "address not seen"
RANK = {"": 0, UNMAPPED: 1, ANONYMISING: 2, UNKNOWN: 3}


# Looking an address up looks at no more than the points of its cell, so many hex digits wide.
CELL_V4, CELL_V6 = 4, 8
BEGIN, ROW, END = 0, 1, 2  # what lies at an address, in the order in which it counts there


def prefix_keys(prefixes: DataFrame) -> DataFrame:
    """Network prefixes as (family, bits, masked address, asn); what is no prefix is left out."""
    digits = ip_hex(F.substring_index("prefix", "/", 1))
    bits = F.substring_index("prefix", "/", -1).try_cast("int")
    found = prefixes.select(digits.alias("digits"), bits.alias("bits"), "asn")
    family = F.length("digits")
    sound = found.filter(family.isNotNull() & F.col("bits").between(0, 4 * family))
    net = mask(F.col("digits"), F.col("bits"))
    return sound.select(family.alias("family"), "bits", net.alias("net"), "asn")


def _cell(digits: Column) -> Column:
    return F.substring(digits, F.lit(1), F.when(F.length(digits) == 8, CELL_V4).otherwise(CELL_V6))


def segments(nets: DataFrame, cells: DataFrame) -> DataFrame:
    """Nested prefixes as points (cell, at, side, asn) between which one number holds.

    Prefixes are nested or apart, so what holds changes where one begins and behind the last
    address of one, and there to the longest of those that go on; of rows that repeat a prefix
    the largest number counts. ``cells`` get a point at their first address, so that every cell
    stands for itself. Points, and not addresses, are looked up once per prefix length: their
    number follows the prefixes.
    """
    family = F.col("family")
    end = last_address(F.col("net"), F.col("bits"), family)
    edges = nets.select(
        "family",
        F.explode(
            F.array(
                F.struct(F.rpad("net", family, "0").alias("at"), F.lit(BEGIN).alias("side")),
                F.struct(end.alias("at"), F.lit(END).alias("side")),
            )
        ).alias("edge"),
    ).select("family", "edge.at", "edge.side")
    wide = F.when(F.length("cell") == CELL_V4, 8).otherwise(32)
    starts = cells.select(wide.alias("family"), F.rpad("cell", wide, "0").alias("at"), F.lit(BEGIN).alias("side"))
    lengths = nets.agg(F.collect_set(F.struct("family", "bits"))).scalar()  # 162 exist
    # The whole address is tried, too, so that a point that nothing covers stays.
    whole = F.array(F.struct(family, (family * 4).alias("bits")))
    tries = (
        edges.unionByName(starts)
        .withColumn("lengths", F.coalesce(lengths, F.array().cast("array<struct<family:int,bits:int>>")))
        .select("family", "at", "side", F.explode(F.array_union("lengths", whole)).alias("try"))
        .filter(family == F.col("try.family"))
        .select("family", "at", "side", "try.bits")
        .withColumn("net", mask(F.col("at"), F.col("bits")))
    )
    goes_on = F.col("found") & ((F.col("side") == BEGIN) | (F.col("at") != end))
    longest = F.max(F.when(goes_on, F.struct("bits", "asn")))
    return (
        tries.join(nets.withColumn("found", F.lit(True)), ["family", "bits", "net"], "left")
        .groupBy("at", "side")
        .agg(longest["asn"].alias("asn"))
        .select(_cell(F.col("at")).alias("cell"), "at", "side", "asn")
    )


def with_network(
    peers: DataFrame,
    prefixes: DataFrame,
    hot_rows: int = skew.HOT_ROWS,
    salts: int = 256,
    id_col: str = "peer_id",
) -> DataFrame:
    """Add ``asn`` and ``network_label`` (empty for an autonomous system) to a peer table.

    An interval join: peers are sorted among the points of their cell and take the number of the
    last point before them. One row per peer is shuffled, once. Rows of a cell with more than
    ``hot_rows`` of them are dealt over ``salts`` tasks, with its points in each.
    """
    rows = peers.select(F.struct("*").alias("peer"), peer_ip(F.col("addr")).alias("at"))
    # What has no address needs no point, and lies where its id says.
    apart = F.concat(F.lit("no "), F.xxhash64(f"peer.{id_col}").cast("string"))
    rows = rows.withColumn("cell", F.coalesce(_cell(F.col("at")), apart))
    counts = rows.filter("at is not null").groupBy("cell").count()
    # At most one number for each hot_rows rows.
    hot = counts.filter(F.col("count") > hot_rows).agg(F.collect_set("cell")).scalar()
    is_hot = F.array_contains(hot, F.col("cell"))
    salt = F.pmod(F.xxhash64(f"peer.{id_col}"), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    points = segments(prefix_keys(prefixes), counts).select(
        F.lit(None).alias("peer"),
        "at",
        "cell",
        "side",
        F.struct("asn").alias("told"),
        F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    told = rows.select(
        "peer",
        "at",
        "cell",
        F.lit(ROW).alias("side"),
        F.lit(None).alias("told"),
        F.when(is_hot, salt).otherwise(F.lit(0)).alias("salt"),
    )
    line = Window.partitionBy("cell", "salt").orderBy("at", "side")
    line = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asn = F.last("told", ignorenulls=True).over(line)["asn"]
    found = told.unionByName(points).withColumn("asn", F.when(asn != 0, asn))
    label = (
        F.when(F.col("peer.addr").isNull(), UNKNOWN)
        .when(F.col("at").isNull(), ANONYMISING)
        .when(F.col("asn").isNull(), UNMAPPED)
        .otherwise("")
    )
    return found.filter(F.col("side") == ROW).select(
        "peer.*", "asn", label.alias("network_label")
    )


def networks(placed: DataFrame) -> DataFrame:
    """One row per network over peers that have one; most peers first."""
    sums = ["messages_in", "messages_out", "bytes_in", "bytes_out", *[f"n_{k}" for k in LIFECYCLE]]
    grouped = placed.groupBy("asn", "network_label").agg(
        F.count(F.lit(1)).alias("peers"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("events").alias("events"),
    )
    return grouped.withColumn(
        "eviction_ratio", ratio(F.col("n_inbound_evicted"), F.col("n_inbound"))
    )


def _rank() -> Column:
    pairs = [F.lit(x) for pair in RANK.items() for x in pair]
    return F.create_map(*pairs)[F.col("network_label")]


def networks_page(nets: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return (
        nets.orderBy(F.desc("peers"), _rank(), F.col("asn").asc()).offset(offset).limit(limit)
    )


def networks_total(nets: DataFrame) -> DataFrame:
    return nets.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("peers"), F.lit(0)).alias("peers_covered")
    )


def network_peers(
    placed: DataFrame, asn: int | None = None, label: str = "", limit: int = 100
) -> DataFrame:
    """The peers of one network, busiest first."""
    if asn is not None:
        mine = placed.filter(F.col("asn") == asn)
    else:
        wanted = label if label in (UNMAPPED, ANONYMISING) else UNKNOWN
        mine = placed.filter(F.col("network_label") == wanted)
    return mine.orderBy(F.desc("events"), F.col("peer_id").asc()).limit(limit)


def with_as_names(nets: DataFrame, as_names: DataFrame) -> DataFrame:
    """Add handle, description and country; NULL for networks without a name."""
    return nets.join(as_names, "asn", "left")
