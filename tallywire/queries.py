"""Every operator as a runnable query over the given tables.

``queries()`` maps a name to ``f(spark, folder) -> DataFrame``. The matching SQL is in
``oracles.py``. Lists leave as text, so that both engines show them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.buckets import bucket_edges, log2_bucket
from tallywire.functions.jsonview import event_json
from tallywire.functions.labels import conn_type_name, network_name, share
from tallywire.functions.payload import ITEM_TYPES, carried_detail, carried_keys
from tallywire.functions.taxonomy import classify
from tallywire.operators import networks as net
from tallywire.operators import pairing, peers, raster, relay, search, timeline
from tallywire.operators.distribution import (
    distribution,
    exact_percentiles,
    merge_distributions,
    with_percentiles,
)
from tallywire.operators.keyed import conversation, pair_by_key
from tallywire.operators.rules import Rule
from tallywire.plans.sizes import settled
from tallywire.session import shared_folder
from tallywire.sources import adapters as adapt
from tallywire.sources import archive as source
from tallywire.sources.tallies import TallyStore
from tallywire.streaming import queries as streams

DAY = 86_400_000
PEER = 8  # the peer of the one-peer questions
FIRST_DAY = 1_704_067_200_000  # 2024-01-01


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return adapt.messages_from_activity(table(spark, folder, "events"))


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    return adapt.race_from_shipments(table(spark, folder, "lineitem"))


def _text(name: str, sep: str = ",") -> Column:
    return F.array_join(F.transform(name, lambda x: x.cast("string")), sep).alias(name)


def _with_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _text(n) for n in names})


# --- totals and time ---


def q_totals(spark, folder):
    return timeline.totals(messages(spark, folder))


def q_breakdown(spark, folder):
    return timeline.breakdown(messages(spark, folder))


def q_category_rollup(spark, folder):
    return timeline.category_rollup(messages(spark, folder))


def q_groups_present(spark, folder):
    return timeline.groups_present(messages(spark, folder))


def q_timeline_kind(spark, folder):
    return timeline.timeline(messages(spark, folder))


def q_timeline_downsampled(spark, folder):
    m = messages(spark, folder)
    return timeline.downsample(timeline.timeline(m), timeline.grid(m), 97, ["event_group", "kind"])


def q_timeline_groups(spark, folder):
    return timeline.timeline_groups(messages(spark, folder), 120)


def _many_kinds(m: DataFrame) -> DataFrame:
    return m.withColumn("kind", F.concat_ws("_", "kind", (F.col("k") % 6).cast("string")))


def q_timeline_group(spark, folder):
    return timeline.timeline_group(_many_kinds(messages(spark, folder)), "message", 50)


# --- distributions ---


def _lifetimes(spark, folder) -> DataFrame:
    return peers.with_lifetime(messages(spark, folder))


def q_lifetime_distribution(spark, folder):
    dist = distribution(_lifetimes(spark, folder), ["peer_id"], "lifetime_ms")
    return _with_text(with_percentiles(dist), "buckets")


def q_lifetime_buckets(spark, folder):
    held = (
        _lifetimes(spark, folder)
        .filter("lifetime_ms is not null")
        .groupBy("kind", log2_bucket(F.col("lifetime_ms")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return held.join(F.broadcast(bucket_edges(spark)), "bucket")  # 32 rows


def q_merged_distribution(spark, folder):
    per_peer = distribution(_lifetimes(spark, folder), ["peer_id", "kind"], "lifetime_ms")
    return _with_text(with_percentiles(merge_distributions(per_peer, ["kind"])), "buckets")


def q_exact_percentiles(spark, folder):
    return exact_percentiles(_lifetimes(spark, folder), ["kind"], "lifetime_ms")


# --- peers ---


def _peers(spark, folder) -> DataFrame:
    return peers.peer_table(messages(spark, folder))


def q_peer_table(spark, folder):
    return _peers(spark, folder)


PAGE_COLUMNS = [
    "peer_id", "addr", "conn_type", "first_seen", "last_seen", "duration_ms", "messages_in",
    "messages_out", "bytes_in", "bytes_out", "events", "lifecycle_events",
]


def q_peers_page(spark, folder):
    return peers.peers_page(_peers(spark, folder), "bytesIn", True, 5, 20).select(*PAGE_COLUMNS)


def q_command_mix(spark, folder):
    return peers.command_mix(messages(spark, folder))


def q_lifecycle_counts(spark, folder):
    return peers.lifecycle_counts(messages(spark, folder))


def q_recent_lifecycle(spark, folder):
    return peers.recent_lifecycle(messages(spark, folder))


def q_connection_durations(spark, folder):
    return _with_text(peers.connection_durations(messages(spark, folder)), "buckets")


def q_connection_durations_evicted(spark, folder):
    return _with_text(peers.connection_durations(messages(spark, folder), "evicted"), "buckets")


def _agents(spark, folder) -> DataFrame:
    return adapt.agents_from_customers(messages(spark, folder), table(spark, folder, "customer"))


def q_agent_census(spark, folder):
    named = peers.with_agents(_peers(spark, folder), _agents(spark, folder))
    return peers.agent_census(named)


def q_agent_totals(spark, folder):
    return peers.agent_totals(peers.with_agents(_peers(spark, folder), _agents(spark, folder)))


def _greetings(spark, folder) -> DataFrame:
    """Views as version messages, and errors as polls that list the acting user."""
    m = messages(spark, folder)
    name = F.concat(F.lit("/agent:"), (F.col("k") % 4).cast("string"), F.lit("/"))
    silent = F.when(F.col("k") % 4 == 3, "").otherwise(name)
    poll = F.col("event_group") == "connection"
    info = F.array(F.struct(F.col("peer_id").alias("id"), silent.alias("subversion")))
    return m.withColumns(
        {
            "user_agent": F.when(F.col("kind") == "view", silent),
            "peer_infos": F.when(poll & (F.col("k") % 3 == 0), info),
        }
    ).withColumns(
        {
            "event_group": F.when(F.col("peer_infos").isNotNull(), "rpc").otherwise(F.col("event_group")),
            "kind": F.when(F.col("peer_infos").isNotNull(), "peer_infos")
            .when((F.col("kind") == "view") & (F.col("k") < 20), "version")
            .otherwise(F.col("kind")),
            "peer_id": F.when(F.col("peer_infos").isNull(), F.col("peer_id")),
        }
    )


def q_peer_agents(spark, folder):
    return peers.peer_agents(_greetings(spark, folder))


def q_peer_detail(spark, folder):
    m = messages(spark, folder)
    card = relay.relay_scorecard(relay.relay_tallies(relay.relay_race(shipments(spark, folder))))
    one = peers.peer_detail(m, PEER, _agents(spark, folder), card)
    commands = F.transform(
        "commands",
        lambda c: F.concat_ws(
            ":", c["command"], c["inbound"].cast("string"), c["outbound"].cast("string"),
            c["inbound_bytes"].cast("string"), c["outbound_bytes"].cast("string"),
        ),
    )
    lifecycle = F.transform(
        "lifecycle",
        lambda e: F.concat_ws(
            ":", e["ts_ms"].cast("string"), e["kind"],
            F.coalesce(e["lifetime_ms"].cast("string"), F.lit("-")),
        ),
    )
    return one.select(
        *PAGE_COLUMNS,
        "user_agent",
        "agent_source",
        F.array_join(commands, ",").alias("commands"),
        F.array_join(lifecycle, ",").alias("lifecycle"),
        "lifecycle_cap",
        F.col("relay.first").alias("relay_first"),
        F.col("relay.late").alias("relay_late"),
        F.col("relay.duplicate_bytes").alias("relay_duplicate_bytes"),
    )


# --- search ---


def q_event_search(spark, folder):
    m = messages(spark, folder)
    return search.search_events(
        m, kinds=["view"], groups=["connection"],
        time_from=FIRST_DAY + DAY, time_to=FIRST_DAY + 9 * DAY,
    )


def q_event_search_text(spark, folder):
    return search.search_events(messages(spark, folder), text="2.0.1")


def q_event_rows(spark, folder):
    m = messages(spark, folder)
    return search.event_rows(m, peers.last_addresses(m))


def q_event_page(spark, folder):
    m = messages(spark, folder)
    found = search.search_events(m, groups=["message"])
    return search.page_rows(m, search.page(found, 300, 100, bits=8), 100)


def q_event_seek(spark, folder):
    """Pages near both ends of the archive and of one group, by one stored index."""
    m = messages(spark, folder)
    index = settled(search.seek_index(m, bits=8), "seek-index")
    cuts = [search.seek(m, index, n, 40, bits=8) for n in (10, 700)]
    cuts.append(search.seek(m, index, 250, 40, groups=["connection"], bits=8))
    shown = [c.select(F.lit(n).alias("page"), "row_index", "pos", "kind") for n, c in enumerate(cuts)]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


def q_event_json(spark, folder):
    m = messages(spark, folder).select(
        "pos", "ts_ms", "kind", "peer_id", "inbound", "size", "misbehaviour",
        (F.col("ts_ms") * 10_000 + F.col("k") * 200_000_000_000_000).alias("large"),
        F.encode(F.col("label"), "utf-8").alias("raw"),
    )
    return event_json(m).select("pos", "json")


def _inventories(spark, folder) -> DataFrame:
    """Messages as inventories of 0 to 6 items whose types and hashes follow from k and size."""
    m = messages(spark, folder)
    names = {"view": "inv", "click": "getdata", "purchase": "notfound"}
    kind = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("kind")]
    types = F.array(*[F.lit(t) for t in ITEM_TYPES])
    number = F.col("k") % 7
    ids = F.when(number > 0, F.sequence(F.lit(1).cast("bigint"), number)).otherwise(
        F.array().cast("array<bigint>")
    )
    item = lambda i: F.struct(
        F.element_at(types, ((F.col("size") + i) % 8 + 1).cast("int")).alias("type"),
        F.encode(F.md5(((F.col("peer_id") * 7 + i) % 50).cast("string")), "utf-8").alias("hash"),
    )
    return m.withColumn("items", F.when(kind.isNotNull(), F.transform(ids, item))).withColumn(
        "kind", F.coalesce(kind, "kind")
    )


def _bodies(spark, folder) -> DataFrame:
    body = {c: F.lit(None).cast("binary") for c in ("txid", "wtxid", "block_hash", "nonce")}
    counts = ("n_addresses", "n_headers", "n_short_ids", "n_txs", "n_indexes")
    body |= {c: F.lit(None).cast("int") for c in counts}
    return _inventories(spark, folder).withColumns(body)


def q_carried_detail(spark, folder):
    return carried_detail(_bodies(spark, folder)).select("pos", "kind", "detail")


def q_carried_keys(spark, folder):
    keyed = carried_keys(_bodies(spark, folder))
    keys = F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")
    return keyed.select("pos", "kind", keys.alias("keys"))


def q_strip_payloads(spark, folder):
    raw = F.encode(F.col("text"), "utf-8")
    english = F.col("lang") == "en"
    docs = table(spark, folder, "documents").select(
        F.lit("message").alias("event_group"),
        F.when(english, "tx").otherwise("unknown").alias("kind"),
        F.when(english, raw).alias("raw"),
        F.when(~english, raw).alias("payload"),
        F.lit(None).cast("array<struct<txid:binary,wtxid:binary,raw:binary>>").alias("txs"),
    )
    return source.strip_payloads(docs)[1]


# --- pairing ---


def q_exchange_pairs(spark, folder):
    return pairing.pair_by_timing(messages(spark, folder), adapt.ACTIVITY_RULES)


def q_exchange_pairs_contended(spark, folder):
    return pairing.pair_by_timing(messages(spark, folder), adapt.CONTENDED_RULES)


def q_request_fate(spark, folder):
    return pairing.request_fate(messages(spark, folder), adapt.ACTIVITY_RULES)


def q_request_fate_contended(spark, folder):
    return pairing.request_fate(messages(spark, folder), adapt.CONTENDED_RULES)


REPORT = [
    "rule", "request", "optional", "opened", "answered", "unanswered", "unanswered_by_peers",
    "unanswered_by_us", "undetermined", "peer_count", "our_count", "peer_mean_ms", "our_mean_ms",
    "peer_p50_ms", "peer_p90_ms", "our_p50_ms", "our_p90_ms",
]


def q_exchange_report(spark, folder):
    report = pairing.exchange_report(messages(spark, folder), adapt.ACTIVITY_RULES)
    return report.select(*REPORT, _text("replies"))


def q_replies_captured(spark, folder):
    return pairing.replies_captured(messages(spark, folder), adapt.ACTIVITY_RULES)


def q_unanswered_meaningful(spark, folder):
    """Whether silence means something, for rules with all replies and with one never seen."""
    m = messages(spark, folder)
    unseen = [Rule("view", ("whisper",), window_ms=adapt.HOUR)]
    parts = [
        pairing.unanswered_is_meaningful(
            pairing.exchange_report(m, rules), pairing.replies_captured(m, rules)
        ).withColumn("rules", F.lit(name))
        for name, rules in (("activity", adapt.ACTIVITY_RULES), ("unseen", unseen))
    ]
    return parts[0].union(parts[1])


def _keyed_messages(spark, folder) -> DataFrame:
    named = adapt.with_keys(messages(spark, folder))
    return named.withColumn("detail", F.lit(None).cast("string"))


def q_keyed_pairs(spark, folder):
    return pair_by_key(_keyed_messages(spark, folder), adapt.ACTIVITY_RULES)


def q_conversation(spark, folder):
    m = _keyed_messages(spark, folder)
    found = search.search_events(m, groups=["message"])
    rows = conversation(m, found, 0, 400, adapt.ACTIVITY_RULES)
    return rows.drop("keys")


# --- relay ---


def _race(spark, folder) -> DataFrame:
    return relay.relay_race(shipments(spark, folder), bits=adapt.SHIP_DAY_BITS)


def _tallies(spark, folder) -> DataFrame:
    return relay.relay_tallies(_race(spark, folder))


def q_relay_race(spark, folder):
    return relay.announcement_race(_race(spark, folder))


def q_wire_race(spark, folder):
    """The race of shipments as wire messages, whose items go by two hashes."""
    race = relay.race_of_events(adapt.wire_from_shipments(table(spark, folder, "lineitem")))
    outcome = ["first", "late", "lag_ms", "duplicate", "held_ms"]
    return race.select(F.decode("item", "utf-8").alias("item"), "peer_id", "ts_ms", "pos", "delivery", *outcome)


def q_relay_waste(spark, folder):
    return relay.delivery_waste(_race(spark, folder))


def q_relay_scorecard(spark, folder):
    return relay.sorted_scorecard(relay.relay_scorecard(_tallies(spark, folder)), "win")


def q_relay_totals(spark, folder):
    return relay.relay_totals(_tallies(spark, folder))


def q_relay_distributions(spark, folder):
    return _with_text(relay.relay_distributions(_tallies(spark, folder)), "buckets")


# The second hash of a part in the two-hash race.
WITNESS = 1_000_000_000


def q_relay_items(spark, folder):
    """Parts announced under one of two hashes, and the one each delivery counts under."""
    rows = shipments(spark, folder)
    under_witness = F.col("peer_id") % 3 == 0
    announced = rows.filter("not delivery").withColumn(
        "item", F.when(under_witness, F.col("item") + WITNESS).otherwise(F.col("item"))
    )
    delivered = rows.filter("delivery").select(
        F.col("item").cast("string").cast("binary").alias("txid"),
        (F.col("item") + WITNESS).cast("string").cast("binary").alias("wtxid"),
        "peer_id", "ts_ms", "pos", "item_no", "size",
    )
    announced = announced.withColumn("item", F.col("item").cast("string").cast("binary"))
    items = relay.with_item(delivered, announced)
    return items.select(
        "pos", "item_no", "peer_id", F.col("item").cast("string").cast("bigint").alias("item")
    )


# --- rasters ---


def q_peer_activity(spark, folder):
    m = messages(spark, folder)
    return raster.peer_activity(
        m, peers.peer_table(m), columns=200, max_rows=50, min_duration_ms=DAY, sort="events"
    )


def q_peer_activity_bytes(spark, folder):
    m = messages(spark, folder)
    cells = raster.peer_activity(
        m, peers.peer_table(m), columns=60, max_rows=40, weight="bytes",
        time_from=FIRST_DAY + 2 * DAY, time_to=FIRST_DAY + 12 * DAY,
    )
    return _with_text(raster.sparse_rows(cells, ["peer_id", "inbound"]), "cells")


def q_activity_summary(spark, folder):
    m = messages(spark, folder)
    table_ = peers.peer_table(m)
    cells = raster.peer_activity(m, table_, columns=200, max_rows=50, min_duration_ms=DAY)
    return raster.activity_summary(
        m, table_, cells, columns=200, max_rows=50, min_duration_ms=DAY
    )


def q_peer_raster(spark, folder):
    return raster.peer_raster(messages(spark, folder), PEER, 40, 2)


def q_peer_raster_summary(spark, folder):
    m = messages(spark, folder)
    return raster.peer_raster_summary(m, PEER, 40, raster.peer_raster(m, PEER, 40, 2))


def q_raster_marks(spark, folder):
    return raster.raster_marks(
        messages(spark, folder), 100, time_from=FIRST_DAY, time_to=FIRST_DAY + 20 * DAY
    )


def q_peer_marks(spark, folder):
    return raster.peer_marks(messages(spark, folder), PEER, 40)


def q_peer_marks_last(spark, folder):
    return raster.peer_marks(messages(spark, folder), PEER, 40, last=8)


def q_peer_activity_rows(spark, folder):
    m = messages(spark, folder)
    rows = raster.peer_activity_rows(
        m, peers.peer_table(m), columns=60, max_rows=40,
        time_from=FIRST_DAY + 2 * DAY, time_to=FIRST_DAY + 12 * DAY,
    )
    marks = F.transform("marks", lambda x: F.concat_ws(" ", x["col"].cast("string"), x["kind"]))
    return _with_text(rows.withColumn("marks", marks), "cells_in", "cells_out", "marks")


# --- networks ---


def _placed(spark, folder) -> DataFrame:
    return net.with_network(_peers(spark, folder), adapt.prefix_table(spark))


def q_peer_networks(spark, folder):
    return _placed(spark, folder).select("peer_id", "addr", "asn", "network_label")


def q_networks(spark, folder):
    return net.networks_page(net.networks(_placed(spark, folder)))


def q_networks_total(spark, folder):
    return net.networks_total(net.networks(_placed(spark, folder)))


def q_network_peers(spark, folder):
    return net.network_peers(_placed(spark, folder), 64511, limit=10).select(*PAGE_COLUMNS)


def q_as_names(spark, folder):
    names = table(spark, folder, "nation").select(
        (F.col("n_nationkey") * 11 + 64500).cast("bigint").alias("asn"),
        F.lower("n_name").alias("handle"),
        F.col("n_name").alias("description"),
        F.substring("n_name", 1, 2).alias("country"),
    )
    nets = net.networks(_placed(spark, folder)).select("asn", "network_label", "peers")
    return net.with_as_names(nets, names)


def q_address_networks(spark, folder):
    """Customers at IPv6, IPv4 and other addresses, and nested prefixes of nations."""
    hexed = lambda number: F.lower(F.hex(number))
    k = F.col("c_custkey").cast("bigint")
    low = hexed(k * 37 % 65536)
    addr = (
        F.when(k % 4 == 0, F.concat(F.lit("[2001:db8:"), hexed(k % 7), F.lit("::"), low, F.lit("]:8333")))
        .when(k % 4 == 1, F.concat(F.lit("2001:DB8:ffff::"), low))
        .when(k % 4 == 2, F.format_string("10.%d.%d.%d:8333", k % 5, F.expr("c_custkey div 256 % 256"), k % 256))
        .when(k % 8 == 3, F.format_string("name%d.onion:8333", k))
    )
    n = F.col("n_nationkey").cast("bigint")
    v6 = F.concat(F.lit("2001:db8:"), hexed(n), F.lit("::/48"))
    nations = table(spark, folder, "nation").select(
        F.explode(
            F.array(
                F.struct(F.when(n < 6, v6).alias("prefix"), (n + 65000).alias("asn")),
                F.struct(F.when(n < 4, F.format_string("10.%d.0.0/16", n)).alias("prefix"), (n + 65100).alias("asn")),
            )
        ).alias("p")
    ).select("p.*")
    outer = [("2001:db8::/32", 64999), ("2001:db8:ffff::/112", 64998), ("2001:db8:ffff::8000/113", 64997)]
    prefixes = nations.unionByName(spark.createDataFrame(outer, "prefix string, asn bigint"))
    rows = table(spark, folder, "customer").select(k.alias("peer_id"), addr.alias("addr"))
    return net.with_network(rows, prefixes)


def q_peer_labels(spark, folder):
    p = _peers(spark, folder)
    return p.select(
        "peer_id",
        conn_type_name(F.col("conn_type")).alias("conn_type"),
        network_name(F.col("peer_id") % 9).alias("network"),
        share(F.col("messages_in"), F.col("messages_in") + F.col("messages_out")).alias("in_share"),
    )


# --- taxonomy ---


ARMS = [
    "ebpf.message", "ebpf.connection", "ebpf.mempool", "ebpf.validation", "rpc", "p2p", "log",
    "ipc", "ebpf.novel", None,
]
SUBS = ["closed", "added", "block_connected", "uptime", "ping_duration", "block_tip", "novel", None]


def q_classified(spark, folder):
    """The activity table's rows under arms and sub-arms in turn, known and unknown ones."""
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int") + 1)
    n = F.col("event_id")
    rows = table(spark, folder, "events").select(
        n.alias("pos"),
        pick(ARMS, n % len(ARMS)).alias("arm"),
        pick(SUBS, F.floor(n / len(ARMS)) % len(SUBS)).alias("sub"),
        F.when(n % 30 != 0, F.col("event_type")).alias("command"),
        (n % 4 < 2).alias("inbound"),
    )
    found = classify(rows)
    return found.select("pos", "category", "event_group", "kind", "label", "inbound")


# --- sources ---


def _raw_lines(spark, folder) -> DataFrame:
    """The activity table as JSON text in hourly files, every 97th record cut short."""
    e = table(spark, folder, "events")
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyyMMdd-HHmmss")
    row = F.to_json(
        F.struct(
            F.col("event_id").alias("record_no"),
            adapt.epoch_ms(F.col("ts")).alias("ts_ms"),
            F.col("event_type").alias("command"),
        )
    )
    damaged = F.col("event_id") % 97 == 0
    return e.select(
        F.concat(F.lit("file:/archive/node.main."), hour, F.lit("-000.events.zst")).alias("file_path"),
        F.when(damaged, F.substring(row, 1, 20)).otherwise(row).alias("value"),
    )


LINE = T.StructType(
    [
        T.StructField("record_no", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("command", T.StringType()),
    ]
)


def q_quarantine(spark, folder):
    _, bad = source.quarantine(source.parse_lines(_raw_lines(spark, folder), LINE))
    name = source.file_name_of(F.col("file_path")).alias("file_name")
    return bad.select(name, F.col(source.CORRUPT).alias("text"))


def q_file_summary(spark, folder):
    lines = _raw_lines(spark, folder)
    good, bad = source.quarantine(source.parse_lines(lines, LINE))
    sizes = lines.groupBy("file_path").agg(F.sum(F.octet_length("value")).alias("size_bytes"))
    name = source.file_name_of(F.col("file_path"))
    return source.file_summary(good, bad, sizes).withColumn("file_name", name).drop("file_path")


def q_archive_order(spark, folder):
    good, _ = source.quarantine(source.parse_lines(_raw_lines(spark, folder), LINE))
    return source.with_archive_order(good).select("file_name", "file_ts", "pos", "ts_ms", "command")


def q_files_read(spark, folder):
    """A given Parquet file as an archive of its own: read, numbered, split and summed up."""
    named = T.StructType(
        [T.StructField("record_no", T.LongType()), T.StructField("ts", T.TimestampNTZType())]
        + [T.StructField(n, T.StringType()) for n in ("event_type", "props")]
    )
    path = f"{folder}/events.parquet"
    raw = source.read_raw(spark, path, "parquet", named)
    raw = raw.withColumn("ts_ms", adapt.epoch_ms(F.col("ts")))
    good, bad = source.quarantine(raw)
    files = source.list_files(spark, path)
    damaged = source.damaged_files(spark, path, "parquet", files)
    ordered = source.with_archive_order(good, files)
    span = ordered.agg(
        F.min("pos").alias("first_pos"),
        F.max_by("ts_ms", "pos").alias("last_ts_ms"),
        F.sum("record_no").alias("record_sum"),
    )
    summary = source.file_summary(good, bad, files, damaged)
    totals = summary.agg(
        F.sum("events").alias("events"),
        F.sum("decode_errors").alias("decode_errors"),
        F.count("error").alias("broken_files"),
    )
    return totals.crossJoin(span)  # one row each


def _renamed(spark, folder: str, ending: str) -> None:
    """Let the data files of a folder end their names otherwise."""
    here = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = here.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(here):
        if status.getPath().getName().startswith("part-"):
            store.rename(status.getPath(), status.getPath().suffix(ending))


EVENTS_A_FILE = 50_000  # each of the written files has readable events


def q_damaged_files(spark, folder):
    """The activity table as gzip files, and every third event in ones that are none."""
    lines = _raw_lines(spark, folder).withColumn("third", F.get_json_object("value", "$.record_no") % 3 == 0)
    home = shared_folder(spark, "damaged")
    sound, cut = f"{home}/sound", f"{home}/cut"
    # Lines are dealt to files evenly: a part of the scan may hold no row, and when it is the
    # first, Spark writes a file without records for it.
    count = max(1, table(spark, folder, "events").count() // EVENTS_A_FILE)
    kept = lines.filter(~F.coalesce("third", F.lit(False))).select("value").repartition(count)
    kept.write.option("compression", "gzip").text(sound)
    lines.filter("third").select("value").repartition(count).write.text(cut)
    _renamed(spark, cut, ".gz")
    good, bad = source.quarantine(source.read_raw(spark, [sound, cut], "json", LINE))
    files = source.list_files(spark, [sound, cut])
    damaged = source.damaged_files(spark, [sound, cut], "json", files)
    summary = source.file_summary(good, bad, files, damaged)
    return summary.groupBy("error").agg(
        F.sum("events").alias("events"), F.sum("decode_errors").alias("decode_errors")
    )


def q_input_files(spark, folder):
    e = source.with_record_no(spark, f"{folder}/events.parquet")
    return e.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows"), F.max("record_no").alias("last_record")
    )


# --- stored tallies ---


def _stored(spark, folder) -> TallyStore:
    """The activity table as files of 2,000 events, added out of order and some of them twice."""
    m = messages(spark, folder)
    file_no = F.expr("pos div 2000")
    path = F.concat(F.lit("file:/archive/node."), F.lpad(file_no.cast("string"), 12, "0"))
    rows = m.withColumns({"file_path": path, "record_no": F.col("pos"), "of_file": file_no})
    sizes = rows.groupBy("file_path", "of_file").agg(F.count(F.lit(1)).alias("size_bytes"))
    store = TallyStore(spark, shared_folder(spark, "tallies"))
    # Files 1, 4, ... are added without their last events first, as if they had grown since.
    early = F.expr("of_file % 3 = 1")
    store.add(rows.filter(early & F.expr("pos % 2000 < 900")), sizes.filter(early).withColumn("size_bytes", F.lit(0).cast("bigint")))
    store.add(rows.filter("of_file % 2 = 1"), sizes.filter("of_file % 2 = 1"))
    rest = store.pending(sizes)
    store.add(rows.join(rest.select("file_path"), "file_path", "left_semi"), rest)
    return store


def q_stored_totals(spark, folder):
    return _stored(spark, folder).totals()


def q_stored_breakdown(spark, folder):
    return _stored(spark, folder).breakdown()


def q_stored_timeline(spark, folder):
    return _stored(spark, folder).timeline()


def q_stored_peers(spark, folder):
    own = F.col("first_pos").bitwiseAND(F.lit((1 << source.POSITION_BITS) - 1))
    return _stored(spark, folder).peer_table().withColumn("first_pos", own)


def q_stored_durations(spark, folder):
    return _with_text(_stored(spark, folder).connection_durations("evicted"), "buckets")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
    return found | streams.queries()
