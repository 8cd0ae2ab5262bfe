from pyspark.sql import functions as F

from tallywire.operators import peers

from . import wire


def test_peer_table(spark):
    rows = [
        wire.misbehaving(900, 9, "bad"),
        wire.opened(1000, 1),
        wire.message(1500, 1, "inv", True, 100),
        wire.message(1200, 1, "ping", False, 32),  # out of time order
        dict(wire.message(1300, 1, "inv", True, 50), addr="10.9.9.9:1", conn_type="feeler"),
        wire.misbehaving(1400, 1, "worse"),
        wire.poll(1450, [(1, "x"), (77, "ghost")]),
        wire.armless(1460),
    ]
    table = {r.peer_id: r for r in peers.peer_table(wire.archive(spark, rows)).collect()}
    assert set(table) == {1, 9}
    one = table[1]
    assert (one.first_seen, one.last_seen, one.duration_ms) == (1000, 1500, 500)
    assert (one.messages_in, one.messages_out, one.bytes_in, one.bytes_out) == (2, 1, 150, 32)
    assert (one.addr, one.conn_type, one.network) == ("10.9.9.9:1", "feeler", 1)
    assert (one.events, one.lifecycle_events, one.n_inbound, one.n_misbehaving) == (5, 2, 1, 1)
    # Only ever seen misbehaving: no address.
    assert (table[9].addr, table[9].conn_type, table[9].events) == (None, None, 1)


def test_page_order_and_ties(spark):
    table = spark.createDataFrame([(3, 5), (1, 5), (2, 9)], "peer_id long, events long")
    ids = lambda *a: [r.peer_id for r in peers.peers_page(table, *a).collect()]
    assert ids("events", True) == [2, 1, 3]
    assert ids("events", False) == [1, 3, 2]
    assert ids("events", True, 1, 1) == [1]
    assert ids("nonsense", False) == [1, 2, 3]


def test_recent_lifecycle_keeps_the_last_eight(spark):
    rows = [wire.opened(1000 + i, 1) for i in range(20)] + [wire.opened(5000, 2)]
    events = wire.archive(spark, rows)
    kept = [r for r in peers.recent_lifecycle(events).collect() if r.peer_id == 1]
    assert sorted(r.ts_ms for r in kept) == list(range(1012, 1020))
    counts = {r.peer_id: r.n_inbound for r in peers.lifecycle_counts(events).collect()}
    assert counts == {1: 20, 2: 1}


def test_lifetime_and_detail(spark):
    rows = [
        wire.opened(1_700_000_000_000, 4),
        wire.message(1_700_000_001_000, 4, "ping", True, 10),
        wire.message(1_700_000_001_000, 4, "inv", True, 10),
        wire.message(1_700_000_001_500, 4, "inv", False, 20),
        wire.ended(1_700_000_004_500, 4, "inbound", 1_700_000_000),
        wire.misbehaving(1_700_000_005_000, 4, "spam"),
        wire.message(1_700_000_001_000, 5, "inv", True, 10),
    ]
    row = wire.one(peers.peer_detail(wire.archive(spark, rows), 4))
    assert [(c.command, c.inbound, c.outbound, c.total) for c in row.commands] == [
        ("inv", 1, 1, 2), ("ping", 1, 0, 1),
    ]
    assert [(e.kind, e.established_at, e.lifetime_ms, e.existing_connections, e.message) for e in row.lifecycle] == [
        ("inbound", None, None, 4, None),
        ("closed", 1_700_000_000_000, 4500, None, None),
        ("misbehaving", None, None, None, "spam"),
    ]
    assert peers.peer_detail(wire.archive(spark, rows), 99).count() == 0


def durations(spark, rows, ending="all"):
    found = peers.connection_durations(wire.archive(spark, rows), ending)
    return {r.conn_type: r for r in found.collect()}


def test_connection_durations(spark):
    t = 1_700_000_000
    rows = [
        wire.ended((t + s) * 1000, s, "inbound", t, evicted=True) for s in (1, 2, 4)
    ] + [
        wire.ended((t + 3600) * 1000, 5, "inbound", t),
        wire.ended((t + 7200) * 1000, 6, "outbound-full-relay", t),
    ]
    both = durations(spark, rows)
    assert set(both) == {"inbound", "outbound-full-relay"}
    inbound = both["inbound"]
    assert (inbound["count"], inbound.min_ms, inbound.max_ms) == (4, 1000, 3_600_000)
    assert (inbound.closed, inbound.evicted) == (1, 3)
    evicted = durations(spark, rows, "evicted")
    assert set(evicted) == {"inbound"}
    assert (evicted["inbound"]["count"], evicted["inbound"].max_ms) == (3, 4000)
    # The counts of both endings come along whichever is shown.
    assert (evicted["inbound"].closed, evicted["inbound"].evicted) == (1, 3)
    assert durations(spark, rows, "closed")["inbound"]["count"] == 1


def test_establishment_in_the_future_counts_as_zero(spark):
    found = durations(spark, [wire.ended(1000, 1, "feeler", 99)])
    assert (found["feeler"]["count"], found["feeler"].max_ms, found["feeler"].mean_ms) == (1, 0, 0.0)


def agents(spark, rows):
    return {
        r.peer_id: (r.user_agent, r.agent_source)
        for r in peers.peer_agents(wire.archive(spark, rows)).collect()
    }


def test_agents(spark):
    rows = [
        wire.poll(500, [(3, "/early/")]),  # before the peer was seen
        wire.version(1000, 1, "/a/"),
        wire.version(1001, 1, "/b/"),  # a second version changes nothing
        wire.version(1002, 2, "/us/", inbound=False),
        wire.message(1003, 3, "ping", True),
        wire.message(1003, 4, "ping", True),
        wire.message(1003, 5, "ping", True),
        wire.poll(1004, [(1, "/x/"), (3, "/polled/"), (4, ""), (5, "/old/"), (88, "/ghost/")]),
        wire.poll(1005, [(3, "/later/")]),
        wire.version(1006, 5, "/first-hand/"),
        wire.version(1007, 4, ""),
    ]
    assert agents(spark, rows) == {
        1: ("/a/", "version"),
        3: ("/polled/", "getpeerinfo"),
        5: ("/first-hand/", "version"),
    }


def test_census(spark):
    rows = [(1, "/b/"), (2, "/a/"), (3, "/b/"), (4, None), (5, "/c/")]
    table = spark.createDataFrame(rows, "peer_id long, user_agent string")
    got = [tuple(r) for r in peers.agent_census(table).collect()]
    assert got == [("/b/", 2, 40.0), ("/a/", 1, 20.0), ("/c/", 1, 20.0)]
    assert len(peers.agent_census(table, 1).collect()) == 1
    assert tuple(wire.one(peers.agent_totals(table))) == (3, 4, 1, 5)
    nobody = table.filter(F.lit(False))
    assert tuple(wire.one(peers.agent_totals(nobody))) == (0, 0, 0, 0)
