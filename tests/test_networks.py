import ipaddress
import random

import pytest

from tallywire.operators import networks as net
from tallywire.operators.peers import peer_table

from . import wire


def at(ts, peer, addr, **more):
    return dict(wire.message(ts, peer, "inv", True, 10), addr=addr, **more)


def test_networks(spark):
    rows = [
        at(1000, 1, "192.0.2.1:8333"), at(1001, 2, "192.0.2.200:8333"), at(1002, 3, "192.0.2.7:1"),
        at(1003, 4, "[2001:db8:1::5]:8333"), at(1004, 5, "expyuzz4wqqyqhjn.onion:8333"),
        at(1005, 6, "198.51.100.4:8333"), at(1006, 7, "203.0.113.5:8333"),
        wire.misbehaving(1007, 8, "x"),
        dict(wire.opened(1008, 1), addr="192.0.2.1:8333"),
        dict(wire.ended(1009, 1, "inbound", 1, evicted=True), addr="192.0.2.1:8333"),
    ]
    prefixes = spark.createDataFrame(
        [("192.0.2.0/24", 10), ("192.0.2.128/25", 11), ("2001:db8::/32", 12), ("203.0.113.0/24", 0)],
        "prefix string, asn long",
    )
    placed = net.with_network(peer_table(wire.archive(spark, rows)), prefixes)
    where = {r.peer_id: r.asn or r.network_label for r in placed.collect()}
    assert where == {
        1: 10, 2: 11, 3: 10, 4: 12, 5: "Tor / I2P / CJDNS", 6: "unmapped IP", 7: "unmapped IP",
        8: "address not seen",
    }
    nets = net.networks(placed)
    listed = net.networks_page(nets).collect()
    assert [r.asn or r.network_label for r in listed] == [
        10, "unmapped IP", 11, 12, "Tor / I2P / CJDNS", "address not seen",
    ]
    assert (listed[0].peers, listed[0].eviction_ratio, listed[0].events) == (2, 1.0, 4)
    assert listed[1].eviction_ratio is None
    assert tuple(wire.one(net.networks_total(nets))) == (6, 8)
    assert [r.peer_id for r in net.network_peers(placed, 10).collect()] == [1, 3]
    assert [r.peer_id for r in net.network_peers(placed, label="unmapped IP").collect()] == [6, 7]
    assert [r.peer_id for r in net.network_peers(placed, label="?").collect()] == [8]
    names = spark.createDataFrame([(10, "TEN", "Ten Inc", "AT")], "asn long, handle string, description string, country string")
    named = {r.asn: r.handle for r in net.with_as_names(nets, names).collect()}
    assert named[10] == "TEN" and named[11] is None


@pytest.mark.parametrize("hot_rows", [0, 4_000_000])
def test_longest_prefix_equals_a_full_scan(spark, hot_rows):
    draw = random.Random(3)
    nets = {}
    for _ in range(150):
        if draw.random() < 0.5:
            bits, space = draw.randrange(0, 17), 32
            value = draw.randrange(8) << 28 | draw.randrange(16) << 16
        else:
            bits, space = draw.choice([0, 3, 16, 29, 32, 47, 64, 127, 128]), 128
            value = draw.randrange(4) << 126 | draw.randrange(4) << 96 | draw.randrange(3)
        value = value >> (space - bits) << (space - bits)
        make = ipaddress.IPv4Network if space == 32 else ipaddress.IPv6Network
        nets[make((value, bits))] = draw.randrange(5)
    ips = [ipaddress.IPv4Address(draw.randrange(8) << 28 | draw.randrange(16) << 16) for _ in range(60)]
    ips += [
        ipaddress.IPv6Address(draw.randrange(4) << 126 | draw.randrange(4) << 96 | draw.randrange(3))
        for _ in range(60)
    ]
    want = {}
    for n, ip in enumerate(ips):
        covering = [x for x in nets if x.version == ip.version and ip in x]
        want[n] = (nets[max(covering, key=lambda x: x.prefixlen)] or None) if covering else None
    rows = [(n, f"[{ip}]:1" if ip.version == 6 else f"{ip}:1") for n, ip in enumerate(ips)]
    peers = spark.createDataFrame(rows, "peer_id long, addr string")
    prefixes = spark.createDataFrame([(str(x), a) for x, a in nets.items()], "prefix string, asn long")
    got = net.with_network(peers, prefixes, hot_rows=hot_rows, salts=4)
    assert {r.peer_id: r.asn for r in got.collect()} == want


@pytest.mark.parametrize("hot_rows", [0, 4_000_000])
def test_edges_of_nested_prefixes(spark, hot_rows):
    """The first and last addresses of every prefix, and the ones beside them, of both families."""
    nets = {
        "10.0.0.0/8": 1, "10.64.0.0/10": 2, "10.64.0.0/16": 3, "10.64.255.0/24": 4, "10.64.255.255/32": 5,
        "10.65.0.0/16": 6, "172.16.0.0/13": 7, "2001:db8::/29": 8, "2001:db8::/32": 9,
        "2001:db8:0:ffff::/64": 10, "2001:db8:0:ffff:8000::/65": 11, "2001:dbf:ffff:ffff::/64": 12,
        "10.65.1.0/24": 0,
    }
    parsed = {ipaddress.ip_network(n): a for n, a in nets.items()}
    ips = set()
    for n in parsed:
        for value in (int(n[0]) - 1, int(n[0]), int(n[0]) + 1, int(n[-1]) - 1, int(n[-1]), int(n[-1]) + 1):
            ips.add(type(n[0])(value))
    ips = sorted(ips, key=str)
    want = {}
    for k, ip in enumerate(ips):
        covering = [n for n in parsed if n.version == ip.version and ip in n]
        want[k] = (parsed[max(covering, key=lambda n: n.prefixlen)] or None) if covering else None
    rows = [(k, f"[{ip}]:8333" if ip.version == 6 else str(ip)) for k, ip in enumerate(ips)]
    bad = [("10.0.0.0/33", 90), ("10.0.0.0/-1", 91), ("x/8", 92), (None, 93), ("10.0.0.0", 94), ("::/x", 95)]
    prefixes = spark.createDataFrame([*nets.items(), *bad], "prefix string, asn long")
    peers = spark.createDataFrame(rows, "peer_id long, addr string")
    got = net.with_network(peers, prefixes, hot_rows=hot_rows, salts=3).collect()
    assert {r.peer_id: r.asn for r in got} == want and len(got) == len(want)


def test_one_row_per_peer_and_no_job_when_called(spark):
    """Peers at one address, peers without one, columns named as the join's own; no prefixes."""
    rows = [(k, "192.0.2.1:1" if k % 3 else None, k, "c", 5) for k in range(300)]
    peers = spark.createDataFrame(rows, "peer_id long, addr string, at long, cell string, side int")
    prefixes = spark.createDataFrame([("192.0.2.0/24", 10)], "prefix string, asn long")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    got = net.with_network(peers, prefixes, hot_rows=50, salts=7)
    assert jobs() == before
    assert got.columns == [*peers.columns, "asn", "network_label"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == [(*r, 10 if r[1] else None) for r in rows]
    none = net.with_network(peers, prefixes.limit(0)).collect()
    assert {r.network_label for r in none} == {"unmapped IP", "address not seen"} and len(none) == 300
    assert net.with_network(peers.limit(0), prefixes).count() == 0
