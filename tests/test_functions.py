import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywire.functions import buckets, labels, payload
from tallywire.functions.address import mask, peer_ip
from tallywire.functions.jsonview import event_json
from tallywire.functions.taxonomy import classify
from tallywire.operators.distribution import distribution, merge_distributions, with_percentiles

from . import wire


def test_taxonomy(spark):
    rows = [
        wire.message(1, 1, "inv", True),
        wire.message(1, 1, "sendtxrcncl", False),  # an open set: the command is the kind
        wire.opened(1, 1),
        dict(ts_ms=1, arm="ebpf.connection"),
        dict(ts_ms=1, arm="ebpf.mempool", sub="rejected"),
        dict(ts_ms=1, arm="ebpf.validation", sub="block_connected"),
        dict(ts_ms=1, arm="rpc", sub="uptime"),
        dict(ts_ms=1, arm="rpc", sub="something_new"),
        dict(ts_ms=1, arm="p2p", sub="ping_duration"),
        dict(ts_ms=1, arm="log", sub="saw_new_header"),
        dict(ts_ms=1, arm="ipc", sub="block_tip"),
        wire.armless(1),
        dict(ts_ms=1, arm="ebpf"),
    ]
    got = wire.rows(wire.archive(spark, rows), "pos", "category", "event_group", "kind", "label")
    assert [g[1:] for g in sorted(got)] == [
        ("ebpf", "message", "inv", "inv"),
        ("ebpf", "message", "sendtxrcncl", "sendtxrcncl"),
        ("ebpf", "connection", "inbound", "connection inbound"),
        ("ebpf", "connection", "(unknown)", "connection (unknown)"),
        ("ebpf", "mempool", "rejected", "mempool rejected"),
        ("ebpf", "validation", "block_connected", "validation block_connected"),
        ("rpc", "rpc", "uptime", "rpc uptime"),
        ("rpc", "rpc", "(unknown)", "rpc (unknown)"),
        ("p2p", "p2p", "ping_duration", "p2p ping_duration"),
        ("log", "log", "saw_new_header", "log saw_new_header"),
        ("ipc", "ipc", "block_tip", "ipc block_tip"),
        ("ebpf", "message", "(unknown)", "(unknown)"),
        ("ebpf", "message", "(unknown)", "(unknown)"),
    ]


def test_addresses(spark):
    want = {
        "1.2.3.4:8333": "01020304",
        "1.2.3.4": "01020304",
        "255.0.10.1:": "ff000a01",
        "[2001:db8::1]:8333": "20010db8" + "0" * 23 + "1",
        "2001:db8::1": "20010db8" + "0" * 23 + "1",
        "[::ffff:1.2.3.4]:8333": "0" * 20 + "ffff01020304",
        "::": "0" * 32,
        "1:2:3:4:5:6:7:8": "00010002000300040005000600070008",
        "1:2:3:4:5:6:7::": "00010002000300040005000600070000",
        ":1:2:3:4:5:6:7": None,
        "1::2::3": None,
        "1.2.3.400:1": None,
        "01.2.3.4:1": None,
        "1.2.3": None,
        "expyuzz4wqqyqhjn.onion:8333": None,
        "abcdef.b32.i2p:0": None,
        "": None,
    }
    df = spark.createDataFrame([(a,) for a in want], "a string")
    got = {r[0]: r[1] for r in df.select("a", peer_ip(F.col("a"))).collect()}
    assert got == want


def test_mask(spark):
    df = spark.createDataFrame([("ffffffff", b) for b in range(33)], "ip string, bits int")
    got = {r[0]: r[1] for r in df.select("bits", mask(F.col("ip"), F.col("bits"))).collect()}
    for bits, digits in got.items():
        full = (int(digits, 16) if digits else 0) << (32 - 4 * len(digits))
        assert full == (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF


def test_inventory_text(spark):
    def texts(*types):
        items = [{"type": t, "hash": wire.hash32(1)} for t in types]
        return wire.message(1, 1, "inv", True, items=items)

    rows = [
        texts("wtx", "block", "wtx"), texts("unknown", "malformed", None), texts(),
        texts("tx", "witness tx", "witness block", "cmpctblock"),
        wire.message(1, 1, "addrv2", True, n_addresses=10),
        wire.message(1, 1, "headers", True, n_headers=1),
        wire.message(1, 1, "cmpctblock", True, n_short_ids=3, n_txs=1),
        wire.message(1, 1, "getblocktxn", True, n_indexes=2),
        wire.message(1, 1, "blocktxn", True, n_txs=2),
        wire.message(1, 1, "ping", True),
        wire.message(1, 1, "inv", True),
        wire.opened(1, 1),
    ]
    got = payload.carried_detail(wire.archive(spark, rows)).orderBy("pos").select("detail").collect()
    assert [r[0] for r in got] == [
        "2x wtx, 1x block", "1x unknown, 2x malformed", "empty",
        "1x tx, 1x witness tx, 1x witness block, 1x cmpctblock",
        "10x address", "1x header", "3x short id, 1x prefilled", "2x index", "2x transaction",
        None, None, None,
    ]


def test_named_keys(spark):
    bad = {"type": "malformed", "hash": wire.hash32(9)}
    items = [{"type": "wtx", "hash": wire.hash32(2)}, {"type": "tx", "hash": wire.hash32(1)}, bad,
             {"type": "block", "hash": wire.hash32(2)}]
    rows = [
        wire.message(1, 1, "getdata", False, items=items),
        wire.naming(1, 1, "tx", True, 9, [3]),
        wire.message(1, 1, "tx", True, txid=b"", wtxid=b""),
        wire.naming(1, 1, "ping", True, 9, [5]),
        wire.message(1, 1, "block", True, block_hash=wire.hash32(8)),
        wire.message(1, 1, "getheaders", True, block_hash=wire.hash32(8)),
    ]
    got = payload.carried_keys(wire.archive(spark, rows)).orderBy("pos").select("keys").collect()
    assert [list(r[0]) for r in got] == [
        [wire.hash32(1), wire.hash32(2)], [wire.hash32(3), wire.hash32(0x83)], [],
        [(5).to_bytes(8, "little")], [wire.hash32(8)], [],
    ]


def test_json(spark):
    df = spark.createDataFrame(
        [(1, 2**53, b"\xab\x01", None, [(2**53 - 1, b"\x0f")], True)],
        "a int, b bigint, c binary, d string, e array<struct<x:bigint,y:binary>>, f boolean",
    )
    assert event_json(df).collect()[0].json == (
        '{"a":1,"b":"9007199254740992","c":"ab01","e":[{"x":9007199254740991,"y":"0f"}],"f":true}'
    )


def test_labels(spark):
    df = spark.createDataFrame([(0, "feeler"), (6, "odd"), (9, None)], "n int, c string")
    got = df.select(labels.network_name(F.col("n")), labels.conn_type_name(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("unroutable", "feeler"), ("internal", "unknown"), ("unknown", None)]
    zero = df.select(labels.share(F.lit(3), F.lit(0)), labels.ratio(F.lit(3), F.lit(0))).first()
    assert tuple(zero) == (0.0, None)


def estimate(samples, p):
    """A percentile read from bucket counts, in plain Python."""
    counts = {}
    for s in samples:
        b = min((s + 1).bit_length() - 1, 31)
        counts[b] = counts.get(b, 0) + 1
    target = max(math.ceil(len(samples) * p), 1)
    seen = 0
    for b in sorted(counts):
        if seen + counts[b] >= target:
            low = 2**b - 1
            width = low if b == 31 else low + 1
            guess = low + int(width * ((target - seen) / counts[b]))
            return min(max(guess, min(samples)), max(samples))
        seen += counts[b]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), min_size=1, max_size=30), min_size=60, max_size=60))
def test_distribution_equals_plain_python(spark, groups):
    rows = [(g, ms) for g, samples in enumerate(groups) for ms in samples]
    df = spark.createDataFrame(rows, "g int, ms bigint")
    dist = with_percentiles(distribution(df, ["g"], "ms"))
    for r in dist.collect():
        samples = groups[r.g]
        assert (r["count"], r.total_ms, r.min_ms, r.max_ms) == (
            len(samples), sum(samples), min(samples), max(samples),
        )
        assert sum(r.buckets) == len(samples) and len(r.buckets) == 32
        for p in (0.5, 0.9, 0.99):
            assert r[f"p{round(p * 100)}_ms"] == estimate(samples, p)
    halves = distribution(df.withColumn("h", F.col("ms") % 2), ["g", "h"], "ms")
    merged = with_percentiles(merge_distributions(halves, ["g"]))
    assert wire.rows(merged, *dist.columns) == wire.rows(dist)


def test_distribution_examples(spark):
    rows = [("a", x) for x in (5, 100, 7, 3000, 0)] + [("b", 40)] * 100
    rows += [("c", 2)] * 90 + [("c", 5000)] * 10
    df = spark.createDataFrame(rows, "g string, ms bigint")
    got = {r.g: r for r in with_percentiles(distribution(df, ["g"], "ms"), (0.5, 0.95)).collect()}
    assert (got["a"]["count"], got["a"].min_ms, got["a"].max_ms, got["a"].mean_ms) == (5, 0, 3000, 622.4)
    assert got["b"].p50_ms == got["b"].p95_ms == 40
    assert 1 <= got["c"].p50_ms <= 3 and got["c"].p95_ms >= 4095
    none = wire.one(with_percentiles(distribution(df.filter("ms < 0"), [], "ms")))
    assert (none["count"], none.mean_ms, none.p50_ms) == (0, 0.0, None)


def test_bucket_edges(spark):
    edges = [tuple(r) for r in buckets.bucket_edges(spark).orderBy("bucket").collect()]
    assert edges[0] == (0, 0, 1) and edges[31] == (31, 2**31 - 1, None)
    values = spark.createDataFrame([(v,) for e in range(40) for v in (2**e - 2, 2**e - 1, 2**e) if v >= 0], "v bigint")
    got = values.select("v", buckets.log2_bucket(F.col("v"))).collect()
    assert all(b == min((v + 1).bit_length() - 1, 31) for v, b in got)


def test_classify_keeps_direction_to_messages(spark):
    rows = [dict(wire.opened(1, 1), inbound=True), wire.message(1, 1, "inv", False)]
    got = classify(wire.archive(spark, rows)).orderBy("pos").select("inbound").collect()
    assert [r[0] for r in got] == [None, False]
