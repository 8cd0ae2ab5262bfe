import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators import relay

from . import brute, wire


def judged(spark, rows, **options):
    return relay.race_of_events(wire.archive(spark, rows), **options)


def test_race_and_waste_of_three_items(spark):
    """Peer 21 hears item 5 first and 6 second, peer 22 the other way round; 23 is always last."""
    rows = [
        wire.inv(10_000, 21, [5]), wire.inv(10_040, 22, [5, 6]), wire.inv(10_110, 21, [6]),
        wire.inv(10_500, 23, [5, 6]), wire.inv(11_000, 23, [4]),
        wire.tx(12_000, 22, 6, 310), wire.tx(12_300, 21, 5, 170), wire.tx(12_450, 23, 6, 310),
        wire.tx(12_900, 23, 6, 310),
    ]
    tallies = relay.relay_tallies(judged(spark, rows))
    card = {r.peer_id: r for r in relay.relay_scorecard(tallies).collect()}
    assert [card[p].win_ratio for p in (21, 22, 23)] == [0.5, 0.5, 1 / 3]
    assert [card[p].first for p in (21, 22, 23)] == [1, 1, 1]
    assert (card[23].duplicate, card[23].duplicate_bytes) == (2, 620)
    assert (card[21].duplicate, card[22].duplicate) == (0, 0)
    totals = wire.one(relay.relay_totals(tallies))
    assert (totals.items, totals.announcements, totals.late_announcements) == (3, 7, 4)
    assert (totals.deliveries, totals.duplicate_deliveries, totals.duplicate_bytes) == (4, 2, 620)
    assert totals.duplicate_factor == 2.0
    dist = {r.measure: r for r in relay.relay_distributions(tallies).collect()}
    assert dist["heard_to_held"].max_ms == 12_300 - 10_000
    none = relay.relay_tallies(judged(spark, rows[:5]))
    assert wire.one(relay.relay_totals(none)).wasted_share is None


def test_rows_that_say_nothing(spark):
    blocks = [{"type": t, "hash": wire.hash32(1)} for t in ("block", "cmpctblock", None)]
    rows = [
        wire.inv(1000, 7, [1, 2, 3], inbound=False),
        wire.message(1000, 7, "inv", True, items=blocks),
        wire.message(1000, 7, "tx", True, txid=b"", wtxid=b""),
        wire.message(1000, 7, "tx", True),
    ]
    assert judged(spark, rows).count() == 0


def test_delivery_under_either_hash(spark):
    rows = [
        wire.inv(300, 31, [70]), wire.tx(365, 31, 71, 90, wtxid=70),  # known by its second hash
        wire.tx(400, 32, 80, 55, wtxid=81),  # known by neither, so it opens its first
        wire.inv(410, 33, [81]), wire.tx(480, 34, 80, 55, wtxid=81),  # and stays there
    ]
    got = {r.pos: (r.item, r.held_ms, r.duplicate) for r in judged(spark, rows).collect()}
    assert got[1] == (wire.hash32(70), 65, False)
    assert got[2] == (wire.hash32(80), None, False)
    assert got[4] == (wire.hash32(80), None, True)


def test_waste_is_a_share_of_what_arrived(spark):
    rows = [wire.tx(1000, 1, 10, 300), wire.tx(1100, 2, 11, 700), wire.tx(1200, 3, 10, 300)]
    totals = wire.one(relay.relay_totals(relay.relay_tallies(judged(spark, rows))))
    assert totals.delivered_bytes == 1300 and totals.wasted_share == 300 / 1300


def random_race(seed, hot):
    draw = random.Random(seed)
    out = []
    for pos in range(500):
        item = 1 if hot and draw.random() < 0.5 else draw.randrange(40)
        ts = 1000 + pos * 10 + (draw.randrange(-400, 400) if seed % 2 else 0)
        delivery = draw.random() < 0.3
        out.append((item, pos * 2, draw.randrange(3), ts, draw.randrange(6), delivery, 7 if delivery else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_race_equals_stepping_through(spark, seed):
    rows = random_race(seed, hot=True)
    df = spark.createDataFrame(
        rows, "item long, pos long, item_no long, ts_ms long, peer_id long, delivery boolean, size long"
    )
    options = dict(hot_rows=10, bits=6) if seed else {}
    race = relay.relay_race(df, **options)
    got = wire.rows(race, "item", "pos", "item_no", "first", "late", "lag_ms", "duplicate", "held_ms")
    assert got == sorted(brute.race(rows), key=repr)
    totals = wire.one(relay.relay_totals(relay.relay_tallies(race)))
    assert totals.items == len({r[0] for r in rows})


@pytest.mark.parametrize("hot_rows", [0, 4_000_000])
def test_two_hashes_equal_stepping_through(spark, hot_rows):
    draw = random.Random(5)
    announced, delivered = [], []
    for pos in range(400):
        t = draw.randrange(60)
        if draw.random() < 0.4:
            announced.append((pos, t if draw.random() < 0.5 else t + 1000))
        else:
            delivered.append((pos, t, t + 1000))
    name = F.lpad(F.col("h").cast("string"), 8, "0").cast("binary")
    a = spark.createDataFrame(announced, "pos long, h long").withColumn("item", name)
    d = spark.createDataFrame(delivered, "pos long, h long, w long").withColumns(
        {"txid": name, "wtxid": F.lpad(F.col("w").cast("string"), 8, "0").cast("binary")}
    )
    got = relay.with_item(d, a, hot_rows=hot_rows)
    found = {r[0]: int(r[1]) for r in got.select("pos", F.col("item").cast("string")).collect()}
    assert found == brute.delivery_items(announced, delivered)


def test_scorecard_order(spark):
    rows = [(1, 5, 5, 0.5, 10), (2, 5, 5, 0.5, None), (3, 0, 0, None, None), (4, 9, 1, 0.9, 3)]
    card = spark.createDataFrame(rows, "peer_id long, first long, late long, win_ratio double, lag_p50_ms long")
    order = lambda *a: [r.peer_id for r in relay.sorted_scorecard(card, *a).collect()]
    assert order("win", True) == [4, 1, 2, 3]
    assert order("win", False) == [3, 2, 1, 4]
    assert order("lag", True) == [1, 4, 2, 3]
    assert order("first", True, 2) == [4, 1]
