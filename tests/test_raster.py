import pytest

from tallywire.operators import raster
from tallywire.operators.peers import peer_table

from . import wire


def busy(spark):
    rows = [wire.message(1000 + 100 * i, 1, "inv", i % 2 == 0, 10) for i in range(40)]
    rows += [wire.message(3000 + 10 * i, 2, "tx", True, 250) for i in range(10)]
    rows.append(wire.opened(3050, 2))
    return wire.archive(spark, rows)


def cells(events, **options):
    found = raster.peer_activity(events, peer_table(events), **{"columns": 50, "max_rows": 10, **options})
    sums = {}
    for r in found.collect():
        assert r.value > 0 and 0 <= r.col < options.get("columns", 50)
        sums[r.peer_id, r.inbound] = sums.get((r.peer_id, r.inbound), 0) + r.value
    return sums


def test_activity(spark):
    events = busy(spark).cache()
    assert cells(events) == {(1, True): 20, (1, False): 20, (2, True): 10}
    assert cells(events, weight="bytes")[2, True] == 2500
    assert set(p for p, _ in cells(events, min_duration_ms=2000)) == {1}
    assert sum(cells(events, time_from=3000, time_to=3900).values()) == 10 + 10
    assert set(p for p, _ in cells(events, max_rows=1)) == {1}
    assert set(p for p, _ in cells(events, max_rows=1, sort="events")) == {1}
    assert cells(events, time_from=5000, time_to=5000) == {}
    assert cells(events, columns=1) == cells(events)
    found = raster.peer_activity(events, peer_table(events), columns=50, max_rows=10)
    about = wire.one(
        raster.activity_summary(events, peer_table(events), found, columns=50, max_rows=1)
    )
    assert (about.peers, about.shown, about.start_ms, about.end_ms) == (2, 1, 1000, 4900)
    assert about.bin_ms == 3900 / 50
    marks = raster.raster_marks(events, 50).collect()
    assert [(m.peer_id, m.col, m.complete) for m in marks] == [(2, 2050 * 50 // 3900, True)]


def test_sparse_rows(spark):
    df = spark.createDataFrame([(1, 7, 3), (1, 2, 9), (2, 0, 1)], "peer_id long, col int, value long")
    got = {r.peer_id: list(r.cells) for r in raster.sparse_rows(df, ["peer_id"]).collect()}
    assert got == {1: [2, 9, 7, 3], 2: [0, 1]}


def test_peer_raster(spark):
    rows = [wire.message(1000 + 100 * i, 1, "inv", True) for i in range(20)]
    rows += [wire.message(1000 + 50 * i, 1, "getdata", False) for i in range(10)]
    rows += [wire.message(1500 + i, 1, "tx", True) for i in range(5)]
    rows += [wire.message(1000, 2, "ping", True)] * 8
    rows += [wire.opened(1000 + i, 1) for i in range(9)]
    events = wire.archive(spark, rows)
    found = raster.peer_raster(events, 1, 10, 2)
    assert {r.kind: r.total for r in found.collect()} == {"inv": 20, "getdata": 10}
    about = wire.one(raster.peer_raster_summary(events, 1, 10, found))
    assert (about.start_ms, about.end_ms, about.commands) == (1000, 2900, 3)
    assert (about.messages_in, about.messages_out, about.bin_ms) == (25, 10, 190.0)
    marks = raster.peer_marks(events, 1, 10).collect()
    assert len(marks) == 9 and all(m.complete for m in marks)
    marks = raster.peer_marks(events, 1, 10, last=8).collect()
    assert len(marks) == 8 and not any(m.complete for m in marks)
    with pytest.raises(ValueError):
        raster.peer_raster(events, 1, 0, 2)
    with pytest.raises(ValueError):
        raster.peer_raster(events, 1, 10, 0)
    assert raster.peer_raster(events, 1, 100_000, 100_000).count() == 35
    # A single instant still has a column.
    assert [(r.col, r.value) for r in raster.peer_raster(events, 2, 10, 5).collect()] == [(0, 8)]
    assert raster.peer_raster(events, 99, 10, 5).count() == 0


def test_activity_rows(spark):
    events = busy(spark)
    found = raster.peer_activity_rows(
        events, peer_table(events), columns=50, max_rows=10, time_from=4800, time_to=5800
    ).orderBy("rank")
    one = wire.one(found)
    assert (one.rank, one.peer_id, one.addr, one.events, one.messages_in) == (1, 1, "10.0.0.1:8333", 40, 20)
    assert (list(one.cells_in), list(one.cells_out), list(one.marks)) == ([0, 1], [5, 1], [])
    # Seen in the window, but without a message or a mark in it.
    quiet = wire.archive(spark, [wire.message(10, 7, "inv", True), wire.message(90, 7, "inv", True), wire.opened(50, 8)])
    found = raster.peer_activity_rows(quiet, peer_table(quiet), columns=4, max_rows=10, time_from=20, time_to=60)
    rows = found.orderBy("rank").collect()
    assert [(r.rank, r.peer_id, r.cells_in, r.cells_out) for r in rows] == [(1, 7, [], []), (2, 8, [], [])]
    assert [[tuple(m) for m in r.marks] for r in rows] == [[], [(3, "inbound")]]
